"""Quality classifier: naive Bayes support vectors.

Features are hashed n-gram indicators of a whole text: byte 3- and 4-grams, and word bigrams reduced to whether a
word is repeated at once, in steps of its share. The class log-count ratios count every labelled training
row; a linear hinge-loss model over indicators scaled by these ratios is fitted by dual coordinate descent on
at most `fit_rows` training rows, as many of each class if there are, and Platt's sigmoid turns its margin into a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphora.llm._common import text_steps, texts_of

#: Hashed feature space; the last few are the repeat shares.
SIZE = 1 << 18
SHARES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4])
#: Labelled rows that the linear model is fitted on at most (the ratios count all), and passes over them.
FIT_ROWS, PASSES = 6_000, 10
#: Cost of a margin violation, and weight of the fitted model against its mean size.
COST, BETA = 1.0, 0.5
#: Score from which a document is of good quality.
GOOD = 0.7


def features(text: bytes) -> np.ndarray:
    """Distinct feature numbers of a text, sorted; none for an empty one."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if not len(b):
        return np.zeros(0, np.int32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    four = (three[:-1] ^ (b[3:] * np.uint32(0x01000193))) * np.uint32(0x9E3779B1)
    grams = np.concatenate([(three * np.uint32(0x85EBCA6B)) >> np.uint32(14), four >> np.uint32(14)]) % np.uint32(SIZE - 16)
    seen = np.zeros(SIZE, bool)
    seen[grams] = True
    words = text.lower().split()
    same = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words) - 1)
    seen[SIZE - 16 + int(np.searchsorted(SHARES, same, side="left"))] = True
    seen[SIZE - 1] = True
    return np.flatnonzero(seen).astype(np.int32)


def train_flag(doc_id):
    """Column: the row's crc32(doc_id as text) mod 4 is not 2. Null ids are never training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray  # per feature, ratio included
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        """Probability-like score of one text's features."""
        size = float(np.sqrt(np.sum(self.ratios[found] ** 2))) or 1.0
        margin = float(np.sum(self.weights[found], dtype=np.float64)) / size + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (doc_id, text, h, quality), h being a hash of doc_id and text; repeated rows count as often as they are given.

    Documents whose labels disagree or are null take no part.
    """
    own = labels.where("quality in (0, 1)").where(train_flag(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    own = own.where("quality = other").select("doc_id", F.col("quality").cast("int").alias("quality"))
    # The labels' side is hashed, never broadcast: it grows with the corpus. Only training texts are shuffled.
    text = F.coalesce("text", F.lit(""))
    texts = docs.where(train_flag(F.col("doc_id"))).select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
    return texts.join(own.hint("shuffle_hash"), "doc_id")


def class_counts(rows: DataFrame) -> np.ndarray:
    """Of each class (0, 1), in how many rows each feature is: summed per task, then over tasks; 2 x SIZE numbers."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, SIZE), np.int64)
        for batch in batches:
            for part in text_steps(batch, "text"):
                for t, q in zip(texts_of(part), part.column(1).to_pylist(), strict=True):
                    count[q][features(t)] += 1
        at = np.flatnonzero(count.any(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[0][at]), pa.array(count[1][at])], ["f", "bad", "good"])

    sums = rows.select("text", "quality").mapInArrow(kernel, "f int, bad long, good long").groupBy("f").agg(F.sum("bad"), F.sum("good"))
    out = np.zeros((2, SIZE), np.int64)
    got = sums.toArrow()  # SIZE rows at most
    out[:, got.column(0).to_numpy()] = np.stack([got.column(1).to_numpy(), got.column(2).to_numpy()])
    return out


def packed(found: np.ndarray) -> bytes:
    """A text's features as numbers or, if that is shorter, a bit each: SIZE / 8 bytes at most, however long the text."""
    if 32 * len(found) < SIZE:
        return found.tobytes()
    seen = np.zeros(SIZE, bool)
    seen[found] = True
    return np.packbits(seen).tobytes()


def unpacked(found: bytes) -> np.ndarray:
    if 8 * len(found) < SIZE:
        return np.frombuffer(found, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8)))


def sample(rows: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """Packed features, and classes, of `most` rows or all: of each class those with the least h, half of them or more if the other has fewer."""
    least = [np.sort(rows.where(F.col("quality") == c).select("h").orderBy("h").limit(most).toArrow().column(0).to_numpy()) for c in (0, 1)]  # no text is sorted
    takes = [min(len(own), max(most // 2, most - len(other))) for own, other in (least, least[::-1])]
    wanted = [(h, c) for c in (0, 1) for h in least[c][: takes[c]].tolist()]  # one that is there twice is a repeated row
    some = rows.where(F.col("h").isin(sorted({h for h, _ in wanted}))).select("text", "quality", "h")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in text_steps(batch, "text"):
                keys = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
                fresh = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
                new = part.take(pa.array(fresh, pa.int64()))
                found = [packed(features(t)) for t in texts_of(new)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *new.columns[1:]], ["found", "quality", "h"])

    once = some.mapInArrow(kernel, "found binary, quality int, h long").groupBy("quality", "h").agg(F.min("found").alias("found")).toArrow()
    held = {(h, c): x for c, h, x in zip(*(once.column(k).to_pylist() for k in range(3)), strict=True)}
    wanted.sort()
    return [held[key] for key in wanted], np.array([c for _, c in wanted], np.int64)


def descend(row: Callable[[int], tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int, size: int = SIZE) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for the hinge loss, bias as a feature of 1: weights, bias and the rows' multipliers, each from 0 to COST.

    row(i): numbers and values of the features of row i. Rows come in another order in each pass, always the same ones.
    """
    w, bias, alpha, order = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(y)):
            found, v = row(i)
            gradient = y[i] * (float(w[found] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1.0), 0.0), COST)
            if step := (new - alpha[i]) * y[i]:
                w[found] += step * v
                bias += step
                alpha[i] = new
    return w, bias, alpha


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, passes: int = PASSES) -> Model:
    """Log-count ratios over all training rows, hinge loss by dual coordinate descent over at most fit_rows.

    With no training row of one class, every score is 1 if class 1 is there, 0.5 if none is, else 0. A text of any length is read whole and counts as one row, of SIZE
    features at most.
    """
    rows = labelled(docs, labels)
    count = class_counts(rows).astype(np.float64)
    if not count[0, -1] or not count[1, -1]:
        offset = 60.0 * (count[1, -1] > 0) - 60.0 * (count[0, -1] > 0)
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, offset)
    smooth = count + 1.0
    ratios = np.log((smooth[1] / smooth[1, :].sum()) / (smooth[0] / smooth[0, :].sum())).astype(np.float32)
    found_of, classes = sample(rows, fit_rows)
    y, n = 2 * classes.astype(np.int64) - 1, len(classes)

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        found = unpacked(found_of[i])
        v = ratios[found]
        return found, v / np.float32(np.sqrt(np.sum(v.astype(np.float64) ** 2)) or 1.0)

    w, bias, _ = descend(row, y, passes)
    w = BETA * w + (1 - BETA) * np.abs(w).mean()  # between the fitted weights and plain naive Bayes
    margins = np.array([float(w[found] @ v) + bias for found, v in map(row, range(n))])
    slope, offset = platt(margins, y)
    return Model((w * ratios).astype(np.float32), ratios, bias, slope, offset)


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that fits classes y (-1, 1) to margins, by Newton's method on smoothed classes.

    Both classes weigh alike, so that the score doesn't lean to the commoner one.
    """
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 0.5 / max(1, n1), 0.5 / max(1, n0)) * len(y)
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 1e-6 * theta)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row of docs (default doc_id), and score double: of the whole text alone (null: empty)."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the data

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in text_steps(batch, "_text"):
                scores = [m.score(features(t)) for t in texts_of(part, "_text")]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], [*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(kernel, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, good: float = GOOD) -> DataFrame:
    """The columns `keep` of every row of docs (default doc_id), score double, predicted int (1 if score >= good)."""
    scored = score(docs, fit(docs, labels), keep)
    return scored.withColumn("predicted", (F.col("score") >= good).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, good: float = GOOD) -> DataFrame:
    """docs without the rows whose score is below good; columns as given."""
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return classify(packed, labels, ["row"], good).where("predicted = 1").select("row.*")
