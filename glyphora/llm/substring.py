"""Removal of word windows that occur more than once, by level-wise doubling.

Windows are tested at a short length first; those repeated at one length alone are extended to twice that
length, until the length asked for is reached or no candidate survives. A window of the full length is known at
a shorter length by its least sub-window (by hash): equal windows have equal least sub-windows, so no
repeat is lost, and neighbouring windows mostly share theirs, so that few keys travel.

Documents are dealt into buckets of bounded size once; that exchange serves each level, and its files are what a level starts from again. A bucket sends each
of its keys once, with how often it has it (1, or 2 for more), and gets back those that are repeated somewhere. So
the rows of a key, however common, are at most one per bucket, and there are at most BUCKETS of these: 30 MB in the task that
adds them up. No text leaves its bucket. Short windows only find candidates, by one hash of 64 bits; whether a full
window is repeated is told by two such hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from glyphora.llm._common import window_hashes, words_of

#: Words of a window that is removed if repeated, and of the first level.
WINDOW, START = 35, 9
#: Bytes of text in a bucket, about (one longer text is a bucket's own problem: it stays whole).
BUCKET = 8 << 20
#: Buckets at most: beyond 8 TB of text they get larger.
BUCKETS = 1 << 20
#: Tasks of an exchange at most; one for each bucket up to that.
TASKS = 50_000
KEY = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("more", pa.int64()), ("n", pa.int32())])
KEY_DDL = "bucket int, key long, more long, n int"


def lengths(window: int = WINDOW, start: int = START) -> list[int]:
    """Lengths of the levels: start, its doubles, window."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Texts:
    """Words of some texts, end to end, and their hashes."""

    def __init__(self, texts: pa.ChunkedArray, window: int):
        one = pa.chunked_array(texts, pa.string()).cast(pa.large_string()).combine_chunks()
        self.flat, self.sizes = words_of(one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one)
        self.ends = np.cumsum(self.sizes)
        coded = self.flat.dictionary_encode()
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in known), np.uint64, len(known))
        self.all = hashes[coded.indices.to_numpy()]
        self.words = known, coded.indices.to_numpy()
        self.window = window
        room = np.repeat(self.ends, self.sizes) - np.arange(len(self.all))
        self.starts = room[: max(0, len(self.all) - window + 1)] >= window  # where a whole window starts

    def least(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the least hash of its sub-windows -> (that, hashes of all sub-windows)."""
        given = window_hashes(self.all, length)
        low, have, need = given, 1, self.window - length + 1
        while have < need:
            step = min(have, need - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        return low, given

    def second(self) -> np.ndarray:
        """Another hash of each full window."""
        known, at = self.words
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 12) for w in known), np.uint64, len(known))
        return window_hashes(hashes[at], self.window, 1)

    def keys(self, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the windows that are alive, their second hashes (of full windows, else 0), and 1, or 2 if there is more than one place."""
        if not alive.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        if length == self.window:
            a, b = window_hashes(self.all, length)[alive], self.second()[alive]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            n = np.diff(np.append(first, len(a)))
            return a[first].view(np.int64), b[first].view(np.int64), np.minimum(n, 2).astype(np.int32)
        low, given = self.least(length)
        top = np.where(alive, low, 0)
        have, need = 1, self.window - length + 1
        top = np.concatenate([np.zeros(need - 1, np.uint64), top, np.zeros(need - 1, np.uint64)])
        while have < need:  # the greatest key of all windows that hold a sub-window
            step = min(have, need - have)
            top = np.maximum(top[:-step], top[step:])
            have += step
        key, n = np.unique(given[(top == given) & (given != 0)], return_counts=True)
        return key.view(np.int64), np.zeros(len(key), np.int64), np.minimum(n, 2).astype(np.int32)


def _repeated(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    keys = np.sort(keys.view(np.uint64))
    at = np.searchsorted(keys, values)
    return keys[np.minimum(at, len(keys) - 1)] == values


def _both_repeated(a: np.ndarray, b: np.ndarray, keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Whether the pair (a, b) is among those of (keys, more)."""
    out = np.zeros(len(a), bool)
    keys, more = keys.view(np.uint64), more.view(np.uint64)
    order = np.lexsort((more, keys))
    keys, more = keys[order], more[order]
    at, look = np.searchsorted(keys, a), np.arange(len(a))
    while len(look):  # once, but where pairs agree in the first hash alone
        look = look[at[look] < len(keys)]
        look = look[keys[at[look]] == a[look]]
        out[look] |= more[at[look]] == b[look]
        look = look[~out[look]]
        at[look] += 1
    return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)


def _keys(bucket: int, texts: Texts, length: int, alive: np.ndarray) -> pa.Table:
    key, more, n = texts.keys(length, alive)
    return pa.table([pa.array(np.full(len(key), bucket, np.int32)), pa.array(key), pa.array(more), pa.array(n)], schema=KEY)


def _first(window: int, length: int):
    def kernel(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        texts = Texts(t.column("text"), window)
        return _keys(key[0].as_py(), texts, length, texts.starts)

    return kernel


def _further(window: int, below: int, length: int):
    def kernel(key: tuple[pa.Scalar, ...], t: pa.Table, repeated: pa.Table) -> pa.Table:
        if not t.num_rows or not repeated.num_rows:
            return KEY.empty_table()
        texts = Texts(t.column("text"), window)
        alive = texts.starts & _repeated(texts.least(below)[0], _numbers(repeated.column("key")))
        return _keys(key[0].as_py(), texts, length, alive)

    return kernel


def dedup(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, start: int = START, bucket: int = BUCKET, whole: bool = False) -> DataFrame:
    """The columns `keep` of every row of docs (default doc_id), and n_words long, n_removed long, kept_sha256
    string, kept_text string.

    Words are runs of anything but ASCII white space. A word is removed if a window of `window` words of its
    document that covers it starts in another place too, in this or another row; windows are those of the input.
    kept_text: the kept words joined by one space; if nothing is removed, the text as given (whole) or null. kept_sha256: of the kept words
    joined so. Null texts are empty; shorter texts keep all; repeated rows remove each other whole.
    """
    keep = keep or ["doc_id"]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, min(BUCKETS, -(-total // bucket)), min(cores, -(-8 * total // bucket)))  # on few data, smaller ones for all cores
    tasks = min(buckets, TASKS)  # grow with the data, so that what one reads doesn't
    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), text.alias("text"), F.struct(*keep).alias("own"))
    dealt = given.repartition(tasks, "bucket").groupBy("bucket")
    back = lambda found: found.repartition(tasks, "bucket").groupBy("bucket")
    levels = lengths(window, start)
    found = None
    for below, length in zip([None, *levels], levels, strict=False):
        if found is None:
            keys = dealt.applyInArrow(_first(window, length), KEY_DDL)
        else:
            keys = dealt.cogroup(back(found)).applyInArrow(_further(window, below, length), KEY_DDL)
        times = F.sum("n").over(Window.partitionBy("key", "more"))
        found = keys.repartition(tasks, "key", "more").withColumn("times", times).where("times > 1").select("bucket", "key", "more")

    def cut(t: pa.Table, repeated: pa.Table) -> pa.Table:
        texts = Texts(t.column("text"), window)
        hit = texts.starts.copy()
        if len(hit):
            hit &= _both_repeated(window_hashes(texts.all, window), texts.second(), _numbers(repeated.column("key")), _numbers(repeated.column("more")))
        edge = np.zeros(len(texts.all) + 1, np.int64)
        edge[:-window][hit] += 1
        edge[window:][hit] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[texts.ends] - before[texts.ends - texts.sizes]
        stays = pa.array(~gone)
        places = np.concatenate([[0], np.cumsum(texts.sizes - removed)])
        lists = pa.LargeListArray.from_arrays(pa.array(places), texts.flat.filter(stays))
        lines = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
        digests = [hashlib.sha256(x).hexdigest() for x in lines.cast(pa.large_binary()).to_pylist()]
        given = t.column("text").combine_chunks() if whole else pa.scalar(None, pa.string())
        kept = pc.if_else(pa.array(removed > 0), lines.cast(pa.string()), given)
        kept = kept.combine_chunks() if isinstance(kept, pa.ChunkedArray) else kept
        own = t.column("own").combine_chunks()
        own = own if isinstance(own, pa.StructArray) else own.chunk(0)
        cols = [own.field(k) for k in range(own.type.num_fields)]
        more = [pa.array(texts.sizes), pa.array(removed.astype(np.int64)), pa.array(digests, pa.string()), kept]
        return pa.table([*cols, *more], names=[*keep, "n_words", "n_removed", "kept_sha256", "kept_text"])

    def cut_or_none(key: tuple[pa.Scalar, ...], t: pa.Table, repeated: pa.Table) -> pa.Table:
        return cut(t, repeated) if t.num_rows else cut_schema.empty_table()

    schema = docs.select(*keep).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    cut_schema = to_arrow_schema(schema)
    return dealt.cogroup(back(found)).applyInArrow(cut_or_none, schema)


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, columns as given, with repeated windows cut from text (and n_chars, if there, set to what is left).

    Every row stays; texts without repeats, and null ones, are unchanged.
    """
    rest = [docs[c] for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*rest, docs["text"].isNull().alias("text")).alias("row"))
    cut = dedup(packed, ["row"], window, whole=True)
    text = F.when(F.col("row")["text"], F.lit(None).cast("string")).otherwise(F.col("kept_text"))
    n = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cut.select(*[(text if c == "text" else n if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])
