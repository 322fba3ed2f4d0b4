"""Token ids of whole texts, and packed token rows (token-id / binary output).

Tokenizer files are read where the code runs; their path is a parameter.
"""

from __future__ import annotations

import array
import base64
import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphora.llm._common import text_steps

#: Bytes of words and ids, with their objects, that a worker remembers.
REMEMBERED = 200 << 20
#: New words that are encoded at once.
LEARN = 20_000


#: Marks that never change the ids of the letters before them.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _letters(word: bytes) -> bool:
    """Whether a word is nothing but letters when the normalizer has composed and lower-cased it."""
    return unicodedata.normalize("NFC", word.decode()).lower().isalpha()


class WordTokenizer:
    """Ids of texts by a `tokenizers` BPE file with word ends whose pieces never span white space.

    Its pre-tokenizer drops white space and its normalizer looks at no more than one word, so a text's ids are
    those of its words in turn. Each distinct word of a batch is looked up once and remembered from batch to
    batch. A word of letters with marks behind is two pieces: the letters, in lower case as the normalizer has
    them, and the marks. New letter runs are encoded together in one text, in which an id with a word end closes
    each; all other words are encoded as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        self.inner = Tokenizer.from_file(path)
        self.known, self.held, self.older = {}, 0, {}
        self.closes = np.zeros(self.inner.get_vocab_size(), bool)
        self.closes[[i for w, i in self.inner.get_vocab().items() if w.endswith("</w>")]] = True

    def _learn(self, words: list[bytes]) -> None:
        known, parts, whole, runs = self.known, [], set(), set()
        for w in words:
            core = w.rstrip(MARKS)
            if core.isalpha() or _letters(core):
                low, rest = core.lower(), w[len(core) :]
                parts.append((w, low, rest))
                runs.add(low)
                if rest:
                    whole.add(rest)
            else:
                whole.add(w)
        runs, whole = list(runs - known.keys()), list(whole - known.keys())
        for at in range(0, len(runs), LEARN):  # in turns: the encoder's own results are large
            turn = runs[at : at + LEARN]
            ids = np.array(self.inner.encode_batch_fast([b" ".join(turn).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(turn):
                raise ValueError("this tokenizer doesn't close each run of letters with a word end")
            data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            known.update((w, data[s:e]) for w, s, e in zip(turn, cuts, cuts[1:], strict=False))
        for at in range(0, len(whole), LEARN):
            turn = whole[at : at + LEARN]
            found = self.inner.encode_batch_fast([w.decode() for w in turn], add_special_tokens=False)
            known.update((w, array.array("I", e.ids).tobytes()) for w, e in zip(turn, found, strict=True))
        known.update((w, known[low] + known[rest] if rest else known[low]) for w, low, rest in parts)
        self.held += 200 * (len(parts) + len(runs) + len(whole)) + 3 * sum(map(len, whole)) + 3 * sum(map(len, runs))

    def forget(self) -> None:
        """Gives back the memory of words; a worker lives on after its task."""
        self.known, self.held, self.older = {}, 0, {}
        pa.default_memory_pool().release_unused()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit numbers."""
        if self.held > REMEMBERED // 2:
            self.older, self.known, self.held = self.known, {}, 0
        found = list(map(self.known.get, words))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        old = {words[k]: ids for k in gaps if (ids := self.older.get(words[k])) is not None}
        self.known |= old
        self.held += 200 * len(old)
        self._learn([words[k] for k in gaps if words[k] not in old])
        for k in gaps:
            found[k] = self.known[words[k]]
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (string, none null) end to end, and where each text's begin, with the end added."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = self.words(coded.dictionary.cast(pa.large_binary()).to_pylist())
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        firsts, index = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        n = sizes[index]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(words), "<u4")[np.repeat(firsts[index] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return ids, np.concatenate([[0], ends])[at]


class RankTokenizer:
    """Ids of texts by a `tiktoken` rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.inner.encode_ordinary(t), "<u4") for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])


@functools.lru_cache(4)
def tokenizer(path: str, pattern: str | None = None):
    return RankTokenizer(path, pattern) if pattern else WordTokenizer(path)


class Room:
    """Bins by the room left in them: a segment tree over room sizes finds the tightest bin that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room of `size` at least -> (bin, room)."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            while i & 1 or not count[i + 1]:  # up until there is something to the right
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room, k = i - self.leaves, i
        while k:
            count[k] -= 1
            k >>= 1
        return self.bins[room].pop(), room


def best_fit_decreasing(sizes: list[int], capacity: int, roomy: Room | None = None, made: int = 0) -> tuple[list[int], Room, int]:
    """Bin of each item: largest items first, each into the tightest open bin -> (bins, open bins, bins so far)."""
    roomy, where = roomy or Room(capacity), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = roomy.tightest(sizes[k])
        if found is None:
            found = made, capacity
            made += 1
        where[k] = found[0]
        if left := found[1] - sizes[k]:
            roomy.add(left, found[0])
    return where, roomy, made


#: Ids that a task packs together, and rows that stay open for the next such lot at most, the roomiest.
LOT, OPEN = 2_000_000, 4096
PACKED = "row_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


def packed_rows(docs: DataFrame, path: str, pattern: str | None, end_id: int, capacity: int = 2048, lot: int = LOT) -> DataFrame:
    """docs (doc_id, text) -> rows of at most `capacity` token ids, by best-fit-decreasing per task; no shuffle.

    A document's ids are those of its text (null: none) with end_id after them; only a longer one is cut, into
    full pieces and a rest, and starts says where in its document each piece begins, so nothing is lost.
    cu_seqlens: cumulative segment lengths, from 0; ids and position_ids: little-endian unsigned 16-bit
    (32-bit if an id needs it), positions starting again from 0 in each segment. doc_ids may hold nulls.
    A task reads lots of about `lot` ids; the OPEN roomiest rows of a lot take part in the next, so memory holds
    one lot and those, and one text with its ids, whatever its length (an unbroken word of megabytes is one unit of the tokenizer). Empty input gives no rows;
    repeated rows are packed as often as they are given.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokenizer(path, pattern), TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        rows: dict[int, list] = {}
        items, held, roomy, made = [], 0, Room(capacity), 0

        def pack(last: bool):
            nonlocal made, items, held, rows, roomy
            where, roomy, made = best_fit_decreasing([len(x[2]) for x in items], capacity, roomy, made)
            for k, x in zip(where, items, strict=True):
                rows.setdefault(k, []).append(x)
            items, held = [], 0
            fresh, open_ = Room(capacity), set()
            for room in range(capacity, 0, -1) if not last else ():
                for b in roomy.bins[room][: OPEN - len(open_)]:
                    fresh.add(room, b)
                    open_.add(b)
            roomy = fresh
            done = sorted(rows.keys() - open_)
            for at in range(0, len(done), 512):
                yield _rows([(base + k, rows.pop(k)) for k in done[at : at + 512]])

        for batch in batches:
            for part in text_steps(batch, "text"):
                given_ids, at = encode(part.column("text"))
                for doc, b, e in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = np.append(given_ids[b:e], np.uint32(end_id))
                    for s in range(0, len(ids), capacity):
                        items.append((doc, s, ids[s : s + capacity]))
                    held += len(ids)
                    if held >= lot:
                        yield from pack(False)
        yield from pack(True)

    return given.mapInArrow(kernel, PACKED)


def _rows(rows: list[tuple[int, list]]) -> pa.RecordBatch:
    out: list[list] = [[], [], [], [], [], [], []]
    for k, x in rows:
        lengths = np.array([len(i) for _, _, i in x])
        ids = np.concatenate([i for _, _, i in x])
        ends = np.cumsum(lengths)
        places = np.arange(len(ids)) - np.repeat(ends - lengths, lengths)
        kind = "<u2" if int(ids.max()) < 1 << 16 else "<u4"
        for to, v in zip(out, (k, len(ids), [d for d, _, _ in x], [s for _, s, _ in x], [0, *ends.tolist()], ids.astype(kind).tobytes(), places.astype(kind).tobytes()), strict=True):
            to.append(v)
    types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], re.findall(r"(\w+) \w+", PACKED))
