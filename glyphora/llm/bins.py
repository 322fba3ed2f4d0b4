"""Best-fit packing of documents into sequences by hierarchical residual packing.

Partitions pack their pieces best-fit-decreasing. After that no two sequences of a partition fit together, so at most one is half full
or less. That one and the `UP` roomiest others go up a tree of partitions, each as one item, to be packed with those of other partitions; all others are given
out. So a node of the tree packs FAN * (UP + 1) items at most, however many partitions there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphora.llm._common import keyed, text_steps, written
from glyphora.llm.tokens import best_fit_decreasing, tokenizer

CAPACITY = 4096
#: Pieces that one partition of the lowest level packs, about, and partitions that a node of the tree merges.
LEAF, FAN = 100_000, 8
#: Sequences that a node sends up beside its emptiest, and partitions of the lowest level at most (a bin's number has 20 bits for its node).
UP, NODES = 64, 1 << 20
#: Bytes of text that are encoded at once.
STEP = 8 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: PIECE and spread, an even deal of the pieces.

    A document's ids are its text's (null: none) and end_id; only one longer than capacity is cut, into full pieces
    and a rest. ids_crc32: of the piece's ids as little-endian unsigned 32-bit numbers.
    """
    given = keyed(docs).select("doc_id", "text", "th")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_steps(batch, "text", STEP):
                cols: list[list] = [[], [], [], [], [], []]
                ids, at = encode(part.column("text"))
                data = ids.tobytes()
                for doc, th, b, e in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    raw = data[4 * b : 4 * e] + end
                    for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                        x = raw[s : s + 4 * capacity]
                        for to, v in zip(cols, (doc, k, s // 4, len(x) // 4, zlib.crc32(x), th), strict=True):
                            to.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "spread"])
        encode.forget()

    return given.mapInArrow(kernel, PIECE + ", spread long")


MEMBER = f"struct<{PIECE.replace(' ', ':').replace(',:', ',')},offset:long>"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = f"node int, bin long, size int, open boolean, members array<{MEMBER}>"


def _pack(up: int, capacity: int, level: int):
    """Kernel: rows (node, size, members), those of a node together, largest first -> BIN. Open: sent up to be packed further."""

    def node_bins(node: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        sizes, members = table.column(1).to_numpy(), table.column(2).combine_chunks()
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        where, _, made = best_fit_decreasing(sizes.tolist(), capacity)
        where = np.array(where)
        order = np.argsort(where, kind="stable")
        first = np.searchsorted(where[order], np.arange(made))
        before = np.cumsum(sizes[order]) - sizes[order]
        base = before - np.repeat(before[first], np.diff(np.append(first, len(order))))  # where each item begins in its bin
        inside = members.take(pa.array(order))
        counts = pc.list_value_length(inside).to_numpy()
        flat = inside.flatten()
        cols = [flat.field(f.name) for f in _MEMBER][:-1] + [pa.array(flat.field("offset").to_numpy() + np.repeat(base, counts))]
        ends = np.append(np.cumsum(counts)[first[1:] - 1], counts.sum())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays(cols, fields=list(_MEMBER)))
        filled = np.add.reduceat(sizes[order], first)
        open_ = np.zeros(made, bool)
        roomiest = np.argsort(filled, kind="stable")[: up + 1] if up >= 0 else []
        open_[roomiest] = filled[roomiest] < capacity
        ids = (level << 56) | (node << 36) | np.arange(made)
        arrays = [pa.array(np.full(made, node, np.int32)), pa.array(ids), pa.array(filled.astype(np.int32)), pa.array(open_), lists]
        return pa.RecordBatch.from_arrays(arrays, ["node", "bin", "size", "open", "members"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at == to:
                    continue
                if held and nodes[at] != node:
                    yield node_bins(node, held)
                    held = []
                node = int(nodes[at])
                held.append(batch.slice(at, to - at))
        if held:
            yield node_bins(node, held)

    return kernel


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """docs (doc_id, text) -> PIECE, sequence_id long, offset long: every piece of every row of docs once.

    Each sequence holds at most `capacity` ids without gaps from 0. Full pieces are sequences of their own and
    stay out of the tree. Repeated rows are packed as often as they are given; a null doc_id stays null.
    """
    own = [c.split(" ")[0] for c in PIECE.split(", ")]
    all_pieces = written(pieces(docs, path, end_id, capacity), "pieces")
    full = all_pieces.where(F.col("length") == capacity)
    rest = all_pieces.where(F.col("length") < capacity)
    nodes = min(max(1, -(-rest.count() // leaf)), NODES)
    node = F.pmod(F.xxhash64("spread", "doc_id", "piece"), F.lit(nodes)).cast("int")
    member = F.array(F.struct(*own, F.lit(0).cast("long").alias("offset")))
    items = rest.select(node.alias("node"), F.col("length").cast("int").alias("size"), member.alias("members"))
    done, level = [], 1
    while True:
        dealt = items.repartition(nodes, "node").sortWithinPartitions("node", F.desc("size"), "members")
        bins = written(dealt.mapInArrow(_pack(UP if nodes > 1 else -1, capacity, level), BIN), f"bins{level}")
        done.append(bins.where("not open") if nodes > 1 else bins)
        if nodes == 1:
            break
        nodes, level = -(-nodes // fan), level + 1
        items = bins.where("open").select((F.col("node") % nodes).alias("node"), "size", "members")
    out = None
    for bins in done:
        rows = bins.select(F.explode("members").alias("m"), F.col("bin").alias("sequence_id"))
        rows = rows.select(*[F.col("m")[c].alias(c) for c in own], "sequence_id", F.col("m.offset").alias("offset"))
        out = rows if out is None else out.unionByName(rows)
    alone = full.select(*own, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(alone)
