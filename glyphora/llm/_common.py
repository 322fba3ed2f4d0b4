"""Helpers shared by the training-data operators: tables, cut lineage, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a vectorised kernel holds at once (a single longer text is one step).
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Without one, a folder of a single machine will do in local mode alone; a cluster must name one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(spark, "_glyphora_dir", None)
        if not where:
            where = spark._glyphora_dir = "file://" + tempfile.mkdtemp(prefix="glyphora-")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet below the shared folder and reads it back.

    The files outlive lost executors. `drop_written` removes them early, `clean` when a result has been saved.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glyphora_path = path
    return out


#: What this driver has written and not deleted yet.
_PATHS: list[str] = []


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _PATHS.remove(name)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by `written`."""
    _delete(df.sparkSession, df._glyphora_path)


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables: results that build on them must have been saved."""
    for name in list(_PATHS):
        _delete(spark, name)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and a row key (did, th), equal only for rows that agree in doc_id and text.

    Null texts count as empty. Columns other than `more` go, so names can't clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        text.alias("text"),
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("did"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("th"),
        *more,
    )


def text_steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of anything but ASCII white space) of all texts (large_string, none null) end to end, and how many each has."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(np.asarray(real))])
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    return flat.filter(real), np.diff(ends[at])


#: Odd numbers that hashes of windows are built on; hashes on different ones agree by chance alone.
_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_POWERS: dict[tuple[int, str], np.ndarray] = {}


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS.get((which, "up"), ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _ODD[which]), ("down", pow(_ODD[which], -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[which, name] = np.multiply.accumulate(x)
    return _POWERS[which, "up"][:n], _POWERS[which, "down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads polynomial sums evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `length` consecutive word hashes; a function of the run alone."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(n, which)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[: n - length + 1])
