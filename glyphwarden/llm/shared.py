"""Small helpers shared by the operators: shared storage, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters that the contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_remainder(c: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids have the remainder of the empty text, 0."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; one of our own only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/glyphwarden-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_groups(df: DataFrame, each: int = 16_000_000, most: int = 50_000) -> int:
    """Into how many groups to deal what comes of df: as many as the session shuffles into, and more where
    the size that the optimizer knows of its inputs asks for it, so that a group does not grow with the input."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = min(-(-size // each), most) if size < 1 << 60 else 0  # a plan without known inputs
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def few(df: DataFrame, rows: int) -> DataFrame:
    """df as a broadcast side if it has at most `rows` rows, which are counted; else Spark's own choice of join."""
    return F.broadcast(df) if df.count() <= rows else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already gone at interpreter exit
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public splitmix64 generator: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; nulls have length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def tidy() -> None:
    """Give memory that a finished task held back to the system: workers live on, and share their executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Cut a batch into runs of rows whose texts have about `limit` bytes, to bound memory."""
    i = batch.schema.get_field_index(column)
    _, off = utf8_column(batch.column(i))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end
