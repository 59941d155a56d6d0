"""Helpers that the training-data operators share: shared-folder tables, Arrow slices, n-grams."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.packaging import ship
from quillframe.sources.records import remove, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master (tests)."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise small state (links, labels, quotas) with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Arrow batches of whole texts hold few rows, so that a worker holds a few MB of them at a time.

    The setting is read when a lazy result runs, so it stays in the session; one that is smaller already is left alone.
    The package goes to the executors, too.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a compressed table in the shared folder; returns it reread, and its path."""
    spark = df.sparkSession
    ship(spark)
    path = f"{checkpoint_dir(spark)}/quillframe/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    free(spark)
    atexit.register(release, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession, path: str) -> None:
    """Delete a table of stored() that no later plan reads; at exit, whatever is left."""
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: int, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices with about `budget` bytes of text each, one row at least, so that numpy buffers stay small."""
    if batch.num_rows == 0:
        return
    size = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
    block = (np.cumsum(size) // budget).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint32 array of code points, and each text's length in it."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), "<u4"), np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))


def hashed_ngrams(codes: np.ndarray, owner: np.ndarray, n: int, bits: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and owner of every window of n code points that lies in one owner's text."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(m, (salt * 1_000_003 + n) & 0xFFFFFFFF, U64)
    for k in range(n):
        h *= U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
        h += codes[k : m + k]
    h *= U64(0xD6E8FEB86659FD93)
    h >>= U64(64 - bits)
    inside = owner[:m] == owner[n - 1 :]
    return h[inside].astype(np.int64), owner[:m][inside]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))
