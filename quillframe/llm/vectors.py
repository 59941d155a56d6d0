"""What the two vector searches share: usable vectors, and row tables of equal nodes met in sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 16 << 20


def usable(rows: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """id, v (array of double) of rows whose vector is whole and finite; of rows that repeat an id, the least vector."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    found = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(sound)
    if not allow_zero:
        found = found.where(F.exists("v", lambda x: x != 0))
    return found.groupBy("id").agg(F.min("v").alias("v"))


def by_key(rows: DataFrame, key: str, settle: Callable[[dict[str, np.ndarray | list]], Iterator[pa.RecordBatch]], schema: str, at_least: int = 20_000, parts: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """settle() over chunks of sorted partitions that hold all rows of each of their keys.

    Chunks have about at_least rows or CHUNK_BYTES bytes; a key's rows must be few (the callers bound or
    salt them). parts: number of partitions, for work that does not follow the bytes. then: order inside a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = weight = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            weight += batch.nbytes
            if size >= at_least or weight >= CHUNK_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column(key).to_numpy()
                end = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if end:
                    yield from settle(table.slice(0, end))
                    table = table.slice(end)
                held, size, weight = table.to_batches(), table.num_rows, table.nbytes
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition(parts, key) if parts else rows.repartition(key)
    return dealt.sortWithinPartitions(key, *then).mapInArrow(run, schema)


def ranks_within(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal keys."""
    new = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))
