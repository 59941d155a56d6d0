"""Comparison of tables and outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.sources.records import kept


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows; NaN equals NaN, null equals null."""
    return a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def same_table(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Equal rows at equal keys (a unique order column); NaN equals NaN."""
    if a.dtypes != b.dtypes:
        return False
    return mismatches(a, b, key).isEmpty()


def mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys at which the tables differ or that one of them lacks."""
    rest = [c for c in a.columns if c != key]
    left = a.select(F.col(key), F.struct(*rest).alias("l"))
    right = b.select(F.col(key), F.struct(*rest).alias("r"))
    return left.join(right, key, "full").where(~F.col("l").eqNullSafe(F.col("r"))).select(key)


def same_outcome(a: Callable[[], DataFrame], b: Callable[[], DataFrame]) -> bool:
    """Both give equal rows, or both fail, with the same code where their errors have one. Each plan runs once, into the shared folder."""

    def outcome(f: Callable[[], DataFrame]) -> DataFrame | str:
        try:
            return kept(f())
        except Exception as e:  # noqa: BLE001  any failure is an outcome
            return getattr(e, "code", "")

    x, y = outcome(a), outcome(b)
    if isinstance(x, str) or isinstance(y, str):
        return isinstance(x, str) and isinstance(y, str) and (x == y or not x or not y)
    return same_rows(x, y)


def integrity(got: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """rows (of got), intact (rows that equal the truth's row with the same key)."""
    rest = [c for c in truth.columns if c != key]
    right = truth.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in rest))
    alike = F.lit(True)
    for c in rest:
        alike &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = got.join(right, F.col(key) == F.col("__key"), "left")
    return joined.agg(F.count("*").alias("rows"), F.coalesce(F.sum((F.col("__key").isNotNull() & alike).cast("long")), F.lit(0)).alias("intact"))
