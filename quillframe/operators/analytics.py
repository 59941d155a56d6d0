"""The consumers of a read table: dictionary codes, totals, sums by category, the largest few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.errors import TooManyCategories
from quillframe.sources.records import kept

MAX_CATEGORIES, MAX_DICTIONARY_BYTES = 65_536, 64 << 20


def dictionary_of(rows: DataFrame, column: str, order: list[str], most: int = MAX_CATEGORIES) -> DataFrame:
    """code, column: distinct values numbered from 0 by first appearance in the given order. Made once, in the shared folder."""
    first = rows.groupBy(column).agg(F.min(F.struct(*order)).alias("first")).limit(most + 1)
    # at most `most` + 1 rows come to the one task that numbers them
    found = kept(first.select((F.row_number().over(Window.orderBy("first")) - 1).alias("code"), column))
    if found.count() > most:
        raise TooManyCategories(f"more than {most} distinct values of {column}")
    return found


def small(dictionary: DataFrame, column: str) -> DataFrame:
    """For a join: broadcast if the names' bytes allow it."""
    size = dictionary.agg(F.coalesce(F.sum(F.octet_length(column) + 16), F.lit(0))).first()[0]
    return F.broadcast(dictionary) if size <= MAX_DICTIONARY_BYTES else dictionary


def encode(rows: DataFrame, column: str, order: list[str], most: int = MAX_CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """rows with column as its code, and the dictionary (code, column), of at most `most` entries."""
    codes = dictionary_of(rows, column, order, most)
    names = [F.col("code").alias(c) if c == column else F.col(c) for c in rows.columns]
    return rows.join(small(codes, column), column).select(*names), codes


def decode(rows: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """rows with the codes in column as text again."""
    names = small(dictionary.select(F.col("code").alias("__code"), F.col(column).alias("__name")), "__name")
    joined = rows.join(names, F.col(column) == F.col("__code"))
    return joined.select(*(F.col("__name").alias(c) if c == column else F.col(c) for c in rows.columns))


def total(rows: DataFrame, amount: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("total_cents"))


def total_by(rows: DataFrame, category: str, amount: str) -> DataFrame:
    """Sums by category, largest first, equal sums by name."""
    return rows.groupBy(category).agg(F.sum(amount).cast("bigint").alias("total_cents")).orderBy(F.desc("total_cents"), F.asc(category))


def largest(rows: DataFrame, category: str, amount: str, n: int = 3) -> DataFrame:
    return total_by(rows, category, amount).limit(n)
