"""CSV sinks and generators of test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Own values: categories, and notes that need quoting.
CATEGORIES = ["wool", "timber", "copper", "glass", "salt", "paper", "spices"]
TRICKY = ["left, then right", 'the "old" mill', "first\nsecond", '"x",\n"y"', "ends with a quote\""]
MONEY_CATEGORIES = ["wages", "freight", "fuel", "repairs", "duties", "storage"]


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """RFC 4180 files: quotes doubled, spaces kept, null written as an empty cell."""
    writer = df.write.mode("overwrite").option("header", header).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def _chance(seed: int, salt: int, n: int) -> Column:
    """A whole number from 0 to n - 1 that depends on the row's id, the seed and the salt."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def benchmark_rows(spark: SparkSession, rows: int, messy: bool = False, seed: int = 7) -> DataFrame:
    """id, user_id, amount, category, ts, note; messy: about 2% of the notes need quotes."""
    note = F.lit("ok")
    if messy:
        note = F.when(_chance(seed, 5, 100) < 2, _pick(TRICKY, _chance(seed, 6, len(TRICKY)))).otherwise(note)
    day, hour = _chance(seed, 3, 28) + 1, _chance(seed, 4, 24)
    return spark.range(rows).select(
        "id",
        _chance(seed, 1, 1_000_000).alias("user_id"),
        F.format_string("%d.%02d", (_chance(seed, 2, 100_001) / 100).cast("long"), _chance(seed, 2, 100_001) % 100).alias("amount"),
        _pick(CATEGORIES, _chance(seed, 7, len(CATEGORIES))).alias("category"),
        F.format_string("2025-01-%02dT%02d:00:00", day, hour).alias("ts"),
        note.alias("note"),
    )


def money_rows(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """id, user_id, note, amount, category of the fixed money schema; 30% of the notes need quotes."""
    p, cents = _chance(seed, 1, 100), _chance(seed, 2, 10_000_000)
    note = F.when(p < 70, F.concat(F.lit("voucher no. "), F.col("id").cast("string"))).otherwise(_pick(TRICKY, _chance(seed, 5, len(TRICKY))))
    return spark.range(1, rows + 1).select(
        "id",
        _chance(seed, 3, 1_000_000).alias("user_id"),
        note.alias("note"),
        F.format_string("%d.%02d", (cents / 100).cast("long"), cents % 100).alias("amount"),
        _pick(MONEY_CATEGORIES, _chance(seed, 4, len(MONEY_CATEGORIES))).alias("category"),
    )
