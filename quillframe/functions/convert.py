"""Strict conversions of text cells as column expressions: null stands for a bad value, which no good cell gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789"
UNSIGNED = r"^[0-9]+\z"
SPECIAL = r"^(?i:nan|[+-]?inf(?:inity)?)\z"
MONEY = r"^[0-9]+(?:[.][0-9]{2})?\z"
BLANK = r"^\s*\z"

TYPES = {"int": "bigint", "float": "double", "str": "string", "u64": "decimal(20,0)", "u32": "bigint", "cents": "bigint", "name": "string"}


def _ends(cell: Column, first: str, last: str) -> Column:
    """Whether a cell starts with one of some characters and ends with one of others. Cheaper than a pattern."""
    return F.contains(F.lit(first), F.substring(cell, 1, 1)) & F.contains(F.lit(last), F.substring(cell, -1, 1)) & (cell != "")


def strict_int(cell: Column) -> Column:
    """64-bit integer: optional sign and ASCII digits, nothing else. A cast that succeeds leaves only blanks at the ends to rule out."""
    return F.when(_ends(cell, "+-" + DIGITS, DIGITS), cell.try_cast("bigint"))


def strict_float(cell: Column) -> Column:
    """Double; a blank cell is NaN, a finite literal that overflows is bad."""
    number = cell.try_cast("double")
    lower = F.lower(cell)
    special = F.when(lower.contains("nan"), F.lit(float("nan"))).when(lower.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    plain = _ends(cell, "+-." + DIGITS, "." + DIGITS) & ~cell.contains("x") & ~cell.contains("X")  # no type suffix, blanks or hexadecimals
    return F.when(plain, F.when(F.abs(number) < float("inf"), number)).when(cell.rlike(BLANK), F.lit(float("nan"))).when(cell.rlike(SPECIAL), special)


def unsigned64(cell: Column) -> Column:
    value = cell.try_cast("decimal(20,0)")
    return F.when(cell.rlike(UNSIGNED), F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value))


def unsigned32(cell: Column) -> Column:
    value = cell.try_cast("bigint")
    return F.when(cell.rlike(UNSIGNED), F.when(value <= 4294967295, value))


def money_cents(cell: Column) -> Column:
    """Exact cents of D+ or D+.DD, never through a double; overflow is bad."""
    return F.when(cell.rlike(MONEY), (cell.try_cast("decimal(38,2)") * 100).try_cast("bigint"))


def text(cell: Column) -> Column:
    """Any text; empty stays empty."""
    return cell


def name(cell: Column) -> Column:
    """Text that is valid and not empty."""
    return F.when((F.length(cell) > 0) & F.is_valid_utf8(cell), cell)


CONVERT = {"int": strict_int, "float": strict_float, "str": text, "u64": unsigned64, "u32": unsigned32, "cents": money_cents, "name": name}


def preview(cell: Column) -> Column:
    """At most 32 characters of a cell, quoted and escaped so that messages stay one line."""
    return F.to_json(F.struct(F.substring(cell, 1, 32).alias("cell")))


def display_money(cents: Column) -> Column:
    """Cents as an exact amount with two decimals."""
    return (cents.cast("decimal(20,2)") / 100).cast("decimal(20,2)")
