"""The fixed money schema: exact header, unsigned ids, integer cents, dictionary-coded categories."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from quillframe.operators import analytics
from quillframe.options import ReadOptions
from quillframe.sources.reader import ORDER, read_csv

# The header and the kinds of the projected columns.
HEADER = "id,user_id,note,amount,category"
COLUMNS = [("id", "u64"), ("user_id", "u32"), ("amount", "cents"), ("category", "name")]


@dataclass(frozen=True)
class MoneyTable:
    """rows: id, user_id, amount_cents, category (code). dictionary: code, category."""

    rows: DataFrame
    dictionary: DataFrame

    def count(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def total_cents(self) -> DataFrame:
        return analytics.total(self.rows, "amount_cents")

    def total_by_category(self) -> DataFrame:
        return analytics.total_by(self.decoded(), "category", "amount_cents")

    def decoded(self) -> DataFrame:
        return analytics.decode(self.rows, self.dictionary, "category")


def read_money(spark: SparkSession, path: str, options: ReadOptions | None = None) -> MoneyTable:
    """Strict read of the money schema; blank lines and empty categories are errors, ids take no plus sign."""
    options = replace(options or ReadOptions(), blank_lines="error")
    rows = read_csv(spark, path, COLUMNS, options, keep_order=True, exact_header=HEADER).withColumnRenamed("amount", "amount_cents")
    coded, dictionary = analytics.encode(rows, "category", ORDER)
    return MoneyTable(coded.select("id", "user_id", "amount_cents", "category"), dictionary)
