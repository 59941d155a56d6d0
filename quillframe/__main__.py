"""python -m quillframe [max_rows]: differences between the naive, common and strict readers on generated files."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import SparkSession

from quillframe.operators import compare
from quillframe.operators.measure import best_seconds
from quillframe.sources.reader import read_common, read_csv, read_naive
from quillframe.sources.records import remove, shared_folder
from quillframe.sources.sinks import benchmark_rows, write_csv

SIZES = (10_000, 100_000, 500_000, 1_000_000)
SCHEMA = "id:int, amount:float, category:str"


def main(argv: list[str]) -> int:
    most = int(argv[0]) if argv else 500_000
    if most < SIZES[0]:
        print(f"max_rows must be {SIZES[0]} or more", file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    print("profile  rows      naive s  common s  strict s  naive rows intact")
    folder = f"{shared_folder(spark)}/quillframe-readers-{uuid.uuid4().hex}"
    try:
        for messy in (False, True):
            for rows in (n for n in SIZES if n <= most):
                path = f"{folder}/{rows}-{messy}"
                write_csv(benchmark_rows(spark, rows, messy), path)
                times = [best_seconds(lambda r=r: r(spark, path, SCHEMA), 3 if rows <= 100_000 else 1) for r in (read_naive, read_common, read_csv)]
                intact = compare.integrity(read_naive(spark, path, SCHEMA), read_csv(spark, path, SCHEMA), "id").first()
                print(f"{'messy' if messy else 'clean':8} {rows:<9} " + " ".join(f"{t:8.2f}" for t in times) + f"   {intact['intact']} of {rows}")
    finally:
        remove(spark, folder)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
