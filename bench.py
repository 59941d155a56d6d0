"""Benchmark: headline CSV reads at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each table is exported to CSV once, outside the timing; a query's figure is the best of three runs
into a sink that keeps nothing. clean: lineitem; messy: documents (quoted commas, quotes, newlines).
"""

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillframe.operators import analytics
from quillframe.operators.measure import best_seconds, measured
from quillframe.options import ReadOptions
from quillframe.plans.driver_queries import _priced, exported
from quillframe.sources.reader import read_common, read_csv
from quillframe.sources.records import size_of

CLEAN = "l_orderkey:int, l_extendedprice:float, l_returnflag:str"
MESSY = "doc_id:int, text:str, lang:str"


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    clean, messy = exported(spark, sf_dir, "lineitem"), exported(spark, sf_dir, "documents")
    priced = _priced(spark, sf_dir, "lineitem", "l_extendedprice")
    lazy = ReadOptions(validate=False)
    runs = {
        "common_clean": lambda: read_common(spark, clean, CLEAN),
        "strict_clean": lambda: read_csv(spark, clean, CLEAN),
        "strict_clean_lazy": lambda: read_csv(spark, clean, CLEAN, lazy),
        "common_messy": lambda: read_common(spark, messy, MESSY),
        "strict_messy": lambda: read_csv(spark, messy, MESSY),
        "strict_messy_lazy": lambda: read_csv(spark, messy, MESSY, lazy),
        "money_by_category": lambda: analytics.total_by(read_csv(spark, priced, "l_extendedprice:cents, l_returnflag:str"), "l_returnflag", "l_extendedprice"),
        "count_messy": lambda: read_csv(spark, messy, "doc_id:int").agg(F.count("*")),
    }
    times = {name: round(best_seconds(make), 3) for name, make in runs.items()}
    table = {}
    for name, path in (("common_clean", clean), ("strict_clean", clean), ("strict_clean_lazy", clean), ("common_messy", messy), ("strict_messy", messy), ("strict_messy_lazy", messy)):
        found = measured(runs[name])
        table[name] = {"rows_s": round(found["rows"] / times[name]), "mb_s": round(size_of(spark, path) / 1e6 / times[name], 1), "partitions": found["partitions"], "heap_mb": round(found["heap_mb"])}
    print(json.dumps({"metric": "csv_reads_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "rates": table}))
    spark.stop()


if __name__ == "__main__":
    main()
