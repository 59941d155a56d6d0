"""Timing, memory and cancellation of whole plans."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillframe.errors import Cancelled


def best_seconds(make: Callable[[], DataFrame], runs: int = 3) -> float:
    """Best wall time of running the plan into a sink that keeps nothing."""
    best = float("inf")
    for _ in range(runs):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return best


def measured(make: Callable[[], DataFrame]) -> dict[str, float]:
    """seconds, rows, partitions and heap_mb (the peak of the driver's JVM heap, which holds the executor on a local master) of one run."""
    plan = make()
    jvm = plan.sparkSession._jvm
    pools = [p for p in jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans() if p.getType().toString().startswith("Heap")]
    jvm.System.gc()
    for p in pools:
        p.resetPeakUsage()
    seen = Observation()
    began = time.perf_counter()
    plan.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - began
    return {"seconds": seconds, "rows": seen.get["rows"], "partitions": plan.rdd.getNumPartitions(), "heap_mb": sum(p.getPeakUsage().getUsed() for p in pools) / 1e6}


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry the tag; cancel(spark, tag) from another thread ends them with Cancelled."""
    sc = spark.sparkContext
    sc.addJobTag(tag)
    try:
        yield
    except Exception as e:
        if "cancelled" in str(e).lower() or "canceled" in str(e).lower():
            raise Cancelled(f"jobs tagged {tag} were cancelled") from e
        raise
    finally:
        sc.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
