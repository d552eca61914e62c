"""Measurement: corpora of exact length, timed workloads, and their summary as a table.

A workload is a scenario (a column expression) and a size in code points. Timed is the
whole projection into a sink that drops it; the peak is that of the driver's JVM heap.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (100, 1_000, 10_000)
SAMPLES = "scenario string, size int, phase string, turn int, seconds double, peak_bytes long, allocated_bytes long"


def corpus(sample: Column, size: Column) -> Column:
    """A text of exactly ``size`` code points, the sample over and over."""
    return F.substring(F.repeat(sample, F.ceil(size / F.length(sample)).cast("int")), F.lit(1), size.cast("int"))


def _heap(spark: SparkSession):
    return spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage().getUsed()


def measurement(spark: SparkSession, call: Callable[[], object]) -> tuple[float, int, int]:
    """(seconds, peak heap, growth of the heap) of a call."""
    before, began = _heap(spark), time.perf_counter()
    call()
    seconds, after = time.perf_counter() - began, _heap(spark)
    return seconds, int(max(before, after)), int(max(0, after - before))


def summary(samples: DataFrame, *keys: str) -> DataFrame:
    """Seconds (least, mean, median, most) and memory of samples, by key."""
    return samples.groupBy(*keys).agg(
        F.count("*").alias("iterations"),
        F.min("seconds").alias("seconds_min"),
        F.avg("seconds").alias("seconds_mean"),
        F.percentile("seconds", F.lit(0.5)).alias("seconds_median"),
        F.max("seconds").alias("seconds_max"),
        F.max("peak_bytes").alias("peak_bytes_max"),
        F.avg("allocated_bytes").alias("allocated_bytes_mean"),
    )


def workloads(spark: SparkSession, scenarios: dict[str, tuple[str, Callable[[Column], Column]]], sizes=SIZES) -> DataFrame:
    """(scenario, size, text): every scenario with every size."""
    one = spark.createDataFrame([(k, s) for k, (s, _) in scenarios.items()], "scenario string, sample string")
    rows = one.crossJoin(spark.createDataFrame([(s,) for s in sizes], "size int"))  # some ten rows
    return rows.select("scenario", "size", corpus(F.col("sample"), F.col("size")).alias("text"))


def run_benchmark(spark: SparkSession, scenarios: dict[str, tuple[str, Callable[[Column], Column]]], *, repeats: int = 5, rows: int = 1000, sizes=SIZES) -> DataFrame:
    """Samples of every workload over ``rows`` copies of its text: the first turn is cold, the others are warm."""
    if not isinstance(repeats, int) or isinstance(repeats, bool) or repeats <= 0:
        raise ValueError("repeats must be a positive integer")
    out = []
    for case in workloads(spark, scenarios, sizes).collect():
        texts = spark.range(rows).select(F.concat(F.lit(case["text"]), F.lit("")).alias("text"))
        spoken = texts.select(scenarios[case["scenario"]][1](F.col("text")).alias("y"))
        for turn in range(repeats + 1):
            took = measurement(spark, lambda: spoken.write.format("noop").mode("overwrite").save())
            out.append((case["scenario"], case["size"], "cold" if turn == 0 else "warm", turn, *took))
    return spark.createDataFrame(out, SAMPLES)


def write_report(samples: DataFrame, path: str) -> None:
    """The summary of samples as JSON lines."""
    summary(samples, "scenario", "size", "phase").write.mode("overwrite").json(path)
