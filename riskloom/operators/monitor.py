"""Monitoring aggregates over decision and latency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import edge_index, rounded
from riskloom.operators.ordered import collapse, percentiles_of, range_prefix

# Histogram edges. --------------------------------------------------------------------
PROBABILITY_EDGES = [0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 1.00]
SCORE_EDGES = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 100.0]
STAGE_EDGES = [0.001, 0.005, 0.010, 0.025, 0.050, 0.100, 0.250, 0.500]
REQUEST_EDGES = [0.005, 0.010, 0.025, 0.050, 0.100, 0.250, 0.500, 1.000]
# ---------------------------------------------------------------------------------------------------


def counts_by(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("total"))


def bucket_histogram(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts per upper edge (value <= edge), with a final +Inf row.

    Values are counted per bucket with map-side combine; the running sum sees edges + 1 rows per key.
    """
    edges = sorted(edges)
    spark = df.sparkSession
    # bucket = first edge >= value; computed as the number of edges strictly below the value.
    below = edge_index(f"-`{value}`", [-e for e in reversed(edges)])
    bucket = (F.lit(len(edges)) - below).alias("bucket")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame(
        [(i, float(e)) for i, e in enumerate(edges)] + [(len(edges), float("inf"))], "bucket int, upper_edge double")
    if keys:
        per_key = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
        spread = per_key.select(*keys, "m", F.explode(F.array(*[
            F.struct(F.lit(i).alias("bucket"), F.lit(e).alias("upper_edge"))
            for i, e in enumerate([*map(float, edges), float("inf")])])).alias("g"))
        filled = spread.select(*keys, "g.*", F.coalesce(F.try_element_at("m", F.col("g.bucket")), F.lit(0)).alias("n"))
    else:
        filled = grid.join(counted, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    running = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*keys, "upper_edge", F.sum("n").over(running).alias("cumulative_count"))


def throughput(df: DataFrame, window: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Events per second in each window."""
    seconds = {"1 minute": 60.0, "5 minutes": 300.0, "1 hour": 3600.0}[window]
    frame = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return df.groupBy(frame.alias("w")).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), "events", rounded(F.col("events") / seconds, 4).alias("events_per_second"))


def block_rate(decisions: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("decision") == "BLOCK")
    return decisions.agg(F.coalesce(rounded(blocked / F.nullif(F.count("*"), F.lit(0)) * 100.0, 4), F.lit(0.0)).alias("block_rate_pct"))


def latency_percentiles(df: DataFrame, window: str | None = None, slide: str | None = None, value: str = "latency_ms") -> DataFrame:
    """p50 / p90 / p95 / p99 / mean per step, optionally per window. Exact for groups of any size."""
    rows = df.select("step", value, *(["timestamp"] if window else []))
    keys = ["step"]
    if window:
        frame = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
        rows = rows.withColumn("window_start", frame["start"])
        keys = ["window_start", "step"]
    points = range_prefix(collapse(rows, keys, value), keys, [value], ["n"])
    marks = percentiles_of(points, keys, value, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    # The mean comes from the same points: value times multiplicity.
    means = points.groupBy(*keys).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("samples"))
    return marks.join(means, keys).select(*keys, "samples", *[rounded(F.col(c), 2).alias(c) for c in ("p50", "p90", "p95", "p99", "mean")])
