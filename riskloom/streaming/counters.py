"""Counters of running streams, and latency percentiles from sketches."""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

COUNTERS = ("received", "processed", "duplicates", "late")


def observed(df: DataFrame, counter: str) -> DataFrame:
    """Count the rows that pass here under the name of a counter; costs no extra pass."""
    return df.observe(counter, F.count(F.lit(1)).alias("rows"))


class CounterListener(StreamingQueryListener):
    """Totals of each named query: rows ``observed`` as received and processed, rows dropped as duplicates by the
    deduplication's state, and rows dropped behind the watermark. Register it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = defaultdict(lambda: dict.fromkeys(COUNTERS, 0))
        self.names: dict[str, str] = {}
        self.ended: set[str] = set()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self.lock:
            self.names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self.lock:
            own = self.totals[p.name or str(p.id)]
            for counter in ("received", "processed"):
                if counter in p.observedMetrics:
                    own[counter] += p.observedMetrics[counter]["rows"]
            for operator in p.stateOperators:
                own["late"] += operator.numRowsDroppedByWatermark
                own["duplicates"] += int(operator.customMetrics.get("numDroppedDuplicateRows", 0))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.lock:
            self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 30.0) -> None:
        """Until the events of a query that has ended have all come in."""
        until = time.time() + seconds
        while str(query.runId) not in self.ended:
            if time.time() > until:
                raise TimeoutError(f"no end of query {query.runId} was reported")
            time.sleep(0.05)

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, received, processed, duplicates, late), one row for each query."""
        with self.lock:
            rows = [(name, *(own[c] for c in COUNTERS)) for name, own in self.totals.items()]
        return spark.createDataFrame(rows, "query string, " + ", ".join(f"{c} long" for c in COUNTERS))


def latency_pane_query(latencies: DataFrame, path: str, checkpoint: str, pane: str = "1 minute", delay: str = "10 minutes", k: int = 200) -> StreamingQuery:
    """Store a quantile sketch of each (pane, step) of ``latencies(timestamp, step, latency_ms)``; every batch stores the
    panes that it has changed, whole. ``k`` sets the sketches' size; up to so many values they are exact."""
    panes = latencies.withWatermark("timestamp", delay).groupBy(F.window("timestamp", pane).alias("w"), "step").agg(
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(k)).alias("sketch"), F.count("latency_ms").alias("samples"))
    shaped = panes.select(F.col("w.start").alias("pane_start"), "step", "sketch", "samples")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return shaped.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_panes(spark: SparkSession, path: str) -> DataFrame:
    """The last stored sketch of each pane."""
    stored = spark.read.parquet(path)
    last = stored.groupBy("pane_start", "step").agg(F.max_by(F.struct("sketch", "samples"), "batch").alias("p"))
    return last.select("pane_start", "step", "p.*")


def sliding_percentiles(panes: DataFrame, pane_seconds: int = 60, panes_in_window: int = 5, marks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(window_start, step, samples, p50, ...) of windows that start with every pane: sketches are merged, no value is read
    again."""
    back = F.explode(F.sequence(F.lit(0), F.lit(panes_in_window - 1)))
    placed = panes.select("step", "sketch", "samples", "pane_start", back.alias("k"))
    start = F.timestamp_seconds(F.unix_timestamp("pane_start") - F.col("k") * pane_seconds)
    merged = placed.groupBy(start.alias("window_start"), "step").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("samples").alias("samples"))
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(m)).alias(f"p{round(100 * m)}") for m in marks]
    return merged.select("window_start", "step", "samples", *named)


def compact(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """Write the last stored row of each key of a folder of batches as one batch of another folder."""
    stored = spark.read.parquet(path)
    fields = [c for c in stored.columns if c not in (*keys, "batch")]
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("p"), F.max("batch").alias("batch"))
    newest = last.agg(F.max("batch")).scalar()
    last.select(*keys, "p.*").write.mode("overwrite").parquet(f"{target}/batch={newest}")
