"""Chronological split without a global sort.

The rank-k row is found by narrowing: day histogram, minute histogram inside the day, then an exact
ordered prefix over that minute alone. Each pass reads two columns; only histograms (bounded by the
calendar) and the two cut rows reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import micros, rounded
from riskloom.operators.ordered import DAY_US, MINUTE_US, range_prefix


def _bucket_of(counts: list, rank: int) -> tuple[int, int]:
    """The bucket that holds position ``rank`` and the number of rows before that bucket."""
    before = 0
    for bucket, n in sorted(counts):
        if before + n > rank:
            return bucket, before
        before += n
    raise ValueError("rank beyond the table")


def _row_at(axis: DataFrame, days: list, rank: int):
    day, before_day = _bucket_of(days, rank)
    inside = axis.where(F.expr(f"us div {DAY_US}L") == day)
    minutes = [(r[0], r[1]) for r in inside.groupBy(F.expr(f"us div {MINUTE_US}L").alias("m")).count().collect()]
    minute, before_minute = _bucket_of(minutes, rank - before_day)
    tied = inside.where(F.expr(f"us div {MINUTE_US}L") == minute).groupBy("us", "id").agg(F.count("*").alias("n"))
    ranked = range_prefix(tied, [], ["us", "id"], ["n"])
    offset = rank - before_day - before_minute
    hit = ranked.where((F.col("before_n") <= offset) & (F.col("before_n") + F.col("n") > offset))
    return hit.select("us", "id").first()


def temporal_split(df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15,
                   tie_break: str = "transaction_id") -> DataFrame:
    """Add ``split``: the first int(train*n) rows by time, the next int(val*n), the rest."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    axis = df.select(micros(F.col("timestamp")).alias("us"), F.col(tie_break).alias("id"))
    days = [(r[0], r[1]) for r in axis.groupBy(F.expr(f"us div {DAY_US}L").alias("d")).count().collect()]
    total = sum(n for _, n in days)
    if total == 0:
        raise ValueError("cannot split an empty table")
    first = int(total * train)
    second = first + int(total * val)

    def before(rank: int) -> Column:
        if rank >= total:
            return F.lit(True)
        cut = _row_at(axis, days, rank)
        us = micros(F.col("timestamp"))
        return (us < cut["us"]) | ((us == cut["us"]) & (F.col(tie_break) < cut["id"]))

    return df.withColumn(
        "split", F.when(before(first), "train").when(before(second), "val").otherwise("test"))


def split_boundaries(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        rounded(F.avg(F.col("is_fraud").cast("double")) * 100.0, 3).alias("fraud_pct"),
    )


def check_no_overlap(boundaries: DataFrame) -> None:
    """Raise when a later split starts before an earlier one ends (three rows)."""
    spans = {r["split"]: (r["first_ts"], r["last_ts"]) for r in boundaries.collect()}
    order = [s for s in ("train", "val", "test") if s in spans]
    for earlier, later in zip(order, order[1:]):
        if spans[earlier][1] > spans[later][0]:
            raise ValueError(f"{earlier} and {later} overlap in time")
