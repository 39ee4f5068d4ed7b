"""Finding hot keys before a keyed operator runs, and dealing rows out by key."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialise

#: Rows that a task of a keyed step takes in the mean, and so many at least where that leaves fewer tasks than the session has.
TASK_ROWS, LEAST_ROWS = 100_000, 10_000


@dataclass(frozen=True)
class SkewPolicy:
    """``hot_rows``: a key with more rows than this is split. ``max_hot_keys``: the largest set of hot keys
    that is broadcast; a larger set is written as a table and joined without a hint."""

    hot_rows: int = 10_000
    max_hot_keys: int = 10_000


class Split(NamedTuple):
    """Rows of ordinary and of hot keys, and how many there are of each; ``hot`` is None when no key is hot."""

    ordinary: DataFrame
    hot: DataFrame | None
    n_ordinary: int
    n_hot: int


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal about ``rows`` rows out by key. The number of partitions follows the rows and is given, so that adaptive execution
    doesn't merge them again: a task's share, and what it sorts, doesn't grow with the table."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(2, -(-rows // TASK_ROWS), min(usual, -(-rows // LEAST_ROWS))), *keys)


def split_hot(df: DataFrame, key: str, policy: SkewPolicy = SkewPolicy(), probe: DataFrame | None = None) -> Split:
    """The rows of ordinary and of hot keys. ``key`` must not be null.

    ``probe``: a cheaper table with the same keys to count, such as the input that ``df`` was derived from.
    One pass over the key column alone, with map-side combine, and another one if there are hot keys. At most ``max_hot_keys + 1`` key values
    reach the driver.
    """
    counts = (df if probe is None else probe).groupBy(key).count()
    is_hot = F.col("count") > policy.hot_rows
    total, n_hot = counts.agg(F.sum("count"), F.sum(F.when(is_hot, F.col("count")))).first()
    if not n_hot:
        return Split(df, None, total or 0, 0)
    hot = counts.where(is_hot).select(key)
    known = hot.limit(policy.max_hot_keys + 1).collect()
    if probe is not None:
        df = materialise(df, "split")  # both parts read it; what it is derived from is computed once
    if len(known) > policy.max_hot_keys:
        # Spark picks the join from the size of the written table; AQE splits a skewed side.
        keys = materialise(hot, "hot-keys")
    else:
        schema = T.StructType([T.StructField(key, df.schema[key].dataType)])
        keys = F.broadcast(df.sparkSession.createDataFrame([(r[0],) for r in known], schema))
    return Split(df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi"), total - n_hot, n_hot)
