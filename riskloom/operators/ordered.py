"""Prefix aggregates over an order, for keys of any size.

A window over a key puts the whole key into one task. Two forms here avoid that:

``strict_prefix``
    order = an integer (microseconds). The order axis is cut into fixed widths (minute, day), each
    (key, slice) is aggregated with map-side combine, the slice totals are prefixed first, and rows only
    ever meet the rows of their own slice. Nothing depends on sampling or partition numbers.

``range_prefix``
    order = any sortable columns. Rows are range-partitioned and written once to the shared folder
    together with their partition number, so every later step (and every retry) sees the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.skew import dealt
from riskloom.session import materialise

MINUTE_US = 60 * 1_000_000
DAY_US = 86_400 * 1_000_000


def strict_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    widths: Sequence[int] = (MINUTE_US, DAY_US),
    prefix: str = "before_",
    n_rows: int | None = None,
) -> DataFrame:
    """Add, per row, sums / maxima of columns over the rows of the same key with a smaller ``order``.

    Rows with an equal ``order`` are not counted. Adds ``before_<column>``; sums start at 0, maxima at
    null. ``widths`` are the slice widths from fine to coarse, each a multiple of the one before. With ``n_rows``, about the
    number of rows, they are dealt out to as many partitions as that needs.
    """
    keys = list(keys)
    names = [*sums, *maxima]

    def merge(a: Column, b: Column, name: str) -> Column:
        if name in maxima:
            return F.greatest(a, b)
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    def aggregate(name: str) -> Column:
        return F.max(name) if name in maxima else F.sum(name)

    if not widths:
        frame = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
        added = {}
        df = df if n_rows is None else dealt(df, n_rows, *keys)
        for name in names:
            value = aggregate(name).over(frame)
            added[prefix + name] = value if name in maxima else F.coalesce(value, F.lit(0))
        return df.withColumns(added)

    width, coarser = widths[0], widths[1:]
    depth = len(widths)
    cut, carry, local = f"_slice{depth}", f"_carry{depth}_", f"_local{depth}_"
    sliced = df.withColumn(cut, F.expr(f"`{order}` div {int(width)}L"))
    totals = sliced.groupBy(*keys, cut).agg(*[aggregate(n).alias(n) for n in names])
    carried = strict_prefix(
        totals, keys, cut, sums, maxima, [w // width for w in coarser], prefix=carry, n_rows=n_rows
    ).select(*keys, cut, *[carry + n for n in names])

    frame = Window.partitionBy(*keys, cut).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    placed = (sliced if n_rows is None else dealt(sliced, n_rows, *keys, cut)).withColumns({local + n: aggregate(n).over(frame) for n in names})
    joined = placed.join(carried, [*keys, cut], "left")
    result = joined.withColumns({prefix + n: merge(F.col(local + n), F.col(carry + n), n) for n in names})
    return result.drop(cut, *[local + n for n in names], *[carry + n for n in names])


def range_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums ``before_<sum>`` and key totals ``total_<sum>`` along ``order`` within ``keys``.

    (keys, order) must be unique: collapse equal values first, which also removes hot values. The two
    windows run over one range slice each, and over the slice totals, which number at most
    (keys + shuffle partitions). Keys must not be null.
    """
    keys, order = list(keys), list(order)
    # No fixed number: AQE may merge neighbouring ranges of small inputs, which keeps their order.
    cut = materialise(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "range")
    totals = cut.groupBy(*keys, "_slice").agg(*[F.sum(s).alias(s) for s in sums])
    # Without keys this window is not partitioned: it sees one row per slice.
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_slice",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_carry_{s}") for s in sums],
        *[F.sum(s).over(per_key).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"_local_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    joined = local.join(carried, [*keys, "_slice"])
    result = joined.withColumns({f"before_{s}": F.col(f"_local_{s}") + F.col(f"_carry_{s}") for s in sums})
    return result.drop("_slice", *[f"_local_{s}" for s in sums], *[f"_carry_{s}" for s in sums])


def percentile_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def collapse(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value) with its multiplicity ``n``; nulls are dropped, as aggregates drop them."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def percentiles_of(points: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles from ``range_prefix`` output over multiplicity ``n``.

    ``points`` needs ``n``, ``before_n``, ``total_n``. Every rank is picked by a filter and a max, so a
    group of any size costs one map-side-combined aggregate.
    """
    picks = []
    for name, p in probs.items():
        position = (F.col("total_n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
    grouped = points.groupBy(*keys).agg(*picks, F.max("total_n").alias("_total"))
    out = []
    for name, p in probs.items():
        position = (F.col("_total") - 1) * F.lit(float(p))
        weight = position - F.floor(position)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * weight).alias(name))
    return grouped.select(*keys, *out)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles per key without holding a key's values in one task."""
    keys = list(keys)
    points = range_prefix(collapse(df, keys, value), keys, [value], ["n"])
    return percentiles_of(points, keys, value, probs)
