"""Leak-free behavioural history: every feature of a row uses only strictly earlier rows.

Ordinary customers: one hash exchange on the customer, one sort, range frames.
Hot customers: the same quantities as prefix sums over +/- events (an event enters a window at its time
and leaves it one width later), computed by ``strict_prefix``, so one customer spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import (
    SECOND, haversine_km, hour_is_unusual, merchant_risk, micros, rounded,
)
from riskloom.operators.ordered import DAY_US, MINUTE_US, strict_prefix
from riskloom.operators.skew import SkewPolicy, dealt, split_hot
from riskloom.schemas import FEATURES, ID_COLUMNS
from riskloom.session import materialise

# Window widths in seconds, cold-start defaults. --------------------------------------
COUNT_WINDOWS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "24h": 86_400, "7d": 604_800}
SUM_WINDOWS = {"5m": 300, "1h": 3600}
DISTINCT_WINDOWS = {
    "unique_merchants_24h": ("merchant_id", 86_400),
    "unique_countries_7d": ("country", 604_800),
    "unique_devices_30d": ("device_id", 2_592_000),
}
COLD_START = {
    "txn_count_1m": 0, "txn_count_5m": 0, "txn_count_15m": 0, "txn_count_1h": 0, "txn_count_24h": 0,
    "txn_count_7d": 0, "amount_sum_5m": 0.0, "amount_sum_1h": 0.0, "customer_avg_amount": 1500.0,
    "customer_std_amount": 500.0, "customer_amount_zscore": 0.0, "amount_to_avg_ratio": 1.0,
    "is_new_device": 1, "is_new_country": 0, "is_new_city": 0, "unique_merchants_24h": 0,
    "unique_countries_7d": 1, "unique_devices_30d": 1, "time_since_prev_txn": 86_400.0,
    "geo_distance_km": 0.0, "travel_speed_kmh": 0.0, "impossible_travel": 0,
}
DEVICE_WINDOW = 86_400
# ---------------------------------------------------------------------------------------------------

NOVELTY = {"is_new_device": "device_id", "is_new_country": "country", "is_new_city": "city"}
PREVIOUS = ["us", "transaction_id", "lat", "lon"]
DEVICE_KEY = "_device"


def _with_axis(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "us": micros(F.col("timestamp")),
        "cents": (F.col("amount").cast("decimal(12,2)") * 100).cast("long"),
    })


def _previous_struct() -> Column:
    return F.struct(*PREVIOUS)


# -- ordinary keys ----------------------------------------------------------------------------------

def _spread(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from exact integers: n * sum(x^2) - sum(x)^2 cannot cancel. Where the product leaves 38
    digits (some 10^9 rows of the largest amounts) it is taken in doubles."""
    exact = F.try_subtract(F.try_multiply(n.cast("decimal(38,0)"), squares), F.try_multiply(total, total)).cast("double")
    rough = n.cast("double") * squares.cast("double") - total.cast("double") * total.cast("double")
    return F.when(n > 0, F.sqrt(F.greatest(F.coalesce(exact, rough), F.lit(0.0))) / F.nullif(n, F.lit(0)))


def _window_stats(df: DataFrame, n_rows: int) -> DataFrame:
    """Every count and sum of a window is that of the whole past less that of what lies before the window: both frames
    grow, so a key of n rows costs n steps for each, not n times the rows of a window."""
    by_customer = Window.partitionBy("customer_id").orderBy("us")
    past = by_customer.rangeBetween(Window.unboundedPreceding, -1)

    def last(seconds: int):
        return by_customer.rangeBetween(-seconds * SECOND, -1)

    def gone(seconds: int):
        return by_customer.rangeBetween(Window.unboundedPreceding, -seconds * SECOND - 1)

    placed = dealt(df, n_rows, "customer_id").withColumn("squares", F.col("cents").cast("decimal(38,0)") * F.col("cents").cast("decimal(38,0)"))
    placed = placed.withColumn("squares", F.col("squares").cast("decimal(28,0)"))
    total = F.coalesce(F.sum("cents").over(past), F.lit(0))
    stats = {
        "n_past": F.count(F.lit(1)).over(past),
        "cents_past": F.sum("cents").over(past),
        "squares_past": F.sum("squares").over(past),
        "previous": F.max(_previous_struct()).over(past),
    }
    for name, seconds in COUNT_WINDOWS.items():
        stats[f"n_{name}"] = F.count(F.lit(1)).over(past) - F.count(F.lit(1)).over(gone(seconds))
    for name, seconds in SUM_WINDOWS.items():
        stats[f"cents_{name}"] = total - F.coalesce(F.sum("cents").over(gone(seconds)), F.lit(0))
    for name, (column, seconds) in DISTINCT_WINDOWS.items():
        stats[f"d_{name}"] = F.size(F.collect_set(column).over(last(seconds))).cast("long")
    windowed = placed.withColumns(stats)
    # (customer, value) windows reuse the customer exchange.
    for name, column in NOVELTY.items():
        first = F.min("us").over(Window.partitionBy("customer_id", F.coalesce(F.col(column), F.lit(""))))
        windowed = windowed.withColumn(f"new_{name}", F.col("us") <= first)
    spread = _spread(F.col("n_past"), F.col("cents_past").cast("decimal(38,0)"), F.col("squares_past").cast("decimal(38,0)"))
    return windowed.withColumns({"std_cents": spread, "cents_past": F.col("cents_past").cast("double")}).drop("squares", "squares_past")


# -- hot keys ---------------------------------------------------------------------------------------

def _presence_events(df: DataFrame, n_rows: int, keys: Sequence[str], value: str, seconds: int, name: str) -> DataFrame:
    """+1 / -1 events whose running sum is the number of distinct values seen in the last ``seconds``.

    Occurrences are first merged per slice no wider than the window (min and max time, map-side
    combined): inside a slice they cannot be further apart than the window, so the merge is exact, and a
    value has at most one row per slice however often it occurs.
    """
    width = seconds * SECOND
    slice_us = max(1, width // 24)
    runs = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value, F.expr(f"us div {slice_us}L").alias("_s"))
        .agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    )
    order = Window.partitionBy(*keys, value).orderBy("lo")
    gaps = dealt(runs, n_rows, *keys, value).withColumns({"prev_hi": F.lag("hi").over(order), "next_lo": F.lead("lo").over(order)})
    starts = F.when(
        F.col("prev_hi").isNull() | (F.col("lo") > F.col("prev_hi") + width),
        F.struct(F.col("lo").alias("us"), F.lit(1).cast("long").alias(name)),
    )
    ends = F.when(
        F.col("next_lo").isNull() | (F.col("next_lo") > F.col("hi") + width),
        F.struct((F.col("hi") + width).alias("us"), F.lit(-1).cast("long").alias(name)),
    )
    return gaps.select(*keys, F.explode(F.array_compact(F.array(starts, ends))).alias("e")).select(*keys, "e.*")


def _event_stats(df: DataFrame, n_rows: int) -> DataFrame:
    columns = df.columns
    cents = F.col("cents").cast("decimal(38,0)")
    # One struct of increments per event; the same fields appear on entry and, negated, on expiry.
    entry = {"n_past": F.lit(1).cast("long"), "cents_past": cents, "squares_past": cents * cents}
    expiries: dict[int, dict[str, Column]] = {}
    for name, seconds in COUNT_WINDOWS.items():
        entry[f"n_{name}"] = F.lit(1).cast("long")
        expiries.setdefault(seconds, {})[f"n_{name}"] = F.lit(-1).cast("long")
    for name, seconds in SUM_WINDOWS.items():
        entry[f"cents_{name}"] = F.col("cents")
        expiries.setdefault(seconds, {})[f"cents_{name}"] = -F.col("cents")
    entry = {name: (c.cast("decimal(38,0)") if name in ("cents_past", "squares_past") else c) for name, c in entry.items()}

    base = df.select("customer_id", "us", F.struct(*columns).alias("row"), _previous_struct().alias("previous"),
                     *[c.alias(n) for n, c in entry.items()])
    windows = [n for n in entry if n not in ("n_past", "cents_past", "squares_past")]
    leaving = F.explode(F.array(*[
        F.struct((F.col("us") + seconds * SECOND).alias("us"),
                 *[changes.get(n, F.lit(0).cast("long")).cast("long").alias(n) for n in windows])
        for seconds, changes in expiries.items()
    ]))
    events = base.unionByName(
        df.select("customer_id", leaving.alias("e")).select("customer_id", "e.*"), allowMissingColumns=True
    )
    for name, (column, seconds) in DISTINCT_WINDOWS.items():
        events = events.unionByName(
            _presence_events(df, n_rows, ["customer_id"], column, seconds, f"d_{name}"), allowMissingColumns=True
        )
    sums = [*entry, *[f"d_{n}" for n in DISTINCT_WINDOWS]]
    prefixed = strict_prefix(events, ["customer_id"], "us", sums, ["previous"], (MINUTE_US, DAY_US), n_rows=n_rows * (1 + len(expiries)))
    rows = prefixed.where(F.col("row").isNotNull()).select(
        "row.*", F.col("before_previous").alias("previous"), *[F.col(f"before_{s}").alias(s) for s in sums]
    )
    for name, column in NOVELTY.items():
        value = F.coalesce(F.col(column), F.lit("")).alias("_value")
        first = df.groupBy("customer_id", value).agg(F.min("us").alias("first_us"))
        rows = (
            rows.withColumn("_value", value).join(first, ["customer_id", "_value"])
            .withColumn(f"new_{name}", F.col("us") <= F.col("first_us"))
            .drop("first_us", "_value")
        )
    n, total = F.col("n_past"), F.col("cents_past")
    return rows.withColumns({"std_cents": _spread(n, total, F.col("squares_past")), "cents_past": total.cast("double")}).drop("squares_past")


# -- shared finish ----------------------------------------------------------------------------------

def finish_history(df: DataFrame) -> DataFrame:
    """Turn raw statistics into the 22 named features, with cold-start constants. Narrow."""
    amount = F.col("amount").cast("double")
    n = F.col("n_past")
    mean = F.col("cents_past") / F.nullif(n, F.lit(0)) / 100.0
    sigma = F.greatest(F.when(n > 1, F.col("std_cents") / 100.0).otherwise(500.0), F.lit(1.0))
    seconds = F.greatest(F.lit(0.5), (F.col("us") - F.col("previous.us")) / float(SECOND))
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("previous.lat"), F.col("previous.lon"))
    work = df.withColumns({"_mean": mean, "_sigma": sigma, "_gap": seconds, "_km": distance})
    work = work.withColumn("_kmh", F.col("_km") / (F.col("_gap") / 3600.0))
    seen = {
        **{f"txn_count_{w}": F.col(f"n_{w}") for w in COUNT_WINDOWS},
        **{f"amount_sum_{w}": rounded(F.col(f"cents_{w}") / 100.0, 2) for w in SUM_WINDOWS},
        "customer_avg_amount": rounded(F.col("_mean"), 2),
        "customer_std_amount": rounded(F.col("_sigma"), 2),
        "customer_amount_zscore": rounded((amount - F.col("_mean")) / F.col("_sigma"), 3),
        "amount_to_avg_ratio": rounded(amount / (F.col("_mean") + 1.0), 3),
        **{name: F.col(f"new_{name}").cast("int") for name in NOVELTY},
        "unique_merchants_24h": F.col("d_unique_merchants_24h"),
        "unique_countries_7d": F.greatest(F.lit(1), F.col("d_unique_countries_7d")),
        "unique_devices_30d": F.greatest(F.lit(1), F.col("d_unique_devices_30d")),
        "time_since_prev_txn": rounded(F.col("_gap"), 1),
        "geo_distance_km": rounded(F.col("_km"), 2),
        "travel_speed_kmh": rounded(F.col("_kmh"), 1),
        "impossible_travel": ((F.col("_kmh") > 900.0) & (F.col("_km") > 200.0)).cast("int"),
    }
    return work.withColumns({
        name: F.when(n > 0, value).otherwise(F.lit(COLD_START[name])) for name, value in seen.items()
    }).drop("_mean", "_sigma", "_gap", "_km", "_kmh")


RAW_STATS = [
    "cents", "std_cents", *[f"n_{w}" for w in COUNT_WINDOWS], *[f"cents_{w}" for w in SUM_WINDOWS],
    *[f"d_{n}" for n in DISTINCT_WINDOWS], *[f"new_{n}" for n in NOVELTY],
]


def customer_history_stats(df: DataFrame, skew: SkewPolicy = SkewPolicy(), probe: DataFrame | None = None) -> DataFrame:
    """Raw strictly-past statistics per row (counts, sums, spread, previous event, novelty)."""
    ordinary, hot, n_ordinary, n_hot = split_hot(_with_axis(df), "customer_id", skew, probe)
    stats = _window_stats(ordinary, n_ordinary)
    return stats if hot is None else stats.unionByName(_event_stats(materialise(hot, "hot-customers"), n_hot))


def history_features(df: DataFrame, skew: SkewPolicy = SkewPolicy(), probe: DataFrame | None = None) -> DataFrame:
    """Input columns plus the 22 customer-history features, ``n_past`` and ``previous``."""
    return finish_history(customer_history_stats(df, skew, probe)).drop(*RAW_STATS, "cents_past", "us")


# -- devices ----------------------------------------------------------------------------------------

def _device_window_stats(df: DataFrame, n_rows: int) -> DataFrame:
    frame = Window.partitionBy(DEVICE_KEY).orderBy("us").rangeBetween(-DEVICE_WINDOW * SECOND, -1)
    seen = dealt(df, n_rows, DEVICE_KEY).withColumn("_customers", F.collect_set("customer_id").over(frame))
    return seen.withColumns({
        "device_customers": F.size("_customers").cast("long"),
        "device_knows_customer": F.array_contains("_customers", F.col("customer_id")),
    }).drop("_customers")


def _device_event_stats(df: DataFrame, n_rows: int) -> DataFrame:
    columns = df.columns
    base = df.select(DEVICE_KEY, "us", F.struct(*columns).alias("row"))
    events = base.unionByName(
        _presence_events(df, n_rows, [DEVICE_KEY], "customer_id", DEVICE_WINDOW, "device_customers"),
        allowMissingColumns=True,
    )
    counted = strict_prefix(events, [DEVICE_KEY], "us", ["device_customers"], (), (MINUTE_US, DAY_US), n_rows=2 * n_rows)
    rows = counted.where(F.col("row").isNotNull()).select(
        "row.*", F.col("before_device_customers").alias("device_customers")
    ).withColumn("_seen", F.col("us"))
    # Did this very customer use the device inside the window? Last use before the row, per pair.
    paired = strict_prefix(rows, [DEVICE_KEY, "customer_id"], "us", (), ["_seen"], (MINUTE_US, DAY_US), n_rows=n_rows)
    recent = F.col("before__seen") >= F.col("us") - DEVICE_WINDOW * SECOND
    return paired.withColumn("device_knows_customer", F.coalesce(recent, F.lit(False))).drop("_seen", "before__seen")


def device_stats(df: DataFrame, skew: SkewPolicy = SkewPolicy(), probe: DataFrame | None = None) -> DataFrame:
    """Distinct customers on the row's device in the 24 h before it; one exchange on the device."""
    axis = df if "us" in df.columns else df.withColumn("us", micros(F.col("timestamp")))
    # Rows without a device share one key, so that they cannot escape the split.
    device = F.coalesce("device_id", F.lit(""))
    counted = None if probe is None else probe.select(device.alias(DEVICE_KEY))
    ordinary, hot, n_ordinary, n_hot = split_hot(axis.withColumn(DEVICE_KEY, device), DEVICE_KEY, skew, counted)
    stats = _device_window_stats(ordinary, n_ordinary)
    if hot is not None:
        stats = stats.unionByName(_device_event_stats(materialise(hot, "hot-devices"), n_hot))
    return stats.drop(DEVICE_KEY)


def device_customer_count(df: DataFrame, skew: SkewPolicy = SkewPolicy(), probe: DataFrame | None = None) -> DataFrame:
    stats = device_stats(df, skew, probe)
    return stats.withColumn("device_customer_count", F.greatest(F.lit(1), F.col("device_customers"))).drop(
        "device_customers", "device_knows_customer", "us"
    )


# -- point features and the full vector -------------------------------------------------------------

def point_features(df: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Features of the row alone. ``profiles``: customer_id, typical_hour_start, typical_hour_end."""
    start = end = None
    work = df
    if profiles is not None:
        hours = profiles.select("customer_id", F.col("typical_hour_start").alias("_start"),
                                F.col("typical_hour_end").alias("_end"))
        work = work.join(hours, "customer_id", "left")
        start, end = F.col("_start"), F.col("_end")
    hour, day = F.hour("timestamp"), F.weekday("timestamp")
    category = F.col("merchant_category") if "merchant_category" in df.columns else F.lit(None).cast("string")
    return work.withColumns({
        "log_amount": rounded(F.log1p(F.col("amount").cast("double")), 4),
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
        "is_unusual_hour": hour_is_unusual(hour, start, end),
        "merchant_risk_score": merchant_risk(category),
    }).drop("_start", "_end")


def all_features(df: DataFrame, profiles: DataFrame | None = None, skew: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Input columns plus all 30 features. Exchanges: customer, device (and the profile join)."""
    return device_customer_count(history_features(point_features(df, profiles), skew, df), skew, df)


def build_features(df: DataFrame, profiles: DataFrame | None = None, skew: SkewPolicy = SkewPolicy(), extra: Sequence[str] = ()) -> DataFrame:
    """The feature table: five id/label columns and the 30 features, amount as double; ``extra`` input columns follow."""
    full = all_features(df, profiles, skew)
    values = [F.col(f).cast("double").alias(f) if f == "amount" else F.col(f) for f in FEATURES]
    return full.select(*ID_COLUMNS, *values, *extra)


def top_feature_correlations(features: DataFrame, k: int = 10) -> DataFrame:
    """Pearson correlation of every feature with the label: one aggregate, then a 30-row ranking."""
    label = F.col("is_fraud").cast("int").cast("double")
    wide = features.agg(*[F.corr(F.col(f).cast("double"), label).alias(f) for f in FEATURES])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in FEATURES
    ]))
    tall = wide.select(pairs.alias("p")).select("p.*")
    ranked = tall.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    return ranked.orderBy(F.abs("correlation").desc(), "feature").limit(k)
