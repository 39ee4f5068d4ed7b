"""Customer maturity, shrunk baselines, device syndicates, profiles and dimension back-fill."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import SECOND, micros, rounded
from riskloom.operators.history import device_stats, history_features
from riskloom.operators.skew import SkewPolicy


def maturity(prior_events: Column) -> Column:
    return F.when(prior_events <= 0, "COLD_START").when(prior_events <= 3, "WARMING").otherwise("MATURE")


def account_maturity(df: DataFrame, skew: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Maturity of the customer at each transaction, from strictly earlier events."""
    return history_features(df, skew).withColumn("account_maturity", maturity(F.col("n_past")))


# Population prior. -------------------------------------------------------------------
PRIOR_MEAN, PRIOR_STD, PRIOR_WEIGHT = 85.0, 35.0, 5.0
# ---------------------------------------------------------------------------------------------------


def shrink(n: Column, mean: Column, std: Column, m: float = PRIOR_WEIGHT, mu0: float = PRIOR_MEAN,
           s0: float = PRIOR_STD) -> tuple[Column, Column]:
    mu = F.when(n > 0, (n * mean + m * mu0) / (n + m)).otherwise(mu0)
    sd = F.when(n > 1, F.greatest(F.lit(10.0), (n * std + m * s0) / (n + m))).otherwise(s0)
    return rounded(mu, 2), rounded(sd, 2)


def shrunk_baseline(df: DataFrame, m: float = PRIOR_WEIGHT, mu0: float = PRIOR_MEAN, s0: float = PRIOR_STD,
                    customers: DataFrame | None = None) -> DataFrame:
    """Shrunk mean and standard deviation per customer; with ``customers`` also for those without events."""
    amount = F.col("amount").cast("double")
    stats = df.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.avg(amount).alias("mean"), F.stddev_samp(amount).alias("std"))
    if customers is not None:
        stats = customers.select("customer_id").join(stats, "customer_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mu, sd = shrink(F.col("n"), F.col("mean"), F.col("std"), m, mu0, s0)
    return stats.select("customer_id", F.col("n").alias("observations"), mu.alias("shrunk_mean"), sd.alias("shrunk_std"))


def device_syndicates(df: DataFrame, threshold: int = 3, skew: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Distinct customers on the device in 24 h including the current one, flag and risk boost."""
    stats = device_stats(df, skew)
    distinct = F.col("device_customers") + F.when(F.col("device_knows_customer"), 0).otherwise(1)
    return stats.withColumn("distinct_customers", distinct).withColumns({
        "is_syndicate": F.col("distinct_customers") >= threshold,
        "risk_boost": F.when(F.col("distinct_customers") >= 5, 0.50)
        .when(F.col("distinct_customers") >= 3, 0.30).otherwise(0.0),
    }).drop("device_customers", "device_knows_customer", "us")


def known_entities(df: DataFrame, as_of: datetime | None = None, horizon_days: int | None = None) -> DataFrame:
    """Known devices and countries, one row per (customer, kind, value) with its first and last use.

    Rows rather than one array per customer: a set has no size limit, a row does.
    """
    seen = df
    if as_of is not None:
        seen = seen.where(F.col("timestamp") <= F.lit(as_of))
        if horizon_days is not None:
            seen = seen.where(F.col("timestamp") > F.lit(as_of) - F.expr(f"INTERVAL {horizon_days} DAYS"))
    pairs = F.explode(F.array(
        F.struct(F.lit("device").alias("kind"), F.col("device_id").alias("value")),
        F.struct(F.lit("country").alias("kind"), F.col("country").alias("value")),
    ))
    return (
        seen.select("customer_id", "timestamp", pairs.alias("e")).where(F.col("e.value").isNotNull())
        .groupBy("customer_id", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    )


def customer_history(df: DataFrame, before: datetime, limit: int | None = None,
                     customer_id: str | None = None) -> DataFrame:
    """Events strictly before ``before``; with ``limit`` the newest ones per customer, output ascending.

    row_number under a limit is pruned on the map side, so a hot customer sends at most ``limit`` rows
    per input partition.
    """
    past = df.where(F.col("timestamp") < F.lit(before))
    if customer_id is not None:
        past = past.where(F.col("customer_id") == customer_id)
    if limit is not None:
        newest = Window.partitionBy("customer_id").orderBy(F.col("timestamp").desc(), F.col("transaction_id").desc())
        past = past.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit).drop("_rank")
    return past.orderBy("customer_id", "timestamp", "transaction_id")


# Profile defaults. -------------------------------------------------------------------
DEFAULT_CUSTOMER = {
    "home_country": "US", "home_city": "New York", "average_amount": 100.0, "std_amount": 30.0,
}
DEFAULT_DEVICE = "DEV-DEFAULT-1"
DEFAULT_MERCHANT = {
    "name": "Default Merchant", "category": "retail", "mcc_code": "5411", "country": "US", "city": "New York",
    "risk_tier": "STANDARD",
}
# ---------------------------------------------------------------------------------------------------


def customer_profile(df: DataFrame, customers: DataFrame, as_of: datetime) -> DataFrame:
    """Home, baseline, recent velocity and tier per customer that is in the dimension or has events.

    Velocity counts reach up to and including ``as_of``. Sets of known devices / countries are counted
    here and listed by ``known_entities``.
    """
    age = (micros(F.lit(as_of).cast("timestamp")) - micros(F.col("timestamp"))) / float(SECOND)
    hour, day = age <= 3600.0, age <= 86_400.0
    activity = df.where(F.col("timestamp") <= F.lit(as_of)).groupBy("customer_id").agg(
        F.count_if(hour).alias("count_last_1h"),
        F.count_if(day).alias("count_last_24h"),
        F.sum(F.when(hour, F.col("amount"))).alias("amount_last_1h"),
        F.max("amount").alias("max_amount"),
        F.count_distinct("device_id").alias("known_devices"),
        F.count_distinct("country").alias("known_countries"),
    )
    joined = customers.select("customer_id", *DEFAULT_CUSTOMER).join(activity, "customer_id", "full")
    zero = F.lit(0).cast("long")
    return joined.select(
        "customer_id",
        *[F.coalesce(F.col(c), F.lit(v)).cast("double" if isinstance(v, float) else "string").alias(c)
          for c, v in DEFAULT_CUSTOMER.items()],
        F.greatest(F.lit(1), F.coalesce("known_devices", zero)).alias("known_devices"),
        F.greatest(F.lit(1), F.coalesce("known_countries", zero)).alias("known_countries"),
        F.coalesce("count_last_1h", zero).alias("count_last_1h"),
        F.coalesce("count_last_24h", zero).alias("count_last_24h"),
        F.coalesce(F.col("amount_last_1h").cast("double"), F.lit(0.0)).alias("amount_last_1h"),
        F.col("max_amount").cast("double").alias("max_amount"),
        F.when(F.coalesce("count_last_1h", zero) < 4, "STANDARD").otherwise("ELEVATED").alias("risk_tier"),
    )


def backfill_dimension(dimension: DataFrame, facts: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """The dimension plus a default row for every key that only the facts know.

    Fact keys are reduced to distinct values before the anti join.
    """
    unseen = facts.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")
    columns = []
    for field in dimension.schema.fields:
        if field.name == key:
            columns.append(F.col(key))
        else:
            columns.append(F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name))
    return dimension.unionByName(unseen.select(*columns))
