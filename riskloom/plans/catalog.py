"""The query catalogue: one entry per operator, each over the whole tables of ``sf_dir``.

Arrays and timestamps are shaped for comparison at this boundary only: arrays become comma-joined text and
timestamps lose their zone (the session runs in UTC).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import behaviour, policy, privacy, rules
from riskloom.functions.columns import haversine_km, rounded
from riskloom.operators import drift, entities, evaluate, explore, history, monitor, split, store, validate
from riskloom.operators.skew import SkewPolicy
from riskloom.plans import oracles as o
from riskloom.plans.scoring import decide_features
from riskloom.schemas import FEATURES, TRANSACTION
from riskloom.session import prepare, scratch_path
from riskloom.sources import star
from riskloom.sources import tables as tables_io
from riskloom.sources.key_index import KeyIndex

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ",").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return present(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# -- shared inputs ----------------------------------------------------------------------------------

def txn(spark, sf):
    return star.transactions(spark, sf)


def feat(spark, sf):
    return history.all_features(txn(spark, sf), star.customers(spark, sf))


def with_scores(df):
    return df.withColumns({"calibrated_probability": F.col("p_raw"), "anomaly_score": F.col("anomaly")})


def scored(spark, sf):
    return decide_features(with_scores(feat(spark, sf)))


AS_OF = datetime(2024, 1, 20)
DRIFT_REF_END, DRIFT_CUR_START = datetime(2024, 1, 11), datetime(2024, 1, 21)


def sel(cte: str, columns: str, source: str, tail: str = "") -> str:
    return f"WITH {cte} SELECT {columns} FROM {source} {tail}"


# -- scans ------------------------------------------------------------------------------------------

@query("S1_read_transactions", sel(
    o.TXN, 'transaction_id, "timestamp", customer_id, merchant_id, CAST(amount AS DOUBLE) AS amount, country, city, lat, lon, '
    "device_id, payment_method, ip_address, merchant_category, is_fraud", "txn"))
def _(spark, sf):
    path = scratch_path(spark, "transactions")
    tables_io.write_table(txn(spark, sf).select(*[f.name for f in TRANSACTION.fields]), path, by_date=True)
    return tables_io.read_transactions(spark, path).select(
        "transaction_id", "timestamp", "customer_id", "merchant_id", "amount", "country", "city", "lat", "lon",
        "device_id", "payment_method", "ip_address", "merchant_category", "is_fraud")


# -- validation -------------------------------------------------------------------------------------

@query("V1_validate", f"""WITH {o.TXN},
 prev AS (SELECT us < lag(us) OVER (ORDER BY ingest_order) AS inv FROM txn),
 c AS (SELECT count(*) AS total_records, count(*) FILTER (is_fraud) AS fraud_count,
   {o.r('avg(is_fraud::INT) * 100', 3)} AS fraud_ratio_pct, CAST(0 AS BIGINT) AS null_values,
   count(*) FILTER (amount <= 0) AS invalid_amounts, count(*) FILTER (lat < -90 OR lat > 90) AS invalid_lat,
   count(*) FILTER (lon < -180 OR lon > 180) AS invalid_lon,
   (SELECT count(*) FILTER (inv) FROM prev) AS order_inversions FROM txn)
 SELECT invalid_amounts = 0 AND invalid_lat = 0 AND invalid_lon = 0 AS is_valid, *,
   CASE WHEN invalid_lat > 0 OR invalid_lon > 0 THEN 'Found coordinate boundary errors: lat=' || invalid_lat || ', lon=' || invalid_lon ELSE '' END AS errors,
   concat_ws(',', CASE WHEN order_inversions > 0 THEN 'Dataset timestamps are not strictly monotonic increasing.' END,
     CASE WHEN fraud_ratio_pct > 15 THEN 'Fraud ratio is unusually high (' || CAST(fraud_ratio_pct AS VARCHAR) || '%)' END,
     CASE WHEN fraud_ratio_pct < 0.1 THEN 'Fraud ratio is extremely low (' || CAST(fraud_ratio_pct AS VARCHAR) || '%)' END) AS warnings FROM c""")
def _(spark, sf):
    return validate.validate(txn(spark, sf), order="ingest_order")


@query("V2_summary_stats", f"""WITH {o.TXN} SELECT CAST(min(amount) AS DOUBLE) AS amount_min,
 {o.r('CAST(sum(amount) AS DOUBLE) / count(*)', 2)} AS amount_mean, CAST(max(amount) AS DOUBLE) AS amount_max,
 count(DISTINCT customer_id) AS unique_customers, count(DISTINCT merchant_id) AS unique_merchants,
 count(DISTINCT device_id) AS unique_devices, count(DISTINCT country) AS unique_countries,
 min("timestamp") AS date_start, max("timestamp") AS date_end,
 {o.r(o.pct('amount', 0.5), 2)} AS amount_median, {o.r(o.pct('amount', 0.95), 2)} AS amount_p95 FROM txn""")
def _(spark, sf):
    return validate.summary_stats(txn(spark, sf))


def requests(spark, sf):
    """Requests: two-letter countries, and the irregular rows a client could send."""
    t = txn(spark, sf)
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("lat") / 5.0 + 13.0).cast("int"), F.lit(1))
    odd = F.col("anomaly") > 0.5
    return t.withColumns({
        "country": F.when(F.col("payment_method") == "UPI", F.concat(F.lit("N"), letter)).otherwise(F.col("country")),
        "currency": F.when(odd, "US").otherwise("USD"),
        "lon": F.col("lon") * F.when(F.col("is_fraud"), 1.2).otherwise(1.0),
    })


_REQ = f"""WITH {o.TXN},
 req AS (SELECT * EXCLUDE (country, currency, lon), CASE WHEN payment_method = 'UPI' THEN 'N' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(lat / 5 + 13 AS INT), 1) ELSE country END AS country,
   CASE WHEN anomaly > 0.5 THEN 'US' ELSE 'USD' END AS currency, lon * CASE WHEN is_fraud THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS lon FROM txn),
 chk AS (SELECT transaction_id, concat_ws(',', CASE WHEN amount <= 0 OR amount > 10000000 THEN 'amount' END,
   CASE WHEN length(currency) <> 3 THEN 'currency' END, CASE WHEN length(country) <> 2 THEN 'country' END,
   CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat' END, CASE WHEN lon NOT BETWEEN -180 AND 180 THEN 'lon' END,
   CASE WHEN us > epoch_us(TIMESTAMP '2024-01-30') + 300000000 THEN 'timestamp' END) AS failed_checks FROM req)
"""


@query("V3_split_valid_rejected", _REQ + "SELECT transaction_id, failed_checks, failed_checks = '' AS accepted FROM chk")
def _(spark, sf):
    now = F.lit(datetime(2024, 1, 30)).cast("timestamp")
    valid, rejected = validate.split_valid_rejected(requests(spark, sf), now)
    ok = valid.select("transaction_id", F.lit("").alias("failed_checks"), F.lit(True).alias("accepted"))
    return ok.unionByName(rejected.select(
        "transaction_id", F.array_join("failed_checks", ",").alias("failed_checks"), F.lit(False).alias("accepted")))


@query("V4_apply_defaults", sel(
    o.TXN, "transaction_id, coalesce(ip_address, '192.168.1.1') AS ip_address, "
    "CASE WHEN payment_method = 'UPI' THEN 'credit_card' ELSE payment_method END AS payment_method, "
    "CASE WHEN merchant_category = 'OTHER' THEN 'MERCH-4091' ELSE merchant_id END AS merchant_id, "
    "transaction_id AS idempotency_key, 'USD' AS currency", "txn"))
def _(spark, sf):
    sparse = txn(spark, sf).withColumns({
        "payment_method": F.when(F.col("payment_method") != "UPI", F.col("payment_method")),
        "merchant_id": F.when(F.col("merchant_category") != "OTHER", F.col("merchant_id")),
    }).drop("currency")
    return validate.apply_defaults(sparse).select(
        "transaction_id", "ip_address", "payment_method", "merchant_id", "idempotency_key", "currency")


_GIVEN = {"amount": "CAST(amount AS DOUBLE)", "travel_speed_kmh": "CASE WHEN is_fraud THEN 0.0::DOUBLE ELSE anomaly END"}


@query("V5_fill_features", sel(o.TXN, "transaction_id, " + ", ".join(f"{_GIVEN.get(f, '0.0::DOUBLE')} AS {f}" for f in FEATURES), "txn"))
def _(spark, sf):
    partial = txn(spark, sf).withColumn("travel_speed_kmh", F.when(~F.col("is_fraud"), F.col("anomaly")))
    return validate.fill_features(partial)


@query("V6_normalise_amount", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice / 3 AS DECIMAL(20,6)), 2) AS DOUBLE) AS amount FROM lineitem WHERE CAST(l_extendedprice / 3 AS DECIMAL(20,6)) > 0")
def _(spark, sf):
    thirds = star.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 3).cast("decimal(20,6)").alias("amount"))
    return validate.normalise_amount(thirds)


@query("V7_label_feedback_check", f"WITH {o.FEEDBACK} SELECT transaction_id, analyst_id, (CASE WHEN notes LIKE '%error' THEN lower(actual_label) ELSE actual_label END) AS actual_label, notes NOT LIKE '%error' AS valid FROM fb")
def _(spark, sf):
    fb = star.feedback(spark, sf)
    typed = F.when(F.col("notes").endswith("error"), F.lower("actual_label")).otherwise(F.col("actual_label"))
    return validate.label_feedback_check(fb.withColumn("actual_label", typed)).select(
        "transaction_id", "analyst_id", "actual_label", "valid")


# -- point features ---------------------------------------------------------------------------------

def feature_query(name: str, *columns: str) -> None:
    quoted = ", ".join(["transaction_id", *columns])

    @query(name, sel(o.FEAT, quoted, "feat"))
    def _(spark, sf):
        return feat(spark, sf).select("transaction_id", *[
            F.col(c).cast("double") if c == "amount" else F.col(c) for c in columns])


def point_query(name: str, *columns: str) -> None:
    quoted = ", ".join(["transaction_id", *columns])

    @query(name, sel(o.FEAT, quoted, "feat"))
    def _(spark, sf):
        points = history.point_features(txn(spark, sf), star.customers(spark, sf))
        return points.select("transaction_id", *[F.col(c).cast("double") if c == "amount" else F.col(c) for c in columns])


point_query("P1_log_amount", "amount", "log_amount")
point_query("P2_calendar", "hour_of_day", "day_of_week", "is_weekend")
point_query("P3_is_unusual_hour", "is_unusual_hour")
point_query("P4_merchant_risk_score", "merchant_risk_score")


@query("P5_haversine_km", sel(
    o.TXN, f"transaction_id, {o.r(o.hav('lat', 'lon', '19.076::DOUBLE', '72.8777::DOUBLE'), 6)} AS km", "txn"))
def _(spark, sf):
    return txn(spark, sf).select("transaction_id", rounded(
        haversine_km(F.col("lat"), F.col("lon"), F.lit(19.076), F.lit(72.8777)), 6).alias("km"))


# -- history ----------------------------------------------------------------------------------------

feature_query("H1_txn_counts", "txn_count_1m", "txn_count_5m", "txn_count_15m", "txn_count_1h", "txn_count_24h", "txn_count_7d")
feature_query("H2_amount_sums", "amount_sum_5m", "amount_sum_1h")
feature_query("H3_customer_avg_amount", "customer_avg_amount")
feature_query("H4_customer_std_amount", "customer_std_amount")
feature_query("H5_customer_amount_zscore", "customer_amount_zscore")
feature_query("H6_amount_to_avg_ratio", "amount_to_avg_ratio")
feature_query("H7_novelty", "is_new_device", "is_new_country", "is_new_city")
feature_query("H8_distinct_in_window", "unique_merchants_24h", "unique_countries_7d", "unique_devices_30d")
feature_query("H10_time_since_prev_txn", "time_since_prev_txn")
feature_query("H11_travel", "geo_distance_km", "travel_speed_kmh")
feature_query("H12_impossible_travel", "impossible_travel")
feature_query("H14_device_customer_count", "device_customer_count")


@query("H9_previous_event", sel(o.FEAT, "transaction_id, prev.id AS previous_id, prev.us AS previous_us", "feat"))
def _(spark, sf):
    return history.history_features(txn(spark, sf)).select(
        "transaction_id", F.col("previous.transaction_id").alias("previous_id"), F.col("previous.us").alias("previous_us"))


@query("H13_cold_start", sel(o.FEAT, "transaction_id, n_past, " + ", ".join(history.COLD_START), "feat", "WHERE n_past = 0"))
def _(spark, sf):
    return feat(spark, sf).where(F.col("n_past") == 0).select("transaction_id", "n_past", *history.COLD_START)


_ALL = "transaction_id, \"timestamp\", customer_id, merchant_id, is_fraud, " + ", ".join(FEATURES)


@query("H15_build_features", sel(o.FEAT, _ALL, "feat"))
def _(spark, sf):
    return history.build_features(txn(spark, sf), star.customers(spark, sf))


@query("H15_build_features_tied_orders", sel(o.ORDERS_FEAT, _ALL, "feat"))
def _(spark, sf):
    return history.build_features(star.order_transactions(spark, sf))


@query("H15_build_features_hot_keys", sel(o.FEAT, _ALL, "feat"))
def _(spark, sf):
    # Every key takes the splitting path that a hot customer or device takes.
    return history.build_features(txn(spark, sf), star.customers(spark, sf), SkewPolicy(hot_rows=0, max_hot_keys=0))


_CORR_LIST = " UNION ALL ".join(f"SELECT '{f}' AS feature, corr(CAST({f} AS DOUBLE), is_fraud::INT::DOUBLE) AS c FROM feat" for f in FEATURES)


@query("H16_top_feature_correlations", f"WITH {o.FEAT}, cc AS ({_CORR_LIST}) SELECT feature, {o.r('c', 6)} AS correlation FROM cc "
       "WHERE c IS NOT NULL AND NOT isnan(c) ORDER BY abs(c) DESC, feature LIMIT 10")
def _(spark, sf):
    table = history.build_features(txn(spark, sf), star.customers(spark, sf))
    return history.top_feature_correlations(table).select("feature", rounded(F.col("correlation"), 6).alias("correlation"))


# -- behaviour --------------------------------------------------------------------------------------

for _id, _name, _sql in (
    ("B1", "amount_component", o.AMOUNT_C), ("B2", "velocity_component", o.VELOCITY_C), ("B3", "kinematic_component", o.KINEMATIC_C),
):
    def _component(name):
        def run(spark, sf):
            return feat(spark, sf).select("transaction_id", rounded(behaviour.components()[name], 6).alias(name))
        return run

    query(f"{_id}_{_name}", sel(o.FEAT, f"transaction_id, {o.r(_sql, 6)} AS {_name}", "feat"))(_component(_name))


@query("B4_novelty_diurnal", sel(o.FEAT, f"transaction_id, {o.r(o.NOVELTY_C, 6)} AS novelty_component, {o.r(o.DIURNAL_C, 6)} AS diurnal_component", "feat"))
def _(spark, sf):
    parts = behaviour.components()
    return feat(spark, sf).select("transaction_id", *[rounded(parts[c], 6).alias(c) for c in ("novelty_component", "diurnal_component")])


@query("B5_behavior_score", sel(o.FEAT, f"transaction_id, {o.BEHAVIOR} AS behavior_score", "feat"))
def _(spark, sf):
    return behaviour.with_behavior(feat(spark, sf)).select("transaction_id", "behavior_score")


@query("B6_behavior_signals", sel(o.FEAT, f"transaction_id, {o.SIGNALS} AS behavior_signals", "feat"))
def _(spark, sf):
    return behaviour.with_behavior(feat(spark, sf)).select("transaction_id", "behavior_signals")


# -- rules ------------------------------------------------------------------------------------------

for _i, (_code, _weight, _pred) in enumerate(o.RULE_SQL, 1):
    def _rule(code):
        def run(spark, sf):
            fired = rules.with_rules(feat(spark, sf)).select("transaction_id", F.explode("triggered_rules").alias("r")).select("transaction_id", "r.*")
            return fired.where(F.col("rule_code") == code).select("transaction_id", "rule_code", "severity_penalty", "category")
        return run

    _cat = rules.RULES[_i - 1][1]
    query(f"R{_i}_{_code[4:].lower()}", sel(
        o.FEAT, f"transaction_id, '{_code}' AS rule_code, {_weight}::DOUBLE AS severity_penalty, '{_cat}' AS category", "feat", f"WHERE {_pred}"))(_rule(_code))


@query("R9_rule_score", sel(o.FEAT, f"transaction_id, {o.RULE_SCORE} AS rule_score, {o.RULE_LIST} AS rules", "feat"))
def _(spark, sf):
    return rules.with_rules(feat(spark, sf)).select("transaction_id", "rule_score", F.col("triggered_rules.rule_code").alias("rules"))


@query("R10_rule_hits", f"WITH {o.SCORED}, hits AS (SELECT unnest(string_split(rules, ',')) AS rule_code, date_trunc('day', \"timestamp\") AS window_start FROM scored WHERE rules <> '') "
       "SELECT rule_code, window_start::TIMESTAMP AS window_start, count(*) AS hits FROM hits GROUP BY 1, 2")
def _(spark, sf):
    return rules.rule_hits(rules.with_rules(feat(spark, sf)), "1 day")


# -- decision ---------------------------------------------------------------------------------------

@query("D1_risk_score", sel(o.SCORED, "transaction_id, risk_score", "scored"))
def _(spark, sf):
    return scored(spark, sf).select("transaction_id", "risk_score")


@query("D2_decision", sel(o.SCORED, f"transaction_id, {o.decision('risk_score')} AS decision", "scored"))
def _(spark, sf):
    return scored(spark, sf).select("transaction_id", "decision")


_COSTS = o.costs("amount", "p_raw")
_COST_SQL = ", ".join(f"{v} AS {k}" for k, v in _COSTS.items())


@query("D3_expected_costs", sel(o.TXN, f"transaction_id, {_COST_SQL}", "txn"))
def _(spark, sf):
    costs = policy.expected_costs(F.col("amount"), F.col("p_raw"))
    return txn(spark, sf).select("transaction_id", *[c.alias(n) for n, c in costs.items()])


@query("D4_score_transactions", sel(
    o.SCORED, f"transaction_id, customer_id, amount, behavior_score, rule_score, rules, {o.SIGNALS} AS behavior_signals, risk_score, "
    f"{o.decision('risk_score')} AS decision, {_COST_SQL}", "scored"))
def _(spark, sf):
    return scored(spark, sf).select(
        "transaction_id", "customer_id", "amount", "behavior_score", "rule_score", F.col("triggered_rules.rule_code").alias("rules"),
        "behavior_signals", "risk_score", "decision", "cost_approve", "cost_review", "cost_block")


@query("D5_fallback_scores", f"""WITH {o.FEAT}, sc AS (SELECT transaction_id, {o.BEHAVIOR} AS b, {o.RULE_SCORE} AS ru FROM feat),
 f AS (SELECT transaction_id, {o.r('least(100.0::DOUBLE, 100.0::DOUBLE * (0.55::DOUBLE * 0.05::DOUBLE + 0.15::DOUBLE * 0.1::DOUBLE + 0.15::DOUBLE * b + 0.15::DOUBLE * ru))', 2)} AS risk_score FROM sc)
 SELECT transaction_id, 0.05::DOUBLE AS raw_score, 0.05::DOUBLE AS calibrated_probability, 0.1::DOUBLE AS anomaly_score, risk_score, {o.decision('risk_score')} AS decision FROM f""")
def _(spark, sf):
    return decide_features(policy.fallback_scores(feat(spark, sf))).select(
        "transaction_id", "raw_score", "calibrated_probability", "anomaly_score", "risk_score", "decision")


@query("D6_cost_optimal_decision", f"WITH {o.TXN}, c AS (SELECT transaction_id, {_COST_SQL} FROM txn) SELECT transaction_id, "
       "CASE WHEN cost_approve <= cost_review AND cost_approve <= cost_block THEN 'APPROVE' WHEN cost_review <= cost_block THEN 'REVIEW' ELSE 'BLOCK' END AS cost_optimal FROM c")
def _(spark, sf):
    costs = policy.expected_costs(F.col("amount"), F.col("p_raw"))
    return txn(spark, sf).select("transaction_id", policy.cost_optimal_decision(
        costs["cost_approve"], costs["cost_review"], costs["cost_block"]).alias("cost_optimal"))


@query("D7_degraded_policy", f"WITH {o.STORE}, {o.PROFILES}, m AS (SELECT t.transaction_id, p.calibrated_probability IS NULL AS degraded, "
       f"(t.amount::DOUBLE > c.average_amount::DOUBLE * 3 OR t.country <> c.home_country) AS odd, {o.decision('t.p_raw * 100')} AS decision "
       "FROM txn t LEFT JOIN predictions p USING (transaction_id) LEFT JOIN cust c ON c.customer_id = t.customer_id) "
       "SELECT transaction_id, degraded, CASE WHEN degraded AND coalesce(odd, true) THEN 'REVIEW' WHEN degraded THEN 'APPROVE' ELSE decision END AS degraded_decision FROM m")
def _(spark, sf):
    t = txn(spark, sf)
    p = star.predictions(t).select("transaction_id", "calibrated_probability")
    ceilings = star.customers(spark, sf).withColumnRenamed("average_amount", "amount_ceiling")
    joined = t.join(p, "transaction_id", "left").withColumn("decision", policy.decision(F.col("p_raw") * 100.0))
    return policy.degraded_policy(joined, ceilings).select("transaction_id", "degraded", "degraded_decision")


# -- entities ---------------------------------------------------------------------------------------

@query("E1_account_maturity", sel(o.FEAT, "transaction_id, n_past, CASE WHEN n_past = 0 THEN 'COLD_START' WHEN n_past <= 3 THEN 'WARMING' ELSE 'MATURE' END AS account_maturity", "feat"))
def _(spark, sf):
    return entities.account_maturity(txn(spark, sf)).select("transaction_id", "n_past", "account_maturity")


@query("E2_shrunk_baseline", f"WITH {o.TXN}, s AS (SELECT customer_id, count(*) AS n, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS mean, stddev_samp(amount::DOUBLE) AS sd FROM txn GROUP BY 1) "
       f"SELECT customer_id, n AS observations, {o.r('(n * mean + 5 * 85.0::DOUBLE) / (n + 5)', 2)} AS shrunk_mean, "
       f"{o.r('CASE WHEN n > 1 THEN greatest(10.0::DOUBLE, (n * sd + 5 * 35.0::DOUBLE) / (n + 5)) ELSE 35.0::DOUBLE END', 2)} AS shrunk_std FROM s")
def _(spark, sf):
    return entities.shrunk_baseline(txn(spark, sf))


@query("E3_device_syndicates", f"WITH {o.TXN}, s AS (SELECT transaction_id, list(customer_id) OVER (PARTITION BY device_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS l, customer_id FROM txn), "
       "d AS (SELECT transaction_id, CAST(len(list_distinct(list_append(coalesce(l, []), customer_id))) AS BIGINT) AS distinct_customers FROM s) "
       "SELECT transaction_id, distinct_customers, distinct_customers >= 3 AS is_syndicate, CASE WHEN distinct_customers >= 5 THEN 0.5::DOUBLE WHEN distinct_customers >= 3 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS risk_boost FROM d")
def _(spark, sf):
    return entities.device_syndicates(txn(spark, sf)).select("transaction_id", "distinct_customers", "is_syndicate", "risk_boost")


@query("E4_known_entities", f"WITH {o.TXN}, p AS (SELECT customer_id, 'device' AS kind, device_id AS value, \"timestamp\" FROM txn UNION ALL SELECT customer_id, 'country', country, \"timestamp\" FROM txn) "
       "SELECT customer_id, kind, value, min(\"timestamp\") AS first_seen, max(\"timestamp\") AS last_seen FROM p WHERE \"timestamp\" <= TIMESTAMP '2024-01-20' AND \"timestamp\" > TIMESTAMP '2024-01-20' - INTERVAL 90 DAY GROUP BY 1, 2, 3")
def _(spark, sf):
    return entities.known_entities(txn(spark, sf), AS_OF, 90)


@query("E5_customer_history", f"WITH {o.TXN}, h AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY us DESC, transaction_id DESC) AS k FROM txn WHERE \"timestamp\" < TIMESTAMP '2024-01-20') "
       "SELECT customer_id, transaction_id, \"timestamp\", CAST(amount AS DOUBLE) AS amount FROM h WHERE k <= 20")
def _(spark, sf):
    return entities.customer_history(txn(spark, sf), AS_OF, 20).select("customer_id", "transaction_id", "timestamp", "amount")


@query("E6_customer_profile", f"""WITH {o.TXN}, {o.PROFILES}, a AS (SELECT customer_id, (epoch_us(TIMESTAMP '2024-01-20') - us) / 1e6 AS age, amount, device_id, country FROM txn WHERE "timestamp" <= TIMESTAMP '2024-01-20'),
 g AS (SELECT customer_id, count(*) FILTER (age <= 3600) AS c1, count(*) FILTER (age <= 86400) AS c24, CAST(sum(amount) FILTER (age <= 3600) AS DOUBLE) AS a1, CAST(max(amount) AS DOUBLE) AS mx, count(DISTINCT device_id) AS kd, count(DISTINCT country) AS kc FROM a GROUP BY 1)
 SELECT customer_id, home_country, home_city, CAST(average_amount AS DOUBLE) AS average_amount, CAST(std_amount AS DOUBLE) AS std_amount,
  greatest(1, coalesce(kd, 0)) AS known_devices, greatest(1, coalesce(kc, 0)) AS known_countries, coalesce(c1, 0) AS count_last_1h, coalesce(c24, 0) AS count_last_24h,
  coalesce(a1, 0.0::DOUBLE) AS amount_last_1h, mx AS max_amount, CASE WHEN coalesce(c1, 0) < 4 THEN 'STANDARD' ELSE 'ELEVATED' END AS risk_tier FROM cust LEFT JOIN g USING (customer_id)""")
def _(spark, sf):
    return entities.customer_profile(txn(spark, sf), star.customers(spark, sf), AS_OF)


@query("E7_backfill_dimension", f"WITH {o.TXN}, m AS (SELECT DISTINCT merchant_id, merchant_category FROM txn) SELECT merchant_id, "
       "CASE WHEN merchant_category = 'OTHER' THEN 'Default Merchant' ELSE 'Merchant ' || substr(merchant_id, 7) END AS name, "
       "CASE WHEN merchant_category = 'OTHER' THEN 'retail' ELSE merchant_category END AS category, '5411' AS mcc_code, 'US' AS country, 'New York' AS city, 'STANDARD' AS risk_tier FROM m")
def _(spark, sf):
    return entities.backfill_dimension(star.merchants(spark, sf), txn(spark, sf), "merchant_id", entities.DEFAULT_MERCHANT)


# -- splits -----------------------------------------------------------------------------------------

@query("T1_temporal_split", sel(o.SPLIT, "transaction_id, split", "parts"))
def _(spark, sf):
    return split.temporal_split(txn(spark, sf)).select("transaction_id", "split")


@query("T2_split_boundaries", sel(
    o.SPLIT, f"split, count(*) AS n_rows, min(\"timestamp\") AS first_ts, max(\"timestamp\") AS last_ts, {o.r('avg(is_fraud::INT) * 100', 3)} AS fraud_pct", "parts", "GROUP BY split"))
def _(spark, sf):
    return split.split_boundaries(split.temporal_split(txn(spark, sf)))


# -- calibration and evaluation ---------------------------------------------------------------------

_BINS = "CAST(least(9, " + " + ".join(f"CAST(p_raw >= {i * 0.1!r}::DOUBLE AS INT)" for i in range(1, 10)) + ") AS INTEGER)"
_CURVE = f"""{o.TXN}, b AS (SELECT {_BINS} AS bin, is_fraud::INT AS y, p_raw FROM txn),
 cb AS (SELECT bin, count(*) AS n, avg(y) AS actual, avg(p_raw) AS mp FROM b GROUP BY bin),
 ab AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin)"""


@query("C3_calibration_curve", f"WITH {_CURVE} SELECT ab.bin, {o.r('ab.bin * 0.1 + 0.05', 3)} AS bin_center, coalesce(n, 0) AS bin_count, {o.r('coalesce(actual, 0)', 4)} AS true_fraction FROM ab LEFT JOIN cb USING (bin)")
def _(spark, sf):
    return evaluate.calibration_curve(txn(spark, sf), "is_fraud", "p_raw").select("bin", "bin_center", "bin_count", "true_fraction")


@query("C4_calibration_error", f"WITH {_CURVE} SELECT (SELECT count(*) FROM b) AS samples, {o.r('(SELECT sum(n * abs(actual - mp)) FROM cb) / (SELECT count(*) FROM b)', 4)} AS expected_calibration_error, "
       f"{o.r('(SELECT avg((p_raw - y) * (p_raw - y)) FROM b)', 4)} AS brier_score")
def _(spark, sf):
    return evaluate.calibration_error(txn(spark, sf), "is_fraud", "p_raw")


def _ratio(a: str, b: str) -> str:
    return o.r(f"coalesce(({a}) / nullif(({b})::DOUBLE, 0), 0)", 4)


@query("G1_fraud_metrics", f"""WITH {o.TXN}, c AS (SELECT count(*) FILTER (is_fraud AND p_raw >= 0.5) AS tp, count(*) FILTER (NOT is_fraud AND p_raw >= 0.5) AS fp,
 count(*) FILTER (NOT is_fraud AND p_raw < 0.5) AS tn, count(*) FILTER (is_fraud AND p_raw < 0.5) AS fn, avg((p_raw - is_fraud::INT) * (p_raw - is_fraud::INT)) AS b FROM txn)
 SELECT 0.5::DOUBLE AS threshold, {_ratio('tp', 'tp + fp')} AS "precision", {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
 {_ratio('fp', 'fp + tn')} AS false_positive_rate, {_ratio('fn', 'fn + tp')} AS false_negative_rate, {o.r('b', 4)} AS brier_score, tp, fp, tn, fn,
 tp + fp + tn + fn AS total_samples, tp + fn AS fraud_samples, tn + fp AS legitimate_samples FROM c""")
def _(spark, sf):
    return evaluate.fraud_metrics(txn(spark, sf), "is_fraud", "p_raw")


@query("G2_roc_auc", f"WITH {o.POINTS} SELECT {o.r('sum(pos * (neg_below + neg / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n))', 4)} AS roc_auc FROM cum")
def _(spark, sf):
    return evaluate.roc_auc(evaluate.score_points(txn(spark, sf), "is_fraud", "p_raw"))


@query("G3_average_precision", f"WITH {o.POINTS} SELECT {o.r('sum(pos / p::DOUBLE * tp / (tp + fp)::DOUBLE)', 4)} AS pr_auc FROM cum")
def _(spark, sf):
    return evaluate.average_precision(evaluate.score_points(txn(spark, sf), "is_fraud", "p_raw"))


@query("G4_threshold_grid", sel(o.GRID, "*", "grid"))
def _(spark, sf):
    return evaluate.threshold_grid(txn(spark, sf), "is_fraud", "p_raw", "amount")


@query("G5_optimal_thresholds", f"WITH {o.GRID} SELECT * FROM (SELECT *, 'f2' AS objective FROM grid ORDER BY f2 DESC, threshold LIMIT 1) UNION ALL SELECT * FROM (SELECT *, 'cost' AS objective FROM grid ORDER BY total_cost, threshold LIMIT 1)")
def _(spark, sf):
    return evaluate.optimal_thresholds(evaluate.threshold_grid(txn(spark, sf), "is_fraud", "p_raw", "amount"))


@query("G6_recall_at", f"WITH {o.POINTS} SELECT 'precision>=0.3' AS bound, {o.r('coalesce(max(tp / p::DOUBLE) FILTER (tp / (tp + fp)::DOUBLE >= 0.3), 0)', 4)} AS recall FROM cum "
       f"UNION ALL SELECT 'fpr<=0.05', {o.r('coalesce(max(tp / p::DOUBLE) FILTER (fp / n::DOUBLE <= 0.05), 0)', 4)} FROM cum")
def _(spark, sf):
    points = evaluate.score_points(txn(spark, sf), "is_fraud", "p_raw")
    a = evaluate.recall_at(points, min_precision=0.3).select(F.lit("precision>=0.3").alias("bound"), "recall")
    return a.unionByName(evaluate.recall_at(points, max_fpr=0.05).select(F.lit("fpr<=0.05").alias("bound"), "recall"))


# -- drift ------------------------------------------------------------------------------------------

def _sides(spark, sf):
    side = F.when(F.col("timestamp") < F.lit(DRIFT_REF_END), "r").when(F.col("timestamp") >= F.lit(DRIFT_CUR_START), "c")
    return feat(spark, sf).withColumn("side", side)


@query("X1_psi", sel(o.DRIFT, "feature, psi", "rep"))
def _(spark, sf):
    return drift.psi(_sides(spark, sf), FEATURES)


@query("X2_ks_test", sel(o.DRIFT, "feature, ks_statistic, p_value", "rep"))
def _(spark, sf):
    return drift.ks_test(_sides(spark, sf), FEATURES)


@query("X3_drift_report", sel(o.DRIFT, "feature, psi, ks_statistic, p_value, status", "rep"))
def _(spark, sf):
    return drift.drift_report(_sides(spark, sf), FEATURES)


@query("X4_drift_overall", f"""WITH {o.DRIFT}, c AS (SELECT count(*) AS total_features_monitored, count(*) FILTER (status <> 'NO_DRIFT') AS drifted_features_count, count(*) FILTER (status = 'CRITICAL_DRIFT') AS critical_features_count FROM rep)
 SELECT *, CASE WHEN critical_features_count > 0 OR drifted_features_count / total_features_monitored::DOUBLE > 0.25 THEN 'CRITICAL_DRIFT_DETECTED' WHEN drifted_features_count > 0 THEN 'MODERATE_DRIFT_DETECTED' ELSE 'STABLE' END AS overall_status FROM c""")
def _(spark, sf):
    return drift.drift_overall(drift.drift_report(_sides(spark, sf), FEATURES))


TOP_DRIFT = ["amount", "amount_to_avg_ratio"]
_WINDOW_PSI = f"""wt AS (SELECT CAST("timestamp" AS DATE) + CAST(k AS INTEGER) AS window_end, feature, value FROM
   (SELECT "timestamp", unnest(['amount', 'amount_to_avg_ratio']) AS feature, unnest([CAST(amount AS DOUBLE), amount_to_avg_ratio]) AS value FROM feat), (SELECT unnest(range(7)) AS k)),
 wc AS (SELECT CAST(window_end AS DATE) AS window_end, feature, len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS c FROM wt JOIN edges USING (feature)
   WHERE window_end <= (SELECT max(CAST("timestamp" AS DATE)) FROM feat) GROUP BY 1, 2, 3),
 wb AS (SELECT x.window_end, b.feature, b.bin, nb, r, coalesce(wc.c, 0) AS c, sum(coalesce(wc.c, 0)) OVER (PARTITION BY x.window_end, b.feature) AS tc
   FROM (SELECT DISTINCT window_end, feature FROM wc) x JOIN cnts b USING (feature) LEFT JOIN wc USING (window_end, feature, bin)),
 ws AS (SELECT window_end, feature, (r / tr::DOUBLE + 1e-4) / (1 + nb * 1e-4) AS e, (c / wb.tc::DOUBLE + 1e-4) / (1 + nb * 1e-4) AS a FROM wb JOIN tot USING (feature)),
 wp AS (SELECT window_end, feature, {o.r('greatest(0.0::DOUBLE, sum((a - e) * ln(a / e)))', 4)} AS psi FROM ws GROUP BY 1, 2)"""


def _window_psi(spark, sf):
    return drift.sliding_psi(feat(spark, sf), F.col("timestamp") < F.lit(DRIFT_REF_END), TOP_DRIFT)


#: The name that the report over all features had.
@query("X3_drift_report_all_features", sel(o.DRIFT, "feature, psi, ks_statistic, p_value, status", "rep"))
def _(spark, sf):
    return QUERIES["X3_drift_report"](spark, sf)


@query("X5_retrain_trigger", f"""WITH {o.DRIFT}, d AS (SELECT p_raw, is_fraud, CAST("timestamp" AS DATE) AS day FROM txn),
 w AS (SELECT CAST(day + CAST(k AS INTEGER) AS DATE) AS window_end, p_raw, is_fraud FROM d, (SELECT unnest(range(7)) AS k)),
 pp AS (SELECT window_end, p_raw AS score, count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM w WHERE window_end <= (SELECT max(day) FROM d) GROUP BY 1, 2),
 cc AS (SELECT *, sum(pos) OVER (PARTITION BY window_end ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY window_end ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY window_end) AS p FROM pp),
 ap AS (SELECT window_end, {o.r('coalesce(sum(pos / nullif(p, 0)::DOUBLE * tp / (tp + fp)::DOUBLE), 0)', 4)} AS pr_auc FROM cc GROUP BY 1),
 {_WINDOW_PSI},
 ps AS (SELECT window_end, max(psi) AS worst_psi FROM wp GROUP BY window_end)
 SELECT window_end, pr_auc, coalesce(worst_psi, 0) AS worst_psi, pr_auc < 0.75 OR coalesce(worst_psi, 0) > 0.25 AS retrain FROM ap LEFT JOIN ps USING (window_end)""")
def _(spark, sf):
    return drift.retrain_trigger(txn(spark, sf), "is_fraud", "p_raw", _window_psi(spark, sf), TOP_DRIFT)


@query("X5_window_psi", f"WITH {o.DRIFT}, {_WINDOW_PSI} SELECT window_end, feature, psi FROM wp")
def _(spark, sf):
    return _window_psi(spark, sf)


# -- exploration ------------------------------------------------------------------------------------

A1_SQL = f"""WITH {o.TXN}, c AS (SELECT count(*) AS total_transactions, count(*) FILTER (is_fraud) AS fraudulent_transactions, min("timestamp") AS start_time, max("timestamp") AS end_time, min(us) AS a, max(us) AS b FROM txn)
 SELECT total_transactions, fraudulent_transactions, start_time, end_time, total_transactions - fraudulent_transactions AS legitimate_transactions,
 {o.r('fraudulent_transactions / total_transactions::DOUBLE * 100', 3)} AS fraud_rate_percentage, '1:' || CAST(floor((total_transactions - fraudulent_transactions) / greatest(fraudulent_transactions, 1)::DOUBLE) AS BIGINT) AS class_imbalance_ratio,
 {o.r('(b - a) / 86400000000.0::DOUBLE', 2)} AS duration_days FROM c"""


@query("A1_overview", A1_SQL)
def _(spark, sf):
    return explore.overview(txn(spark, sf))


_SEG = f"""{o.TXN}, t2 AS (SELECT 'overall' AS segment, amount, cents FROM txn UNION ALL SELECT CASE WHEN is_fraud THEN 'fraudulent' ELSE 'legitimate' END, amount, cents FROM txn)"""


@query("A2_amount_by_class", f"WITH {_SEG} SELECT segment, count(*) AS transactions, {o.r('CAST(sum(cents) AS DOUBLE) / count(*) / 100', 2)} AS mean, {o.r('stddev_samp(amount::DOUBLE)', 2)} AS std, CAST(max(amount) AS DOUBLE) AS max, "
       f"{o.r(o.pct('amount', 0.5), 2)} AS median, {o.r(o.pct('amount', 0.75), 2)} AS p75, {o.r(o.pct('amount', 0.95), 2)} AS p95 FROM t2 GROUP BY segment")
def _(spark, sf):
    return explore.amount_by_class(txn(spark, sf))


@query("A3_cardinality", sel(o.TXN, "count(DISTINCT customer_id) AS unique_customers, count(DISTINCT merchant_id) AS unique_merchants, count(DISTINCT device_id) AS unique_devices, count(DISTINCT country) AS unique_countries, count(DISTINCT city) AS unique_cities", "txn"))
def _(spark, sf):
    return explore.cardinality(txn(spark, sf))


@query("A4_fraud_by", f"""WITH {o.TXN}, d AS (SELECT 'hour' AS dimension, CAST(hour("timestamp") AS VARCHAR) AS value, is_fraud FROM txn UNION ALL SELECT 'merchant_category', merchant_category, is_fraud FROM txn UNION ALL SELECT 'country', country, is_fraud FROM txn)
 SELECT dimension, value, count(*) AS transactions, {o.r('avg(is_fraud::INT)', 6)} AS fraud_rate FROM d GROUP BY 1, 2""")
def _(spark, sf):
    return explore.fraud_by(txn(spark, sf))


# -- store ------------------------------------------------------------------------------------------

def tables(spark, sf):
    t = txn(spark, sf)
    return t, star.decisions(t), star.predictions(t)


_LIST = ('t.transaction_id, t."timestamp", t.customer_id, t.merchant_id, CAST(t.amount AS DOUBLE) AS amount, t.country, t.device_id, '
         "coalesce(d.decision, 'PENDING') AS decision, CAST(d.risk_score AS DOUBLE) AS risk_score, coalesce(d.rules, '') AS rules, p.calibrated_probability, p.anomaly_score, p.inference_latency_ms")
_LIST_FROM = "txn t LEFT JOIN decisions d USING (transaction_id) LEFT JOIN predictions p USING (transaction_id)"


def _listing(df):
    return df.withColumn("rules", F.col("triggered_rules.rule_code")).select(
        "transaction_id", "timestamp", "customer_id", "merchant_id", "amount", "country", "device_id", "decision",
        "risk_score", "rules", "calibrated_probability", "anomaly_score", "inference_latency_ms")


@query("K1_list_transactions", f"WITH {o.STORE} SELECT {_LIST} FROM {_LIST_FROM} ORDER BY t.us DESC, t.transaction_id DESC LIMIT 50 OFFSET 10")
def _(spark, sf):
    return _listing(store.list_transactions(*tables(spark, sf), limit=50, offset=10))


@query("K1_list_transactions_review", f"WITH {o.STORE} SELECT {_LIST} FROM {_LIST_FROM} WHERE d.decision = 'REVIEW' ORDER BY t.us DESC, t.transaction_id DESC LIMIT 50")
def _(spark, sf):
    return _listing(store.list_transactions(*tables(spark, sf), limit=50, decision="review"))


@query("K2_transaction_detail", f"WITH {o.STORE} SELECT {_LIST} FROM {_LIST_FROM} WHERE t.transaction_id = 'TXN-100-2'")
def _(spark, sf):
    return _listing(store.transaction_detail(*tables(spark, sf), "TXN-100-2"))


@query("K2_explanation", f"WITH {o.STORE} SELECT transaction_id, {o.r('(SELECT avg(is_fraud::INT) FROM txn)', 6)} AS base_value, calibrated_probability AS prediction_value, "
       "CASE WHEN calibrated_probability > 0.5 THEN round(calibrated_probability - 0.5, 4) END AS top_positive_impact FROM predictions WHERE transaction_id = 'TXN-100-2'")
def _(spark, sf):
    t, _, p = tables(spark, sf)
    base = t.agg(rounded(F.avg(F.col("is_fraud").cast("double")), 6)).first()[0]
    return store.explanation(p, "TXN-100-2", base).select(
        "transaction_id", "base_value", "prediction_value", F.try_element_at("top_positive_features", F.lit(1))["impact"].alias("top_positive_impact"))


@query("K2_risk_breakdown", f"WITH {o.STORE} SELECT transaction_id, CAST(risk_score AS DOUBLE) AS risk_score, decision, CAST(cost_estimate_fn AS DOUBLE) AS cost_estimate_fn, CAST(cost_estimate_fp AS DOUBLE) AS cost_estimate_fp, nullif(rules, '') AS rule_code FROM decisions WHERE transaction_id = 'TXN-100-2'")
def _(spark, sf):
    _, d, _ = tables(spark, sf)
    return store.risk_breakdown(d, "TXN-100-2").select("transaction_id", "risk_score", "decision", "cost_estimate_fn", "cost_estimate_fp", "rule_code")


def _batch(spark, sf):
    """Stored first twenty days; the batch is everything from the fifteenth day on, each row sent twice."""
    t = txn(spark, sf).withColumn("idempotency_key", F.concat(F.col("customer_id"), F.lit("|"), F.date_format("timestamp", "yyyy-MM-dd HH")))
    stored = store.first_per_key(t.where(F.col("timestamp") < F.lit(AS_OF)), "idempotency_key", ["timestamp", "transaction_id"])
    sent = t.where(F.col("timestamp") >= F.lit(datetime(2024, 1, 15)))
    return stored, sent.unionByName(sent)


@query("K3_insert_if_absent", f"""WITH {o.TXN}, k AS (SELECT transaction_id, us, "timestamp", customer_id || '|' || strftime("timestamp", '%Y-%m-%d %H') AS idempotency_key FROM txn),
 stored AS (SELECT * FROM k WHERE "timestamp" < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY us, transaction_id) = 1),
 b AS (SELECT * FROM k WHERE "timestamp" >= TIMESTAMP '2024-01-15' AND transaction_id NOT IN (SELECT transaction_id FROM stored) AND idempotency_key NOT IN (SELECT idempotency_key FROM stored))
 SELECT transaction_id, idempotency_key FROM b QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY us, transaction_id) = 1""")
def _(spark, sf):
    stored, sent = _batch(spark, sf)
    return store.insert_if_absent(stored, sent, ["transaction_id", "idempotency_key"], ["timestamp", "transaction_id"]).select("transaction_id", "idempotency_key")


@query("K3_key_index", f"""WITH {o.TXN}, k AS (SELECT transaction_id, us, "timestamp", customer_id || '|' || strftime("timestamp", '%Y-%m-%d %H') AS idempotency_key FROM txn),
 stored AS (SELECT * FROM k WHERE "timestamp" < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY us, transaction_id) = 1),
 b AS (SELECT * FROM k WHERE "timestamp" >= TIMESTAMP '2024-01-15')
 SELECT transaction_id, idempotency_key FROM stored
 WHERE transaction_id IN (SELECT transaction_id FROM b) OR idempotency_key IN (SELECT idempotency_key FROM b)""")
def _(spark, sf):
    stored, sent = _batch(spark, sf)
    path = scratch_path(spark, "key-index")
    stored.select("transaction_id", "idempotency_key").write.parquet(path)
    return KeyIndex(spark, path, ["transaction_id", "idempotency_key"]).matching(sent)


def _crossing(t):
    """Every transaction under the key of its customer and hour, and again with the id of the customer's one before."""
    keyed = t.withColumn("idempotency_key", F.concat(F.col("customer_id"), F.lit("|"), F.date_format("timestamp", "yyyy-MM-dd HH")))
    before = F.lag("transaction_id").over(Window.partitionBy("customer_id").orderBy("timestamp", "transaction_id"))
    again = keyed.withColumn("transaction_id", before).where(F.col("transaction_id").isNotNull())
    first = keyed.select("transaction_id", "idempotency_key", "timestamp", F.lit(1).alias("seq"))
    return first.unionByName(again.select("transaction_id", "idempotency_key", F.col("timestamp"), F.lit(0).alias("seq")))


@query("K3_first_write_wins", f"""WITH RECURSIVE {o.TXN}, k AS (SELECT transaction_id, customer_id, us, customer_id || '|' || strftime("timestamp", '%Y-%m-%d %H') AS idempotency_key FROM txn),
 b AS (SELECT transaction_id, customer_id, us, idempotency_key, 1 AS seq FROM k
  UNION ALL SELECT * FROM (SELECT lag(transaction_id) OVER (PARTITION BY customer_id ORDER BY us, transaction_id) AS transaction_id, customer_id, us, idempotency_key, 0 FROM k) WHERE transaction_id IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY us, seq, transaction_id) AS n FROM b),
 w AS (SELECT customer_id, n, transaction_id, idempotency_key, true AS kept, [transaction_id] AS ids, [idempotency_key] AS keys FROM r WHERE n = 1
  UNION ALL SELECT r.customer_id, r.n, r.transaction_id, r.idempotency_key, NOT list_contains(ids, r.transaction_id) AND NOT list_contains(keys, r.idempotency_key),
   CASE WHEN NOT list_contains(ids, r.transaction_id) AND NOT list_contains(keys, r.idempotency_key) THEN list_append(ids, r.transaction_id) ELSE ids END,
   CASE WHEN NOT list_contains(ids, r.transaction_id) AND NOT list_contains(keys, r.idempotency_key) THEN list_append(keys, r.idempotency_key) ELSE keys END
  FROM w JOIN r ON r.customer_id = w.customer_id AND r.n = w.n + 1)
 SELECT transaction_id, idempotency_key FROM w WHERE kept""")
def _(spark, sf):
    batch = _crossing(txn(spark, sf))
    return store.first_write_wins(batch, ["transaction_id", "idempotency_key"], ["timestamp", "seq", "transaction_id"]).select("transaction_id", "idempotency_key")


@query("K4_consolidate_labels", f"WITH {o.TXN}, {o.FEEDBACK}, l AS (SELECT transaction_id, actual_label = 'FRAUD' AS is_fraud, 'analyst:' || analyst_id AS label_source, created_at AS confirmed_at FROM fb QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY created_at DESC) = 1) "
       "SELECT * FROM l UNION ALL SELECT transaction_id, is_fraud, 'chargeback', \"timestamp\" FROM txn WHERE is_fraud AND transaction_id NOT IN (SELECT transaction_id FROM l)")
def _(spark, sf):
    existing = txn(spark, sf).where("is_fraud").select("transaction_id", "is_fraud", F.lit("chargeback").alias("label_source"), F.col("timestamp").alias("confirmed_at"))
    return store.consolidate_labels(star.feedback(spark, sf), existing)


def _registry(spark, sf):
    """One model version per day, its areas taken from that day's labels."""
    daily = txn(spark, sf).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("d")).agg(
        F.avg(F.col("is_fraud").cast("double")).alias("rate"), F.max("timestamp").alias("t"))
    return daily.select(
        F.concat(F.lit("v"), F.col("d")).alias("version_id"), F.lit("boosted_champion").alias("model_name"), F.lit("gbt").alias("algorithm"),
        (F.col("rate") > 0.05).alias("is_champion"), rounded(F.col("rate"), 4).alias("pr_auc"), F.lit(0.9).alias("roc_auc"),
        F.lit(0.01).alias("brier_score"), F.col("t").alias("trained_at"), F.col("t").alias("deployed_at"),
        F.to_json(F.struct(F.col("d").alias("day"), F.lit(4).alias("depth"))).alias("parameters"))


_REG = f"{o.TXN}, reg AS (SELECT 'v' || strftime(\"timestamp\", '%Y-%m-%d') AS version_id, avg(is_fraud::INT) AS rate, max(\"timestamp\") AS t FROM txn GROUP BY 1)"


@query("K6_champion_model", f"WITH {_REG} SELECT version_id, {o.r('rate', 4)} AS pr_auc, t AS deployed_at FROM reg WHERE rate > 0.05 ORDER BY t DESC LIMIT 1")
def _(spark, sf):
    return store.champion_model(_registry(spark, sf)).select("version_id", "pr_auc", "deployed_at")


@query("K6_register_model", f"WITH {_REG} SELECT version_id, rate > 0.05 AS is_champion, {o.r('rate', 4)} AS pr_auc, '{{\"day\":\"' || substr(version_id, 2) || '\",\"depth\":4}}' AS parameters FROM reg")
def _(spark, sf):
    everything = _registry(spark, sf)
    half = everything.where(F.col("deployed_at") < F.lit(AS_OF))
    return store.model_versions(store.register_model(half, everything)).select("version_id", "is_champion", "pr_auc", "parameters")


@query("K7_summary_kpis", f"""WITH {o.STORE} SELECT (SELECT count(*) FROM txn) AS total_transactions, (SELECT CAST(sum(amount) AS DOUBLE) FROM txn) AS total_volume,
 count(*) FILTER (decision = 'APPROVE') AS approved_count, count(*) FILTER (decision = 'REVIEW') AS review_count, count(*) FILTER (decision = 'BLOCK') AS blocked_count,
 {o.r('CAST(sum(risk_score) AS DOUBLE) / count(*)', 2)} AS average_risk_score, {o.r("count(*) FILTER (decision = 'BLOCK') / (SELECT count(*) FROM txn)::DOUBLE * 100", 2)} AS block_rate_pct FROM decisions""")
def _(spark, sf):
    t, d, _ = tables(spark, sf)
    return store.summary_kpis(t, d)


@query("K8_risk_distribution", f"WITH {o.STORE}, g AS (SELECT unnest(range(0, 100, 10)) AS s), c AS (SELECT least(90, floor(risk_score::DOUBLE / 10) * 10) AS s, count(*) AS n FROM decisions GROUP BY 1) "
       "SELECT g.s || '-' || (g.s + 10) AS bucket, coalesce(n, 0) AS count FROM g LEFT JOIN c ON g.s = c.s")
def _(spark, sf):
    _, d, _ = tables(spark, sf)
    return store.risk_distribution(d)


@query("K9_search", f"WITH {o.STORE} SELECT transaction_id, customer_id, decision FROM decisions WHERE (contains(lower(transaction_id), 'txn-10') OR contains(lower(customer_id), 'txn-10')) AND decision = 'APPROVE'")
def _(spark, sf):
    _, d, _ = tables(spark, sf)
    return store.search(d, "Txn-10", "APPROVE").select("transaction_id", "customer_id", "decision")


@query("K9_search_indexed", f"WITH {o.STORE} SELECT transaction_id, customer_id, decision FROM decisions WHERE contains(lower(transaction_id), '-123') OR contains(lower(customer_id), '-123')")
def _(spark, sf):
    _, d, _ = tables(spark, sf)
    path = scratch_path(spark, "search")
    tables_io.write_search_index(d, path, ["transaction_id", "customer_id"])
    return store.search(d, "-123", candidates=tables_io.search_candidates(spark, path, "-123")).select("transaction_id", "customer_id", "decision")


@query("K10_merge_live", f"""WITH {o.TXN}, live AS (SELECT * FROM txn WHERE is_fraud), st AS (SELECT * FROM txn WHERE "timestamp" < TIMESTAMP '2024-01-30 12:00:00'),
 u AS (SELECT *, 'live' AS source FROM live WHERE transaction_id NOT IN (SELECT transaction_id FROM st) UNION ALL SELECT *, 'stored' FROM st)
 SELECT transaction_id, source, "timestamp" FROM u ORDER BY source, us DESC, transaction_id DESC LIMIT 30""")
def _(spark, sf):
    t = txn(spark, sf).select("transaction_id", "timestamp", "is_fraud")
    merged = store.merge_live(t.where("is_fraud"), t.where(F.col("timestamp") < F.lit(datetime(2024, 1, 30, 12))))
    return merged.select("transaction_id", "source", "timestamp")


@query("K11_training_extract", f"WITH {o.FEAT}, {o.FEEDBACK}, l AS (SELECT transaction_id, actual_label = 'FRAUD' AS is_fraud, 'analyst:' || analyst_id AS label_source FROM fb QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY created_at DESC) = 1) "
       "SELECT f.transaction_id, f.customer_id, f.amount, f.customer_amount_zscore, f.txn_count_24h, f.device_customer_count, l.is_fraud, l.label_source FROM feat f JOIN l USING (transaction_id)")
def _(spark, sf):
    features = history.build_features(txn(spark, sf), star.customers(spark, sf))
    labels = store.consolidate_labels(star.feedback(spark, sf))
    return store.training_extract(txn(spark, sf), features, labels).select(
        "transaction_id", "customer_id", "amount", "customer_amount_zscore", "txn_count_24h", "device_customer_count", "is_fraud", "label_source")


@query("K12_fraud_trends", f"WITH {o.TXN} SELECT CAST(date_trunc('hour', \"timestamp\") AS TIMESTAMP) AS bucket_start, count(*) FILTER (is_fraud) AS fraud_count, count(*) FILTER (NOT is_fraud) AS genuine_count, "
       "coalesce(CAST(sum(amount) FILTER (is_fraud) AS DOUBLE), 0.0::DOUBLE) AS fraud_volume, coalesce(CAST(sum(amount) FILTER (NOT is_fraud) AS DOUBLE), 0.0::DOUBLE) AS genuine_volume FROM txn GROUP BY 1")
def _(spark, sf):
    return store.fraud_trends(txn(spark, sf))


@query("K13_constraint_report", f"""WITH {o.STORE}, {o.FEEDBACK} SELECT 'transactions_customer_fk' AS constraint_name, count(*) FILTER (customer_id NOT IN (SELECT 'CUST-' || c_custkey FROM customer)) AS violations FROM txn
 UNION ALL SELECT 'transactions_merchant_fk', count(*) FILTER (merchant_category = 'OTHER') FROM txn
 UNION ALL SELECT 'decisions_transaction_fk', 0
 UNION ALL SELECT 'transactions_pk', count(*) - count(DISTINCT transaction_id) FROM txn
 UNION ALL SELECT 'decisions_transaction_unique', count(*) - count(DISTINCT transaction_id) FROM decisions
 UNION ALL SELECT 'decisions_score_range', count(*) FILTER (risk_score NOT BETWEEN 0 AND 100) FROM decisions
 UNION ALL SELECT 'decisions_value', count(*) FILTER (decision NOT IN ('APPROVE','REVIEW','BLOCK')) FROM decisions
 UNION ALL SELECT 'feedback_label', count(*) FILTER (actual_label NOT IN ('FRAUD','LEGITIMATE')) FROM fb""")
def _(spark, sf):
    t, d, _ = tables(spark, sf)
    return store.constraint_report(t, star.customers(spark, sf), star.merchants(spark, sf), d, star.feedback(spark, sf))


# -- monitoring -------------------------------------------------------------------------------------

@query("O1_counts_by", f"WITH {o.STORE} SELECT decision, 'v1' AS policy_version, count(*) AS total FROM decisions GROUP BY 1")
def _(spark, sf):
    _, d, _ = tables(spark, sf)
    return monitor.counts_by(d.withColumn("policy_version", F.lit("v1")), "decision", "policy_version")


def _hist_sql(value: str, edges: list[float], source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {e!r}::DOUBLE AS upper_edge, count(*) FILTER ({value} <= {e!r}::DOUBLE) AS cumulative_count FROM {source}" for e in edges)
    return f"{rows} UNION ALL SELECT 'inf'::DOUBLE, count({value}) FROM {source}"


@query("O2_bucket_histogram", f"WITH {o.TXN} " + _hist_sql("p_raw", monitor.PROBABILITY_EDGES, "txn"))
def _(spark, sf):
    return monitor.bucket_histogram(txn(spark, sf), "p_raw", monitor.PROBABILITY_EDGES)


LAT_SQL = _LAT = "lat_t AS (SELECT event_type AS step, value / 1000 AS seconds, value AS latency_ms, ts FROM events)"


@query("O2_latency_histogram", f"WITH {_LAT}, e AS (SELECT unnest([{', '.join(repr(x) + '::DOUBLE' for x in monitor.STAGE_EDGES)}, 'inf'::DOUBLE]) AS upper_edge) "
       "SELECT step, upper_edge, count(*) FILTER (seconds <= upper_edge) AS cumulative_count FROM lat_t, e GROUP BY 1, 2")
def _(spark, sf):
    rows = star.latencies(spark, sf).withColumn("seconds", F.col("latency_ms") / 1000)
    return monitor.bucket_histogram(rows, "seconds", monitor.STAGE_EDGES, ["step"])


@query("O3_throughput", f"WITH {o.TXN} SELECT CAST(date_trunc('minute', \"timestamp\") AS TIMESTAMP) AS window_start, count(*) AS events, {o.r('count(*) / 60.0::DOUBLE', 4)} AS events_per_second FROM txn GROUP BY 1")
def _(spark, sf):
    return monitor.throughput(txn(spark, sf))


@query("O4_block_rate", f"WITH {o.STORE} SELECT {o.r("count(*) FILTER (decision = 'BLOCK') / count(*)::DOUBLE * 100", 4)} AS block_rate_pct FROM decisions")
def _(spark, sf):
    _, d, _ = tables(spark, sf)
    return monitor.block_rate(d)


_P = ", ".join(f"{o.r(f'quantile_cont(latency_ms, {q})', 2)} AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))


@query("O5_latency_percentiles", f"WITH {_LAT} SELECT step, count(*) AS samples, {_P}, {o.r('avg(latency_ms)', 2)} AS mean FROM lat_t GROUP BY step")
def _(spark, sf):
    return monitor.latency_percentiles(star.latencies(spark, sf))


@query("O5_latency_percentiles_windowed", f"WITH {_LAT} SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, step, count(*) AS samples, {_P}, {o.r('avg(latency_ms)', 2)} AS mean FROM lat_t GROUP BY 1, 2")
def _(spark, sf):
    return monitor.latency_percentiles(star.latencies(spark, sf), "1 hour")


# -- privacy ----------------------------------------------------------------------------------------

_IP = ("CASE WHEN ip_address IS NULL OR ip_address IN ('', 'unknown') THEN '0.0.0.0' WHEN regexp_matches(ip_address, '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') "
       "THEN split_part(ip_address, '.', 1) || '.' || split_part(ip_address, '.', 2) || '.***.***' WHEN contains(ip_address, ':') THEN split_part(ip_address, ':', 1) || ':****:****' ELSE '***.***.***.***' END")
_TOKEN = "CASE WHEN payment_method = '' OR payment_method IS NULL THEN 'TOKEN-****' WHEN length(trim(payment_method)) <= 4 THEN '****' ELSE '****-****-****-' || right(trim(payment_method), 4) END"


@query("Y1_mask_ip", sel(o.TXN, f"transaction_id, {_IP} AS masked", "txn"))
def _(spark, sf):
    return txn(spark, sf).select("transaction_id", privacy.mask_ip(F.col("ip_address")).alias("masked"))


@query("Y2_mask_token", sel(o.TXN, f"transaction_id, {_TOKEN} AS masked", "txn"))
def _(spark, sf):
    return txn(spark, sf).select("transaction_id", privacy.mask_token(F.col("payment_method")).alias("masked"))


@query("Y3_sanitize", sel(o.TXN, f"transaction_id, customer_id, {_IP} AS ip_address, CASE WHEN contains(lower(payment_method), 'token') THEN {_TOKEN} ELSE payment_method END AS payment_method, '[REDACTED]' AS cvv", "txn"))
def _(spark, sf):
    payload = txn(spark, sf).select("transaction_id", "customer_id", "ip_address", "payment_method", (F.col("event_id") % 1000).cast("string").alias("cvv"))
    return privacy.sanitize(payload)


@query("Y4_idempotency_key", sel(o.TXN, "transaction_id, sha256(customer_id || '|' || CAST(amount AS VARCHAR) || '|' || strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S') || '|fraud-salt') AS idempotency_key", "txn"))
def _(spark, sf):
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return txn(spark, sf).select("transaction_id", privacy.idempotency_key(F.col("customer_id"), F.col("amount"), stamp).alias("idempotency_key"))
