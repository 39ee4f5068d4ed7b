"""ANSI SQL for the same questions, over the same parquet tables, for the correctness check."""

from __future__ import annotations

from riskloom.schemas import FEATURES

TXN = """
ev AS (
  SELECT e.*, unnest(CASE WHEN event_id % 50 = 0 THEN [0,1,2,3,4] ELSE [0] END) AS i,
         CASE WHEN event_id % 10 < 8 THEN user_id % 25 ELSE event_id % 25 END AS nk,
         (event_id * 31) % 50 AS mk
  FROM events e),
txn AS (
  SELECT 'TXN-' || event_id || '-' || i AS transaction_id,
         ts + to_seconds(i * 10) AS "timestamp",
         epoch_us(ts) + i * 10000000 AS us,
         'CUST-' || user_id AS customer_id,
         'MERCH-' || mk AS merchant_id,
         CAST(value * 100 AS DECIMAL(12,2)) AS amount,
         CAST(round(value * 10000) AS BIGINT) AS cents,
         'USD' AS currency, n_name AS country,
         'CITY-' || nk || '-' || (event_id % 3) AS city,
         nk * 5.0::DOUBLE - 60.0::DOUBLE AS lat, nk * 13.5::DOUBLE - 170.0::DOUBLE AS lon,
         'DEV-' || json_extract_string(props, '$.k') AS device_id,
         CASE WHEN event_type = 'purchase' THEN 'TOKEN_CC_' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
              ELSE 'UPI' END AS payment_method,
         CASE WHEN event_id % 7 = 0 THEN NULL
              WHEN event_id % 7 = 1 THEN '2001:db8:0:' || (event_id % 100) || '::' || (event_id % 9)
              ELSE '10.' || (event_id % 250) || '.' || (event_id % 199) || '.' || (event_id % 97) END AS ip_address,
         ['JEWELRY_LUXURY','DIGITAL_WALLET_TRANSFER','ELECTRONICS','GAMING_CASINO','DEPARTMENT_STORE',
          'GAS_STATION','UTILITIES','GROCERY','RESTAURANT','OTHER'][mk % 10 + 1] AS merchant_category,
         (value > 200 OR (event_type = 'error' AND value > 60)) AS is_fraud,
         round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(value - 120.0::DOUBLE) / 40.0::DOUBLE)), 6) AS p_raw,
         least(1.0::DOUBLE, value / 500.0::DOUBLE) AS anomaly,
         event_id * 5 + i AS ingest_order, event_id
  FROM ev JOIN nation ON n_nationkey = nk)
"""

PROFILES = """
cust AS (
  SELECT 'CUST-' || user_id AS customer_id, n_name AS home_country, 'CITY-' || (user_id % 25) || '-0' AS home_city,
         CAST(greatest(0, c_acctbal) AS DECIMAL(12,2)) AS average_amount, CAST(30 AS DECIMAL(12,2)) AS std_amount,
         CASE WHEN user_id % 5 <> 0 THEN user_id % 3 + 7 END AS typical_hour_start,
         CASE WHEN user_id % 5 <> 0 THEN user_id % 3 + 21 END AS typical_hour_end
  FROM (SELECT DISTINCT user_id FROM events) JOIN customer ON user_id = c_custkey
       JOIN nation ON n_nationkey = user_id % 25)
"""

RISK = """CASE coalesce(merchant_category, 'DEPARTMENT_STORE')
  WHEN 'JEWELRY_LUXURY' THEN 0.85 WHEN 'DIGITAL_WALLET_TRANSFER' THEN 0.80 WHEN 'ELECTRONICS' THEN 0.75
  WHEN 'GAMING_CASINO' THEN 0.70 WHEN 'DEPARTMENT_STORE' THEN 0.35 WHEN 'GAS_STATION' THEN 0.20
  WHEN 'UTILITIES' THEN 0.15 WHEN 'GROCERY' THEN 0.10 WHEN 'RESTAURANT' THEN 0.10 ELSE 0.3 END"""


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(2.0::DOUBLE * 6371.0::DOUBLE * atan2(sqrt({h}), sqrt(1.0::DOUBLE - {h})))"


def r(x: str, d: int) -> str:
    return f"(round(CAST({x} AS DOUBLE) + 1e-9::DOUBLE, {d}) + 0.0::DOUBLE)"


def _windows(source: str, has_category: bool = True, profiles: bool = True) -> str:
    """Features over a CTE ``source`` shaped like txn."""
    risk = RISK if has_category else "0.35"
    hours = ("(hour_of_day < coalesce(typical_hour_start, 8) OR hour_of_day > coalesce(typical_hour_end, 22))"
             if profiles else "(hour_of_day < 8 OR hour_of_day > 22)")
    join = "LEFT JOIN cust USING (customer_id)" if profiles else ""
    extra = "typical_hour_start, typical_hour_end," if profiles else ""

    def last(sec: int) -> str:
        return f"(PARTITION BY customer_id ORDER BY us RANGE BETWEEN {sec * 1000000} PRECEDING AND 1 PRECEDING)"

    first = lambda c: f"(us <= min(us) OVER (PARTITION BY customer_id, {c}))"
    seen = lambda v, d: f"CASE WHEN n_past > 0 THEN {v} ELSE {d} END"
    return f"""
raw AS (
  SELECT t.*, {extra} hour("timestamp") AS hour_of_day, isodow("timestamp") - 1 AS day_of_week,
    count(*) OVER past AS n_past,
    CAST(sum(cents) OVER past AS DOUBLE) AS cents_past,
    stddev_pop(cents) OVER past AS std_cents,
    max({{'us': us, 'id': transaction_id, 'lat': lat, 'lon': lon}}) OVER past AS prev,
    count(*) OVER {last(60)} AS n1m, count(*) OVER {last(300)} AS n5m, count(*) OVER {last(900)} AS n15m,
    count(*) OVER {last(3600)} AS n1h, count(*) OVER {last(86400)} AS n24h, count(*) OVER {last(604800)} AS n7d,
    coalesce(sum(cents) OVER {last(300)}, 0) AS s5m, coalesce(sum(cents) OVER {last(3600)}, 0) AS s1h,
    count(DISTINCT merchant_id) OVER {last(86400)} AS um, count(DISTINCT country) OVER {last(604800)} AS uc,
    count(DISTINCT device_id) OVER {last(2592000)} AS ud,
    {first('device_id')} AS nd, {first('country')} AS nc, {first('city')} AS ncity,
    count(DISTINCT customer_id) OVER (PARTITION BY device_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS dc
  FROM {source} t {join}
  WINDOW past AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mid AS (
  SELECT *, cents_past / nullif(n_past, 0) / 100.0::DOUBLE AS mean_,
    greatest(CASE WHEN n_past > 1 THEN std_cents / 100.0::DOUBLE ELSE 500.0::DOUBLE END, 1.0::DOUBLE) AS sigma_,
    greatest(0.5::DOUBLE, (us - prev.us) / 1000000.0::DOUBLE) AS gap_,
    {hav('lat', 'lon', 'prev.lat', 'prev.lon')} AS km_
  FROM raw),
mid2 AS (SELECT *, km_ / (gap_ / 3600.0::DOUBLE) AS kmh_, CAST(amount AS DOUBLE) AS amt FROM mid),
feat AS (
  SELECT * EXCLUDE (amount, hour_of_day, day_of_week), amt AS amount, CAST(hour_of_day AS INTEGER) AS hour_of_day,
    CAST(day_of_week AS INTEGER) AS day_of_week,
    {r('ln(1 + amt)', 4)} AS log_amount,
    CAST(day_of_week >= 5 AS INTEGER) AS is_weekend, CAST({hours} AS INTEGER) AS is_unusual_hour,
    CAST({risk} AS DOUBLE) AS merchant_risk_score,
    {seen('n1m', '0')} AS txn_count_1m, {seen('n5m', '0')} AS txn_count_5m, {seen('n15m', '0')} AS txn_count_15m,
    {seen('n1h', '0')} AS txn_count_1h, {seen('n24h', '0')} AS txn_count_24h, {seen('n7d', '0')} AS txn_count_7d,
    {seen(r('s5m / 100.0::DOUBLE', 2), '0.0::DOUBLE')} AS amount_sum_5m, {seen(r('s1h / 100.0::DOUBLE', 2), '0.0::DOUBLE')} AS amount_sum_1h,
    {seen(r('mean_', 2), '1500.0::DOUBLE')} AS customer_avg_amount, {seen(r('sigma_', 2), '500.0::DOUBLE')} AS customer_std_amount,
    {seen(r('(amt - mean_) / sigma_', 3), '0.0::DOUBLE')} AS customer_amount_zscore,
    {seen(r('amt / (mean_ + 1.0::DOUBLE)', 3), '1.0::DOUBLE')} AS amount_to_avg_ratio,
    CAST({seen('CAST(nd AS INTEGER)', '1')} AS INTEGER) AS is_new_device,
    CAST({seen('CAST(nc AS INTEGER)', '0')} AS INTEGER) AS is_new_country,
    CAST({seen('CAST(ncity AS INTEGER)', '0')} AS INTEGER) AS is_new_city,
    {seen('um', '0')} AS unique_merchants_24h, {seen('greatest(1, uc)', '1')} AS unique_countries_7d,
    {seen('greatest(1, ud)', '1')} AS unique_devices_30d,
    {seen(r('gap_', 1), '86400.0::DOUBLE')} AS time_since_prev_txn,
    {seen(r('km_', 2), '0.0::DOUBLE')} AS geo_distance_km, {seen(r('kmh_', 1), '0.0::DOUBLE')} AS travel_speed_kmh,
    CAST({seen('CAST(kmh_ > 900 AND km_ > 200 AS INTEGER)', '0')} AS INTEGER) AS impossible_travel,
    greatest(1, dc) AS device_customer_count
  FROM mid2)
"""


FEAT = f"{TXN}, {PROFILES}, {_windows('txn')}"

ORDERS_TXN = """
otxn AS (
  SELECT 'ORD-' || o_orderkey AS transaction_id, o_orderdate AS "timestamp", epoch_us(o_orderdate) AS us,
         'CUST-' || o_custkey AS customer_id, 'MERCH-' || (o_orderkey % 50) AS merchant_id,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         o_orderpriority AS country, 'CITY-' || (o_orderkey % 40) AS city,
         (o_custkey % 25) * 5.0::DOUBLE - 60.0::DOUBLE AS lat, (o_orderkey % 25) * 13.5::DOUBLE - 170.0::DOUBLE AS lon,
         'DEV-' || (o_orderkey % 500) AS device_id, (o_orderstatus = 'F') AS is_fraud
  FROM orders)
"""
ORDERS_FEAT = f"{ORDERS_TXN}, {_windows('otxn', has_category=False, profiles=False)}"

# -- behaviour, rules, policy ------------------------------------------------------------------------
AMOUNT_C = ("greatest(CASE WHEN customer_amount_zscore > 2 OR amount_to_avg_ratio > 3 THEN "
            "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (customer_amount_zscore - 1.5::DOUBLE) / 3.5::DOUBLE)) ELSE 0.0::DOUBLE END, "
            "CASE WHEN amount_to_avg_ratio > 8 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END)")
VELOCITY_C = "least(1.0::DOUBLE, txn_count_1m * 0.45::DOUBLE + greatest(0, txn_count_1h - 3) * 0.10::DOUBLE)"
KINEMATIC_C = ("CASE WHEN impossible_travel = 1 THEN 1.0::DOUBLE WHEN travel_speed_kmh > 500 "
               "THEN least(1.0::DOUBLE, travel_speed_kmh / 900.0::DOUBLE) ELSE 0.0::DOUBLE END")
NOVELTY_C = "is_new_device * 0.4::DOUBLE + is_new_country * 0.4::DOUBLE + is_new_city * 0.2::DOUBLE"
DIURNAL_C = "is_unusual_hour * 0.5::DOUBLE"
BEHAVIOR = r(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({AMOUNT_C}) * 0.35::DOUBLE + ({VELOCITY_C}) * 0.25::DOUBLE + "
             f"({KINEMATIC_C}) * 0.20::DOUBLE + ({NOVELTY_C}) * 0.15::DOUBLE + ({DIURNAL_C}) * 0.05::DOUBLE))", 4)
SIGNALS = """concat_ws(',',
  CASE WHEN customer_amount_zscore > 2 OR amount_to_avg_ratio > 3 THEN 'AMOUNT_HIGH_ZSCORE' END,
  CASE WHEN amount_to_avg_ratio > 8 THEN 'AMOUNT_RATIO_SURGE' END,
  CASE WHEN txn_count_1m >= 2 THEN 'VELOCITY_BURST_1M' END,
  CASE WHEN txn_count_1h >= 5 THEN 'VELOCITY_ELEVATED_1H' END,
  CASE WHEN impossible_travel = 1 THEN 'IMPOSSIBLE_TRAVEL_SPEED' END,
  CASE WHEN impossible_travel <> 1 AND travel_speed_kmh > 500 THEN 'HIGH_TRANSIT_VELOCITY' END,
  CASE WHEN is_new_device = 1 THEN 'NEW_DEVICE_DETECTED' END,
  CASE WHEN is_new_country = 1 THEN 'NEW_COUNTRY_DETECTED' END,
  CASE WHEN is_unusual_hour = 1 THEN 'OFF_HOURS_ACTIVITY' END)"""

RULE_SQL = [
    ("R01_IMPOSSIBLE_TRAVEL", 0.90, "impossible_travel = 1 OR (travel_speed_kmh > 900 AND geo_distance_km > 200)"),
    ("R02_VELOCITY_BURST_1M", 0.80, "txn_count_1m >= 3"),
    ("R03_NEW_DEVICE_HIGH_AMOUNT", 0.75, "is_new_device = 1 AND customer_amount_zscore > 3"),
    ("R04_NEW_COUNTRY_FIRST_TIME", 0.60, "is_new_country = 1 AND amount > 5000"),
    ("R05_DEVICE_SHARING_ANOMALY", 0.85, "device_customer_count >= 4"),
    ("R06_UNUSUAL_HOUR_LARGE_SPEND", 0.50, "is_unusual_hour = 1 AND amount_to_avg_ratio > 5"),
    ("R07_HIGH_AMOUNT_ZSCORE", 0.70, "customer_amount_zscore >= 5"),
    ("R08_HIGH_RISK_MERCHANT_ANOMALY", 0.65, "merchant_risk_score >= 0.7::DOUBLE AND amount_to_avg_ratio > 4"),
]
RULE_SCORE = r("least(1.0::DOUBLE, " + " + ".join(
    f"CASE WHEN {p} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for _, w, p in RULE_SQL) + ")", 4)
RULE_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{c}' END" for c, _, p in RULE_SQL) + ")"


def clip01(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


def decision(score: str) -> str:
    return f"CASE WHEN {score} < 30 THEN 'APPROVE' WHEN {score} < 75 THEN 'REVIEW' ELSE 'BLOCK' END"


def costs(amount: str, p: str) -> dict[str, str]:
    a, q = f"greatest(0.0::DOUBLE, CAST({amount} AS DOUBLE))", clip01(p)
    return {
        "cost_approve": r(f"{q} * ({a} + 25.0::DOUBLE)", 2),
        "cost_review": r(f"(1.0::DOUBLE - {q}) * 2.0::DOUBLE + 4.0::DOUBLE", 2),
        "cost_block": r(f"(1.0::DOUBLE - {q}) * 35.0::DOUBLE", 2),
    }


SCORED = f"""{FEAT},
sc AS (SELECT *, {BEHAVIOR} AS behavior_score, {RULE_SCORE} AS rule_score, {RULE_LIST} AS rules FROM feat),
scored AS (
  SELECT *, {r('least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE * (0.55::DOUBLE * ' + clip01('p_raw') + ' + 0.15::DOUBLE * ' + clip01('anomaly') + ' + 0.15::DOUBLE * behavior_score + 0.15::DOUBLE * rule_score)))', 2)} AS risk_score
  FROM sc)
"""

_C = costs("amount", "p_raw")
STORE = f"""{TXN},
predictions AS (
  SELECT transaction_id, p_raw AS calibrated_probability, anomaly AS anomaly_score, anomaly * 100.0::DOUBLE AS inference_latency_ms
  FROM txn WHERE ip_address IS NOT NULL),
decisions AS (
  SELECT transaction_id, "timestamp", customer_id, CAST({r('p_raw * 100', 2)} AS DECIMAL(5,2)) AS risk_score,
         {decision(r('p_raw * 100', 2))} AS decision,
         CASE WHEN {r('p_raw * 100', 2)} >= 75 THEN 'R07_HIGH_AMOUNT_ZSCORE' ELSE '' END AS rules,
         CAST({_C['cost_approve']} AS DECIMAL(12,2)) AS cost_estimate_fn, CAST({_C['cost_block']} AS DECIMAL(12,2)) AS cost_estimate_fp
  FROM txn WHERE merchant_category <> 'OTHER')
"""

FEEDBACK = """
fb AS (
  SELECT 'TXN-' || event_id || '-0' AS transaction_id, a AS analyst_id,
         CASE WHEN (a = 'A1' AND value > 60) OR (a = 'A2' AND value > 90) THEN 'FRAUD' ELSE 'LEGITIMATE' END AS actual_label,
         'reviewed ' || event_type AS notes,
         ts + CASE WHEN a = 'A1' THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS created_at
  FROM (SELECT *, unnest(['A1', 'A2']) AS a FROM events WHERE event_type IN ('purchase', 'error')))
"""

SPLIT = f"""{TXN},
ranked AS (SELECT *, row_number() OVER (ORDER BY us, transaction_id) - 1 AS rk, count(*) OVER () AS n FROM txn),
parts AS (SELECT *, CASE WHEN rk < CAST(floor(n * 0.70::DOUBLE) AS BIGINT) THEN 'train'
   WHEN rk < CAST(floor(n * 0.70::DOUBLE) AS BIGINT) + CAST(floor(n * 0.15::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM ranked)
"""


def pct(value: str, p: float) -> str:
    return f"quantile_cont(CAST({value} AS DOUBLE), {p})"


_EDGES = [0.01 + i * ((0.99 - 0.01) / 98) for i in range(98)] + [0.99]
GRID = f"""{TXN},
th AS (SELECT unnest([{', '.join(repr(e) + '::DOUBLE' for e in _EDGES)}]) AS t),
cnt AS (
  SELECT t, count(*) FILTER (is_fraud AND p_raw >= t) AS tp, count(*) FILTER (NOT is_fraud AND p_raw >= t) AS fp,
         count(*) FILTER (is_fraud AND p_raw < t) AS fn, count(*) FILTER (NOT is_fraud AND p_raw < t) AS tn,
         coalesce(CAST(sum(amount) FILTER (is_fraud AND p_raw < t) AS DOUBLE), 0.0::DOUBLE) AS missed
  FROM txn JOIN th ON true GROUP BY t),
grid AS (
  SELECT {r('t', 3)} AS threshold,
   {r('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)', 4)} AS "precision", {r('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)', 4)} AS recall,
   {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)', 4)} AS f1,
   {r('coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0)::DOUBLE, 0)', 4)} AS f2,
   tp, fp, fn, tn, {r('missed + 25 * fn', 2)} AS fn_loss, {r('35 * fp', 2)} AS fp_loss, {r('missed + 25 * fn + 35 * fp', 2)} AS total_cost
  FROM cnt)
"""

POINTS = f"""{TXN},
pts AS (SELECT p_raw AS score, count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM txn GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
   coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
   sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM pts)
"""

_SIDE = "CASE WHEN \"timestamp\" < TIMESTAMP '2024-01-11' THEN 'r' WHEN \"timestamp\" >= TIMESTAMP '2024-01-21' THEN 'c' END"
_TALL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, side FROM sided WHERE side IS NOT NULL" for f in FEATURES)
_INNER = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))
DRIFT = f"""{FEAT},
sided AS (SELECT *, {_SIDE} AS side FROM feat),
tall AS ({_TALL}),
edges AS (SELECT feature, list_sort(list_distinct([{_INNER}])) AS e FROM tall WHERE side = 'r' GROUP BY feature),
tot AS (SELECT feature, count(*) FILTER (side = 'r') AS tr, count(*) FILTER (side = 'c') AS tc FROM tall GROUP BY feature),
binned AS (SELECT t.feature, len(list_filter(e, lambda x: x <= value)) AS bin, side FROM tall t JOIN edges USING (feature)),
bins AS (SELECT feature, unnest(range(len(e) + 1)) AS bin, len(e) + 1 AS nb FROM edges),
cnts AS (SELECT b.feature, b.bin, nb, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'c') AS c
   FROM bins b LEFT JOIN binned x ON b.feature = x.feature AND b.bin = x.bin GROUP BY 1, 2, 3),
sh AS (SELECT feature, (r / tr::DOUBLE + 1e-4) / (1 + nb * 1e-4) AS e, (c / tc::DOUBLE + 1e-4) / (1 + nb * 1e-4) AS a FROM cnts JOIN tot USING (feature)),
psi AS (SELECT feature, greatest(0.0::DOUBLE, sum((a - e) * ln(a / e))) AS psi FROM sh GROUP BY feature),
val AS (SELECT feature, value, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'c') AS c FROM tall GROUP BY 1, 2),
cdf AS (SELECT feature, abs(sum(r) OVER w / tr::DOUBLE - sum(c) OVER w / tc::DOUBLE) AS d, tr, tc FROM val JOIN tot USING (feature)
   WINDOW w AS (PARTITION BY feature ORDER BY value)),
ksd AS (SELECT feature, max(d) AS d, max(tr)::DOUBLE * max(tc) / (max(tr) + max(tc)) * max(d) * max(d) AS l2 FROM cdf GROUP BY feature),
ks AS (SELECT feature, d, CASE WHEN l2 < 1e-3 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
   list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * l2))))) END AS p FROM ksd),
rep AS (SELECT feature, {r('psi', 4)} AS psi, {r('d', 4)} AS ks_statistic, {r('p', 4)} AS p_value,
   CASE WHEN psi >= 0.25 OR (p < 0.05 AND d > 0.15) THEN 'CRITICAL_DRIFT' WHEN psi >= 0.10 OR p < 0.05 THEN 'MODERATE_DRIFT' ELSE 'NO_DRIFT' END AS status
   FROM psi JOIN ks USING (feature))
"""
