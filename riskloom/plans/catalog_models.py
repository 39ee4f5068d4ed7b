"""Catalogue entries that fit models or write files: compared by rows unless SQL can state the result."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import rounded
from riskloom.operators import attribution, boosting, calibration, explore, forest, history, models, split, store
from riskloom.plans import oracles as o
from riskloom.plans import training
from riskloom.plans.catalog import A1_SQL, query, scored, sel, txn
from riskloom.plans.scoring import score_transactions
from riskloom.session import materialise, scratch_path
from riskloom.sources import star, tables

_FITTED: dict[tuple[str, str, str], object] = {}


def fitted(spark: SparkSession, sf: str, name: str, build):
    """Fit once per application and data folder; several entries read the same model."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITTED:
        _FITTED[key] = build()
    return _FITTED[key]


def training_table(spark, sf) -> DataFrame:
    return fitted(spark, sf, "table", lambda: training.training_table(txn(spark, sf), star.customers(spark, sf)))


def part(spark, sf, name) -> DataFrame:
    return training.part(training_table(spark, sf), name)


def logistic(spark, sf):
    return fitted(spark, sf, "logistic", lambda: models.logistic_baseline(part(spark, sf, "train")))


def forest_model(spark, sf):
    return fitted(spark, sf, "random_forest", lambda: models.random_forest_baseline(part(spark, sf, "train")))


def champion(spark, sf):
    return fitted(spark, sf, "champion", lambda: models.boosted_champion(part(spark, sf, "train"), valid=part(spark, sf, "val"), patience=training.PATIENCE))


def isolation(spark, sf) -> forest.IsolationForest:
    return fitted(spark, sf, "isolation", lambda: forest.isolation_forest_fit(part(spark, sf, "train")))


def scratch(spark, label: str) -> str:
    return scratch_path(spark, label)


# -- sources and sinks ------------------------------------------------------------------------------

@query("S2_write_table", sel(o.TXN, "transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount, CAST(CAST(\"timestamp\" AS DATE) AS VARCHAR) AS event_date", "txn"))
def _(spark, sf):
    path = scratch(spark, "table")
    tables.write_table(txn(spark, sf).drop("scenario"), path, by_date=True)
    back = spark.read.parquet(path)
    return back.select("transaction_id", "customer_id", "amount", F.col("event_date").cast("string").alias("event_date"))


_ASKED = ["TXN-100-2", "TXN-7-0", "TXN-9999999-0", "TXN-4321-0", *(f"TXN-{k}-0" for k in range(500, 520))]


@query("K2_point_lookup", sel(o.TXN, "transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount", "txn", f"WHERE transaction_id IN ({', '.join(repr(k) for k in _ASKED)})"))
def _(spark, sf):
    path = scratch(spark, "lookup")
    tables.write_lookup_table(txn(spark, sf), path)
    return tables.look_up(spark, path, _ASKED).select("transaction_id", "customer_id", "amount")


@query("S2_write_csv", sel(o.TXN, "transaction_id, CAST(amount AS DOUBLE) AS amount", "txn"))
def _(spark, sf):
    path = scratch(spark, "csv")
    tables.write_table(txn(spark, sf).select("transaction_id", "amount"), path, fmt="csv")
    return spark.read.schema("transaction_id string, amount decimal(12,2)").option("header", True).csv(path)


@query("S3_profiles", f"WITH {o.PROFILES} SELECT customer_id, home_country, home_city, CAST(average_amount AS DOUBLE) AS average_amount, typical_hour_start, typical_hour_end FROM cust")
def _(spark, sf):
    path = scratch(spark, "profiles")
    people = star.customers(spark, sf)
    tables.write_profiles(people.select("customer_id", "home_country", "home_city", F.col("average_amount").cast("double").alias("average_amount"),
                                        "typical_hour_start", "typical_hour_end"), path)
    return tables.read_profiles(spark, path).select("customer_id", "home_country", "home_city", "average_amount", "typical_hour_start", "typical_hour_end")


@query("S7_write_report", A1_SQL)
def _(spark, sf):
    path = scratch(spark, "report")
    report = explore.overview(txn(spark, sf))
    tables.write_report(report, path)
    return tables.read_report(spark, path, report.schema)


@query("K5_append_audit_event", f"WITH {o.STORE} SELECT 'risk-engine' AS actor, 'DECISION' AS action, transaction_id AS target_resource, '{{\"decision\":\"' || decision || '\"}}' AS details, ip_address FROM decisions JOIN (SELECT transaction_id, ip_address FROM txn) USING (transaction_id)")
def _(spark, sf):
    path = scratch(spark, "audit")
    t = txn(spark, sf)
    decided = star.decisions(t).join(t.select("transaction_id", "ip_address"), "transaction_id")
    rows = store.audit_rows(decided, "risk-engine", "DECISION", "transaction_id", {"decision": "decision"}, "ip_address")
    tables.append_audit(rows, path)
    return spark.read.parquet(path).select("actor", "action", "target_resource", "details", "ip_address")


# -- models -----------------------------------------------------------------------------------------

@query("M1_prior_baseline", f"WITH {o.SPLIT} SELECT transaction_id, {o.r("(SELECT avg(is_fraud::INT) FROM parts WHERE split = 'train')", 6)} AS probability_fraud FROM parts WHERE split = 'test'")
def _(spark, sf):
    table = training_table(spark, sf)
    out = models.prior_baseline(table.where("split = 'train'"), table.where("split = 'test'"))
    return out.select("transaction_id", rounded(F.col("probability_fraud"), 6).alias("probability_fraud"))


@query("M2_logistic_baseline")
def _(spark, sf):
    return models.score_with(logistic(spark, sf), part(spark, sf, "test")).select("transaction_id", "label", "raw_score")


@query("M3_random_forest_baseline")
def _(spark, sf):
    return models.score_with(forest_model(spark, sf), part(spark, sf, "test")).select("transaction_id", "label", "raw_score")


@query("M4_boosted_champion")
def _(spark, sf):
    return models.score_with(champion(spark, sf), part(spark, sf, "test")).select("transaction_id", "label", "raw_score")


# What the small model of the next entry is fitted with. --------------------------------
SMALL = ["amount", "hour_of_day", "txn_count_24h", "is_new_device", "unique_merchants_24h", "time_since_prev_txn", "device_customer_count", "merchant_risk_score"]
SMALL_STEP, SMALL_PENALTIES = 0.3, boosting.Penalties(gamma=0.0, l1=0.05, l2=1.0, min_child_weight=3.0)
# ---------------------------------------------------------------------------------------------------


def _boosted_sql() -> str:
    """Two trees of two levels, grown in SQL by going through all thresholds of all nodes."""
    score = lambda g, h: f"(power(greatest(abs({g}) - {SMALL_PENALTIES.l1}::DOUBLE, 0), 2) / ({h} + {SMALL_PENALTIES.l2}::DOUBLE))"
    value = f"-{SMALL_STEP}::DOUBLE * sign(g) * greatest(abs(g) - {SMALL_PENALTIES.l1}::DOUBLE, 0) / (h + {SMALL_PENALTIES.l2}::DOUBLE)"
    ranks = ", ".join(f"{k / 8}" for k in range(1, 8))
    parts = [
        o.FEAT, o.SPLIT.removeprefix(o.TXN).lstrip(",\n "),
        f"""base AS MATERIALIZED (SELECT transaction_id AS id, parts.is_fraud::INT AS y, ('0x' || substr(md5(transaction_id), 1, 7))::BIGINT % 1000003 AS draw,
              {', '.join(f'coalesce(feat.{n}::DOUBLE, 0) AS x{k}' for k, n in enumerate(SMALL))} FROM feat JOIN parts USING (transaction_id) WHERE split = 'train')""",
        "wt AS (SELECT sum(1 - y) / sum(y)::DOUBLE AS pw FROM base)",
        "u AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT id, {k} AS f, x{k} AS x FROM base" for k in range(len(SMALL))) + ")",
        f"cut AS MATERIALIZED (SELECT DISTINCT f, thr FROM (SELECT f, max(x) AS top, unnest(quantile_disc(x, [{ranks}])) AS thr FROM u GROUP BY f) WHERE thr < top)",
    ]
    margin = "0.0::DOUBLE"
    found = []
    for t in range(2):
        source = "base, wt" if t == 0 else f"base JOIN leaf{t - 1} USING (id), wt"
        margin = "0.0::DOUBLE" if t == 0 else f"leaf{t - 1}.m"
        parts.append(f"g{t} AS MATERIALIZED (SELECT id, 0 AS node, {margin} AS m, draw * {t + 1} % 1000003 < 0.8::DOUBLE * 1000003 AS own, "
                     f"CASE WHEN y = 1 THEN pw ELSE 1 END AS w, y, 1 / (1 + exp(-{margin})) AS p FROM {source})")  # fmt: skip
        parts.append(f"a{t}_0 AS MATERIALIZED (SELECT id, node, m, own, w * (p - y) AS g, w * p * (1 - p) AS h FROM g{t})")
        for d in range(2):
            rows, best = f"a{t}_{d}", f"b{t}_{d}"
            parts.append(f"""s{t}_{d} AS (SELECT node, f, thr, sum(g) AS g, sum(h) AS h, sum(CASE WHEN x <= thr THEN g ELSE 0 END) AS gl, sum(CASE WHEN x <= thr THEN h ELSE 0 END) AS hl
                FROM {rows} JOIN u USING (id) JOIN cut USING (f) WHERE own GROUP BY node, f, thr)""")
            parts.append(f"""{best} AS MATERIALIZED (SELECT node, f, thr, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 5) DESC, f, thr) AS k
                FROM (SELECT *, {score('gl', 'hl')} + {score('(g - gl)', '(h - hl)')} - {score('g', 'h')} AS gain FROM s{t}_{d} WHERE hl >= 3 AND h - hl >= 3)) WHERE k = 1 AND gain > 1e-6)""")
            parts.append(f"""a{t}_{d + 1} AS MATERIALIZED (SELECT id, CASE WHEN b.node IS NULL THEN r.node WHEN x <= thr THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node, m, own, g, h
                FROM {rows} r LEFT JOIN {best} b USING (node) LEFT JOIN u ON u.id = r.id AND u.f = b.f)""".replace("SELECT id,", "SELECT r.id,"))
            found.append(f"SELECT {t} AS tree, node AS id, ['{"', '".join(SMALL)}'][f + 1] AS feature, thr AS threshold, gain, 0.0::DOUBLE AS value FROM {best}")
        parts.append(f"v{t} AS (SELECT node, {value} AS value FROM (SELECT node, sum(g) FILTER (own) AS g, sum(h) FILTER (own) AS h FROM a{t}_2 GROUP BY node))")
        parts.append(f"leaf{t} AS MATERIALIZED (SELECT id, m + value AS m FROM a{t}_2 JOIN v{t} USING (node))")
        found.append(f"SELECT {t} AS tree, node AS id, NULL AS feature, 0.0::DOUBLE AS threshold, 0.0::DOUBLE AS gain, value FROM v{t}")
    return f"WITH {', '.join(parts)} SELECT tree::INT AS tree, id::INT AS id, feature, threshold, {o.r('gain', 3)} AS gain, {o.r('value', 6)} AS value FROM ({' UNION ALL '.join(found)})"


@query("M4_boosted_trees", _boosted_sql())
def _(spark, sf):
    """Splits, gains and leaf values of the first trees of a small model."""
    train = part(spark, sf, "train")
    ranks = ", ".join(f"{k / 8}D" for k in range(1, 8))
    at = train.agg(*[F.expr(f"array({', '.join(f'percentile_disc({r}) WITHIN GROUP (ORDER BY {n})' for r in ranks.split(', '))})").alias(n) for n in SMALL], *[F.max(n).alias(f"top_{n}") for n in SMALL]).first()
    edges = [sorted({x for x in at[n] if x < at[f"top_{n}"]}) for n in SMALL]
    model = boosting.fit(train, SMALL, trees=2, depth=2, step=SMALL_STEP, features=1.0, penalties=SMALL_PENALTIES, edges=edges)
    named = F.get(F.array(*[F.lit(n) for n in SMALL]), F.when(F.col("feature") >= 0, F.col("feature")))
    return model.table(spark).select("tree", "id", named.alias("feature"), "threshold", rounded(F.col("gain"), 3).alias("gain"), rounded(F.col("value"), 6).alias("value"))


@query("M5_predict", sel(o.TXN, "transaction_id, p_raw >= 0.5 AS predicted_fraud", "txn"))
def _(spark, sf):
    return models.predict(txn(spark, sf), "p_raw").select("transaction_id", "predicted_fraud")


@query("M6_feature_importance")
def _(spark, sf):
    return models.feature_importance(champion(spark, sf))


@query("M6_coefficients")
def _(spark, sf):
    return models.feature_importance(logistic(spark, sf))


_HEX = "('0x' || substr(md5(transaction_id || ':42'), {}, 7))::BIGINT"
_DRAWN = f"""{o.SPLIT}, h AS (SELECT {_HEX.format(1)} AS a, {_HEX.format(8)} AS b, CAST(floor(least(1, 256 / count(*) OVER ()::DOUBLE) * 1000003) AS BIGINT) AS most FROM parts WHERE split = 'train')"""


@query("M7_isolation_forest_fit", f"WITH {_DRAWN} SELECT t::INT AS tree, count(*) AS n_rows, count(*) AS in_leaves, 0 AS one_child, ceil(log2(count(*)))::INT AS most_depth "
       "FROM h, (SELECT unnest(range(120)) AS t) WHERE (a + b * t) % 1000003 < most GROUP BY t")
def _(spark, sf):
    """Per tree: the rows it was grown on, those in its leaves, inner nodes without two children, and the depth it may have."""
    nodes = isolation(spark, sf).nodes
    leaf = F.col("feature") < 0
    shape = nodes.groupBy("tree").agg(
        F.max("n_rows").alias("n_rows"), F.sum(F.when(leaf, F.col("n_rows"))).alias("in_leaves"),
        (F.count("*") - 2 * F.count_if(leaf) + 1).cast("int").alias("one_child"))
    return shape.withColumn("most_depth", F.ceil(F.log2("n_rows")).cast("int"))


@query("M8_isolation_forest_score")
def _(spark, sf):
    # The stored features of all rows, which the forest was fitted on a part of.
    return forest.isolation_forest_score(isolation(spark, sf), training_table(spark, sf)).select("transaction_id", "is_fraud", "anomaly_score")


@query("M9_anomaly_separation", f"WITH {o.SCORED} SELECT {o.r('avg(anomaly) FILTER (NOT is_fraud)', 6)} AS mean_legitimate, {o.r('avg(anomaly) FILTER (is_fraud)', 6)} AS mean_fraud, "
       f"{o.r('corr(anomaly, is_fraud::INT)', 6)} AS anomaly_correlation, {o.r('corr(behavior_score, is_fraud::INT)', 6)} AS behavior_correlation FROM scored")
def _(spark, sf):
    out = forest.anomaly_separation(scored(spark, sf), "anomaly", "behavior_score")
    return out.select(*[rounded(F.col(c), 6).alias(c) for c in out.columns])


# A given linear model for the attribution check. -------------------------------------
LINEAR = {"amount": (0.0002, 5000.0), "txn_count_24h": (0.1, 2.5), "customer_amount_zscore": (0.4, 0.0), "geo_distance_km": (-0.0001, 3000.0)}
# ---------------------------------------------------------------------------------------------------
_CONTRIB = {n: f"((CAST({n} AS DOUBLE) - {m}::DOUBLE) * {c}::DOUBLE)" for n, (c, m) in LINEAR.items()}


@query("M10_linear_attribution", sel(o.FEAT, "transaction_id, " + ", ".join(f"{o.r(v, 6)} AS {n}" for n, v in _CONTRIB.items()), "feat"))
def _(spark, sf):
    out = attribution.linear_contributions(
        history.all_features(txn(spark, sf), star.customers(spark, sf)),
        {n: c for n, (c, _) in LINEAR.items()}, {n: m for n, (_, m) in LINEAR.items()})
    return out.select("transaction_id", *[rounded(F.col("contributions")[i]["impact"], 6).alias(n) for i, n in enumerate(LINEAR)])


@query("M10_tree_attribution", f"WITH {o.SPLIT} SELECT transaction_id, 0.0::DOUBLE AS difference FROM parts WHERE split = 'test'")
def _(spark, sf):
    """Contributions add up to the margin less the nodes' cover-weighted mean."""
    scored = models.score_with(champion(spark, sf), part(spark, sf, "test"))
    out = attribution.tree_contributions(scored, attribution.boosted_nodes(champion(spark, sf)))
    margin = F.log(F.col("raw_score") / (1.0 - F.col("raw_score")))
    base = attribution.expected_value(attribution.boosted_nodes(champion(spark, sf)))
    gap = margin - base - F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["impact"])
    return out.select("transaction_id", rounded(gap, 5).alias("difference"))


_TOP = " UNION ALL ".join(f"SELECT transaction_id, '{n}' AS feature, {v} AS impact FROM feat" for n, v in _CONTRIB.items())


@query("M11_top_drivers", f"""WITH {o.FEAT}, c AS ({_TOP}),
 p AS (SELECT transaction_id, string_agg(feature, ',' ORDER BY impact DESC, feature) AS positive FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY impact DESC, feature) AS k FROM c WHERE impact > 0) WHERE k <= 2 GROUP BY 1),
 n AS (SELECT transaction_id, string_agg(feature, ',' ORDER BY impact, feature) AS negative FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY impact, feature) AS k FROM c WHERE impact < 0) WHERE k <= 2 GROUP BY 1)
 SELECT transaction_id, coalesce(positive, '') AS positive, coalesce(negative, '') AS negative FROM feat LEFT JOIN p USING (transaction_id) LEFT JOIN n USING (transaction_id)""")
def _(spark, sf):
    out = attribution.linear_contributions(
        history.all_features(txn(spark, sf), star.customers(spark, sf)),
        {n: c for n, (c, _) in LINEAR.items()}, {n: m for n, (_, m) in LINEAR.items()})
    top = attribution.with_top_drivers(out, 2)
    return top.select("transaction_id", F.col("shap_positive_drivers.feature").alias("positive"), F.col("shap_negative_drivers.feature").alias("negative"))


@query("M12_model_leaderboard")
def _(spark, sf):
    test = part(spark, sf, "test")
    rate = part(spark, sf, "train").agg(F.avg("label")).scalar()
    return training.leaderboard({
        "prior": test.withColumn("raw_score", rate),
        "logistic": models.score_with(logistic(spark, sf), test),
        "random_forest": models.score_with(forest_model(spark, sf), test),
        "boosted": models.score_with(champion(spark, sf), test),
    })


@query("M13_save_load_model", f"WITH {o.SPLIT} SELECT transaction_id, 0.0::DOUBLE AS difference FROM parts WHERE split = 'test'")
def _(spark, sf):
    """The scores of a model that was stored and loaded are those of the model itself."""
    path = scratch(spark, "model")
    models.save_model(logistic(spark, sf), path)
    test = part(spark, sf, "test")
    loaded = models.score_with(models.load_model(path), test).select("transaction_id", F.col("raw_score").alias("loaded"))
    own = models.score_with(logistic(spark, sf), test).select("transaction_id", "raw_score")
    return own.join(loaded, "transaction_id").select("transaction_id", F.abs(F.col("raw_score") - F.col("loaded")).alias("difference"))


# -- calibration ------------------------------------------------------------------------------------

@query("C1_isotonic")
def _(spark, sf):
    val, test = (models.score_with(logistic(spark, sf), part(spark, sf, p)) for p in ("val", "test"))
    model = calibration.isotonic_fit(val, "raw_score")
    return calibration.isotonic_apply(model, test, "raw_score").select("transaction_id", "raw_score", "calibrated_probability")


_ISO = f"""{o.SPLIT}, v AS (SELECT p_raw AS x, count(*) AS w, sum(is_fraud::INT) AS s FROM parts WHERE split = 'val' GROUP BY 1),
 c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs, w, s FROM v),
 ab AS (SELECT a.i AS a, b.i AS i, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)::DOUBLE AS m FROM c a JOIN c b ON a.i <= b.i),
 mm AS (SELECT i, a, min(m) OVER (PARTITION BY a ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM ab),
 iso AS (SELECT x, g FROM c JOIN (SELECT i, max(m) AS g FROM mm GROUP BY i) USING (i)),
 t AS (SELECT transaction_id, p_raw FROM parts WHERE split = 'test'),
 lo AS (SELECT transaction_id, p_raw, x AS x0, g AS g0 FROM t ASOF LEFT JOIN iso ON p_raw >= x),
 hi AS (SELECT transaction_id, x AS x1, g AS g1 FROM t ASOF LEFT JOIN iso ON p_raw <= x)"""


@query("C1_isotonic_given_scores", f"WITH {_ISO} SELECT transaction_id, {o.r('CASE WHEN x0 IS NULL THEN g1 WHEN x1 IS NULL THEN g0 WHEN x1 = x0 THEN g0 ELSE g0 + (g1 - g0) * (p_raw - x0) / (x1 - x0) END', 5)} AS calibrated_probability FROM lo JOIN hi USING (transaction_id)")
def _(spark, sf):
    """Isotonic regression as the largest of the least means: the min-max form gives the same fit."""
    parts = split.temporal_split(txn(spark, sf)).select("transaction_id", "split", "p_raw", F.col("is_fraud").cast("int").alias("label"))
    model = calibration.isotonic_fit(parts.where("split = 'val'"), "p_raw")
    out = calibration.isotonic_apply(model, parts.where("split = 'test'"), "p_raw")
    return out.select("transaction_id", rounded(F.col("calibrated_probability"), 5).alias("calibrated_probability"))


@query("C2_platt")
def _(spark, sf):
    val, test = (models.score_with(logistic(spark, sf), part(spark, sf, p)) for p in ("val", "test"))
    model = calibration.platt_fit(val, "raw_score")
    return calibration.platt_apply(model, test, "raw_score").select("transaction_id", "raw_score", "calibrated_probability")


_PLATT = f"""{o.SPLIT}, v AS (SELECT p_raw AS x, is_fraud::INT::DOUBLE AS y FROM parts WHERE split = 'val'), n AS (SELECT count(*)::DOUBLE AS n FROM v),
 it(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
   SELECT k, a, b, avg(p - y) AS g0, avg((p - y) * x) + b / any_value(n) AS g1, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * x) AS h01, avg(p * (1 - p) * x * x) + 1 / any_value(n) AS h11
   FROM (SELECT k, a, b, x, y, n, 1 / (1 + exp(-(a + b * x))) AS p FROM it, v, n WHERE k < 25) GROUP BY k, a, b)),
 fit AS (SELECT a, b FROM it WHERE k = 25)"""


@query("C2_platt_given_scores", f"WITH RECURSIVE {_PLATT} SELECT transaction_id, {o.r('1 / (1 + exp(-(a + b * p_raw)))', 3)} AS calibrated_probability FROM parts, fit WHERE split = 'test'")
def _(spark, sf):
    """Logistic calibration of given scores against Newton's method."""
    parts = split.temporal_split(txn(spark, sf)).select("transaction_id", "split", "p_raw", F.col("is_fraud").cast("int").alias("label"))
    model = calibration.platt_fit(parts.where("split = 'val'"), "p_raw")
    out = calibration.platt_apply(model, parts.where("split = 'test'"), "p_raw")
    return out.select("transaction_id", rounded(F.col("calibrated_probability"), 3).alias("calibrated_probability"))


@query("D4_score_with_models")
def _(spark, sf):
    def build():
        val = models.score_with(champion(spark, sf), part(spark, sf, "val"))
        calibrator = calibration.isotonic_fit(val, "raw_score")
        return training.Scorer(champion(spark, sf), calibrator, isolation(spark, sf))

    scorer = fitted(spark, sf, "scorer", build)
    out = score_transactions(txn(spark, sf), scorer, star.customers(spark, sf))
    return out.select("transaction_id", "raw_score", "calibrated_probability", "anomaly_score", "behavior_score", "rule_score",
                      "risk_score", "decision", F.col("shap_positive_drivers.feature").alias("drivers"))
