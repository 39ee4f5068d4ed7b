"""Fitted models on a separable problem, isolation forest and tree attribution."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import attribution, evaluate, forest, models
from riskloom.session import scratch_path

NAMES = ["amount", "txn_count_1h", "customer_amount_zscore"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        fraud = i % 10 == 0
        rows.append((f"T{i:05d}", bool(fraud), float(rng.gamma(2, 80) + 900 * fraud * rng.uniform()), float(rng.poisson(1 + 3 * fraud)), float(rng.normal() + 3 * fraud)))
    df = spark.createDataFrame(rows, "transaction_id string, is_fraud boolean, amount double, txn_count_1h double, customer_amount_zscore double")
    return models.model_input(df, names=NAMES).cache()


def auc(df):
    return evaluate.roc_auc(evaluate.score_points(df, "label", "raw_score")).first()[0]


def test_models_reach_the_floor(table):
    for fit in (lambda: models.logistic_baseline(table, NAMES), lambda: models.random_forest_baseline(table, NAMES, 20, 6)):
        assert auc(models.score_with(fit(), table)) >= 0.94


def test_champion_and_attribution_add_up(spark, table):
    champion = models.boosted_champion(table, NAMES, trees=8, depth=3, step=0.3)
    scored = models.score_with(champion, table)
    assert auc(scored) >= 0.94
    nodes = attribution.boosted_nodes(champion)
    out = attribution.tree_contributions(scored, nodes, NAMES)
    total = F.aggregate("contributions.impact", F.lit(0.0), lambda a, x: a + x)
    margin = F.log(F.col("raw_score") / (1 - F.col("raw_score")))
    base = out.select((margin - total).alias("base")).toPandas()["base"]
    assert np.allclose(base, attribution.expected_value(nodes), atol=1e-9)


def test_forest_does_not_depend_on_how_its_rows_are_stored(table):
    """The rows of a share and their order follow from the rows, so that bagging does too, and shares are equal."""
    stored = table.repartition(1), table.repartition(11, "transaction_id")
    trees = [models.random_forest_baseline(df, NAMES, 5, 4).stages[-1].toDebugString for df in stored]
    assert trees[0].split("\n", 1)[1] == trees[1].split("\n", 1)[1]
    cores = table.sparkSession.sparkContext.defaultParallelism
    for at_most, shares in ((1500, cores), (100, 2 * cores)):
        sizes = [len(part) for part in models.in_waves(table.repartition(3), 1500, at_most).rdd.glom().collect()]
        assert len(sizes) == shares and sum(sizes) == 1500 and max(sizes) <= 2 * 1500 / shares


def test_attribution_of_a_saved_forest(spark, table):
    model = models.random_forest_baseline(table, NAMES, 5, 4)
    path = scratch_path(spark, "test-forest")
    models.save_model(model, path)
    nodes = attribution.saved_tree_nodes(f"{path}/stages/{[d for d in sorted(os.listdir(path.removeprefix('file:') + '/stages')) if 'Random' in d][0]}", spark)
    rows = table.limit(40)
    shared = attribution.tree_contributions(rows, nodes, NAMES).select(*NAMES, "contributions.impact").toPandas()

    def expected(tree, x, known):
        node = {r.id: r for r in tree.itertuples()}

        def go(k):
            n = node[k]
            if n.feature < 0:
                return n.value
            if n.feature in known:
                return go(n.left if x[n.feature] <= n.threshold else n.right)
            a, b = node[n.left].cover, node[n.right].cover
            return (a * go(n.left) + b * go(n.right)) / (a + b)

        return go(0)

    for r in shared.itertuples():
        x = [getattr(r, n) for n in NAMES]
        want = np.zeros(3)
        for order in itertools.permutations(range(3)):
            for k, f in enumerate(order):
                want[f] += sum(expected(t, x, order[: k + 1]) - expected(t, x, order[:k]) for _, t in nodes.groupby("tree")) / 6
        assert np.allclose(want, r.impact)


def test_wide_leaves_are_the_same_with_and_without_tables(monkeypatch):
    rng = np.random.default_rng(4)
    met = rng.integers(0, 2, (6, 50)).astype(float)
    share = rng.uniform(0.1, 0.9, 6)
    x = np.where(met == 1, 0.0, 1.0)
    for bits in (6, 5):
        monkeypatch.setattr(attribution, "TABLED", bits)
        nodes, left = [], 1.0
        for k in range(6):
            nodes += [(0, k, k + 10, k + 1 if k < 5 else 99, k, 0.5, 0.0, left), (0, k + 10, -1, -1, -1, 0.0, 0.0, left * (1 - share[k]))]
            left *= share[k]
        chain = attribution.pd.DataFrame(nodes + [(0, 99, -1, -1, -1, 0.0, 2.0, left)], columns=["tree", "id", "left", "right", "feature", "threshold", "value", "cover"])
        chain[["left", "right"]] = chain[["right", "left"]]  # x = 0 goes on
        out = np.zeros((6, 50))
        for leaf in attribution._leaves(chain):
            attribution._add(out, x, leaf)
        assert np.allclose(out, attribution._impacts(met, share, 2.0))


def test_isolation_forest_finds_outliers(spark, table):
    model = forest.isolation_forest_fit(table, features=NAMES, trees=40)
    again = forest.isolation_forest_fit(table, features=NAMES, trees=40)
    assert model.low == again.low and model.high == again.high
    odd = spark.createDataFrame([("X", 9000.0, 40.0, 30.0)], "transaction_id string, amount double, txn_count_1h double, customer_amount_zscore double")
    scores = forest.isolation_forest_score(model, table).toPandas()["anomaly_score"]
    assert scores.between(0, 1).all()
    assert forest.isolation_forest_score(model, odd).first()["anomaly_score"] > scores.median()


def test_top_drivers(spark):
    df = spark.range(1).select(F.expr("array(named_struct('feature','a','impact',0.5D), named_struct('feature','b','impact',-0.2D), "
                                      "named_struct('feature','c','impact',0.9D), named_struct('feature','d','impact',-0.7D), named_struct('feature','e','impact',0.0D))").alias("contributions"))
    r = attribution.with_top_drivers(df, 3).first()
    assert [d["feature"] for d in r["shap_positive_drivers"]] == ["c", "a"]
    assert [d["feature"] for d in r["shap_negative_drivers"]] == ["d", "b"]


def test_isolation_forest_scores_a_row_once(spark, monkeypatch):
    table = spark.range(0, 2000, 1, 4).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 97).cast("double").alias("amount"), (F.col("id") % 11).cast("double").alias("hour_of_day"))
    scored, raw_scores = spark.sparkContext.accumulator(0), forest.raw_scores

    def counted(model, df):
        look = F.udf(lambda x: scored.add(1) or x, "double")
        return raw_scores(model, df).withColumn("raw", look("raw"))

    monkeypatch.setattr(forest, "raw_scores", counted)
    forest.isolation_forest_fit(table, features=["amount", "hour_of_day"], trees=5, tree_rows=64)
    assert scored.value == 2000


def test_trees_of_a_row_are_drawn_from_its_two_numbers(spark):
    rows = spark.range(50).select(F.md5(F.col("id").cast("string").cast("binary")).alias("digest"))
    column = forest._trees_of(F.col("digest"), 120, 60_000)
    out = rows.select("digest", column.alias("trees"))
    for r in out.collect():
        a, b = int(r["digest"][:7], 16), int(r["digest"][7:14], 16)
        assert r["trees"] == [t for t in range(120) if (a + b * t) % forest.PRIME < 60_000]
    each = out._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in each[each.index("filter(") :]


def test_scored_rows_read_the_features_that_the_forest_was_fitted_on(spark):
    from riskloom.plans import catalog, catalog_models

    sf = "/root/testdata/sf0.001"
    out = catalog.QUERIES["M8_isolation_forest_score"](spark, sf)
    assert out.inputFiles() and set(out.inputFiles()) == set(catalog_models.training_table(spark, sf).inputFiles())
