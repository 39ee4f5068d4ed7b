"""Exact duplicates against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from riskloom.llm import exact_dedup, queries

ADDED = list(exact_dedup.ADDED)


def plain(rows, normalise=lambda t: t):
    """{row number: (keep_id, group_size, sha256)} and the texts' best ids."""
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[normalise(t or "")].append(k)
    out = {}
    for t, ks in groups.items():
        ids = [rows[k][0] for k in ks if rows[k][0] is not None]
        for k in ks:
            out[k] = (max(ids) if ids else None, len(ks), hashlib.sha256(t.encode()).hexdigest())
    return out


def rows_of(n, seed):
    """A third of the rows hold one text; others repeat a few times, or stand alone."""
    dice = random.Random(seed)
    rows = [(k, "hot" if dice.random() < 0.34 else dice.choice(["", None, "é \x1c", "long " * 30_000]) if dice.random() < 0.05 else f"t{dice.randrange(n)}") for k in range(n)]
    dice.shuffle(rows)
    return rows + [(None, "hot"), (None, "only"), (None, "only"), (5, "twice"), (5, "twice"), (n, "HOT")]


@pytest.mark.parametrize("counters", [1, 4, 2048])
def test_marks(spark, counters):
    rows = rows_of(600, counters)
    docs = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "k int, doc_id long, text string, kept string").repartition(5)
    got = exact_dedup.mark(docs, counters=counters).collect()
    assert {r["k"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == plain(rows)
    assert len(got) == len(rows) and Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({v[2]: 1 for v in plain(rows).values()})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_rows_that_stay_are_as_they_were(spark):
    rows = rows_of(300, 7)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, at string, stays string")
    got = exact_dedup.deduplicate(docs, normalise=exact_dedup.F.lower, counters=3)
    assert got.schema == docs.schema
    want = plain(rows, str.lower)
    assert Counter((r["doc_id"], (r["text"] or "").lower()) for r in got.collect()) == Counter({(v[0], (rows[k][1] or "").lower()): 1 for k, v in want.items()})


def test_empty_and_only_some_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.mark(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert exact_dedup.mark(docs, columns=["doc_id"]).columns == ["doc_id", *ADDED]


@pytest.mark.parametrize("counters", [1, 3, 20])
def test_summaries_keep_frequent_values(spark, counters):
    dice = random.Random(counters)
    values = [f"v{int(dice.expovariate(0.3))}".encode() for _ in range(3000)]
    keys = spark.createDataFrame(pa.table({"d": pa.array(values, pa.binary())})).repartition(7)
    got = {bytes(r["d"]) for r in exact_dedup.frequent(keys, counters).collect()}
    assert len(got) <= counters and got >= {v for v, n in Counter(values).items() if n > len(values) / (counters + 1)}


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_exact_dedup"](spark, sf).collect()
    want = {docs[k][0]: v for k, v in plain(docs).items()}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
