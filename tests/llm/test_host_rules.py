"""Quality rules of documents and hosts against plain Python."""

import re

import pytest

from riskloom.llm import host_rules, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    ws = SPACE.findall(text or "")
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
    lines, dups, known = [x for x in (text or "").split("\n") if SPACE.search(x)], 0, set()
    for x in lines:
        dups += x in known
        known.add(x)
    failed = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(hit), failed)


CASES = [
    None, "", " \n\t ", "one", "a b c d e f g h", "x " * 40, "a b c d e f g h " * 2 + "z", "é# ß *&\n\né# ß *&\nq",
    " ".join(f"w{i % 30}" for i in range(500)), "\x1c x\x0by " + " ".join(f"v{i}" for i in range(30)), " ".join(f"long{i}" for i in range(40_000)),
]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(CASES)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: tuple(r[c] for c in host_rules.RULES) for r in host_rules.with_rules(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(CASES)}


def test_hosts_with_many_failures_go_with_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "fine") for i in range(40)] + [(100, "short", "fine")]
    rows += [(200 + i, "short", "bad") for i in range(40)] + [(300, good, "bad"), (301, good, None), (301, good, None), (None, None, "small")]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", host_rules.F.lit(1)))
    kept = [r["doc_id"] for r in got.where("kept").collect()]
    assert sorted(kept) == [*range(40), 301, 301] and got.count() == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_empty(spark, rows):
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [r["kept"] for r in got] == [False] * len(rows)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in host_rules.RULES) for r in queries.QUERIES["op9_host_rules"](spark, sf).collect()}
    assert got == {r["doc_id"]: plain(r["text"]) for r in docs}
