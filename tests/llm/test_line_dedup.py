"""Repeated runs of lines against a plain search."""

import random
import re

import pytest

from riskloom.llm import line_dedup, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, min_words=50):
    """doc_id -> text without the lines of all runs that stand earlier, tried window by window."""
    docs = sorted(docs, key=lambda d: d[0])
    lines = {d: [(x, p, len(SPACE.findall(x))) for p, x in enumerate((t or "").split("\n")) if SPACE.search(x)] for d, t in docs}
    first, out = {}, {}
    for d, t in docs:
        ls, spans = lines[d], set()
        for step in (1, -1):
            for s in range(len(ls)):
                e, n = s, 0
                while 0 <= e < len(ls) and n < min_words:
                    n += ls[e][2]
                    e += step
                if n >= min_words:
                    spans.add((s, e) if step == 1 else (e + 1, s + 1))
        cut = set()
        for s, e in sorted(spans):
            if first.setdefault(tuple(x for x, _, _ in ls[s:e]), (d, s)) != (d, s):
                cut.update(p for _, p, _ in ls[s:e])
        out[d] = t if not cut else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut)
    return out


def run(spark, docs, **options):
    frame = spark.createDataFrame([(d, t, len(t or ""), 1) for d, t in docs], "doc_id long, text string, n_chars long, runs int").repartition(3)
    got = line_dedup.deduplicate_lines(frame, **options)
    assert got.columns == frame.columns
    return {r["doc_id"]: r["text"] for r in got.collect()}


@pytest.mark.parametrize("min_words", [6, 50])
def test_runs(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 9, 20, 60]))) for _ in range(60)] + ["", " "]
    passage = rng.sample(pool, 12)
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, "a b c d e f\na b c d e f\na b c d e f"), (4, " ".join(["one"] * 70)), (5, " ".join(["one"] * 70))]
    for k in range(10, 70):
        body = rng.choices(pool, k=rng.randrange(1, 14))
        if rng.random() < 0.6:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.randrange(3) : rng.randrange(8, 13)]
        docs.append((k, "\n".join(body)))
    docs += [(100 + k, docs[20][1]) for k in range(40)]
    rng.shuffle(docs)
    want = plain(docs, min_words)
    assert run(spark, docs, min_words=min_words) == want
    words = {d: len(SPACE.findall(t or "")) for d, t in docs}
    kept = run(spark, docs, min_words=min_words, drop_emptied=True)
    assert set(kept) == {d for d, t in want.items() if SPACE.search(t or "") or words[d] == 0 or t == dict(docs)[d]}


def test_long_documents(spark):
    rng = random.Random(1)
    base = [f"line {rng.randrange(10**9)} of {k}" for k in range(4000)]
    docs = [(1, "\n".join(base)), (2, "\n".join(["x y", *base[1000:3500], "z"])), (3, "\n".join(["same words here"] * 3000))]
    got = run(spark, docs)
    assert got[1] == docs[0][1] and got[2] == "x y\nz" and set(got[3].split("\n")) == {"same words here"} and len(got[3].split("\n")) < 20


def test_nulls_repeats_and_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicate_lines(frame).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (1, long), (1, long), (1, "other"), (2, None), (None, None)]
    got = sorted((str(r["doc_id"]), str(r["text"])[:5]) for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, frame.schema)).collect())
    assert got == [("1", ""), ("1", ""), ("1", "other"), ("2", "None"), ("None", "None"), ("None", "w0 w1")]


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op6_line_dedup"](spark, sf).collect()}
    assert got == plain(docs) and any(got[d] != t for d, t in docs)
