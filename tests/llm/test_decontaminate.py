"""Hits of benchmark windows against a plain search."""

import hashlib
import random
import re

import pytest

from riskloom.llm import decontaminate, queries
from riskloom.llm.decontaminate import Automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=13):
    windows = {}
    for item, text in items:
        ws = word_list(text)
        for i in range(max(len(ws) - window + 1, 1 if ws else 0)):
            windows.setdefault(tuple(ws[i : i + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, hit, found = word_list(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (which := windows.get(tuple(ws[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= which - {None}
        out.append((doc, len(ws), len(hit), tuple(sorted(map(str, found)))))
    return sorted(out, key=str)


def test_automaton_finds_all_windows():
    rng = random.Random(5)
    for _ in range(200):
        window = rng.choice([1, 2, 3, 5])
        items = [(k, [rng.randrange(3) for _ in range(rng.randrange(1, 9))]) for k in range(rng.randrange(1, 6))]
        stream = [rng.randrange(3) for _ in range(40)]
        automaton = Automaton(items, window)
        got = {(i, n, x) for i, n, which in automaton.matches(stream) for x in which}
        want = set()
        for k, seq in items:
            n = min(window, len(seq))
            parts = {tuple(seq[j : j + n]) for j in range(len(seq) - n + 1)}
            want |= {(i, n, k) for i in range(n - 1, len(stream)) if tuple(stream[i - n + 1 : i + 1]) in parts}
        assert got == want


@pytest.mark.parametrize(("shard_words", "pass_words"), [(50_000, 4_000_000), (12, 4_000_000), (12, 40)])
def test_scan(spark, shard_words, pass_words):
    rng = random.Random(7)
    vocabulary = ["an", "Of", "the", "É", "x9", "to"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (2, text(14)), (3, "One. two-THREE"), (4, None), (5, "..."), (None, "lonely item here"), (6, text(40)), (6, text(13))]
    docs = [(1, None), (2, ""), (3, "one two three"), (4, f"{items[0][1]} zz {items[1][1]}"), (4, "lonely item here again"), (None, items[6][1]), (7, text(3000)), (8, " ".join([items[1][1]] * 300))]
    got = decontaminate.scan(
        spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string"),
        spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words, pass_words=pass_words,
    )
    rows = [(r["doc_id"], r["n_words"], sum(h["last"] - h["first"] + 1 for h in r["hits"]), tuple(sorted(map(str, r["items"])))) for r in got.collect()]
    assert sorted(rows, key=str) == plain(docs, items)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r["hits"] for r in decontaminate.scan(got.select("doc_id", "text"), empty).collect()] == [[]] * len(docs)


def test_many_shards_take_one_pass(spark, tmp_path):
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(40))) for k in range(60)]
    items += [(1000 + k, items[0][1]) for k in range(500)]  # copies: one segment, many ids
    docs = [(d, " ".join([rng.choice(items)[1], f"zz{d}", rng.choice(items)[1]]) if d % 3 else f"clean {d}") for d in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    found = decontaminate.scan(spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame(items, "item_id long, text string"), shard_words=100)
    rows = [(r["doc_id"], r["n_words"], sum(h["last"] - h["first"] + 1 for h in r["hits"]), tuple(sorted(map(str, r["items"])))) for r in found.collect()]
    assert sorted(rows, key=str) == plain(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 1 and f"{tmp_path}/docs" in plan


def test_pairs_stop_at_segments():
    import pyarrow as pa

    words = decontaminate.np.array([0, 1, 2, 2, 0, 1], decontaminate.np.int32)
    known = decontaminate.Segments(pa.array([b"a", b"b", b"c"]), words, decontaminate.np.array([0, 3, 4, 6]), decontaminate.np.array([7, 9, 7]), decontaminate.np.array([0, 1, 1, 3]), 2, 3)
    assert known.shards() == [range(0, 1), range(1, 3)]
    assert known.pairs(range(0, 3)).tolist() == [1, 5] and known.pairs(range(1, 2)).tolist() == []
    assert known.least(range(0, 3)) == 1 and known.listed({0, 2}) == [7, 9] and known.listed({1}) == []


def test_spans_are_cut_and_covered_documents_go(spark):
    item = " ".join(f"w{i}" for i in range(60))
    filler = " ".join(f"é{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, f"{filler} {item}, {filler}", 5), (2, item, 5), (3, filler, 5), (4, None, 5)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and out[1]["text"] == f"{filler} , {filler}" and out[3]["n_chars"] == 5
    assert out[1]["n_chars"] == len(out[1]["text"])


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n) for d, n, h, i in plain(docs, items)]
    got = queries.QUERIES["op4_decontamination"](spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(w[5] for w in want)
