"""The stages against plain Python, and their contract."""

import collections

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import test_decontaminate, test_host_rules, test_line_dedup, test_superminhash


def plain(docs, items, sources):
    """doc_id -> text after the four filtering stages."""
    counts = {d: test_host_rules.plain(t) for d, t in docs.items()}
    hosts = collections.defaultdict(list)
    for d in docs:
        hosts[sources[d]].append(counts[d][5])
    rates = [sum(v) / len(v) for v in hosts.values()]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    k = max(1, mean * (1 - mean) / var - 1) if var else 1
    bad = {h for h, v in hosts.items() if (sum(v) + k * mean) / (len(v) + k) > 0.5}
    docs = {d: t for d, t in docs.items() if not counts[d][5] and sources[d] not in bad}
    cut = test_line_dedup.plain(list(docs.items()))
    docs = {d: t for d, t in cut.items() if t == docs[d] or test_line_dedup.SPACE.search(t)}
    keep = {d for d, _, _, kept in test_superminhash.plain(list(docs.items())) if kept}
    docs = {d: t for d, t in docs.items() if d in keep}
    hit = {d: (n, h) for d, n, h, _ in test_decontaminate.plain(list(docs.items()), items)}
    return {d: t for d, t in docs.items() if not (hit[d][1] and 20 * hit[d][1] >= hit[d][0])}


def test_pipeline(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain({r["doc_id"]: r["text"] for r in rows}, items, {r["doc_id"]: r["source"] for r in rows})
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = entry.queries()["pipeline"](spark, sf).collect()
    sizes = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert set(sizes) == set(want) and 0 < len(want) < len(rows)
    long = {r["doc_id"]: test_decontaminate.plain([(r["doc_id"], want[r["doc_id"]])], items)[0][2] for r in got}
    for d, t in want.items():
        if long[d] < 50:
            assert sizes[d] == len(coder.encode(t, add_special_tokens=False).ids) + 1


def test_stages_keep_clashing_columns(spark, sf):
    text = " ".join(f"w{i}" for i in range(100))
    names = ("kept", "hits", "items", "n_words", "runs", "row", "doc", "_doc", "_place", "_runs", "_words", "_host", "_kept", "rep", "base_failed", "host", "n_shingles", "component_id", "block")
    docs = spark.createDataFrame([(1, text, "en", "s", 5), (2, text + "\nmore " + text, "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for r in stage(spark, docs, sf).collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 2


def test_stages_keep_columns_and_take_nulls(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(None, text, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, text + " x", None, "s", None)], schema)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.collect()
        assert stage(spark, docs.limit(0), sf).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 4
