"""Token ids piece by piece against whole texts; packing and token files against plain encoding."""

import pathlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import packing, queries, token_files
from riskloom.llm.token_ids import Encoder
from riskloom.llm.words import BY_PUNCTUATION, BY_WHITE_SPACE, slices, words
from riskloom.session import scratch_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "  a  b ", "a\n b", "É x  y", "x　 y", " ́a", "a  \n\n b\t c", "it's  ok ΑΣ Σ", "<|endoftext|> hi", "😀 a😀", "\x1c a \x1cb", "a  \n x", "é  \n y", "it's.'s x.'t"]
piece = st.text(st.sampled_from(list("ab'.,!1 \n\t\r\x0b\x1c éÉß   　́😀<|>sS")), max_size=40)


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path):
    encoder = Encoder(path, 1)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(piece, st.none(), st.text(max_size=20)), max_size=6))
    def check(texts):
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [whole(encoder, t) for t in texts]

    check()
    ids, bounds = encoder.encode(pa.array(ODD).slice(2, 9))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [whole(encoder, t) for t in ODD[2:11]]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_as_the_file_has_them(path):
    plain = Tokenizer.from_file(path)
    texts = ["one<|endoftext|> two", "<|endoftext|>", "<|startoftext|>a<|endoftext|><|endoftext|>b ", "x <|endoftext|>\n y", "<|endof", "text|>", "É<|endoftext|>\u3000a", "<|ENDOFTEXT|> <|<|endoftext|>|>", None, "'<|startoftext|>s it's"]
    ids, bounds = Encoder(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    if path == BYTES:
        assert ids[: bounds[1]].tolist() == [505, 50256, 734]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.one_of(piece, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|end"])), max_size=6).map("".join), max_size=6))
    def check(texts):
        ids, bounds = Encoder.of_process(path).encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    check()


@pytest.mark.parametrize("table,pattern", [(BY_WHITE_SPACE, r"[^\x20\x09-\x0D]+"), (BY_PUNCTUATION, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(table, pattern):
    texts = pa.array([*ODD, "Word " * 3000, None])
    got = []
    for batch in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], limit=20):
        found = words(batch.column(0), table)
        names = [w.decode() for w in found.distinct.to_pylist()]
        got += [[names[k] for k in found.ids[a:b]] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
    assert got == [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts.to_pylist()]


def documents(spark):
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choices(["an", "of", "É.", "tea\n"], k=rng.randrange(1, 900))) for _ in range(60)), "long text " * 9000]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "again"), (7, "again")]
    return rows, spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_tokens int").repartition(4)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, encoding):
    rows, frame = documents(spark)
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(frame, path, WORDS, encoding=encoding, row_group_bytes=1 << 16, page_bytes=1 << 10)
    encoder = Encoder(WORDS, 1)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digests(spark, path).collect())
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [g[1] for g in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((str(g[1]), g[3]) for g in got) == sorted((str(d), crc(whole(encoder, t))) for d, t in rows)
    some = token_files.read_tokens(spark, path, ("doc_id", "ids"), (60, 62))
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {d: whole(encoder, t) for d, t in rows if d and 60 <= d <= 62}
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,60)" in some._jdf.queryExecution().toString()


def check_pieces(rows, got, capacity):
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    return sequences, docs


def test_packing(spark):
    rows, frame = documents(spark)
    got = packing.pack(frame, BYTES, capacity=128, group_chars=20_000).collect()
    sequences, _ = check_pieces(rows, got, 128)
    encoder = Encoder(BYTES, 1)
    want = sorted((str(d), len(ids), start) for d, ids in ((d, whole(encoder, t)) for d, t in rows) for start in [0])
    assert sorted((str(r["doc_id"]), r["doc_tokens"], 0) for r in got if r["start"] == 0) == want
    ids = {}
    for d, t in rows:
        ids.setdefault(d, whole(encoder, t))
    assert all(r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in got)
    assert sum(r["length"] for r in got) == sum(len(whole(encoder, t)) for _, t in rows)
    assert len(sequences) * 128 - sum(r["length"] for r in got) < 128 * len({r["sequence_id"] >> 32 for r in got})


def test_rows_of_one_id_are_dealt_to_many_groups(spark):
    rows = [(None, f"text {i} of no id " * 20) for i in range(300)] + [(5, f"text {i} of one id " * 20) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, group_chars=10_000).collect()
    for d in (None, 5):
        groups = [r["sequence_id"] >> 32 for r in got if r["doc_id"] == d and r["start"] == 0]
        assert len(groups) == 300 and max(map(groups.count, groups)) < 50


def test_assignment_balances_costs():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 700) for _ in range(500)] + [5000, 2048, 0, 1]
    pieces, costs = packing.assign(lengths, 2048)
    got = {}
    for doc, start, length, _, _ in pieces:
        got.setdefault(doc, []).append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(got.get(doc, [])):
            assert start == at
            at += length
        assert at == n
    used = {}
    for _, _, length, s, _ in pieces:
        used[s] = used.get(s, 0) + length
    assert len(used) == -(-sum(lengths) // 2048) and max(used.values()) <= 2048
    mixed = [costs[s] for s in used if sum(p[3] == s for p in pieces) > 1]
    assert np.std(mixed) < 0.06 * np.mean(mixed)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(frame, BYTES).collect() == []
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(frame, path, WORDS)
    assert token_files.token_digests(spark, path).collect() == []


def test_queries(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    encoder = Encoder(BYTES, 1)
    got = queries.QUERIES["op3_packing"](spark, sf).collect()
    check_pieces(None, got, 2048)
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {d: len(whole(encoder, t)) for d, t in docs.items()}
    encoder, at = Encoder(WORDS, 1), 0
    rows = {r["doc_id"]: r for r in queries.QUERIES["op8_token_files"](spark, sf).collect()}
    for d in sorted(docs):
        ids = whole(encoder, docs[d])
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_an_id_of_many_rows_spreads_over_files(spark):
    rows = [(7, f"text number {k}") for k in range(400)] + [(None, f"without id {k}") for k in range(400)] + [(k, "x") for k in range(20)]
    path = scratch_path(spark, "token-files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, WORDS)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(path)
    for only in ("doc_id = 7", "doc_id IS NULL"):
        assert stored.where(only).select("part").distinct().count() > 1
    digests = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in token_files.token_digests(spark, path).collect())
    assert [d[2] for d in digests] == sorted(d[2] for d in digests)
    assert all(a[0] + a[1] == b[0] for a, b in zip(digests, digests[1:], strict=False))


def test_freed_memory_is_given_back():
    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    before = held()
    taken = [bytes(4000) for _ in range(50_000)]
    last = [taken[k] for k in range(0, len(taken), 1000)]  # what stays keeps the C library from shrinking its heap
    del taken
    assert held() > before + 100
    assert not list(slices(iter([])))
    assert held() < before + 60 and len(last) == 50
