"""Signatures, links and groups against plain sets."""

import random
import re

import numpy as np

from riskloom.llm import queries, superminhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    ws = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def plain(docs):
    """doc_id -> (set size, smallest id reachable), by an inverted index and union-find."""
    sets = [(d, shingle_set(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = {}
    for i, (_, s) in enumerate(sets):
        common = {}
        for g in s:
            for k in at.setdefault(g, []):
                common[k] = common.get(k, 0) + 1
            at[g].append(i)
        for k, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[k][1]) - n):
                a, b = root(sets[i][0]), root(sets[k][0])
                parent[max(a, b)] = min(a, b)
    return {(d, len(s), root(d), root(d) == d) for d, s in sets}


def test_signature_is_a_minimum_over_permutations():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 7, 90, 3000, 200_000, 5)]
    table = superminhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for s, row in zip(sets[:4], table, strict=False):
        want = [np.iinfo(np.uint32).max] * 128
        for e in s:
            order = list(range(128))
            for j in range(128):
                r = int(superminhash.mix(np.array([e + np.uint64((superminhash.GOLDEN * (j + 1)) % (1 << 64))]))[0])
                k = j + (((r & 0xFFFFFFFF) * (128 - j)) >> 32)
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], (j << 24) + (r >> 40))
        assert row.tolist() == want
    again = superminhash.signatures(rng.permutation(sets[5]), np.array([0, 200_000]))
    assert (again[0] == table[5]).all()


def test_estimates_are_close():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 250, dtype=np.uint64)
        a, b = pool[:200], pool[50:]
        t = superminhash.signatures(np.concatenate([a, b]), np.array([0, 200, 400]))
        errors.append((t[0] == t[1]).mean() - 150 / 250)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < (0.24 / 128) ** 0.5


def variants(rng, n, words=60):
    """Chains: each is an edit of an earlier one, so links alone connect them."""
    texts = [[rng.choice(["An", "of", "é", "it"]) + str(rng.randrange(900)) for _ in range(words)]]
    for _ in range(n - 1):
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_groups(spark):
    rng = random.Random(11)
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A b\tc d e", "x " * 50, "x x x x x", "ü ü", "long words " * 30_000]
    for size in (2, 3, 8, 60, 150):
        texts += variants(rng, size)
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} {' '.join(f'u{k}_{i}' for i in range(40))}" for k in range(60)] + ["same text of a few words"] * 70
    rng.shuffle(texts)
    docs = [(7 * i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, component_id int").repartition(5)
    assert {tuple(r) for r in superminhash.near_duplicates(frame).collect()} == plain(docs)
    kept = superminhash.deduplicate(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c, k in plain(docs) if k)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    assert superminhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "z y x w v u"), (2, "z y x w v u"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (4, None)]
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in superminhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 1, True)] * 2 + [("2", 1, False)] + [("3", 1, False)] * 2 + [("4", 4, True)] * 2 + [("None", None, True)]
    assert sorted(str(r["doc_id"]) for r in superminhash.deduplicate(spark.createDataFrame(rows, schema)).collect()) == ["1", "4", "None"]


def test_an_id_with_different_texts(spark):
    """Each of an id's texts has its links, in whatever order the rows come."""
    base = [f"w{i}" for i in range(60)]
    other, near = [f"v{i}" for i in range(60)], [f"v{i}" for i in range(59)] + ["x"]
    third = [f"u{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, " ".join(near)), (5, " ".join(third)), (9, " ".join(third[:-1])), (11, " ".join(base) + " end"), (12, "alone it stands")]
    want = {5: 5, 7: 5, 9: 5, 11: 5, 12: 12}
    rng = random.Random(2)
    kept = set()
    for _ in range(3):
        frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(frame).collect()} == want
        kept.add(tuple(sorted(tuple(r) for r in superminhash.deduplicate(frame).collect())))
        rng.shuffle(rows)
    assert len(kept) == 1 and [d for d, _ in kept.pop()] == [5, 12]


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.QUERIES["op10_superminhash"](spark, sf).collect()} == plain(docs)


def test_no_groups_take_no_python_workers(spark):
    empty = superminhash.no_labels(spark)
    assert empty.columns == ["rep", "component"] and [k for _, k in empty.dtypes] == ["bigint", "bigint"]
    assert "ExistingRDD" not in empty._jdf.queryExecution().executedPlan().toString() and not empty.collect()
