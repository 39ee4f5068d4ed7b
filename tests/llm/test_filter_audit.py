"""Filter interactions against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_masks(rows):
    """rows: (doc_id, text, part)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, p in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > least[t])
        out.append((i, p or "", sum(bool(f) << k for k, f in enumerate(fails))))
    return out


def plain_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in range(2))
    out = {}
    masks = plain_masks(rows)
    for part in {m[1] for m in masks}:
        own = [m for m in masks if m[1] == part]
        shares = Counter()
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                gone = [m for m in alive if m[2] & bit]
                fails = [m for m in own if m[2] & bit]
                alive = [m for m in alive if not m[2] & bit]
                shares[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(alive), len(gone), len(fails) - len(gone), sum(m[2] == bit for m in own), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shares[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def texts(n, seed):
    """Long shared beginnings, a third of one text, small and empty ones."""
    dice = random.Random(seed)
    header = "Licence of many pages. " * 400
    made = []
    for k in range(n):
        draw = dice.random()
        words = [f"w{dice.randrange(400)}é" for _ in range(dice.choice([3, 150, 250, 260]))]
        if draw < 0.33:
            t = header + "the hot one"
        elif draw < 0.5:
            t = header + str(dice.randrange(40))
        elif draw < 0.6:
            t = dice.choice(["", None, " \n", "A", "B%", "x\x1cy " * 300])
        else:
            t = " ".join(words) + dice.choice(["", " #", " SHOUTED " * 20])
        made.append((dice.choice([k, k, k, k - 1, None]), t, dice.choice(["en", "fr", None, ""])))
    return made


@pytest.mark.parametrize("range_bytes", [1 << 12, 1 << 16, filter_audit.RANGE_BYTES])
def test_masks(spark, range_bytes):
    rows = texts(500, 3)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part string, mask int").repartition(6)
    got = Counter((r["doc_id"], r["part"], r["mask"]) for r in filter_audit.failures(docs, part="part", range_bytes=range_bytes).collect())
    assert got == Counter(plain_masks(rows))


def test_small_blocks_of_held_texts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", 2000)
    rows = texts(200, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = Counter(tuple(r) for r in filter_audit.failures(docs).collect())
    assert got == Counter(plain_masks(rows))


def test_separators_part_sorted_texts(spark):
    rows = texts(400, 9)
    cuts = filter_audit.separators(spark.createDataFrame([(t or "",) for _, t, _ in rows], "text string"), 1 << 12)
    assert cuts == sorted(set(cuts)) and len(cuts) > 20
    assert any(len(c) > 9000 for c in cuts)  # beyond the shared header


def test_trie(spark):
    dice = random.Random(1)
    trie, want = filter_audit.Trie(), defaultdict(list)
    for k in range(3000):
        text = bytes(dice.choices(b"ab", k=dice.randrange(9)))
        least = dice.choice([None, dice.randrange(100)])
        trie.insert(text, k, least, 1)
        want[text].append((k, least))
    got = {tuple(sorted(r)): least for r, least in trie.copied()}
    assert got == {tuple(k for k, _ in v): min((x for _, x in v if x is not None), default=None) for v in want.values() if len(v) > 1}


def test_audit(spark):
    rows = texts(120, 4)
    labels = [(k, k % 2, (k % 7 == 0) + 0) for k in range(0, 120, 3)] + [(None, 1, 1), (3, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = [(i, max(q == 1 for j, q, _ in labels if j == i) + 0, max(x == 1 for j, _, x in labels if j == i) + 0) for i in {x[0] for x in labels} if i is not None]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(rows, known) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = docs.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang")))
    assert filter_audit.audit(one, labels).where("kept + removed > 1").count() == 0
