"""Scores against a plain model over word tuples; probabilities that add up to one."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from riskloom.llm import language_model, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
END = "</s>"


def tokens(text):
    return [*SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


class Plain:
    def __init__(self, docs, order):
        self.order, self.c = order, [Counter() for _ in range(order + 1)]
        train = [tokens(t) for d, t in docs if not held(d)]
        for ts in train:
            ts = ["<s>"] * (order - 1) + ts
            for i in range(order - 1, len(ts)):
                for n in range(1, order + 1):
                    self.c[n][tuple(ts[i - n + 1 : i + 1])] += 1
        for n in range(1, order):
            self.c[n][("<s>",) * n] = len(train)
        ones = [v for k, v in self.c[1].items() if k != ("<s>",)]
        self.n, self.v = sum(ones), len(ones)
        n1, n2 = ones.count(1), ones.count(2)
        self.d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.x = [0, 0]
        for n in range(2, order + 1):
            buckets = {}
            for v in self.c[n - 1].values():
                if v:
                    t, k = buckets.get(int(math.log2(v) * 8 + 1e-9), (0, 0))
                    buckets[int(math.log2(v) * 8 + 1e-9)] = (t + 1, k + v)
            low, high = 0.0, 1.0
            for _ in range(50):
                x = (low + high) / 2
                enough = sum(t * (k / t) ** x for t, k in buckets.values()) >= sum(v > 0 for g, v in self.c[n].items())
                low, high = (low, x) if enough else (x, high)
            self.x.append(low)

    def p(self, history, word):
        k = self.c[1][(word,)]
        p = (k - self.d) / self.n if k else self.d * self.v / self.n if self.n else 1.0
        for n in range(2, self.order + 1):
            h = tuple(history[len(history) - n + 1 :])
            if whole := self.c[n - 1][h]:
                u = whole ** self.x[n] / (whole + whole ** self.x[n])
                p = (1 - u) * self.c[n][(*h, word)] / whole + u * p
        return p

    def score(self, text):
        ts = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(ts[:i], ts[i])) for i in range(self.order - 1, len(ts)))


def texts(rng, n):
    words = ["an", "Of", "the", "é", "x9", "to"] + [f"r{i}" for i in range(40)]
    out = [None, "", " \n"] + [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(n)]
    return out + [f"{out[5]} {i}" for i in range(10)] + [" ".join(rng.choices(words, k=3000))]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block_chars", [6 << 20, 700])
def test_scores(spark, order, block_chars):
    rng = random.Random(order)
    docs = list(enumerate(texts(rng, 90))) + [(None, "an of the"), (3, "the same id"), (3, "the same id")]
    model = Plain(docs, order)
    rows = language_model.score(spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double"), order, block_chars).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 7), round(r["score"], 7)) for r in rows)
    want = []
    for d, t in docs:
        ts = tokens(t)
        base = sum(math.log10((model.c[1][(w,)] + 0.5) / (model.n + 0.5 * (model.v + 1))) for w in ts)
        want.append((str(d), held(d), len(ts), sum(model.c[1][(w,)] > 0 for w in ts), round(base, 7), round(model.score(t), 7)))
    assert got == sorted(want) and {r["train_tokens"] for r in rows} == {model.n}


def test_probabilities_add_up_to_one():
    rng = random.Random(2)
    model = Plain(list(enumerate(texts(rng, 60))), 2)
    vocabulary = [k[0] for k in model.c[1] if k != ("<s>",)] + ["never seen"]
    for h in ("<s>", "an", "r3", "never seen"):
        assert abs(sum(model.p([h], w) for w in vocabulary) - 1) < 1e-9


def test_empty(spark):
    schema = "doc_id long, text string"
    assert language_model.score(spark.createDataFrame([], schema)).collect() == []
    only = next(d for d in range(99) if held(d))
    (row,) = language_model.score(spark.createDataFrame([(only, "a b")], schema)).collect()
    assert (row["score"], row["train_tokens"], row["n_known"]) == (0.0, 0, 0)


def test_held_out_texts_gain(spark, sf):
    rows = [r for r in queries.QUERIES["op2_backoff_model"](spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows) and len(rows) > 20
