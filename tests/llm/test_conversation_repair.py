"""Conversation repair against a search from the end, written apart."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import conversation_repair as repair
from riskloom.llm import queries

AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault). The least (cost, audit, turns) from each row on, by recursion."""

    @functools.cache
    def best(i, place, inserted):
        found = []
        if i == len(rows) and place in ("", "a"):
            found.append((0, "", ()))
        follow = "a" if place == "u" else "u"
        name = {"u": "user", "a": "assistant"}[follow]
        if inserted < 3:
            c, a, t = best(i, follow, inserted + 1)
            found.append((c + 3, "I" + a, ((name, ""), *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = best(i + 1, place, 0)
            found.append((c + 4, "D" + a, t))
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                c, a, t = best(i + 1, follow, 0)
                found.append((c + 3 + more, "R" + a, ((name, text), *t)))
                if role[:1] in AFTER[place]:
                    c, a, t = best(i + 1, AFTER[place][role[:1]], 0)
                    found.append((c + more, "K" + a, ((role, text), *t)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def plain(rows):
    """{conv: result} of damaged rows (conv, turn, role, text)."""
    talks = defaultdict(list)
    for conv, *row in rows:
        talks[conv].append(row)
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for r, *_ in judged]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        cost, audit, kept = cheapest(tuple(judged))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest, kept)
    return out


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), ())


def talks(n, seed, most=7):
    dice = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(dice.randrange(1, most + 1)):
            role = dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = dice.choice(["Yes.", "No?", "cut", "", None, " \x0b", "é!\n ", "x\x1c", f"q{dice.randrange(5)}."])
            rows.append((dice.choice([conv, conv, conv, conv, None]) if conv == 0 else conv, dice.choice([turn, turn, turn, None, turn + 2]), role, text))
    dice.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, fault string").repartition(3)


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_damaged_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = talks(300, block)
    want = {c: EMPTY for c, *_ in rows} | plain(damage(rows))
    got = {r[0]: tuple(r)[1:] for r in repair.audits(repair.damaged(frame(spark, rows))).collect()}
    assert got == {c: x[:-1] for c, x in want.items()}


def test_repaired_turns(spark):
    rows = talks(200, 11)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: list(x[-1]) for c, x in plain(filled).items() if x[-1]}
    got = defaultdict(list)
    for r in sorted(repair.repaired(repair.whole(frame(spark, rows))).collect(), key=lambda r: r["place"]):
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == want


@pytest.mark.parametrize("roles", ["u", "uua", "ua", "sua", "aau", "s"])
def test_long_conversations_in_blocks(spark, roles):
    rows = [(roles[k % len(roles)], f"{k}" + ("." if k % 5 else ""), repair.CUT if k % 5 == 0 else repair.FINE) for k in range(700)]
    whole, parts = repair.Conversation(1), repair.Conversation(1)
    whole.block = rows
    whole.initial = parts.initial = None
    for k, (role, text, fault) in enumerate(rows):
        parts.add(k, role, text, fault)
    assert parts.result()[-3:] == whole.result()[-3:]


def test_long_texts_and_empty(spark):
    rows = [(1, 0, "user", "long " * 200_000 + "."), (1, 1, "assistant", "ok.")]
    got = repair.audits(repair.whole(frame(spark, rows))).collect()
    assert [(r["cost"], r["audit"]) for r in got] == [(0, "KK")]
    assert repair.audits(repair.damaged(frame(spark, []))).count() == 0 and repair.repaired(repair.whole(frame(spark, []))).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: EMPTY for c, *_ in rows} | plain(damage(rows))
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, sf).select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect()}
    assert got == {c: x[:-1] for c, x in want.items()}


def test_damage_touches_what_it_should(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert repair.damaged(rows).where("gone").count() == sum(zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0 for r in rows.collect())
    assert repair.damaged(rows).where(F.col("text") == "").count() > 0
