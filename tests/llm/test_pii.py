"""Pseudonyms: format, linkage, turning them round, and a plain Feistel network beside them."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from riskloom.llm import pii, queries


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits))) % 10


def plain_digits(digits, key, kind):
    n, u = len(digits), len(digits) // 2
    halves, sizes = [int(digits[:u] or 0), int(digits[u:])], [10**u, 10 ** (n - u)]
    for i in range(1, 9):
        k = 0 if i % 2 else 1
        mark = "|".join([key, kind, str(n), str(i), str(halves[1 - k])])
        halves[k] = (halves[k] + int(hashlib.sha256(mark.encode()).hexdigest()[:15], 16)) % sizes[k]
    return (str(halves[0]).zfill(u) if u else "") + str(halves[1]).zfill(n - u)


def moved(spark, values, key="k", back=False):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return dict(frame.select("v", pii.pseudonym(F.col("v"), key, back)).collect())


def card(rng, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return body + str((10 - luhn(body + "0")) % 10)


def test_values(spark):
    rng = random.Random(1)
    emails = [f"{''.join(rng.choices('abcXYZ', k=rng.randrange(1, 40)))}.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com" for _ in range(30)]
    cards = [card(rng, rng.randrange(13, 20)) for _ in range(30)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(30)]
    phones = [f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}" for _ in range(30)]
    dates = [f"{rng.randrange(1900, 2099)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" for _ in range(30)]
    values = {*emails, *cards, *ips, *phones, *dates, "1@x.org", "078-05-1120"}
    got = moved(spark, values)
    assert None not in got.values() and len(values) == len(set(got.values()))
    back = moved(spark, got.values(), back=True)
    assert all(back[p] == v for v, p in got.items())
    assert all(luhn(got[c]) == 0 and len(got[c]) == len(c) for c in cards) and all(re.sub(r"\d", "0", got[p]) == re.sub(r"\d", "0", p) for p in phones)
    assert all(got[c][:-1] == plain_digits(c[:-1], "k", "card") for c in cards)
    assert all(got[p][3:].translate({ord(c): None for c in " ()-"}) == plain_digits(re.sub(r"\D", "", p[3:]), "k", "phone") for p in phones)
    assert sum(got[v] == v for v in values) < 5 and moved(spark, values, "other") != got


def shape(v):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", v)))


def test_notations_of_days(spark):
    rng = random.Random(5)
    forms = {
        "iso": lambda y, m, d: f"{y}-{m:02}-{d:02}", "year": lambda y, m, d: f"{y}/{m:02}/{d:02}", "european": lambda y, m, d: f"{d:02}/{m:02}/{y}",
        "american": lambda y, m, d: f"{m:02}/{d:02}/{y}" if d > 12 else None, "dots": lambda y, m, d: f"{d:02}.{m:02}.{y}",
        "bare": lambda y, m, d: f"{d}/{m}/{y}" if d < 10 or m < 10 else None, "bare dots": lambda y, m, d: f"{d}.{m}.{y}" if d < 10 or m < 10 else None,
        "bare american": lambda y, m, d: f"{m}/{d}/{y}" if d > 12 and m < 10 else None,
    }
    days = [(2024, 1, 25), (2024, 1, 5), (2000, 2, 29), (1900, 1, 1)] + [(rng.randrange(1900, 2099), rng.randrange(1, 13), rng.randrange(1, 29)) for _ in range(60)]
    told = {(day, k): v for day in days for k, f in forms.items() if (v := f(*day))}
    got = moved(spark, set(told.values()))
    assert None not in got.values() and len(set(got.values())) == len(got)
    back = moved(spark, got.values(), back=True)
    assert all(back[p] == v for v, p in got.items())
    fields = {k: [] for k in forms}
    for (day, k), v in told.items():
        fields[k].append(got[v])
        if k in ("iso", "year", "european", "dots"):  # one day, one pseudonym
            y, m, d = map(int, got[told[day, "iso"]].split("-"))
            assert got[v] == forms[k](y, m, d)
    assert all(re.fullmatch(r"\d\d/\d\d/\d{4}", v) and int(v[3:5]) > 12 for v in fields["american"])
    assert all(re.fullmatch(r"[1-9]\d?/[1-9]\d?/\d{4}", v) and len(v) < 10 for v in fields["bare"] + fields["bare american"])


def test_times_after_days_and_other_places(spark):
    texts = ["2024-01-25T10:00:00Z", "on 2024-01-25.", "x2024-01-25", "2024-01-25-7", "1.2.2024.5", "01/5/2024", "2024-01-25Tomorrow"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: r for r in pii.pseudonymise(frame, "k").collect()}
    day = got[0]["text"][:10]
    assert got[0]["text"] == f"{day}T10:00:00Z" and day != "2024-01-25" and got[1]["text"] == f"on {day}."
    assert [got[k]["text"] for k in range(2, 7)] == texts[2:] and sum(r["n_values"] for r in got.values()) == 2


def iban(country, account):
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{country}{98 - number % 97:02}{account}"


def test_accounts_and_long_addresses(spark):
    rng = random.Random(9)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    capitals, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    ibans = [iban("DE", pick("0123456789", 18)) for _ in range(20)] + [iban("GB", pick(capitals, 4) + pick("0123456789", 14)) for _ in range(20)] + ["DE89 3704 0044 0532 0130 00"]
    groups = lambda n: [pick(hexa, rng.randrange(1, 5)) for _ in range(n)]
    six = [":".join(groups(8)) for _ in range(10)] + [":".join(groups(3)) + "::" + ":".join(groups(2)) for _ in range(10)] + ["fe80::1a2b", "2001:DB8::FF00:42:8329", "2001:db8:85a3::"]
    got = moved(spark, ibans + six)
    assert None not in got.values() and len(set(got.values())) == len(set(ibans + six))
    back = moved(spark, got.values(), back=True)
    assert all(back[p] == v for v, p in got.items())
    for v in ibans:
        p = got[v].replace(" ", "")
        assert p == iban(p[:2], p[4:]) and p[:2] == v[:2] and shape(got[v])[4:] == shape(v)[4:] and got[v] != v
    assert all(re.sub("[0-9a-fA-F]", "0", got[v]) == re.sub("[0-9a-fA-F]", "0", v) for v in six)
    assert set(moved(spark, ["DE88370400440532013000", "1:2:3", "::", "1::2::3", "1:2:3:4:5:6:7:8:9", "AB12 not one"]).values()) == {None}


def test_names_keep_their_capitals(spark):
    got = moved(spark, ["Ann.Bee7@x.org", "ann.bee7@x.org", "ANN.BEE7@X.org"])
    assert shape(got["Ann.Bee7@x.org"]) == "Aaa.Aaa0@a.aaa" and len({v.lower() for v in got.values()}) == 1 and len(set(got.values())) == 3


def test_invalid_values_are_left_alone(spark):
    values = ["300.1.1.1", "1234567890123", "2001-02-30", "1899-12-31", "000-12-3456", "+1234", "4570364245126886"]
    assert set(moved(spark, values).values()) == {None}
    texts = [f"in {v} out" for v in values] + ["a@b", "x 12345 y", "v1.2.3.4.5", None, ""]
    frame = spark.createDataFrame([(t, 7, 8) for t in texts], "text string, n_values int, found int")
    assert {r["found"] for r in pii.pseudonymise(frame, "k").collect()} == {8}
    assert {(r["text"], r["n_values"]) for r in pii.pseudonymise(frame, "k").collect()} == {(t, 0) for t in texts}


def test_linkage_in_long_texts_and_repeats(spark):
    one = "Mail ann.b88@x.example.com, call +1 (286) 555-5053; 1.2.3.4."
    frame = spark.createDataFrame([(1, one), (1, one), (2, "w " * 200_000 + one), (3, one.upper())], "doc_id long, text string")
    rows = [r["text"][-len(one):] for r in pii.pseudonymise(frame, "k").collect()]
    emails = {re.search(r"\S+@x", r, re.I)[0].lower() for r in rows}
    assert len(emails) == 1 and not any("555-5053" in r or "ann" in r.lower().split("@")[0] or "1.2.3.4." in r for r in rows)
    assert pii.pseudonymise(frame.limit(0), "k").collect() == []


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    email = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w")
    n = 0
    for r in queries.QUERIES["op1_feistel"](spark, sf).collect():
        old, new = email.findall(texts[r["doc_id"]]), email.findall(r["text"])
        assert len(old) == len(new) and not set(old) & set(new)
        n += len(old)
        if not r["n_values"]:
            assert r["text"] == texts[r["doc_id"]]
    assert n
