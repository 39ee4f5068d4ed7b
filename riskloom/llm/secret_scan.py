"""Secret scans: broad rules find candidates, a random forest removes the false positives.

Candidates are values of known formats, values assigned to names such as password or token, and long strings that mix
letters and digits, all whole, however long. A known format inside a longer assigned value is a candidate of its own
beside it; NAME=VALUE is split at '='. Each has features: length, transitions between kinds of characters, coverage by
words of the corpus, the path (source) and shape of its place, and its neighbouring words.

The forest is always fitted on labelled findings. Where the caller has none of their own, ``planted`` makes some: values
of the kinds in ``secret_kinds`` (keys and passwords; digests, ids, slugs, paths, prose in base64, placeholders) are put
into texts of the corpus, and each candidate that covers such a value takes the label of its kind.

The dictionary holds words that make up at least one in 100,000 of the corpus' words, so it never has more than
100,000, however large the corpus; counts cover all texts. Labelled findings lie in at most ``contexts`` texts (1,000),
taken in the order of a hash, and about ``drawn`` of them are made (8,000), whatever the corpus' size; the forest is
fitted on at most ``sample`` labelled rows (20,000). All candidates are scored.

Nulls: a null text has no candidates, a null source is a source of its own; rows are handled one by one, so repeated
ids don't matter. An empty table gives no rows. Given labels of one kind only are refused. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import secret_kinds
from riskloom.llm.columns import tidy
from riskloom.llm.words import BY_PUNCTUATION, mix, slices, words
from riskloom.session import materialise

SAMPLE = 20_000
#: Share of the corpus' words that makes a word part of the dictionary.
COMMON = 1e-5
#: Public formats of keys, and names that secrets are assigned to.
FORMATS = {
    "aws_key_id": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth"
KNOWN = re.compile("|".join(f"(?P<{k}>(?<![A-Za-z0-9_-]){v}(?![A-Za-z0-9_-]))" for k, v in FORMATS.items()))
ASSIGNED = re.compile(rf"(?i:{NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?(?P<value>[^\s\"',;]{{6,}})")
#: A run ends at '=' where more follows, so a name and its value are two; padding at the end belongs to it.
RUN = re.compile(r"(?<![\w/+-])(?=[A-Za-z0-9/+=_-]{16})[A-Za-z0-9/+_-]+(?:=+(?![A-Za-z0-9/+=_-]))?")
DIGIT = re.compile(r"[0-9]")
LEAST = 16
#: No candidate without one of these, which is far quicker to look for; the shortest format has 15 characters.
QUICK = re.compile(rf"(?i:{NAMES})|[A-Za-z0-9/+=_.-]{{15}}")
NEIGHBOURS = 16
#: Labelled findings that are made where none are given, and the texts that they are put into.
DRAWN, CONTEXTS = 8000, 1000
#: What stands before the digests that are no secrets.
DIGESTS = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "revision", "etag", "hash")
#: Lower and upper case letters, digits, and signs; letters beyond ASCII count as signs.
KINDS_OF = defaultdict(lambda: "s", {c: "l" if chr(c).islower() else "u" if chr(c).isupper() else "d" for c in range(128) if chr(c).isalnum()})


@dataclass(frozen=True)
class Candidate:
    """A value at a:b by a rule; ``at`` is where its name begins, if it has one."""

    rule: str
    at: int
    a: int
    b: int


class Rules:
    """Known formats and assigned values are looked for each on its own, and long strings in what these leave."""

    def finditer(self, text: str) -> Iterator[Candidate]:
        found = [Candidate(m.lastgroup, m.start(), *m.span()) for m in KNOWN.finditer(text)]
        known = {(c.a, c.b) for c in found}
        assigned = [Candidate("assigned", m.start(), *m.span("value")) for m in ASSIGNED.finditer(text)]
        found += [c for c in assigned if (c.a, c.b) not in known]
        found.sort(key=lambda c: (c.a, c.b))
        yield from found
        taken = 0
        for m in RUN.finditer(text):
            a, b = m.span()
            while taken < len(found) and found[taken].b <= a:
                taken += 1
            k = taken
            while k < len(found) and found[k].a < b:
                yield from self._random(text, a, found[k].a)
                a = max(a, found[k].b)
                k += 1
            yield from self._random(text, a, b)

    def _random(self, text: str, a: int, b: int) -> Iterator[Candidate]:
        if b - a >= LEAST and DIGIT.search(text, a, b):
            yield Candidate("random", a, a, b)


RULES = Rules()
FOUND = "doc_id long, start long, length long, rule string, masked string, features array<double>"


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None, sample: int = SAMPLE, keep: float = 0.5) -> DataFrame:
    """(doc_id, start, length, rule, masked, probability, kept) of every candidate in ``docs(doc_id, text, path)``.

    ``labelled`` has rows of features and label (0 or 1), as ``candidates`` gives them; ``start`` counts characters.
    """
    tidy(docs.sparkSession)
    common = dictionary(docs)
    found = materialise(candidates(docs, path, common), "secret-candidates")
    model = train(planted(docs, path, common) if labelled is None else labelled, sample)
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    probability = F.round(F.get(vector_to_array("probability"), 1), 6)
    return scored.select("doc_id", "start", "length", "rule", "masked", probability.alias("probability"), (probability >= keep).alias("kept"))


def train(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel:
    """A forest of 60 trees, on at most ``sample`` rows."""
    rows = labelled.select("features", F.col("label").cast("double").alias("label"))
    rows = materialise(rows.orderBy(F.xxhash64("features"), "features", "label").limit(sample), "secret-sample")
    if rows.select("label").distinct().count() < 2:
        raise ValueError("a forest needs labelled findings that are secrets, and some that are not")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=60, maxDepth=10, seed=7, featureSubsetStrategy="onethird")
    return forest.fit(rows.withColumn("vector", array_to_vector("features")))


def planted(
    docs: DataFrame, path: str = "source", known: list[str] | None = None, kinds: list[str] | None = None, contexts: int = CONTEXTS, drawn: int = DRAWN
) -> DataFrame:
    """(kind, label, features) of values of ``kinds`` (all by default), put into texts of ``docs``."""
    common = frozenset(dictionary(docs) if known is None else known)
    wanted = sorted(kinds or secret_kinds.KINDS)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("place"))
    texts = texts.withColumn("mark", F.xxhash64("text", "place"))
    marks = [r["mark"] for r in texts.select("mark").distinct().orderBy("mark").limit(contexts).collect()]
    chosen = texts.where(F.col("mark").isin(marks)).dropDuplicates(["mark"]).select(F.substring("text", 1, 2000).alias("text"), "place")
    texts = materialise(chosen, "secret-contexts")
    if not (rows := texts.count()):
        texts, rows = docs.sparkSession.createDataFrame([("", "")], "text string, place string"), 1
    draws = -(-drawn // rows)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, place in zip(*(batch.column(c).to_pylist() for c in ("text", "place")), strict=True):
                for kind, body, start, end in secret_kinds.plant(text, draws, wanted):
                    for m in RULES.finditer(body):
                        if min(end, m.b) - max(start, m.a) > (end - start) / 2:
                            out.append((kind, int(secret_kinds.KINDS[kind].secret), _features(body, place, m.at, m.a, m.b, m.rule, common)))
            kinds_ = (pa.string(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds_, strict=True)], ["kind", "label", "features"])

    return texts.repartition(4).mapInArrow(make, "kind string, label int, features array<double>")


def dictionary(docs: DataFrame, common: float = COMMON) -> list[str]:
    """Words of 3 to 20 letters that make up at least ``common`` of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = words(batch.column("text"), BY_PUNCTUATION)
            n = np.bincount(found.ids, minlength=len(found.distinct))
            yield pa.RecordBatch.from_arrays([found.distinct.cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    counted = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")), "secret-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [r["word"] for r in counted.where((F.col("n") >= common * total) & F.col("word").rlike("^[a-z]{3,20}$")).collect()]


def candidates(docs: DataFrame, path: str = "source", known: list[str] | None = None) -> DataFrame:
    """Candidates with features."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(frozenset(dictionary(docs) if known is None else known))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = model.value
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
        for batch in slices(batches):
            rows = []
            for doc, text, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "place")), strict=True):
                if text and QUICK.search(text):
                    rows += [(doc, *row) for row in _in_text(text, place or "", common)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(path).cast("string").alias("place"))
    return rows.mapInArrow(find, FOUND)


def _in_text(text: str, place: str, common: frozenset[str]) -> Iterator[tuple]:
    for m in RULES.finditer(text):
        value = text[m.a : m.b]
        yield m.a, m.b - m.a, m.rule, value[:3] + "*" * min(len(value) - 3, 12), _features(text, place, m.at, m.a, m.b, m.rule, common)


def _features(text: str, place: str, start: int, a: int, b: int, rule: str, common: frozenset[str]) -> list[float]:
    value = text[a:b]
    kinds = value.translate(KINDS_OF)
    n, steps = len(value), max(len(value) - 1, 1)
    changes = Counter(map("".join, zip(kinds, kinds[1:], strict=False)))
    counts = np.array(list(Counter(value).values())) / n
    line = text.rfind("\n", 0, start) + 1
    before, after = text[max(0, start - 80) : start].split()[-2:], text[b : b + 80].split()[:2]
    lower, folded = value.lower(), [w.lower().strip(".,:;()`\"'") for w in before + after]
    assigned = text[start:a].lower() if rule == "assigned" else text[max(0, a - 12) : a].lower()
    out = [
        float(n), sum(k for pair, k in changes.items() if pair[0] != pair[1]) / steps, (changes["ld"] + changes["dl"]) / steps,
        (changes["lu"] + changes["ul"]) / steps, kinds.count("d") / n, float(-(counts * np.log2(counts)).sum()), float(len(set(kinds))),
        _coverage(lower, common), float(rule == "assigned"), float(rule in FORMATS), float(start == line), float(sum(w in common for w in folded)),
        float(not lower.strip("0123456789abcdef")), kinds.count("s") / n, max(map(len, re.split("[^A-Za-z]+", value))) / n,
        float(any(x in w for x in DIGESTS for w in [assigned, *folded])), _printable(value), (changes["ss"]) / steps, float(max(counts)),
    ]
    spread = [0.0] * NEIGHBOURS
    for side, ws in (("b", before), ("a", after), ("p", [place])):
        for w in ws:
            spread[_hash(side + w.lower()) % NEIGHBOURS] += 1.0
    return out + spread


def _printable(value: str) -> float:
    """The share of letters and spaces in what the value decodes to as base64; 0 if it does not."""
    body = value.rstrip("=")
    if len(body) < LEAST or not re.fullmatch(r"[A-Za-z0-9+/]+", body):
        return 0.0
    raw = base64.b64decode(body[: len(body) // 4 * 4])
    return sum(65 <= c <= 90 or 97 <= c <= 122 or c == 32 for c in raw) / len(raw)


def _hash(word: str) -> int:
    return int(mix(np.array([int.from_bytes(word.encode()[:8].ljust(8, b"\0"), "little")], np.uint64))[0])


def _coverage(value: str, common: frozenset[str]) -> float:
    """The share of characters that dictionary words cover, the longest first from each place on."""
    at = covered = 0
    while at < len(value):
        for n in range(min(20, len(value) - at), 2, -1):
            if value[at : at + n] in common:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / max(len(value), 1)
