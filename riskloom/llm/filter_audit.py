"""How quality filters interact: what each removes, in every order, and what the others would have removed anyway.

Five filters judge whole texts: A too few words, B too few distinct ones, C many capitals, D markup signs, E a text
that a smaller id has anywhere in the table. A to D are found where a text lies. For E, a bytes-weighted sample of the
texts is sorted, and the shortest prefixes that part the samples cut the texts into ranges of about ``range_bytes``, or
less where there are more shuffle partitions. Each task joins its copies of a text and stores every text once (for
every 32 MB) with its least id; ranges of texts meet in compressed radix tries whose terminals hold least ids, and a
traversal gives these back to the tasks' texts. A text that a third of all rows hold thus reaches its trie once for each
task. The sample decides only how texts are dealt out; equality is that of whole texts. Failures of a document become
one mask of five bits; masks are counted by part, and all orders are read off those counts, 32 or fewer for each part.

Nulls: a null text is empty, a null part is the empty string; a null id is neither smaller nor larger than any other, so
E keeps it and it gives no label. Repeated rows each count; rows of one id are not duplicates of each other. Of repeated
labels an id is good (toxic) if any says so. Empty tables give no rows. Texts of any length are compared whole. Other
columns of the input are left out, so none can clash.
"""

from __future__ import annotations

import itertools
import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import byte_table, slices, words
from riskloom.session import materialise

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SIGNS = 200, 50, 3, r"[#$%&*|]"
DUPLICATE = 16
#: Text of a range; sampled texts stand for this much text each; text that a task holds while it joins copies.
RANGE_BYTES, SAMPLE_BYTES, HELD_BYTES = 16 << 20, 1 << 20, 32 << 20
CASED = byte_table(b"\x20\t\n\v\f\r", lower=False)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = [
    {"filter_order": o, "step": k + 1, "before": sum(1 << FILTERS.index(x) for x in o[:k]), "bit": 1 << FILTERS.index(o[k])} for o in ORDERS for k in range(len(o))
]
JUDGED = {"r": pa.int64(), "doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "range": pa.int64(), "text": pa.binary(), "least": pa.int64(), "docs": pa.int64()}


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, with zeros where nothing is removed."""
    return interactions(failures(docs, part=part), labels)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, part, mask) of every row; bit k of the mask is set if the document fails the k-th filter."""
    spark = docs.sparkSession
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), filled(part).alias("part"), filled(text).alias("text"))
    cuts = spark.sparkContext.broadcast(separators(rows.select("text"), range_bytes))
    schema = "r long, doc_id long, part string, mask int, range long, text binary, least long, docs long"
    judged = materialise(rows.mapInArrow(lambda batches: _judge(batches, cuts.value), schema), "filter-audit")
    texts = judged.where("range IS NOT NULL").select("range", "r", "text", "least", "docs")
    least = texts.repartition("range").sortWithinPartitions("range").mapInArrow(_tries, "r long, least long")
    each = judged.where("range IS NULL").select("r", "doc_id", "part", "mask").join(least, "r", "left")
    copy = F.when(F.col("doc_id") > F.col("least"), DUPLICATE).otherwise(0)
    return each.select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def separators(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> list[bytes]:
    """The shortest prefixes, in order, that part every few texts of a sorted sample from those before them."""
    sample = texts.where(F.rand(7) < F.octet_length("text") / F.lit(float(min(SAMPLE_BYTES, range_bytes))))
    sample = materialise(sample.select(F.substring("text", 1, 64).alias("head"), "text"), "text-sample")
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, min(range_bytes // min(SAMPLE_BYTES, range_bytes), sample.count() // partitions))
    ordered = sample.repartitionByRange("head").sortWithinPartitions("text").select(F.col("text").cast("binary").alias("text"))
    found = ordered.mapInArrow(lambda batches: _separate(batches, every), "cut binary").collect()
    return sorted({bytes(r["cut"]) for r in found})


def _separate(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    before, passed = b"", 0
    for batch in batches:
        cuts = []
        for text in batch.column(0).to_pylist():
            passed += 1
            if text != before and passed >= every:
                cuts.append(text[: shared(before, text, 0) + 1])
                passed = 0
            before = text
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.binary())], ["cut"])


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes ``a`` has in common with what stands in ``b`` from ``at``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[at + low : at + mid] else (low, mid - 1)
    return low


def _judge(batches: Iterator[pa.RecordBatch], cuts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each distinct text with the least id of its documents; ``r`` links them."""
    number = TaskContext.get().partitionId() << 40
    held: dict[bytes, list] = {}
    size = 0
    for batch in slices(batches):
        ids, parts, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part", "text"))
        numbers = np.empty(batch.num_rows, np.int64)
        for k, (key, text) in enumerate(zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)):
            record = held.get(text)
            if record is None:
                record = held[text] = [number, None, 0]
                number += 1
                size += len(text) + 200
            if key is not None and (record[1] is None or key < record[1]):
                record[1] = key
            record[2] += 1
            numbers[k] = record[0]
        yield _rows(batch.num_rows, r=numbers, doc_id=ids, part=parts, mask=_mask(texts))
        if size >= HELD_BYTES:
            yield from _texts(held, cuts)
            held, size = {}, 0
    yield from _texts(held, cuts)


def _mask(texts: pa.Array) -> np.ndarray:
    """Bits A to D of each text."""
    w = words(texts, CASED)
    n = np.diff(w.bounds)
    of = np.repeat(np.arange(len(n), dtype=np.int64), n)
    width = max(len(w.distinct), 1)
    distinct = np.bincount(np.unique(of * width + w.ids[: len(of)]) // width, minlength=len(n)) if len(of) else np.zeros(len(n), np.int64)
    capitals = pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False)
    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    signs = pc.match_substring_regex(texts, SIGNS).to_numpy(zero_copy_only=False)
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * n, 100 * capitals.astype(np.int64) > MOST_CAPITALS_PERCENT * points.astype(np.int64), signs)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails)).astype(np.int32)


def _texts(held: dict[bytes, list], cuts: list[bytes]) -> Iterator[pa.RecordBatch]:
    todo, rows, size = len(held), [], 0
    for text, (number, least, docs) in held.items():
        rows.append((number, bisect_right(cuts, text), text, least, docs))
        todo, size = todo - 1, size + len(text)
        if size >= 4 << 20 or not todo:
            yield _rows(len(rows), **dict(zip(("r", "range", "text", "least", "docs"), zip(*rows, strict=True), strict=True)))
            rows, size = [], 0


def _rows(n: int, **columns) -> pa.RecordBatch:
    made = [c if isinstance(c := columns.get(name), pa.Array) else pa.nulls(n, t) if c is None else pa.array(c, t) for name, t in JUDGED.items()]
    return pa.RecordBatch.from_arrays(made, list(JUDGED))


class Trie:
    """A compressed radix trie. A text ends at a terminal, which holds its least id, documents and records."""

    __slots__ = ("edges", "least", "docs", "records")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Trie]] = {}
        self.least: int | None = None
        self.docs = 0
        self.records: list[int] = []

    def insert(self, text: bytes, record: int, least: int | None, docs: int) -> None:
        node, at = self, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Trie()
                node.edges[text[at]] = (text[at:], leaf)
                node = leaf
                break
            label, child = edge
            if not text.startswith(label, at):
                k = shared(label, text, at)
                fork = Trie()
                fork.edges[label[k]] = (label[k:], child)
                label, child = label[:k], fork
                node.edges[text[at]] = (label, child)
            node, at = child, at + len(label)
        if least is not None and (node.least is None or least < node.least):
            node.least = least
        node.docs += docs
        node.records.append(record)

    def copied(self) -> Iterator[tuple[list[int], int | None]]:
        """Records and least id of every text of more than one document."""
        stack = [self]
        while stack:
            node = stack.pop()
            if node.docs > 1:
                yield node.records, node.least
            stack += [child for _, child in node.edges.values()]


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, least) of the texts of more than one document. Rows come in order of range; one trie at a time."""
    trie, current = Trie(), None
    for batch in slices(batches):
        for span, record, text, least, docs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if span != current:
                yield from _least(trie)
                trie, current = Trie(), span
            trie.insert(text, record, least, docs)
    yield from _least(trie)


def _least(trie: Trie, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, int]] = []
    for records, least in trie.copied():
        if least is not None:
            found += [(r, least) for r in records]
        if len(found) >= size:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["r", "least"])


def interactions(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of ``failures`` rows by part, order and step; ``labels(doc_id, quality, toxic)``."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    # Counted before the join: an id or a null that many rows have becomes one row for each mask.
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]]
    masks = rows.groupBy("part", "mask").agg(*sums)
    cells = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    kind = "array<struct<filter_order: string, step: int, before: int, bit: int>>"
    rows = cells.withColumn("at", F.explode(F.from_json(F.lit(json.dumps(STEPS)), kind)))
    before, bit = F.col("at.before"), F.col("at.bit")
    fails, passed = lambda x: x["mask"].bitwiseAND(bit) != 0, lambda x: x["mask"].bitwiseAND(before) == 0
    removed = lambda x: fails(x) & passed(x)
    # Over all orders a document goes equally often to each filter that it fails.
    share = lambda x: x["n"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(x["mask"]))
    return rows.select(
        "part", "at.filter_order", "at.step",
        _total(lambda x: passed(x) & ~fails(x)).alias("kept"), _total(removed).alias("removed"),
        _total(lambda x: fails(x) & ~passed(x)).alias("redundant"), _total(lambda x: x["mask"] == bit).alias("unique_fails"),
        _total(removed, lambda x: x["good"]).alias("good_lost"), _total(removed, lambda x: x["toxic"]).alias("toxic_lost"),
        _total(fails, share).alias("shapley"),
    )


def _total(chosen: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x["n"]) -> Column:
    return F.aggregate(F.filter("cells", chosen), F.lit(0).cast("long"), lambda total, x: total + value(x).cast("long"))
