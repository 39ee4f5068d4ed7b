"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's set holds the hashes of its distinct five-word shingles; with fewer words, the whole sequence is its one
shingle; without words it is empty and linked with nothing. Documents are linked where the sets' Jaccard similarity is
0.75 or more, and grouped by the links' connected components.

* Signature: in round j every shingle offers the value j + r at the next place of its own random permutation of the
  places; each place keeps the least. A document is done when no place can get less (early stopping): long documents
  need one round, and places are correlated so that estimates vary less than with independent hashes.
* Equal sets form a class; its smallest id stands for it from then on. An id with several texts can be the smallest of
  several classes: one of these keeps the id, the others get numbers above all ids, and links by the id tie them.
* Banding: 32 bands of 4 places. A pair at the limit shares none with probability 5e-6.
* In a bucket no pairs of all members are formed. In a few rounds each member is compared with its most similar
  pivot, which joins the large groups. What may still be linked are documents of different groups in one bucket:
  they are compared in blocks, by sketches (which drop pairs estimated more than five deviations under the limit)
  and then on full sets. A link within a group changes nothing and is not looked for.

Nulls: a null text is an empty one; a row without an id is linked with nothing (component null, kept). Rows that
repeat an id share a component, whatever order they come in. Texts of any length are read whole. An empty table gives no
rows. Other columns are ignored here and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.columns import carried, restored, tidy
from riskloom.llm.words import BY_WHITE_SPACE, mix, shingles, slices, words
from riskloom.session import materialise

PLACES = 128
BANDS = 32
STAR_ROUNDS = 2
#: Documents in a block of the last comparison.
BLOCK = 256
#: Shingles whose permutations are held at once.
HELD = 60_000
FRACTION_BITS = 24
GOLDEN = 0x9E3779B97F4A7C15
SIGNED = "doc_id long, mark long, n_shingles long, low long, high long, bands array<long>, sketch binary"
WHOLE = ["n_shingles", "low", "high"]
LARGEST = (1 << 63) - 1


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, one text after the other, and their bounds."""
    found = words(texts, BY_WHITE_SPACE)
    hashes = found.hashes()[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    runs = shingles(hashes, n)
    sets = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(runs[a : b - n + 1]))
        else:
            sets.append(mix(shingles(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    bounds = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def signatures(elements: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures of sets (bounds as above), as integers: round in the high bits, fraction in the low ones."""
    n = len(bounds) - 1
    out = np.full((n, places), np.iinfo(np.uint32).max, np.uint32)
    start = 0
    while start < n:  # documents by groups of about HELD shingles; of a larger one, by parts
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + HELD, side="right")) - 1)
        if end == start + 1:
            for a in range(bounds[start], bounds[end], HELD):
                _rounds(elements[a : min(a + HELD, bounds[end])], np.zeros(min(HELD, bounds[end] - a), np.int64), out[start:end])
        else:
            _rounds(elements[bounds[start] : bounds[end]], np.repeat(np.arange(end - start), np.diff(bounds[start : end + 1])), out[start:end])
        start = end
    return out


def _rounds(elements: np.ndarray, owner: np.ndarray, table: np.ndarray) -> None:
    places = table.shape[1]
    flat = table.reshape(-1)
    rows, order = np.arange(len(elements)), None
    for j in range(places):
        if not len(elements):
            return
        random = mix(elements + np.uint64((GOLDEN * (j + 1)) % (1 << 64)))
        value = np.uint32(j << FRACTION_BITS) + (random >> np.uint64(64 - FRACTION_BITS)).astype(np.uint32)
        other = j + (((random & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        target = other if order is None else order[rows, other]
        np.minimum.at(flat, owner * places + target, value)
        going = (table >> FRACTION_BITS).max(axis=1) > j
        still = going[owner]
        if order is None:
            elements, owner, other, target = elements[still], owner[still], other[still], target[still]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(elements), 1))
        elif not still.all():
            elements, owner, other, target, order = elements[still], owner[still], other[still], target[still], order[still]
        rows = np.arange(len(elements))
        order[rows, other] = order[:, j]
        order[:, j] = target


def band_keys(table: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band of places and of the band's number."""
    parts = table.reshape(len(table), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN), parts.shape[:2])
    for k in range(parts.shape[2]):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)


def sign(docs: DataFrame, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """Set size, two sums that tell sets apart, band keys and an 8-bit sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            elements, bounds = shingle_sets(batch.column("text"))
            table = signatures(elements, bounds, places)
            filled = np.flatnonzero(np.diff(bounds))
            sums = np.zeros((2, batch.num_rows), np.uint64)
            for k, salt in enumerate((0, GOLDEN)):
                if len(filled):
                    sums[k, filled] = np.add.reduceat(mix(elements + np.uint64(salt)), bounds[:-1][filled])
            keys = band_keys(table, bands)
            sketch = (table & 255).astype(np.uint8)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(places), n, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary()),
                ],
                names=["doc_id", "mark", "n_shingles", "low", "high", "bands", "sketch"],
            )

    return _marked(docs).mapInArrow(run, SIGNED)


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): the mark tells the texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))


def classes_of(signed: DataFrame) -> DataFrame:
    """(n_shingles, low, high, first, mark, rep) of each set; ``first`` is the smallest id that has it."""
    grouped = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*WHOLE).agg(F.min(F.struct("doc_id", "mark")).alias("at"))
    grouped = materialise(grouped.select(*WHOLE, F.col("at.doc_id").alias("first"), "at.mark", F.monotonically_increasing_id().alias("number")), "near-sets-of-ids")
    repeated = grouped.groupBy("first").agg(F.min("number").alias("base"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = F.when(F.coalesce(F.col("base"), F.col("number")) == F.col("number"), F.col("first")).otherwise(F.lit(LARGEST) - F.col("number"))
    return materialise(grouped.join(repeated, "first", "left").select(*WHOLE, "first", "mark", own.alias("rep")), "near-classes")


def near_duplicates(docs: DataFrame, percent: int = 75, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``."""
    tidy(docs.sparkSession)
    signed = materialise(sign(docs), "near-signatures")
    classes = classes_of(signed)
    component = _components(docs, signed, classes, percent, star_rounds)
    of_class = classes.join(component, "rep", "left").select(*WHOLE, F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", *WHOLE).join(of_class, WHOLE, "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, **options: int) -> DataFrame:
    """One row of each group, that of the smallest id; rows without an id stay. Of several rows of that id the one with
    the least hashes of its text and of the whole row stays."""
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    kept = materialise(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")), "near-kept")
    ids = kept.select(F.col("doc_id").alias("_id"))
    out = docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi")
    if kept.where("_n > 1").limit(1).count():
        rows = carried(out, "doc_id").withColumn("hashes", F.struct(F.xxhash64("row.text").alias("text"), F.xxhash64("row").alias("all")))
        least = rows.groupBy("doc_id").agg(F.min("hashes").alias("hashes"))
        out = restored(rows.join(least, ["doc_id", "hashes"]).dropDuplicates(["doc_id", "hashes"]), docs.columns)
    return out.unionByName(docs.where("doc_id is null"))


def _components(docs: DataFrame, signed: DataFrame, classes: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    """(rep, component) of the classes' representatives that are linked with others."""
    spark = docs.sparkSession
    one = classes.select(F.col("first").alias("doc_id"), "mark", "rep")
    reps = signed.join(one, ["doc_id", "mark"]).select("rep", "bands", "sketch")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).where("pivot < top").drop("top")
    members = materialise(banded.join(shared, "key").distinct(), "near-members")
    home = materialise(members.groupBy("rep").agg(F.min("pivot").alias("home")), "near-homes")
    sketches = materialise(reps.join(home, "rep", "left_semi").select("rep", "sketch").dropDuplicates(["rep"]), "near-sketches")
    texts = _marked(docs).join(one.join(home, "rep", "left_semi"), ["doc_id", "mark"]).select("rep", "text")
    sets = materialise(texts.mapInArrow(_sets, "rep long, elements binary").dropDuplicates(["rep"]), "near-sets")
    labels = no_labels(spark)
    # Same id, different texts: linked by the id.
    twice = linked_by_id(signed, classes)
    if twice is not None:
        labels = merge(labels, twice)

    for turn in range(star_rounds):
        known = _known(members, labels)
        if turn == 0:
            pivots = known.select("key", F.col("pivot").alias("r")).distinct()
        else:
            rank = F.xxhash64("rep", F.lit(turn))
            pivots = known.groupBy("key").agg(F.min(F.struct(rank, F.col("rep").alias("r"))).alias("p")).select("key", "p.r")
        group = labels.select(F.col("rep").alias("r"), F.col("component").alias("c"))
        pairs = known.join(pivots, "key").where("rep <> r").select("rep", "component", "r").distinct().join(group, "r", "left").where("component <> coalesce(c, r)")
        near = materialise(_estimated(pairs.select(F.col("rep").alias("a"), F.col("r").alias("b")), sketches, percent), "near-pairs")
        best = near.groupBy("a").agg(F.max(F.struct("same", "b")).alias("p")).select("a", "p.b")
        labels = merge(labels, materialise(_verified(best, sets, percent), "near-links"))
    return merge(labels, materialise(_sweep(members, labels, home, sketches, sets, percent), "near-links"))


def no_labels(spark: SparkSession) -> DataFrame:
    """No groups (rep, component), known as empty to the planner: rows given from Python would start workers at each use."""
    return spark.range(0).select(F.col("id").alias("rep"), F.col("id").alias("component"))


def _known(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their groups, of the buckets that hold several groups."""
    known = members.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return known.join(mixed, "key", "left_semi")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        elements, bounds = shingle_sets(batch.column("text"))
        packed = [elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(packed, pa.binary())], names=["rep", "elements"])


def _least_same(percent: int) -> int:
    """Equal sketch bytes that a pair at the limit has but for one time in ten millions."""
    j = percent / 100
    return int(PLACES * (j - 5.2 * (j * (1 - j) / PLACES) ** 0.5))


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs with the number of equal sketch bytes, without those far under the limit."""
    least = _least_same(percent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            same = (x == y).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same.astype(np.int32))], names=["a", "b", "same"])
            yield out.filter(pa.array(same >= least))

    x = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x"))
    y = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(count, "a long, b long, same int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                linked.append(bool(_similar(x, y, np.array([0, len(y)]), percent)[0]))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    x = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _similar(x: np.ndarray, others: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Which of several sorted sets (none empty) are similar enough to the sorted set x."""
    at = np.minimum(np.searchsorted(x, others), len(x) - 1)
    common = np.add.reduceat((x[at] == others).astype(np.int64), bounds[:-1])
    return (common > 0) & (100 * common >= percent * (len(x) + np.diff(bounds) - common))


def _sweep(members: DataFrame, labels: DataFrame, home: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among all pairs of different groups that share a bucket, tested block by block.

    Documents of one home (the group, or that of the first pivot) are dealt to blocks of about BLOCK. Two blocks that
    meet in a bucket are a unit: its sketches are compared at once, and the pairs that pass are verified in one task
    on the sets of the documents concerned. However many buckets two blocks share, they are compared once.
    """
    least = _least_same(percent)
    known = _known(members, labels)
    group = labels.select(F.col("rep").alias("home"), F.col("component").alias("of_home"))
    placed = known.select("rep", "component").distinct().join(home, "rep").join(group, "home", "left").withColumn("home", F.coalesce("of_home", "home"))
    placed = placed.withColumn("home", F.when(F.col("component") < F.col("rep"), F.col("component")).otherwise(F.col("home")))
    sizes = placed.groupBy("home").agg(F.count("*").alias("n"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)))
    placed = materialise(placed.join(sizes, "home").select("rep", "component", block.alias("block")), "near-blocks")
    in_bucket = materialise(known.select("key", "rep").join(placed, "rep").select("key", "block").distinct(), "near-bucket-blocks")
    other = in_bucket.select("key", F.col("block").alias("right"))
    units = materialise(in_bucket.withColumnRenamed("block", "left").join(other, "key").where("left <= right").select("left", "right").distinct(), "near-units")
    full = placed.join(sketches, "rep").groupBy("block").agg(F.collect_list(F.struct("rep", "component", "sketch")).alias("docs"))
    left, right = (full.select(F.col("block").alias(k), F.col("docs").alias(c)) for k, c in (("left", "x"), ("right", "y")))
    close = materialise(units.join(left, "left").join(right, "right").select("left", "right", "x", "y").mapInArrow(_close(least), "left long, right long, a array<long>, b array<long>"), "near-close")

    needed = close.select(F.col("left").alias("l"), F.col("right").alias("r"), F.explode(F.array_distinct(F.concat("a", "b"))).alias("rep"))
    carried = needed.join(sets, "rep").join(placed.select("rep", "component"), "rep")
    return close.groupBy("left", "right").cogroup(carried.groupBy("l", "r")).applyInArrow(_exact(percent), "a long, b long")


def _close(least: int):
    """Pairs of two blocks, of different groups, whose sketches are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one unit's documents at a time
                unit = batch.slice(k, 1)
                (ids, of, x), (others, others_of, y) = (_columns(unit.column(c).flatten()) for c in ("x", "y"))
                a, b = [], []
                for i in range(len(ids)):
                    near = ((y == x[i]).sum(axis=1) >= least) & (others_of != of[i])
                    if unit.column("left") == unit.column("right"):
                        near &= others > ids[i]
                    b.append(others[near])
                    a.append(np.full(len(b[-1]), ids[i]))
                a, b = np.concatenate(a), np.concatenate(b)
                if len(a):
                    kind = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([unit.column("left"), unit.column("right"), pa.array([a], kind), pa.array([b], kind)], names=["left", "right", "a", "b"])

    return run


def _columns(docs: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rep, component, sketch = docs.flatten()
    return rep.to_numpy(), component.to_numpy(), np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(len(docs), -1)


def _exact(percent: int):
    """Of a unit's pairs, links that join its groups as all its links would: a forest of them."""

    def run(close: pa.Table, carried: pa.Table) -> pa.Table:
        sets = {r: np.frombuffer(e, np.uint64) for r, e in zip(carried["rep"].to_pylist(), carried["elements"].to_pylist(), strict=True)}
        group = dict(zip(carried["rep"].to_pylist(), carried["component"].to_pylist(), strict=True))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for pairs_a, pairs_b in zip(close["a"].to_pylist(), close["b"].to_pylist(), strict=True):
            a, b = np.array(pairs_a), np.array(pairs_b)
            cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=True):
                x = int(a[start])
                others = [y for y in b[start:end].tolist() if root(group[y]) != root(group[x])]
                if not others:
                    continue
                bounds = np.cumsum([0, *(len(sets[y]) for y in others)])
                for y in np.array(others)[_similar(sets[x], np.concatenate([sets[y] for y in others]), bounds, percent)].tolist():
                    p, q = root(group[x]), root(group[y])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        links.append((x, y))
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def linked_by_id(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of one id with different texts, if there are any: each to the least of them."""
    rows = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", *WHOLE).distinct()
    several = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    tied = materialise(rows.join(several, "doc_id", "left_semi").join(classes, WHOLE).select("doc_id", "rep"), "near-same-id")
    if not tied.limit(1).count():
        return None
    links = tied.join(tied.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id")
    return links.where("least < rep").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (rep, component) after further links; a group's label is its smallest member."""
    known = labels.select(F.col("rep").alias("node"), "component")

    def relabel(edges: DataFrame, by: DataFrame) -> DataFrame:
        a, b = by.select(F.col("node").alias("a"), F.col("component").alias("x")), by.select(F.col("node").alias("b"), F.col("component").alias("y"))
        named = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
        return named.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    members = known.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    members = members.groupBy("node").agg(F.min("component").alias("component"))
    edges = materialise(relabel(links, known).mapInArrow(forest, "a long, b long"), "near-edges")
    members = materialise(members, "near-groups")
    while edges.limit(1).count():
        parent = materialise(edges.groupBy("b").agg(F.min("a").alias("a")), "near-parents")
        while True:  # every node of the forest hangs on a smaller one; halve the paths until all hang on roots
            up = parent.select(F.col("b").alias("a"), F.col("a").alias("root"))
            jumped = materialise(parent.join(up, "a", "left").select("b", F.coalesce("root", "a").alias("a"), F.col("root").isNotNull().alias("moved")), "near-roots")
            parent = jumped.select("b", "a")
            if not jumped.where("moved").limit(1).count():
                break
        step = parent.select(F.col("b").alias("node"), F.col("a").alias("component"))
        edges = materialise(relabel(edges, step), "near-edges")
        up = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        members = materialise(members.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "near-groups")
    return members.select(F.col("node").alias("rep"), "component")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links: one link to the smallest member from each other member of a local group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    links = [(root(x), x) for x in list(parent) if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])
