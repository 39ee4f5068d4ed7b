"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Words are lower-cased runs of letters, digits and characters beyond ASCII. A window is ``window`` consecutive words of
an item; a shorter item that has words is one window. The automaton of all windows' text reads a document's words one
by one and keeps the longest match that ends at each; where it reaches a window, the window's words are hit and its
items are noted. Stretches whose neighbouring words never stand together in an item are skipped beforehand: the match
breaks there in any case.

Items are cut into overlapping segments (which have the same windows); copies of a segment (known by a 64-bit
hash) are one, with several ids.
Segments are broadcast as numbers, four bytes a word, and the tasks build automata of ``SHARD_WORDS`` words from them.
Documents are read once: a task holds the stretches of some texts, leads them through the automata one after another and
keeps only the last few automata. Items of more than ``PASS_WORDS`` words in all take another pass over the documents
for each ``PASS_WORDS``, so that no broadcast grows with the benchmark.

Nulls: a null or empty text has no words and is never hit, a text of any length is read whole; a null item text is skipped; an item without an id hits
words but is not listed. Documents are rows: repeated ids are judged row by row, and all columns of the input are
kept except those that the result adds, which replace columns of the same name. Empty tables give no hits.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import carried, restored
from riskloom.llm.words import BY_PUNCTUATION, _buffers, slices, words
from riskloom.session import materialise

SHARD_WORDS = 50_000
SEGMENT_WORDS = 4_096
#: Item words of one broadcast.
PASS_WORDS = 4_000_000
#: Automata that a task keeps, and the bytes of text whose stretches it holds while it goes through more than these.
KEPT_AUTOMATA = 2
HELD_BYTES = 128 << 20
ADDED = "n_words long, hits array<struct<first: int, last: int, start: long, stop: long>>, items array<long>"


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, segments: list[tuple[int, list[int]]], window: int) -> None:
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.long_items: list[set] = [set()]
        short: dict[int, list[tuple[int, int | None]]] = {}
        for item, seq in segments:
            state = 0
            for n, word in enumerate(seq, 1):
                state = self._extend(state, word)
                if n >= window:
                    self.long_items[state].add((item,))
            if seq and len(seq) < window:
                short.setdefault(state, []).append((len(seq), item))
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in order:  # what ends in a state ends in its suffixes too
            if self.length[self.link[s]] >= window:
                self.long_items[self.link[s]] |= self.long_items[s]
        self.short: list[tuple] = [()] * len(self.link)
        for s in reversed(order):
            self.short[s] = (*short.get(s, ()), *self.short[self.link[s]])
        # The suffix of exactly one window: the last state up the links that is long enough.
        self.anchor = [-1] * len(self.link)
        for s in reversed(order):
            up = self.link[s]
            self.anchor[s] = -1 if self.length[s] < window else s if self.length[up] < window else self.anchor[up]

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            q = step[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = self._state({}, 0, length[last] + 1)
        p = last
        while p != -1 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p != -1:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p != -1 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.long_items.append(set())
        return len(self.link) - 1

    def matches(self, stream: list[int]) -> Iterator[tuple[int, int, list]]:
        """(position, words covered up to it, item ids) wherever a window ends."""
        step, link, length, window = self.step, self.link, self.length, self.window
        state = matched = 0
        for i, word in enumerate(stream):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            if matched >= window:
                yield i, window, [x for (x,) in self.long_items[self.anchor[state] if self.length[link[state]] < window else self.anchor[link[state]]]]
            for n, item in self.short[state]:
                if n <= matched:
                    yield i, n, [item]


class Segments(NamedTuple):
    """Distinct segments as numbers of words, and the item ids of each."""

    names: pa.Array  #: the distinct words
    words: np.ndarray  #: their places in ``names``, one segment after another
    bounds: np.ndarray  #: where each segment begins, and the end
    items: np.ndarray
    item_bounds: np.ndarray
    window: int
    shard_words: int

    def shards(self) -> list[range]:
        """Consecutive segments of about ``shard_words`` words."""
        of = self.bounds[:-1] // self.shard_words
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def pairs(self, which: range) -> np.ndarray:
        """Neighbouring words of some segments, each pair as one number."""
        a, b = self.bounds[which.start], self.bounds[which.stop]
        inside = np.ones(b - a, bool)
        inside[self.bounds[which.start + 1 : which.stop + 1] - a - 1] = False  # no pair begins with a segment's last word
        run = self.words[a:b].astype(np.int64)
        return np.unique(run[:-1][inside[:-1]] * len(self.names) + run[1:][inside[:-1]])

    def automaton(self, which: range) -> Automaton:
        return Automaton([(k, self.words[self.bounds[k] : self.bounds[k + 1]].tolist()) for k in which], self.window)

    def least(self, which: range) -> int:
        return int(min(self.window, np.diff(self.bounds[which.start : which.stop + 1]).min()))

    def listed(self, segments: set[int]) -> list[int]:
        return sorted({i for k in segments for i in self.items[self.item_bounds[k] : self.item_bounds[k + 1]].tolist()})


def scan(docs: DataFrame, items: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """``docs`` with n_words, hits (merged runs of hit words, with their bytes in the text) and items."""
    added = [c.split()[0] for c in ADDED.split(", ") if not c.startswith(("last", "start", "stop"))]
    out = docs.drop(*added)
    types = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in out.schema)
    cut = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    cut = materialise(cut.mapInArrow(_segments(window), "item_id long, words array<string>").withColumn("segment", F.xxhash64("words")), "segments")
    distinct = cut.groupBy("segment").agg(F.first("words").alias("words"))
    passes = max(1, -(-(distinct.agg(F.sum(F.size("words"))).first()[0] or 0) // pass_words))
    for k in range(passes):
        mine = F.pmod(F.col("segment"), F.lit(passes)) == k
        # Ids travel apart from the words, so that an item of many copies is collected once.
        ids = cut.where(mine & F.col("item_id").isNotNull()).select("segment", "item_id").distinct()
        known = docs.sparkSession.sparkContext.broadcast(tuple(_coded(distinct.where(mine).toArrow(), ids.toArrow(), window, shard_words)))
        source = out if k == 0 else materialise(out, "decontaminate")
        out = source.mapInArrow(_reader(known, k == 0), f"{types}, {ADDED}")
    return out


def _coded(segments: pa.Table, ids: pa.Table, window: int, shard_words: int) -> Segments:
    lists = segments.column("words").combine_chunks()
    spelt = lists.flatten().cast(pa.binary()).dictionary_encode()
    order = segments.column("segment").to_numpy()
    ranked = np.argsort(order)
    place = ranked[np.searchsorted(order[ranked], ids.column("segment").to_numpy())] if len(order) else np.zeros(0, np.int64)
    by_place = np.argsort(place, kind="stable")
    return Segments(
        spelt.dictionary, spelt.indices.to_numpy(zero_copy_only=False).astype(np.int32),
        np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64),
        ids.column("item_id").to_numpy()[by_place], np.searchsorted(place[by_place], np.arange(len(order) + 1)), window, shard_words,
    )


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)


def contaminated(coverage: int = 20) -> Column:
    """At least one word in ``coverage`` is hit."""
    return (n_hit() > 0) & (coverage * n_hit() >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, coverage: int = 20, longest: int = 50) -> DataFrame:
    """Documents over the coverage limit go; from others, spans of ``longest`` or more hit words are cut out.

    Keeps the columns of ``docs``; n_chars, if there is one, follows the new text.
    """
    found = scan(carried(docs, "text"), items, window).where(~contaminated(coverage))
    long = F.filter("hits", lambda h: h["last"] - h["first"] + 1 >= longest)
    utf8 = F.encode("text", "utf-8")
    ends = F.concat(F.transform(long, lambda h: h["start"]), F.array(F.octet_length("text").cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(long, lambda h: h["stop"]))
    parts = F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(utf8, (a + 1).cast("int"), (b - a).cast("int")), "utf-8"))
    out = found.withColumn("text", F.when(F.size(long) > 0, F.array_join(parts, "")).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size(long) > 0, new).otherwise(F.col("row.n_chars"))
    return restored(out, docs.columns, **changed)


def _segments(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = words(batch.column("text"), BY_PUNCTUATION)
            names = [w.decode() for w in found.distinct.to_pylist()]
            ids, out = [], []
            for item, a, b in zip(batch.column("item_id").to_pylist(), found.bounds[:-1], found.bounds[1:], strict=True):
                for start in range(a, max(b - window + 1, a + (b > a)), SEGMENT_WORDS):
                    ids.append(item)
                    out.append([names[k] for k in found.ids[start : min(b, start + SEGMENT_WORDS + window - 1)]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.string()))], names=["item_id", "words"])

    return cut


class _Texts:
    """A slice of documents: the stretches that may hold windows, and what the automata found in them."""

    def __init__(self, batch: pa.RecordBatch, names: dict[bytes, int], pairs: np.ndarray, least: int) -> None:
        texts = batch.column("text")
        found = words(texts, BY_PUNCTUATION)
        offsets, _ = _buffers(texts)
        self.batch, self.size, self.bounds, self.offsets = batch, int(offsets[-1] - offsets[0]), found.bounds, offsets - offsets[0]
        ids = np.fromiter((names.get(w, -1) for w in found.distinct.to_pylist()), np.int64, len(found.distinct))[found.ids]
        self.begins, sizes = _stretches(ids, found.bounds, pairs, len(names), least)
        self.runs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # Only the words of stretches are kept: their places, numbers and bytes.
        self.at = np.arange(self.runs[-1]) + np.repeat(self.begins - self.runs[:-1], sizes)
        self.ids, self.byte_starts, self.byte_ends = ids[self.at], found.starts[self.at], found.ends[self.at]
        self.doc = np.searchsorted(found.bounds, self.begins, side="right") - 1
        self.spans: dict[int, list] = {}
        self.segments: dict[int, set] = {}

    def meet(self, automaton: Automaton, pairs: np.ndarray, n: int, least: int) -> None:
        begins, sizes = _stretches(self.ids, self.runs, pairs, n, least)
        run = np.searchsorted(self.runs, begins, side="right") - 1
        for start, size, r in zip(begins.tolist(), sizes.tolist(), run.tolist(), strict=True):
            doc, shift = int(self.doc[r]), int(self.begins[r] - self.runs[r]) + start
            for i, covered, which in automaton.matches(self.ids[start : start + size].tolist()):
                self.spans.setdefault(doc, []).append((shift + i - covered + 1, shift + i))
                self.segments.setdefault(doc, set()).update(which)

    def rows(self, known: Segments, first: bool) -> pa.RecordBatch:
        batch, bounds = self.batch, self.bounds
        byte = lambda ends, word, d: int(ends[np.searchsorted(self.at, word)] - self.offsets[d])
        place = lambda d, a, b: (int(a - bounds[d]), int(b - bounds[d]), byte(self.byte_starts, a, d), byte(self.byte_ends, b, d))
        hits = [[place(d, a, b) for a, b in _merge(self.spans.get(d, []))] for d in range(batch.num_rows)]
        listed = [known.listed(self.segments.get(d, set())) for d in range(batch.num_rows)]
        if not first:
            hits = [_merge([tuple(h.values()) for h in x] + y) for x, y in zip(batch.column("hits").to_pylist(), hits, strict=True)]
            listed = [sorted({*x, *y}) for x, y in zip(batch.column("items").to_pylist(), listed, strict=True)]
            batch = batch.select(batch.schema.names[:-3])
        struct = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
        rows = [[dict(zip(("first", "last", "start", "stop"), h, strict=True)) for h in x] for x in hits]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.diff(bounds).astype(np.int64)), pa.array(rows, pa.list_(struct)), pa.array(listed, pa.list_(pa.int64()))],
            names=[*batch.schema.names, "n_words", "hits", "items"],
        )


def _reader(model, first: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Segments(*model.value)
        names = {w: i for i, w in enumerate(known.names.to_pylist())}
        shards = known.shards()
        every = range(len(known.bounds) - 1)
        pairs, least = (known.pairs(every), known.least(every)) if shards else (np.zeros(0, np.int64), 1)
        built: OrderedDict[int, tuple] = OrderedDict()

        def shard(k: int) -> tuple:
            if k not in built:
                while len(built) >= KEPT_AUTOMATA:
                    built.popitem(last=False)
                built[k] = (known.automaton(shards[k]), known.pairs(shards[k]), len(names), known.least(shards[k]))
            built.move_to_end(k)
            return built[k]

        held: list[_Texts] = []
        there_and_back = False

        def finish() -> Iterator[pa.RecordBatch]:
            # Back and forth, so that the automata built last are met first.
            for k in reversed(range(len(shards))) if there_and_back else range(len(shards)):
                if any(len(t.begins) for t in held):
                    for t in held:
                        t.meet(*shard(k))
            yield from (t.rows(known, first) for t in held)

        for batch in slices(batches):
            held.append(_Texts(batch, names, pairs, least))
            if len(shards) <= KEPT_AUTOMATA or sum(t.size for t in held) >= HELD_BYTES:
                yield from finish()
                held, there_and_back = [], not there_and_back
        yield from finish()

    return read


def _stretches(ids: np.ndarray, bounds: np.ndarray, pairs: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of the longest runs, within bounds, of known words that stand together in some item."""
    if not len(ids) or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.zeros(len(ids), bool)  # to the word before
    both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
    if len(pairs):
        key = ids[both - 1] * n + ids[both]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        joined[both[pairs[at] == key]] = True
    inner = bounds[1:-1]
    joined[inner[inner < len(ids)]] = False
    begins = np.flatnonzero(~joined)
    sizes = np.diff(np.append(begins, len(ids)))
    runs = np.flatnonzero((sizes >= least) & (ids[begins] >= 0))
    return begins[runs], sizes[runs]


def _merge(spans: list[tuple]) -> list[tuple]:
    """Runs joined where they overlap or touch; further fields come in pairs that grow likewise."""
    out: list[list] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1] + 1:
            out[-1][1::2] = [max(a, b) for a, b in zip(out[-1][1::2], s[1::2], strict=True)]
        else:
            out.append(list(s))
    return [tuple(s) for s in out]
