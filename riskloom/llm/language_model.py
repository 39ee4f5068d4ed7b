"""An n-gram language model as a weighted backoff automaton, trained and applied in blocks of documents.

States are contexts of up to ``order - 1`` words. A seen continuation is an arc with the log-probability of the
smoothed n-gram; a failure arc leads to the context without its first word and costs the context's backoff weight.
A text is read once from left to right: the automaton carries its state, follows failure arcs until a word has an
arc, and adds up the weights. A word that training has not seen is one symbol with an arc at the empty context.

Smoothing: p(w | h) = (1 - u) c(h w) / c(h) + u p(w | h'), with h' the shorter context and u = t / (c(h) + t), where
t = c(h) ** x is the number of continuations expected of a context that stands c(h) times; x is fitted for each n so
that these numbers add up to the n-grams that training has. At the empty context words have (c - d) / N and the
unknown symbol d V / N, with d = n1 / (n1 + 2 n2), so known words and unknown ones add up to one.

Nothing of the model is held whole anywhere. A block of documents sends each of its distinct n-grams once, with its
count among the block's training texts, packed by key range; a task for each range adds the blocks' counts up, and a
block gets back those that differ from its own. The arcs and states that a block's texts can touch are then an
automaton in the memory of one task. Only histograms of counts and N, V, n1, n2 meet on the driver.

N-grams are known by 64-bit hashes. Nulls: a null text is an empty one (one end token); a row without an id is
part of training if the hash of nothing says so, and is scored like any other. Rows that repeat an id count and are
scored each for itself. An empty table gives no rows; without training texts all words are unknown. Other columns
are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import tidy
from riskloom.llm.words import BY_WHITE_SPACE, mix, slices, words
from riskloom.session import materialise

#: Characters of text in a block, and n-grams in a key range, on average.
BLOCK_CHARS = 5 << 20
RANGE_GRAMS = 2 << 20
GOLDEN = 0x9E3779B97F4A7C15
#: Hashes of the end of a text and of what stands before its first word.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
PACKED = "n int, span int, block int, keys binary, counts binary"
#: Buckets of counts in histograms: eighths of powers of two.
FINE = 8


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, order: int = 2, block_chars: int = BLOCK_CHARS, held: Column | None = None) -> DataFrame:
    """Scores of every text of ``docs(doc_id, text)`` under a model of those that are not held out."""
    tidy(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (held_out() if held is None else held).alias("held_out"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    spans = 1 << max(0, int(np.ceil(np.log2(max(1, order * chars / 6 / RANGE_GRAMS)))))
    sent = dealt.groupBy("block").applyInArrow(_counts(order, spans), PACKED)
    summed = materialise(sent.groupBy("n", "span").applyInArrow(_sums, PACKED), "lm-counts")
    stats, unseen = _fitted(summed, order)
    answers = summed.where("block >= 0").select("n", F.col("block").alias("to"), "keys", "counts")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(_scorer(order, stats, unseen), SCORES)
    return scored.withColumn("train_tokens", F.lit(stats[1]).cast("long"))


def _fitted(summed: DataFrame, order: int) -> tuple[tuple[int, int, int, int], list[float]]:
    """V, N, n1, n2, and the exponent of each n, from histograms of counts."""
    unpacked = summed.where("block < 0").select("n", F.from_json(F.col("counts").cast("string"), "array<struct<bucket: int, types: long, tokens: long>>").alias("h"))
    rows = unpacked.select("n", F.explode("h").alias("h")).groupBy("n", "h.bucket").agg(F.sum("h.types").alias("types"), F.sum("h.tokens").alias("tokens")).collect()
    table = {(r["n"], r["bucket"]): (r["types"], r["tokens"]) for r in rows}
    of = lambda n: [v for (m, b), v in table.items() if m == n]
    exponents = [0.0, 0.0]
    for n in range(2, order + 1):
        types, size = np.array(of(n - 1) or [(0, 0)], float).T
        target = sum(t for t, _ in of(n))
        mean = size / np.maximum(types, 1)
        low, high = 0.0, 1.0
        for _ in range(50):
            x = (low + high) / 2
            low, high = (x, high) if (types * mean**x).sum() < target else (low, x)
        exponents.append(low)
    # The start of a text counts as a context, not as a word.
    words = [(b, v) for (m, b), v in table.items() if m == 1]
    starts = table.get((0, 0), (0, 0))[1]
    v, total = sum(t for _, (t, _) in words), sum(c for _, (_, c) in words)
    one, two = table.get((1, 0), (0, 0))[0], table.get((1, FINE), (0, 0))[0]
    if order > 1 and starts:
        v, total = v - 1, total - starts
        one, two = one - (starts == 1), two - (starts == 2)
    return (v, total, one, two), exponents


def _tokens(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes with ends, their bounds, the held-out flags and the ids, slice by slice."""
    for batch in slices(iter(table.combine_chunks().to_batches())):
        found = words(batch.column("text"), BY_WHITE_SPACE)
        hashes = found.hashes()[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
        hashes = np.insert(hashes, found.bounds[1:], END)
        bounds = found.bounds + np.arange(len(found.bounds))
        yield hashes, bounds, batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("doc_id")


def _grams(hashes: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order``, the hash of the n-gram that ends at each token; BEGIN stands before a text."""
    out = [hashes]
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    for n in range(2, order + 1):
        k = n - 1
        word = np.full(len(hashes), BEGIN)
        word[k:] = hashes[: len(hashes) - k] if k else hashes
        word[place < k] = BEGIN
        out.append(mix(out[-1] * np.uint64(3) + mix(word + np.uint64(GOLDEN * n % (1 << 64)))))
    return out


def _begin(n: int) -> np.uint64:
    """The context of an n-gram at the start of a text."""
    return mix(np.array([BEGIN]) + np.uint64(n))[0]


class Counts:
    """Sorted n-gram hashes of a block, with counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts

    @classmethod
    def of_tokens(cls, grams: list[np.ndarray], training: list[np.ndarray]) -> Counts:
        """Of 63-bit hashes; the last bit says whether training counts the token, so that one sort does it all."""
        marked = np.concatenate([(g & ~np.uint64(1)) | t.astype(np.uint64) for g, t in zip(grams, training, strict=True)] or [np.zeros(0, np.uint64)])
        marked.sort()
        keys = marked >> np.uint64(1)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return cls(keys[first], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first) if len(first) else first)

    def replaced(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.counts[np.searchsorted(self.keys, keys)] = counts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of hashes that are here, by one sort of the hashes: neighbours in order are near in memory."""
        order = np.argsort(keys)
        out = np.empty(len(keys), np.int32)
        out[order] = np.searchsorted(self.keys, (keys >> np.uint64(1))[order])
        return out


def _block(table: pa.Table, order: int) -> list[Counts]:
    """Counts by n of the block's n-grams and of the starts of its texts (as contexts), among its training texts."""
    grams: list[list] = [[] for _ in range(order)]
    flags: list[list] = [[] for _ in range(order)]
    for hashes, bounds, held, _ in _tokens(table):
        training = np.repeat(~held, np.diff(bounds))
        for n, gram in enumerate(_grams(hashes, bounds, order)):
            grams[n].append(gram)
            flags[n].append(training)
            if n < order - 1:
                grams[n].append(np.full(len(held), _begin(n + 2)))
                flags[n].append(~held)
    return [Counts.of_tokens(g, f) for g, f in zip(grams, flags, strict=True)]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, of which the high ones are all zero, compressed; their count goes before them."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _packed(n: int, span: int, block: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
    """Ascending keys as differences, which are short, and their counts."""
    return n, span, block, _planes(np.diff(keys, prepend=np.uint64(0))), _planes(counts)


def _keys(planes: bytes) -> np.ndarray:
    return np.cumsum(_numbers(planes), dtype=np.uint64)


def _totals(planes: bytes) -> np.ndarray:
    return _numbers(planes).astype(np.int64)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = [c.split()[0] for c in PACKED.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _counts(order: int, spans: int) -> Callable[[pa.Table], pa.Table]:
    bits = 63 - (spans.bit_length() - 1)

    def run(table: pa.Table) -> pa.Table:
        block, rows = table["block"][0].as_py(), []
        for n, c in enumerate(_block(table, order), 1):
            cuts = np.searchsorted(c.keys, np.arange(spans, dtype=np.uint64) << np.uint64(bits)).tolist()
            rows += [_packed(n, k, block, c.keys[a:b], c.counts[a:b]) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(c.keys)], strict=True)) if b > a]
        return _table(rows)

    return run


def _sums(table: pa.Table) -> pa.Table:
    """Of one key range: for each block, sums that differ from its own counts; and the histogram of the sums."""
    n, span = table["n"][0].as_py(), table["span"][0].as_py()
    blocks = table["block"].to_pylist()
    keys = [_keys(k) for k in table["keys"].to_pylist()]
    own = np.concatenate([_totals(c) for c in table["counts"].to_pylist()])
    of = np.repeat(np.arange(len(blocks)), [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sums = np.add.reduceat(own[order], first)
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    rows = []
    back = np.flatnonzero((total > 0) & (total != own))
    cuts = np.searchsorted(of[back], np.arange(len(blocks) + 1))
    for k, block in enumerate(blocks):
        if cuts[k + 1] > cuts[k]:
            at = back[cuts[k] : cuts[k + 1]]
            rows.append(_packed(n, span, block, keys[at], total[at]))
    seen = sums[sums > 0]
    bucket = np.floor(np.log2(seen) * FINE + 1e-9).astype(np.int64)
    types, tokens = np.bincount(bucket), np.bincount(bucket, weights=seen).astype(np.int64)
    h = [{"bucket": int(b), "types": int(types[b]), "tokens": int(tokens[b])} for b in np.flatnonzero(types)]
    rows.append((n, span, -1, b"", json.dumps(h).encode()))
    if n == 1 and (at := np.flatnonzero(ordered[first] == _begin(2) >> np.uint64(1))).size:  # n = 0: texts
        rows.append((0, span, -1, b"", json.dumps([{"bucket": 0, "types": 1, "tokens": int(sums[at[0]])}]).encode()))
    return _table(rows)


def _joined(table: pa.Table, answers: pa.Table, order: int) -> list[Counts]:
    """The block's n-grams with their counts in all training texts."""
    out = _block(table, order)
    for n, keys, counts in zip(answers["n"].to_pylist(), answers["keys"].to_pylist(), answers["counts"].to_pylist(), strict=True):
        out[n - 1].replaced(_keys(keys), _totals(counts))
    return out


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block.

    State 0 is the empty context, from which every word has an arc. A further state is a context of 1 to
    ``order - 1`` words that training has seen and that a token of the block follows.
    """

    def __init__(self, grams: list[np.ndarray], contexts: list[np.ndarray], counts: list[Counts], stats: tuple[int, int, int, int], exponents: list[float]) -> None:
        """grams[n - 1] and contexts[n - 1] are of each token, as places in counts[n - 1] and counts[n - 2]."""
        v, total, n1, n2 = stats
        order = len(counts)
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.unknown = discount * v / total if total else 1.0
        count = counts[0].counts
        chance = np.where(count > 0, (count - discount) / max(total, 1), self.unknown)
        self.width = len(count)

        # States: the known contexts by length; each fails to the context without its first word.
        number = [np.zeros(0, np.int64)]
        fail, cost, size = [np.zeros(1, np.int64)], [np.zeros(1)], 1
        for n in range(1, order):
            known = np.zeros(len(counts[n - 1].counts), bool)
            known[contexts[n]] = True
            known &= counts[n - 1].counts > 0
            number.append(np.where(known, size + np.cumsum(known) - 1, 0))
            at = np.empty(len(known), np.int64)
            at[contexts[n]] = np.arange(len(contexts[n]))
            at = at[known]
            fail.append(np.zeros(len(at), np.int64) if n == 1 else number[n - 1][contexts[n - 1][at]])
            cost.append(np.log10(_novelty(counts[n - 1].counts[known], exponents[n + 1])))
            size += len(at)
        self.fail, self.cost, self.number = np.concatenate(fail), np.concatenate(cost), number

        # Arcs: the chance of an n-gram needs that of the shorter one, of some token that ends it.
        lower = chance[grams[0]]
        keys, weight, after = [], [], []
        for n in range(2, order + 1):
            source, seen, whole = number[n - 1][contexts[n - 1]], counts[n - 1].counts[grams[n - 1]], counts[n - 2].counts[contexts[n - 1]]
            u = _novelty(np.maximum(whole, 1), exponents[n])
            now = np.where(source > 0, (1 - u) * seen / np.maximum(whole, 1) + u * lower, lower)
            at = np.full(len(counts[n - 1].counts), -1)
            at[grams[n - 1]] = np.arange(len(source))
            at = at[at >= 0]
            at = at[(source[at] > 0) & (seen[at] > 0)]
            keys.append(source[at].astype(np.int64) * self.width + grams[0][at])
            weight.append(np.log10(now[at]))
            m = min(n, order - 1)
            after.append(number[m][grams[m - 1][at]])
            lower = now
        none = [np.zeros(0, np.int64)]
        self.weight, self.after = np.concatenate([*none, *weight]), np.concatenate([*none, *after])
        self._hash(np.concatenate([*none, *keys]))
        self.word_weight = np.log10(chance)
        self.word_after = number[1] if order > 1 else np.zeros(self.width, np.int64)

    def state_of(self, n: int, place: int) -> int:
        """The state of a context of ``n`` words, 0 if there is none."""
        return int(self.number[n][place])

    def _hash(self, keys: np.ndarray) -> None:
        """A table of arcs by state and word, with open addresses."""
        self.mask = np.uint64((1 << max(3, int(len(keys) * 2).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int64)
        self.keys = keys
        at, left = mix(keys.view(np.uint64)) & self.mask, np.arange(len(keys))
        while len(left):
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = left[free]
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each state and word, or -1."""
        key = state * self.width + word
        at = mix(key.view(np.uint64)) & self.mask
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != key)) if len(self.keys) else np.zeros(0, np.int64)
        while len(wrong):
            at[wrong] = (at[wrong] + np.uint64(1)) & self.mask
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != key[wrong])]
        return out

    def walk(self, words: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
        """log10 probabilities of texts, read together from left to right, each with its state."""
        lengths = np.diff(bounds)
        longest = np.argsort(-lengths, kind="stable")
        begins = bounds[:-1][longest]
        going = np.searchsorted(-lengths[longest], -np.arange(lengths.max(initial=0)), side="left").tolist()
        states, totals = np.full(len(lengths), start, np.int64), np.zeros(len(lengths))
        for t, k in enumerate(going):
            word, state, total = words[begins[:k] + t], states[:k], totals[:k]
            here = np.flatnonzero(state)
            root = np.flatnonzero(state == 0)
            while len(here):
                arc = self.arc(state[here], word[here])
                has = arc >= 0
                done, arc = here[has], arc[has]
                total[done] += self.weight[arc]
                failed = here[~has]
                total[failed] += self.cost[state[failed]]
                state[done] = self.after[arc]
                state[failed] = self.fail[state[failed]]
                back = state[failed] == 0
                root = np.concatenate([root, failed[back]])
                here = failed[~back]
            total[root] += self.word_weight[word[root]]
            state[root] = self.word_after[word[root]]
        out = np.empty(len(lengths))
        out[longest] = totals
        return out


def _novelty(counts: np.ndarray, exponent: float) -> np.ndarray:
    """The weight of the shorter context after one that stands so many times."""
    kinds = counts.astype(float) ** exponent
    return kinds / (counts + kinds)


def _scorer(order: int, stats: tuple[int, int, int, int], exponents: list[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    v, total = stats[:2]

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCORES.split(", ")]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not table.num_rows:
            return pa.schema(list(zip(names, kinds, strict=True))).empty_table()
        counts = _joined(table, answers, order)
        hashes, sizes, held, ids = [], [], [], []
        for h, bounds, out, docs in _tokens(table):
            hashes.append(h)
            sizes.append(np.diff(bounds))
            held.append(out)
            ids.append(docs)
        hashes = np.concatenate(hashes)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        grams = [c.find(g) for c, g in zip(counts, _grams(hashes, bounds, order), strict=True)]
        firsts = bounds[:-1]
        contexts = [grams[0]]
        for n in range(2, order + 1):
            before = np.empty(len(hashes), np.int32)
            before[1:] = grams[n - 2][:-1]
            before[firsts] = counts[n - 2].find(np.array([_begin(n)]))[0]
            contexts.append(before)
        del hashes
        automaton = Automaton(grams, contexts, counts, stats, exponents)
        start = 0
        for n in range(1, order):
            start = automaton.state_of(n, contexts[n][0]) or start
        c = counts[0].counts[grams[0]]
        base = np.add.reduceat(np.log10((c + 0.5) / (total + 0.5 * (v + 1))), firsts)
        known = np.add.reduceat((c > 0).astype(np.int64), firsts)
        score = automaton.walk(grams[0], bounds, start)
        return pa.table([pa.concat_arrays(ids), np.concatenate(held), np.diff(bounds).astype(np.int64), known, base, score], names=names)

    return run
