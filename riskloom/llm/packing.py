"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (dense layers and attention). Documents are dealt to
groups by a hash of their id and text, so rows with one id or none are dealt out; only equal rows always share a
group. In a group, whole sequences are cut off long documents first; what remains goes, in
descending order, to the open sequence of the lowest cost that has room. As many sequences are open as the tokens
need; a piece that fits nowhere is cut, so a group leaves fewer than ``capacity`` places empty.

Nulls: a null text is an empty document, one sequence place for its end id. Rows that repeat an id are packed as
rows of their own; ties are broken by id, then by the ids' checksum, so equal input gives equal output. An empty
table gives no rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.token_ids import ENCODED_BYTES, Encoder
from riskloom.llm.words import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"
#: Characters of text in a group, on average; a group is handled by one task.
GROUP_CHARS = 4 << 20


def pack(
    docs: DataFrame,
    tokenizer: str,
    end: int = 1,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their sequence and offset."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_process(tokenizer, end)
        for batch in slices(batches, limit=ENCODED_BYTES):
            ids, bounds = encoder.encode(batch.column("text"))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column("pack_group"), batch.column("doc_id"), packed.cast(pa.binary())], names=["pack_group", "doc_id", "ids"])

    def fill(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = sorted(((d, zlib.crc32(b), b) for d, b in zip(table["doc_id"].to_pylist(), table["ids"].to_pylist(), strict=True)), key=lambda r: (r[0] is not None, r[0], r[1]))
        pieces, costs = assign([len(r[2]) // 4 for r in rows], capacity, linear, quadratic)
        group = table["pack_group"][0].as_py()
        out = []
        for doc, start, length, sequence, offset in pieces:
            doc_id, _, ids = rows[doc]
            out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, (group << 32) + sequence, offset, costs[sequence]))
        kinds = (*[pa.int64()] * 7, pa.float64())
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-chars // group_chars))
    dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    return dealt.mapInArrow(encode, "pack_group long, doc_id long, ids binary").groupBy("pack_group").applyInArrow(fill, PIECES)


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (document, start, length, sequence, offset) and each sequence's cost."""

    def cost(n: int) -> float:
        return linear * n + quadratic * n * n

    pieces: list[tuple[int, int, int, int, int]] = []
    costs: list[float] = []
    rest = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, len(costs), 0))
            costs.append(cost(capacity))
        if n % capacity:
            rest.append((-(n % capacity), doc, n - n % capacity))
    opened = -(-sum(-r[0] for r in rest) // capacity)
    first = len(costs)
    costs += [0.0] * opened
    used = [0] * opened
    heapq.heapify(rest)
    # Sequences by room: all costs of a room in a heap, so that the cheapest one with room enough is among few tops.
    by_room: dict[int, list[tuple[float, int]]] = {capacity: [(0.0, s) for s in range(opened)]}
    rooms = np.zeros(capacity + 1, bool)
    rooms[capacity] = opened > 0
    while rest:
        n, doc, start = heapq.heappop(rest)
        n = -n
        fits = np.flatnonzero(rooms[n:]) + n
        if len(fits):
            room = min(fits.tolist(), key=lambda r: by_room[r][0])
            take = n
        else:  # cut: fill the largest room, and deal the rest again
            room = take = int(np.flatnonzero(rooms)[-1])
            heapq.heappush(rest, (-(n - take), doc, start + take))
        _, sequence = heapq.heappop(by_room[room])
        rooms[room] = bool(by_room[room])
        pieces.append((doc, start, take, first + sequence, used[sequence]))
        used[sequence] += take
        costs[first + sequence] += cost(take)
        if left := room - take:
            heapq.heappush(by_room.setdefault(left, []), (costs[first + sequence], sequence))
            rooms[left] = True
    return pieces, costs
