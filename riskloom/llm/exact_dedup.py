"""Exact duplicates of whole texts, with frequent texts taken out of the shuffle.

The SHA-256 of each text is stored beside what the caller wants back. Misra-Gries summaries of the tasks' digests are
merged into at most ``counters`` candidates, among which is every digest of more than 1/(counters + 1) of all rows. One
more pass verifies the candidates: it counts them in full and finds the row that stays. What it finds (at most
``counters`` rows of a fixed size) is broadcast, and rows of these texts are decided where they lie. The remaining
digests, none of them frequent, are shuffled in the ordinary way.

Texts are equal if identical, or if ``normalise`` makes them so. Of equal texts the row with the largest id stays, and
of repeated rows with that id one of them. Nulls: a null text counts as an empty one; a null id is less than any other.
Empty texts are equal to each other. Texts of any length are hashed whole. An empty table gives no rows. Rows are
carried as one struct, so no column of theirs can clash with those that are added; ``mark`` leaves out columns of the
input that bear the name of an added one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise

#: Candidates kept by a summary; the broadcast holds no more, about 60 bytes each.
COUNTERS = 2048
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def whole(text: Column) -> Column:
    """Texts as they are."""
    return text


def mark(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None,
    normalise: Callable[[Column], Column] = whole, counters: int = COUNTERS,
) -> DataFrame:
    """``columns`` of every row (all by default), with keep_id, group_size, kept and text_sha256."""
    columns = [c for c in columns or docs.columns if c not in ADDED]
    return _judged(docs, doc_id, text, columns, normalise, counters).select(
        *[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("stays.id").alias("keep_id"), "group_size",
        (F.col("at") == F.col("stays.at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = whole, counters: int = COUNTERS
) -> DataFrame:
    """One row of each text, as it was."""
    judged = _judged(docs, doc_id, text, docs.columns, normalise, counters)
    return judged.where(F.col("at") == F.col("stays.at")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _judged(docs: DataFrame, doc_id: str, text: str, columns: list[str], normalise: Callable[[Column], Column], counters: int) -> DataFrame:
    """(digest, row, id, at, stays(id, at), group_size); ``at`` numbers the rows, so that repeated ones differ."""
    body = normalise(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).alias("none"))
    rows = docs.select(row.alias("row"), F.col(f"`{doc_id}`").alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "exact-digests")
    best = F.max(F.struct("id", "at"))
    winners = rows.join(F.broadcast(frequent(rows.select("digest"), counters)), "digest").groupBy("digest").agg(best.alias("stays"), F.count("*").alias("group_size"))
    winners = materialise(winners.where("group_size > 1"), "exact-winners")
    split = rows.join(F.broadcast(winners), "digest", "left")
    hot, rest = split.where(F.col("group_size").isNotNull()), split.where(F.col("group_size").isNull()).drop("stays", "group_size")
    same = Window.partitionBy("digest")
    return hot.unionByName(rest.withColumns({"stays": best.over(same), "group_size": F.count("*").over(same)}))


def frequent(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` values of the one binary column of ``keys``, among them all of more than 1/(counters + 1) of its rows."""
    spark, name = keys.sparkSession, keys.columns[0]
    merged = keys.mapInArrow(lambda batches: _summary(batches, counters), f"`{name}` binary, n long").groupBy(name).agg(F.sum("n").alias("n"))
    top = merged.orderBy(F.col("n").desc(), name).limit(counters + 1).collect()
    least = top[counters]["n"] if len(top) > counters else 0
    return spark.createDataFrame(pa.table({name: pa.array([bytes(r[0]) for r in top if r["n"] > least], pa.binary())}))


def _summary(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """A Misra-Gries summary of the task's values. A batch's own counts are a summary too, and summaries are merged by
    adding them up and taking the first count that is too many from all."""
    name, held = "k", pa.table({"k": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    for batch in batches:
        name = batch.schema.names[0]
        new = pa.table({"k": batch.column(0).cast(pa.binary()), "n": pa.array(np.ones(batch.num_rows, np.int64))})
        held = pa.concat_tables([held, new]).group_by("k").aggregate([("n", "sum")]).rename_columns(["k", "n"])
        if held.num_rows > counters:
            n = held.column("n").to_numpy()
            n = n - np.partition(n, -counters - 1)[-counters - 1]
            held = pa.table({"k": held.column("k"), "n": n}).filter(pa.array(n > 0))
    if held.num_rows:
        yield pa.RecordBatch.from_arrays([held.column("k").combine_chunks(), held.column("n").combine_chunks()], [name, "n"])
