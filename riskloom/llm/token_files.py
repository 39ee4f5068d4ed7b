"""Token ids as Parquet list columns: ascending document ids, controlled row groups, pages and encodings.

The tables are ordinary Parquet. A list column of small integers is dictionary-coded (ids of a vocabulary take
16 bits or less) or, on request, delta-coded; row groups and pages have a set size and the writer adds column and
offset indexes, so a reader that wants some documents or only their lengths touches few pages.

Nulls: a null text is an empty one (its ids are the end id alone); a null document id sorts first. Rows that repeat
an id keep their own ids, in any order among themselves. An empty table gives an empty file set. Columns of the
input other than the two named ones are ignored, so clashing names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.token_ids import ENCODED_BYTES, Encoder
from riskloom.llm.words import slices

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int = 1,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids to ``path``.

    Each file is one range of document ids in ascending order (rows of one id by a hash of their texts, so that an id of
    many rows spreads over files); ``part`` numbers the ranges and ``part_start`` counts
    the ids before a document within its range. ``encoding`` is "dictionary" or "delta".
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder.of_process(tokenizer, end), TaskContext.get().partitionId(), 0
        for batch in slices(batches, limit=ENCODED_BYTES):
            ids, bounds = encoder.encode(batch.column("text"))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(before + bounds[:-1]),
                    pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            before += int(bounds[-1])

    # Rows of one id, or of none, are ranged by a hash of their texts.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").drop("mark")
    dictionary = {"dictionary": "true", "delta": "false"}[encoding]
    (
        ordered.mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", dictionary)
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", "1000")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids"), ids_between: tuple[int, int] | None = None) -> DataFrame:
    """Some columns of some documents: both reach the Parquet scan, which skips row groups and pages."""
    table = spark.read.schema(FILE_SCHEMA).parquet(path)
    if ids_between is not None:
        table = table.where(F.col("doc_id").between(*ids_between))
    return table.select(*columns)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, ids_before): one row for each file, from the length column alone."""
    totals = read_tokens(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("ids_before"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("part_start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, path, ("doc_id", "part", "part_start", "ids")).mapInArrow(digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(spark, path), "part").select("doc_id", (F.col("ids_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
