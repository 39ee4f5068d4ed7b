"""An index of a growing table's unique keys: which stored rows may share a key with a batch, without reading the table.

Beside the table lies ``<table>_keys``. Its entries are cut into generations (what one or several batches added), keys and
buckets by hash; every bucket has a Bloom filter of one 64-bit word for each two keys. A batch tests its hashes against
the filters (four bytes a stored key) and then reads the entries of those buckets only that a filter did not rule out.

The index follows the table: files that no generation covers are indexed before the next look-up, so a writer that dies
between table and index loses nothing, and a table that was there before is taken over. A generation counts once its row in
``generations`` is written; what an unfinished one left is never read. ``FAN_OUT`` generations of a level become one of the
next, so that a key is written again as often as the logarithm of the table's size, and the number of generations stays small.

Null keys have no entry. The table's keys are unique, as its writer keeps them; repeats that it has all the same have an entry for
each different row. Keys are compared as strings, in full: hashes only choose what is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import materialise

#: Keys of a bucket, and generations of a level that are merged.
BUCKET_KEYS = 50_000
FAN_OUT = 8
GENERATION = "gen string, level int, buckets int, replaces array<string>"


def _word(h: Column, words: Column) -> Column:
    """Place of a hash's word in a filter."""
    return F.pmod(F.shiftrightunsigned(h, 24), words)


def _bits(h: Column) -> Column:
    """The four bits of a hash, from its lowest 24 bits."""
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(4)])


class KeyIndex:
    """Keys of the Parquet table at ``table``; ``keys`` are its unique columns."""

    def __init__(self, spark: SparkSession, table: str, keys: Sequence[str], bucket_keys: int = BUCKET_KEYS) -> None:
        self.spark, self.table, self.keys, self.bucket_keys = spark, table.rstrip("/"), list(keys), bucket_keys
        self.path = f"{self.table}_keys"

    def refresh(self) -> None:
        """Index the files that are not covered yet, then merge generations."""
        new = self._uncovered()
        if new:
            columns = ", ".join(f"`{k}` string" for k in self.keys)
            rows = self.spark.read.schema(columns).parquet(*new)
            self._add(rows.select(F.struct(*self.keys).alias("row")).distinct(), 0, [], new)
        while due := self._due():
            old = self._entries(due).where(F.col("key") == F.col("owner")).select("row")
            self._add(old, due[0]["level"] + 1, [g["gen"] for g in due], [])

    def matching(self, batch: DataFrame) -> DataFrame:
        """Key columns of the stored rows that share a key with the batch (and of no others)."""
        self.refresh()
        wanted = self._hashed(batch.select(F.struct(*[F.col(k).cast("string").alias(k) for k in self.keys]).alias("row")))
        wanted = wanted.select("key", "value", "h").distinct()
        hit = self.candidates(wanted)
        if not hit:
            return self.spark.createDataFrame([], ", ".join(f"`{k}` string" for k in self.keys))
        parts = [f"{self.path}/entries/gen={g}/key={k}/bucket={b}" for g, k, b in hit]
        entries = self.spark.read.schema(self._entry_schema()).option("basePath", f"{self.path}/entries").parquet(*parts)
        found = entries.join(wanted.select("key", "value"), ["key", "value"], "left_semi")
        return found.select("row.*").distinct()

    def candidates(self, wanted: DataFrame) -> list[tuple[str, str, int]]:
        """Generation, key and bucket of the entries that the filters leave for some (key, h)."""
        live = self._live()
        if not live:
            return []
        filters = self.spark.read.schema("key string, bucket int, words array<long>, gen string").option("basePath", f"{self.path}/filters").parquet(
            *[f"{self.path}/filters/gen={g['gen']}" for g in live])
        sizes = F.array(*[F.struct(F.lit(g["gen"]).alias("gen"), F.lit(g["buckets"]).alias("buckets")) for g in live])
        asked = wanted.select("key", "h", F.explode(sizes).alias("g")).groupBy("key", "g.gen", F.pmod("h", "g.buckets").cast("int").alias("bucket"))
        asked = asked.agg(F.collect_set("h").alias("hashes"))
        words = F.size("words").cast("long")
        there = F.exists("hashes", lambda h: F.get("words", _word(h, words).cast("int")).bitwiseAND(_bits(h)) == _bits(h))
        rows = filters.join(asked, ["key", "gen", "bucket"]).where(there).select("gen", "key", "bucket").collect()
        return sorted(map(tuple, rows))

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """One entry for each key of a row that is not null; ``owner`` names the first of them."""
        named = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"row.{k}").alias("value")) for k in self.keys])
        named = F.filter(named, lambda e: e["value"].isNotNull())
        entries = rows.select("row", F.get(named, F.lit(0))["key"].alias("owner"), F.explode(named).alias("e"))
        return entries.select("row", "owner", "e.*", F.xxhash64("e.value").alias("h"))

    def _entry_schema(self) -> str:
        fields = ", ".join(f"`{k}`: string" for k in self.keys)
        return f"row struct<{fields}>, owner string, value string, h long, gen string, key string, bucket int"

    def _add(self, rows: DataFrame, level: int, replaces: list[str], files: list[str]) -> None:
        spark, gen = self.spark, uuid.uuid4().hex
        known = self._filters(replaces).groupBy("key").agg(F.sum("n").alias("n")) if replaces else rows.agg(F.count("*").alias("n"))
        count = known.agg(F.max("n")).first()[0] or 0
        buckets = max(1, -(-count // self.bucket_keys))
        entries = self._hashed(rows).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
        entries = entries.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "h")
        entries.write.partitionBy("key", "bucket").parquet(f"{self.path}/entries/gen={gen}")
        stored = spark.read.schema("h long, key string, bucket int").parquet(f"{self.path}/entries/gen={gen}")
        sizes = stored.groupBy("key", "bucket").agg(F.count("*").alias("n")).withColumn("size", F.expr("(n + 1) div 2").cast("long"))
        sizes = materialise(sizes, "key-buckets")
        blank = sizes.select("key", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("w"), F.lit(0).cast("long").alias("bits"))
        used = stored.join(sizes, ["key", "bucket"]).select("key", "bucket", _word(F.col("h"), F.col("size")).alias("w"), _bits(F.col("h")).alias("bits"))
        words = blank.unionByName(used).groupBy("key", "bucket", "w").agg(F.bit_or("bits").alias("bits"))
        arrays = words.groupBy("key", "bucket").agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("a"))
        filters = arrays.join(sizes.select("key", "bucket", "n"), ["key", "bucket"]).select("key", "bucket", "n", F.col("a.bits").alias("words"))
        filters.write.parquet(f"{self.path}/filters/gen={gen}")
        if files:
            spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(f"{self.path}/covered/gen={gen}")
        spark.createDataFrame([(gen, level, buckets, replaces)], GENERATION).coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def _filters(self, gens: list[str]) -> DataFrame:
        return self.spark.read.schema("key string, n long").parquet(*[f"{self.path}/filters/gen={g}" for g in gens])

    def _entries(self, gens: list) -> DataFrame:
        paths = [f"{self.path}/entries/gen={g['gen']}" for g in gens]
        return self.spark.read.schema(self._entry_schema()).option("basePath", f"{self.path}/entries").parquet(*paths)

    def _generations(self) -> list:
        return self.spark.read.schema(GENERATION).parquet(f"{self.path}/generations").collect() if self._exists(f"{self.path}/generations") else []

    def _live(self) -> list:
        every = self._generations()
        gone = {g for row in every for g in row["replaces"]}
        return [row for row in every if row["gen"] not in gone]

    def _due(self) -> list:
        live = self._live()
        for level in sorted({g["level"] for g in live}):
            same = [g for g in live if g["level"] == level]
            if len(same) >= FAN_OUT:
                return same
        return []

    def _uncovered(self) -> list[str]:
        if not self._exists(self.table):
            return []
        there = [unquote(f) for f in self.spark.read.schema(f"`{self.keys[0]}` string").parquet(self.table).inputFiles()]
        done = [g["gen"] for g in self._generations() if g["level"] == 0]
        if not done:
            return there
        covered = self.spark.read.schema("file string").parquet(*[f"{self.path}/covered/gen={g}" for g in done])
        listed = self.spark.createDataFrame([(f,) for f in there], "file string")
        return [r["file"] for r in listed.join(covered, "file", "left_anti").collect()]

    def _exists(self, path: str) -> bool:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)
