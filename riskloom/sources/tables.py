"""Readers and writers of the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom import schemas
from riskloom.session import materialise
from riskloom.sources.key_index import KeyIndex


#: Keys of one pushed filter: beyond ten, Spark pushes only their bounds.
LOOK_UP = 10
REPORT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_transactions(spark: SparkSession, path: str, schema: StructType = schemas.TRANSACTION) -> DataFrame:
    """Parquet scan with a fixed schema: nothing is inferred, columns and filters are pushed down."""
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by_date: bool = False) -> None:
    """Parquet or CSV. ``by_date`` partitions by event date and keeps a customer's rows close in a file."""
    out = df
    if by_date:
        salt = F.pmod(F.xxhash64("customer_id"), F.lit(8))
        dated = df.withColumn("event_date", F.to_date("timestamp"))
        out = dated.repartition("event_date", salt).sortWithinPartitions("event_date", "customer_id")
    writer = out.write.mode(mode)
    if by_date:
        writer = writer.partitionBy("event_date")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError("format must be parquet or csv")


def write_lookup_table(df: DataFrame, path: str, key: str = "transaction_id", row_group_bytes: int = 16 << 20, mode: str = "errorifexists") -> None:
    """Parquet for point look-ups: files hold ranges of the key and row groups are sorted by it, so that their bounds
    rule out nearly all of them; Bloom filters rule out keys that lie within the bounds but are not there."""
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    writer = ordered.write.mode(mode).option("parquet.block.size", row_group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option(f"parquet.bloom.filter.adaptive.enabled#{key}", "true").parquet(path)


def look_up(spark: SparkSession, path: str, values: list[str], key: str = "transaction_id") -> DataFrame:
    """The rows of some keys. Few keys at a time are asked for as equalities, which reach the row groups' filters."""
    table = spark.read.parquet(path)
    parts = [values[k : k + LOOK_UP] for k in range(0, len(values), LOOK_UP)] or [[]]
    return reduce(DataFrame.unionByName, [table.where(F.col(key).isin(part)) for part in parts])


def write_search_index(df: DataFrame, path: str, columns: Sequence[str], key: str = "transaction_id") -> None:
    """Postings (gram, key) of every three characters of the lower-case columns, sorted by gram, and how many there are of
    each. Nulls and texts of fewer characters have none."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    of = lambda c: F.when(F.length(c) >= 3, grams(c)).otherwise(F.array().cast("array<string>"))
    found = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.array(*[of(F.lower(c)) for c in columns])))).alias("gram"))
    write_lookup_table(found, f"{path}/postings", "gram")
    postings = df.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/grams")


def search_candidates(spark: SparkSession, path: str, term: str, grams: int = 2) -> DataFrame | None:
    """Keys of rows that may hold the term: those in the postings of its rarest grams. None for a term of fewer than three
    characters, which needs a scan."""
    term = term.lower()
    wanted = sorted({term[i : i + 3] for i in range(len(term) - 2)})
    if not wanted:
        return None
    known = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted)).collect()
    if len(known) < len(wanted):  # one of them is nowhere
        return look_up(spark, f"{path}/postings", [], "gram").select("key")
    rarest = [r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:grams]]
    found = look_up(spark, f"{path}/postings", rarest, "gram").groupBy("key").agg(F.count_distinct("gram").alias("n"))
    return found.where(F.col("n") == len(rarest)).select("key")


def write_profiles(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_profiles(spark: SparkSession, path: str, schema: StructType = schemas.PROFILE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A metrics or drift report as JSON lines, times with microseconds."""
    df.write.mode(mode).option("timestampFormat", REPORT_TIME).json(path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", REPORT_TIME).json(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit events, partitioned by day."""
    events.withColumn("event_date", F.to_date("created_at")).write.mode("append").partitionBy("event_date").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table does not hold yet: a repeated batch adds nothing, whenever it comes.

    The stored rows that share a key come from the table's ``KeyIndex``; the table itself is not read. Within the batch the
    first write wins. Returns the batch's rows that the table now holds: those appended, and those of an earlier delivery
    of the same batch.
    """
    from riskloom.operators.store import insert_if_absent

    dated = df.withColumn("event_date", F.to_date("timestamp"))
    known = materialise(KeyIndex(df.sparkSession, path, keys).matching(dated), "known-keys")
    fresh = materialise(insert_if_absent(known, dated, keys, ["timestamp", "transaction_id"]), "append")
    write_dated(fresh, path)
    old = known.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    again = df.join(old, reduce(lambda a, b: a & b, same), "left_semi")
    return fresh.select(*df.columns).unionByName(again)


def append_dated(df: DataFrame, path: str, key: str) -> None:
    """The same for one key whose rows always come under the same day: only the days of the batch are looked at."""
    spark = df.sparkSession
    dated = df.withColumn("event_date", F.to_date("timestamp"))
    if _exists(spark, path):
        days = [r[0] for r in dated.select("event_date").distinct().collect()]
        known = spark.read.schema(dated.schema).parquet(path).where(F.col("event_date").isin(days)).select(key)
        # What is stored already is found by the keys alone, and mostly little of a batch.
        there = materialise(dated.select(key).join(known, key, "left_semi").distinct(), "known-keys")
        dated = dated.join(there, key, "left_anti").select(*dated.columns)
    write_dated(dated, path, once=key)


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def write_dated(df: DataFrame, path: str, per_day: int = 8, once: str | None = None) -> None:
    """Append by day, each day from at most ``per_day`` tasks, so that files are few and no day is one task. With ``once``, one
    row for each value of that column and day; rows are dealt out by it, so that they move and are sorted only once."""
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(once or "transaction_id"), F.lit(per_day))).repartition("event_date", "_salt")
    if once is not None:
        alike = Window.partitionBy("event_date", "_salt", once).orderBy("timestamp")
        dealt = dealt.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") == 1)
    dealt.select(*df.columns).write.mode("append").partitionBy("event_date").parquet(path)
