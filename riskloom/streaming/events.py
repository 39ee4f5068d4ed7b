"""Event sources and sinks, parsing, dead letters and duplicates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.functions.columns import parse_timestamp
from riskloom.schemas import RAW_EVENT

DEDUPE_HORIZON = "24 hours"


def read_stream(spark: SparkSession, source: str, location: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A stream with one string column ``value``.

    ``files``: a folder of JSON-lines files. ``kafka``: ``location`` is the topic, ``options`` carry the
    broker list; the records are keyed by customer there, so a customer's events stay in order.
    """
    reader = spark.readStream.options(**(options or {}))
    if source == "files":
        return reader.format("text").load(location)
    if source == "kafka":
        stream = reader.format("kafka").option("subscribe", location).load()
        return stream.select(F.col("value").cast("string").alias("value"))
    raise ValueError("source must be files or kafka")


def parse_events(raw: DataFrame, schema: StructType = RAW_EVENT) -> DataFrame:
    """JSON text to typed columns plus ``payload``. Unreadable JSON or numbers become nulls, never a failure."""
    fields = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    event = raw.select(F.col("value").alias("payload"), fields.alias("e")).select("payload", "e.*")
    return event.withColumns({
        "timestamp": parse_timestamp(F.col("timestamp")),
        "amount": F.col("amount").try_cast("decimal(12,2)"),
        "lat": F.col("lat").try_cast("double"),
        "lon": F.col("lon").try_cast("double"),
        "idempotency_key": F.coalesce("idempotency_key", "transaction_id"),
    })


def event_error() -> Column:
    """The reason an event cannot be processed, or null."""
    return (
        F.when(F.col("transaction_id").isNull() | F.col("customer_id").isNull(), "missing transaction_id or customer_id")
        .when(F.col("amount").isNull(), "amount is not a number")
        .when(F.col("timestamp").isNull(), "timestamp is not readable")
    )


def dead_letters(df: DataFrame, error, step: str) -> DataFrame:
    """Failed rows as (letter_id, key, payload, error, step). Letters of equal payloads and steps are one letter, sent again."""
    bad = df.withColumn("error", error).where(F.col("error").isNotNull())
    letter = F.sha2(F.concat_ws("|", F.lit(step), F.coalesce("payload", F.lit(""))), 256)
    return bad.select(letter.alias("letter_id"), F.coalesce("transaction_id", F.lit("unknown")).alias("key"), "payload", "error", F.lit(step).alias("step"))


def route_dead_letters(parsed: DataFrame, step: str = "features") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters). Two filters over one parsed input; works on tables and streams."""
    return parsed.where(event_error().isNull()), dead_letters(parsed, event_error(), step)


def route_missing(df: DataFrame, columns: list[str], step: str) -> tuple[DataFrame, DataFrame]:
    """The same split for rows that lack the outputs of an earlier step."""
    lost = F.lit(False)
    for c in columns:
        lost = lost | F.col(c).isNull()
    error = F.when(lost, F.lit("missing " + ", ".join(columns)))
    payload = df if "payload" in df.columns else df.withColumn("payload", F.to_json(F.struct(*df.columns)))
    return df.where(~lost), dead_letters(payload, error, step)


def dedupe_stream(events: DataFrame, key: str = "idempotency_key", horizon: str = DEDUPE_HORIZON) -> DataFrame:
    """First event per key within the horizon; the watermark bounds the state."""
    return events.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark([key])


def dedupe_events(events: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Batch form: first event per key by event time. Copies of a hot key are dropped on the map side."""
    order = Window.partitionBy(key).orderBy("timestamp", "transaction_id")
    return events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def as_messages(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_stream(df: DataFrame, sink: str, location: str, checkpoint: str, key: str = "customer_id",
                 options: Mapping[str, str] | None = None, once: bool = True):
    """Start a keyed JSON sink: ``files`` writes key/value JSON lines, ``kafka`` a topic."""
    writer = as_messages(df, key).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    if sink == "files":
        return writer.format("json").start(location)
    if sink == "kafka":
        return writer.format("kafka").option("topic", location).options(**(options or {})).start()
    raise ValueError("sink must be files or kafka")


def replay_dead_letters(letters: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Raw ``value`` rows to feed back, one for each letter: the stored payload, or its repair by ``letter_id``.

    Of several repairs of a letter the one that sorts first counts.
    """
    once = letters.dropDuplicates(["letter_id"])
    if fixed is None:
        return once.select(F.col("payload").alias("value"))
    repairs = fixed.groupBy("letter_id").agg(F.min("payload").alias("_fixed"))
    return once.join(repairs, "letter_id", "left").select(F.coalesce("_fixed", "payload").alias("value"))
