"""Helpers for column expressions and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` or a function within it names it."""
    return F.get(F.transform(F.array(value), body), 0)


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The rows as one column ``row``, beside copies of some columns: nothing that is added can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in names])


def restored(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows' own columns again, some with new values."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in columns])


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of a query when it ends (steps here store what later ones read), and hand
    Python batches of a few megabytes, however long the texts are."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
