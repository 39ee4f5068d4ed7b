"""Quality rules of documents, and of the hosts that they come from, in DataFrame functions alone.

A document fails the base rules if it is short or repeats itself. Per host the failures are counted, the hosts'
rates are shrunk towards a beta prior that is fitted to all hosts by moments, and hosts whose shrunk rate is above
``host_limit`` are rejected with all their documents.

Nulls: a null text has no words and fails; documents without a host form a host of their own (null) and are judged
like any other. Repeated ids and rows count each for itself. An empty table gives no rows; a single host, or hosts
of equal rates, have a prior as strong as one document. Columns of the input are kept; those that the rules add
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import carried, let, restored
from riskloom.session import materialise

WINDOW = 8
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, text: str = "text") -> DataFrame:
    """Add the counts of each document and ``base_failed``. Arrays within the row; nothing is shuffled."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        tokens,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(_windows(w), _repeated).cast("long").alias("n_repeat_words"),
        ),
    )
    counted = docs.drop(*RULES, "_words").withColumn("_words", of_words).withColumns(
        {
            "n_words": F.col("_words.n_words"),
            "word_chars": F.col("_words.word_chars"),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("_words.n_repeat_words"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.drop("_words").withColumn("base_failed", failed)


def _windows(tokens: Column) -> Column:
    """A hash of every 8-word window."""

    def runs(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(tokens) < WINDOW, none).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), runs))


def _repeated(windows: Column) -> Column:
    """Words within windows that stand more than once."""

    def covered(ordered: Column) -> Column:
        near = lambda x, i: F.coalesce(x["h"] == F.get(ordered, i)["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(ordered, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, covered))


def host_verdicts(judged: DataFrame, host: str, host_limit: float = 0.5) -> DataFrame:
    """(host, documents, failures, rate, rejected) of every host: counts are combined before the shuffle."""
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    raw = F.col("failures") / F.col("documents")
    mean, spread = F.avg(raw).alias("m"), F.var_pop(raw).alias("v")
    m, v = hosts.agg(mean, spread).first()
    # Moments of a beta distribution; at least one document strong, and never so strong that hosts can't differ.
    strength = max(1.0, m * (1 - m) / v - 1) if m is not None and v else 1.0
    rate = (F.col("failures") + F.lit(strength * (m or 0.0))) / (F.col("documents") + F.lit(strength))
    return hosts.select("host", "documents", "failures", rate.alias("rate"), (rate > host_limit).alias("rejected"))


def judge(docs: DataFrame, host: str = "source", host_limit: float = 0.5, **rules: int) -> DataFrame:
    """``docs`` with the rules' columns and ``kept``."""
    return judge_counted(with_rules(docs, **rules), host, host_limit)


def passing(docs: DataFrame, host: str = "source", text: str = "text", host_limit: float = 0.5, **rules: int) -> DataFrame:
    """The rows that are kept, as they were, whatever their columns are called."""
    rows = carried(docs).select("row", F.col(f"row.`{text}`").alias("text"), F.col(f"row.`{host}`").alias("host"))
    return restored(judge_counted(with_rules(rows, **rules).drop("text"), "host", host_limit).where("kept"), docs.columns)


def judge_counted(counted: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """The same for rows that have the rules' columns. They are stored once, as the hosts and the rows both read them."""
    judged = materialise(counted, "host-rules")
    rejected = host_verdicts(judged, host, host_limit).where("rejected").select(F.col("host").alias("_host"), F.lit(True).alias("_rejected"))
    verdict = judged.drop("_host", "_rejected", "kept").join(rejected, F.col(host).eqNullSafe(F.col("_host")), "left")
    return verdict.withColumn("kept", ~F.col("base_failed") & F.col("_rejected").isNull()).drop("_host", "_rejected")
