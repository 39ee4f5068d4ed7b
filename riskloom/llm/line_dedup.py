"""Removal of repeated runs of lines by winnowing over line hashes, in DataFrame functions alone.

Documents are ordered by id (then by a hash of the text); lines without words count for nothing and stay. A line is
deleted if it is part of a run of lines, of ``min_words`` words or more, that also stands earlier; the first occurrence
of anything stays, as every deleted line matches an earlier one.

From each line on, and from each line back, a window takes lines until they hold ``min_words`` words: every such run
consists of windows. The least line hash of a window is its fingerprint, which equal windows choose at the same line.
Windows meet by fingerprint and content; the first place of each is kept, and from each later place the match is
extended line by line, both ways, as far as a window may reach.

Nulls: a null text has no lines and stays null; rows without an id come first. Rows equal in id and text are one
document, edited alike. An empty table gives no rows. Columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.columns import carried, let, restored, tidy
from riskloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"


def _place() -> Column:
    """A document's place in the order, which is also what rows are joined by."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, runs): of each document that repeats something, disjoint ascending runs of line numbers to delete."""
    tidy(docs.sparkSession)
    text = F.col("text").cast("string")
    lines = F.transform(F.split(text, "\n"), lambda x, p: F.struct(F.xxhash64(x).alias("h"), p.alias("p"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    known = docs.where(text.isNotNull()).select(_place().alias("doc"), F.filter(lines, lambda x: x["w"] > 0).alias("lines")).where(F.size("lines") > 0)
    known = materialise(known, "lines")

    line = known.select("doc", F.posexplode("lines").alias("i", "x")).select("doc", "i", "x.h", "x.w")
    in_doc = Window.partitionBy("doc")
    line = line.withColumn("end", F.sum("w").over(in_doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("end") - F.col("w"))

    ahead, back = in_doc.orderBy("before").rangeBetween(0, min_words - 1), in_doc.orderBy("end").rangeBetween(1 - min_words, 0)
    for name, window in (("ahead", ahead), ("back", back)):
        line = line.withColumns(
            {
                f"{name}_words": F.sum("w").over(window),
                f"{name}_least": F.min(F.struct("h", (-F.col("i")).alias("i"))).over(window),
                f"{name}_content": F.collect_list("h").over(window),
            }
        )
    part = lambda name: F.struct(*[F.col(f"{name}_{c}").alias(c) for c in ("words", "least", "content")])
    windows = line.select("doc", F.explode(F.array(part("ahead"), part("back"))).alias("x")).where(F.col("x.words") >= min_words)
    prints = windows.select(F.xxhash64("x.least.h", "x.content").alias("print"), F.struct("doc", (-F.col("x.least.i")).alias("i")).alias("at")).distinct()
    prints = materialise(prints, "line-prints")
    first = prints.groupBy("print").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    pairs = prints.join(first, "print").where("at <> first").select("at", "first").distinct()

    # Blocks of lines that reach min_words beyond either end, so that a match needs no whole document.
    def blocks(name: str) -> DataFrame:
        reach = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / min_words).cast("int")),
            lambda b: F.struct(b.alias("b"), F.slice("lines", F.greatest(F.lit(1), (b - 1) * min_words + 1), F.lit(3 * min_words)).alias("x")),
        )
        rows = known.dropDuplicates(["doc"]).select(F.col("doc").alias(f"{name}_doc"), F.explode(reach).alias("r"))
        return rows.select(f"{name}_doc", F.col("r.b").alias(f"{name}_b"), F.col("r.x").alias(f"{name}_x"))

    places = pairs
    for name in ("at", "first"):
        i = F.col(f"{name}.i")
        block = F.floor(i / min_words).cast("int")
        places = places.withColumns({f"{name}_doc": F.col(f"{name}.doc"), f"{name}_b": block, f"{name}_i": i - F.greatest(F.lit(0), (block - 1) * min_words)})
    places = places.join(blocks("at"), ["at_doc", "at_b"]).join(blocks("first"), ["first_doc", "first_b"])
    found = places.select(
        F.col("at_doc").alias("doc"), "at_x", "at_i",
        _equal(_after("at", min_words), _after("first", min_words)).alias("on"), _equal(_back("at", min_words), _back("first", min_words)).alias("back"),
    )
    runs = found.select("doc", F.get("at_x", F.col("at_i") - F.col("back"))["p"].alias("a"), F.get("at_x", F.col("at_i") + F.col("on") - 1)["p"].alias("b")).distinct()

    # Overlapping runs become one.
    ahead = in_doc.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("a") > F.coalesce(F.max("b").over(ahead) + 1, F.lit(-1))).cast("int")
    island = F.sum("fresh").over(in_doc.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0))
    merged = runs.withColumn("fresh", fresh).withColumn("island", island).groupBy("doc", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def _after(name: str, n: int) -> Column:
    return F.slice(F.col(f"{name}_x"), F.col(f"{name}_i") + 1, F.lit(n))


def _back(name: str, n: int) -> Column:
    start = F.greatest(F.lit(0), F.col(f"{name}_i") - n)
    return F.reverse(F.slice(F.col(f"{name}_x"), start + 1, F.col(f"{name}_i") - start))


def _equal(x: Column, y: Column) -> Column:
    """How many lines agree from the first on."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    return let(same, lambda s: F.when(F.array_position(s, False) == 0, F.size(s)).otherwise(F.array_position(s, False).cast("int") - 1))


def deduplicate_lines(docs: DataFrame, min_words: int = 50, drop_emptied: bool = False) -> DataFrame:
    """``docs`` without later repeated runs; n_chars, if there is one, follows the text.

    With ``drop_emptied``, documents that lose all their words go.
    """
    runs = materialise(repeated_runs(docs.select("doc_id", "text"), min_words), "line-runs").select(F.col("doc").alias("_doc"), F.col("runs").alias("_runs"))
    # A merge join at every size: a broadcast for small inputs alone would hide what the texts cost to move.
    placed = carried(docs, "doc_id", "text").withColumn("_place", _place())
    joined = placed.join(runs.hint("merge"), F.col("_place") == F.col("_doc"), "left")
    text = F.col("text").cast("string")

    def without(lines: Column) -> Column:
        edges = F.concat(F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))), F.col("_runs"), F.array(F.struct(F.size(lines).alias("a"), F.size(lines).alias("b"))))
        between = lambda a, b: F.slice(lines, a + 1, b - a)
        parts = F.transform(
            F.sequence(F.lit(0), F.size("_runs")),
            lambda k: F.concat(
                F.filter(between(F.greatest(F.get(edges, k)["a"], F.lit(0)), F.get(edges, k)["b"] + 1), lambda x: ~x.rlike(WORD)),
                between(F.get(edges, k)["b"] + 1, F.get(edges, k + 1)["a"]),
            ),
        )
        return F.array_join(F.flatten(parts), "\n")

    out = joined.withColumn("text", F.when(F.col("_runs").isNull(), text).otherwise(let(F.split(text, "\n"), without)))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("_runs").isNull(), F.col("row.n_chars")).otherwise(new)
    if drop_emptied:
        out = out.where(F.col("_runs").isNull() | F.col("text").rlike(WORD))
    return restored(out, docs.columns, **changed)
