"""One query for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    conversation_repair, decontaminate, exact_dedup, filter_audit, host_rules, language_model, line_dedup, packing, pii, secret_scan, superminhash,
    token_files, warc,
)
from riskloom.llm.columns import tidy
from riskloom.session import prepare, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Of the test tables; a real one comes from where secrets are kept.
PII_KEY = "key of the test tables"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tidy(prepare(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "n_values", "text")


@query
def op2_backoff_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    warc.register(spark)
    records = lambda: spark.read.format("warc").load(path)  # noqa: E731  each has pushed predicates of its own
    # Each kind of record is asked for by its header; revisits are read without payloads.
    whole = records().where("record_type = 'response'").select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), warc.payload_digest(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    again = records().where("record_type = 'revisit'").select("record_id", "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", "refers_to")
    both = whole.unionByName(again)
    return both.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to"))


ORACLES["op7_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top,
         array_to_string(list_transform(range(4), lambda k: substr((('0x' || substr(d, (1 + 10 * k)::INT, 10))::BIGINT)::BIT::VARCHAR, 25)), '') AS bits
  FROM p
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, (i * 5 + j + 1)::INT, 1)::INT * (16 >> j::INT)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM b
"""


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_digests(spark, path)


@query
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = host_rules.with_rules(table(spark, sf_dir, "documents")).select("doc_id", "source", *host_rules.RULES)
    return host_rules.judge_counted(docs).select("doc_id", *host_rules.RULES, "kept")


ORACLES["op9_host_rules"] = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) >= 8
), gg AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(ws, p, p + 7), ' ')) AS n FROM g
), r AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - p, 8))) AS n_repeat_words
  FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM gg WHERE n > 1) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source
), s AS (
  SELECT avg(f / n) AS m, CASE WHEN coalesce(var_pop(f / n), 0) > 0 THEN greatest(1, avg(f / n) * (1 - avg(f / n)) / var_pop(f / n) - 1) ELSE 1 END AS k FROM h
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (f + k * m) / (n + k) <= 0.5 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, s
"""


@query
def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audits(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


# The least repair so far for each place in the order (nothing, s, u, a), as (cost, audit, repaired text), row by row.
_REROLED = "{'c': %s.c + 3 + cut, 'a': %s.a || 'R', 't': %s.t || '%s:' || text || chr(10)}"
_KEPT = "CASE WHEN role[1] = '%s' THEN {'c': %s.c + cut, 'a': %s.a || 'K', 't': %s.t || role || ':' || text || chr(10)} END"
_DROPPED = "{'c': %s.c + 4, 'a': %s.a || 'D', 't': %s.t}"
_INSERTED = "{'c': %s.c + 3, 'a': %s.a || 'I', 't': %s.t || '%s:' || chr(10)}"


def _least(*found: str) -> str:
    return f"list_min(list_filter([{', '.join(found)}], lambda x: x.c IS NOT NULL))"


def _fitting(*found: str) -> str:
    return ", ".join(f"CASE WHEN fine THEN {x} END" for x in found)


ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) r(i)
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key
  FROM conversations
), drawn AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(key, lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) % 20 AS draw
  FROM src, crc
), made AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) FROM drawn WHERE draw > 0)
), told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM made
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
         regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS ended, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) || role[1] AS pair
  FROM told
), rows_ AS (
  SELECT *, NOT blank AND NOT again AS fine, CASE WHEN NOT blank AND NOT again AND NOT ended THEN 3 ELSE 0 END AS cut FROM judged
), walk AS (
  SELECT conv_id, 0::BIGINT AS p, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS b0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS b1,
         {{'c': 3::BIGINT, 'a': 'I', 't': 'user:' || chr(10)}} AS b2, {{'c': 6::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS b3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, p, b0, b1, b2, {_least('n3', _INSERTED % ('b2', 'b2', 'b2', 'assistant'))} AS b3
  FROM (
    SELECT conv_id, p, n0 AS b0, n1 AS b1, n3, {_least('n2', *(_INSERTED % (x, x, x, 'user') for x in ('n0', 'n1', 'n3')))} AS b2
    FROM (
      SELECT w.conv_id, r.p, {_DROPPED % ('b0', 'b0', 'b0')} AS n0,
             {_least(_DROPPED % ('b1', 'b1', 'b1'), _fitting(_KEPT % ('s', 'b0', 'b0', 'b0')))} AS n1,
             {_least(_DROPPED % ('b2', 'b2', 'b2'), *(y for x in ('b0', 'b1', 'b3') for y in (_fitting(_REROLED % (x, x, x, 'user')), _fitting(_KEPT % ('u', x, x, x)))))} AS n2,
             {_least(_DROPPED % ('b3', 'b3', 'b3'), _fitting(_REROLED % ('b2', 'b2', 'b2', 'assistant')), _fitting(_KEPT % ('a', 'b2', 'b2', 'b2')))} AS n3
      FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.p = w.p + 1
    )
  )
), ends AS (
  SELECT conv_id, {_least('b0', 'b3')} AS best FROM (SELECT *, max(p) OVER (PARTITION BY conv_id) AS last FROM walk) WHERE p = last
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate,
         sum((fine AND NOT ended)::INT) AS truncated, sum((coalesce(pair, 'su') NOT IN ('su', 'ua', 'au'))::INT) AS illegal
  FROM rows_ GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
       sha256(CASE WHEN best.t = '' THEN '' ELSE best.t[:-2] END) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d
), m AS (
  SELECT w.doc_id, part, coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic,
         (len(ws) < 200)::INT + 2 * (100 * list_unique(ws) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (w.doc_id > min(w.doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM w LEFT JOIN labels USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), p AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM p
"""


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"), columns=["doc_id"])


ORACLES["op13_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"'[\x20\x09-\x0D]+'"
_MARKS = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES["op4_decontamination"] = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, {_MARKS}), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex({_LOWER}, {_MARKS}), lambda x: x <> '') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(list_slice(ws, p, p + 12), ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)
), hit AS (
  SELECT doc_id, p, n, item_id FROM dw JOIN win USING (n, k)
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

ORACLES["op6_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, len(list_filter(string_split_regex(x, {_SPACES}), lambda y: y <> '')) AS n FROM l
), k AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM w WHERE n > 0
), f AS (
  SELECT doc_id, list(x) OVER a AS c, sum(n) OVER a AS m, min(p) OVER a AS s, max(p) OVER a AS e
  FROM k WINDOW a AS (PARTITION BY doc_id ORDER BY upto - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, list(x) OVER a, sum(n) OVER a, min(p) OVER a, max(p) OVER a
  FROM k WINDOW a AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), z AS (
  SELECT *, doc_id * 10000000 + s AS here, min(doc_id * 10000000 + s) OVER (PARTITION BY c) AS first FROM f WHERE m >= 50
), gone AS (
  SELECT DISTINCT k.doc_id, k.p FROM z JOIN k ON k.doc_id = z.doc_id AND k.p BETWEEN z.s AND z.e WHERE here > first
), t AS (
  SELECT doc_id, string_agg(x, chr(10) ORDER BY p) AS kept FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN g.doc_id IS NULL THEN text ELSE coalesce(kept, '') END AS text, lang, source,
       CASE WHEN g.doc_id IS NULL THEN n_chars ELSE length(coalesce(kept, '')) END AS n_chars
FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM gone) g USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES["op10_superminhash"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, {_SPACES}), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c
)
SELECT a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = a AS kept
FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a
"""
