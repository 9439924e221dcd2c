"""Queries of the numbered operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import (
    bloom_lm, compression, filter_audit, line_windows, media, mixing, near_dedup, orc_tokens, packing, repetition, token_counts, treap, url_lists,
)
from chartloom.llm.common import fold, read_table, whole_text


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(media.stored_media(read_table(spark, sf_dir, "documents"))).drop("tile")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, with_ids=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = compression.fit(docs, read_table(spark, sf_dir, "labels"))
    return compression.score(docs.select("doc_id", whole_text().alias("text")), model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return orc_tokens.digest(orc_tokens.token_table(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def _captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time spread over a year by their id."""
    seconds = F.pmod(F.col("page_id") * 7919, F.lit(365)) * 86_400 + F.pmod(F.col("page_id"), F.lit(86_400))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + seconds).alias("fetch_time"))


def _feed(pages: DataFrame) -> DataFrame:
    """Dated entries for some hosts, their domains and path segments, by a hash of the key."""
    host = url_lists.host_of(F.col("url"))
    kinds = F.array(
        F.struct(F.lit("hosts").alias("list"), host.alias("key")),
        F.struct(F.lit("domains").alias("list"), F.regexp_replace(host, r"^[^.]*\.", "").alias("key")),
        F.struct(F.lit("paths").alias("list"), F.concat_ws("/", host, url_lists.segment_of(F.col("url"))).alias("key")),
    )
    keys = pages.select(F.inline(kinds)).where("key <> ''").distinct()
    value = F.conv(F.substring(F.md5(F.concat_ws(":", "list", "key").cast("binary")), 1, 7), 16, 10).cast("long")
    keyed = keys.select("list", "key", value.alias("v")).where("v % 4 = 0 OR key LIKE 'spam-farm%' OR key LIKE 'cheap-pills%'")
    day = F.expr("v DIV 4 % 300")
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day.alias("day")),
        F.struct(F.lit("remove").alias("action"), F.when(F.col("v") % 3 == 0, day + 30 + F.col("v") % 50).alias("day")),
        F.struct(F.lit("add").alias("action"), F.when(F.col("v") % 9 == 0, day + 90).alias("day")),
    )
    rows = keyed.select("list", "key", F.inline(steps)).where("day IS NOT NULL")
    return rows.select("list", "key", "action", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("day") * 86_400).alias("at"))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_lists.judge_captures(_captures(pages), _feed(pages))
    return judged.select("page_id", "url", F.unix_seconds("fetch_time").alias("fetched_s"), "blocked", "lists")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.language_model_scores(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f for f in (
        op1_media, op2_packing, op3_quality, op4_orc_tokens, op5_near_dedup, op6_url_lists, op7_language_model,
        op8_mixing, op9_line_windows, op10_repetition, op11_filter_audit, op12_ranked_search, op13_token_counts, pipeline,
    )
}

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_SEGMENT = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)"

CHECK_SQL = {
    "op6_url_lists": f"""
WITH u AS (
  SELECT page_id, url, {_HOST} AS host, {_SEGMENT} AS segment,
         1704067200 + (page_id * 7919) % 365 * 86400 + page_id % 86400 AS t
  FROM pages),
k AS (
  SELECT DISTINCT list, key FROM (
    SELECT 'hosts' AS list, host AS key FROM u UNION ALL
    SELECT 'domains', regexp_replace(host, '^[^.]*\\.', '') FROM u UNION ALL
    SELECT 'paths', host || '/' || segment FROM u) WHERE key <> ''),
v AS (
  SELECT * FROM (SELECT list, key, CAST('0x' || substr(md5(list || ':' || key), 1, 7) AS BIGINT) AS v FROM k)
  WHERE v % 4 = 0 OR key LIKE 'spam-farm%' OR key LIKE 'cheap-pills%'),
e AS (
  SELECT list, key, 0 AS gone, v // 4 % 300 AS day FROM v UNION ALL
  SELECT list, key, 1, v // 4 % 300 + 30 + v % 50 FROM v WHERE v % 3 = 0 UNION ALL
  SELECT list, key, 0, v // 4 % 300 + 90 FROM v WHERE v % 9 = 0),
keys AS (
  SELECT page_id, url, t, host || '/' || segment AS key FROM u WHERE host <> '' AND segment <> '' UNION ALL
  SELECT page_id, url, t, array_to_string(string_split(host, '.')[i:], '.')
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM u WHERE host <> '')),
last AS (
  SELECT k.page_id, k.url, k.t, e.list, e.key, max(e.day * 2 + e.gone) AS state
  FROM keys k JOIN e ON e.key = k.key AND 1704067200 + e.day * 86400 <= k.t GROUP BY ALL),
hit AS (SELECT page_id, url, t, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM last WHERE state % 2 = 0 GROUP BY ALL)
SELECT u.page_id, u.url, u.t AS fetched_s, hit.lists IS NOT NULL AS blocked, coalesce(hit.lists, '') AS lists
FROM u LEFT JOIN hit ON hit.page_id = u.page_id AND hit.url = u.url AND hit.t = u.t""",
    "op9_line_windows": """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS k
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS rn
    FROM w WHERE regexp_matches(k, '[^\\x20\\x09-\\x0D]')) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (SELECT unnest([0, 1, 2]) AS d)),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM l),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT l.doc_id, len(l.ls) AS n_lines, len(l.ls) - coalesce(kept.n, 0) AS n_removed,
       CASE WHEN coalesce(kept.n, 0) = len(l.ls) THEN l.text ELSE coalesce(kept.text, '') END AS text
FROM l LEFT JOIN kept USING (doc_id)""",
    "op11_filter_audit": """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
o AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
m AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) AS c,
         regexp_matches(w.text, '[#$%&*|]') AS d, coalesce(w.doc_id > first, false) AS e, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM w JOIN o ON o.text = w.text LEFT JOIN m ON m.doc_id = w.doc_id),
c AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
p AS (
  SELECT l1.l || l2.l || l3.l || l4.l || l5.l AS filter_order FROM l l1, l l2, l l3, l l4, l l5
  WHERE len(list_distinct([l1.l, l2.l, l3.l, l4.l, l5.l])) = 5),
h AS (
  SELECT c.*, filter_order, a::INT + b::INT + c::INT + d::INT + e::INT AS fails,
         least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END,
               CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END,
               CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS hit
  FROM c, p),
s AS (
  SELECT h.*, step, substr(filter_order, step, 1) AS letter,
         CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failing
  FROM h, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (hit > step), 0) AS kept, coalesce(sum(n) FILTER (hit = step), 0) AS removed,
         coalesce(sum(n) FILTER (failing AND hit < step), 0) AS redundant, coalesce(sum(n) FILTER (failing AND fails = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (hit = step), 0) AS good_lost, coalesce(sum(bad) FILTER (hit = step), 0) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r""",
    "op12_ranked_search": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
g AS (SELECT count(*) AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
o AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM o GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY t),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), g GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
}
