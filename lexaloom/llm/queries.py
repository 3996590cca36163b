"""The query of each operator over its whole table, and its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, editprints, langid, linededup, media, minhash, packing, quality, token_files, urlfilter


def vocabulary(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dated_entries(pages: DataFrame) -> DataFrame:
    """A list for the pages table, which has none: every domain (a host's last three
    labels) has a history that depends on its digest. Five in eight domains are
    never listed; the others are added at one of many instants, most are taken
    off later and some of those listed again. Hosts of those listed that start
    with www are allowed from 2023-07-01 on."""
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    domains = hosts.select(F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".").alias("rule")).where(r"size(split(rule, '\\.')) = 3").distinct()
    digit = lambda k: F.conv(F.substring(F.md5("rule"), k, 1), 16, 10).cast("int")
    day = lambda n: F.timestamp_seconds(F.lit(1672531200) + n * 86_400)  # noqa: E731  from 2023-01-01 on
    listed = domains.where(digit(1) < 6).withColumn("start", digit(2) * 16 + digit(3))
    added = listed.select("rule", F.lit(False).alias("allow"), F.lit("add").alias("action"), day(F.col("start")).alias("at"))
    removed = listed.where(digit(4) < 12).select("rule", F.lit(False), F.lit("remove"), day(F.col("start") + 30 + digit(5) * 8))
    again = listed.where(digit(4) < 4).select("rule", F.lit(False), F.lit("add"), day(F.col("start") + 200 + digit(6) * 8))
    allowed = hosts.where("host like 'www.%'").select(F.col("host").alias("rule"), F.lit(True), F.lit("add"), day(F.lit(181)))
    return added.union(removed).union(again).union(allowed)


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch times: page n counts as fetched n * 997 minutes, modulo 500 days, after 2023-01-01."""
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.timestamp_seconds(F.lit(1672531200) + F.pmod(F.col("page_id") * 997 * 60, F.lit(500 * 86_400))).alias("fetched_at"))
    judged = urlfilter.judge_captures(captures, _dated_entries(pages))
    return judged.withColumns({c: F.unix_seconds(c) for c in ("fetched_at", "active_since")})


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_editprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(_table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, similarity_percent=80)


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_removed")


QUERIES = {
    "op1_urlfilter": op1_urlfilter,
    "op2_quality": op2_quality,
    "op3_editprints": op3_editprints,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_audio": op6_audio,
    "op7_langid": op7_langid,
    "op8_bpe": op8_bpe,
    "op9_minhash": op9_minhash,
    "op10_linededup": op10_linededup,
}

ORACLES = {
    "op1_urlfilter": r"""
WITH captures AS (
  SELECT page_id, url, lower(regexp_replace(regexp_extract(coalesce(url, ''), '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '(^.*@)|(\.?:[0-9]*$)|(\.$)', '', 'g')) AS host,
    1672531200 + (page_id * 997 * 60) % (500 * 86400) AS fetched_at FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
domains AS (SELECT DISTINCT regexp_extract(host, '([^.]*\.[^.]*\.[^.]*)$', 1) AS rule FROM hosts WHERE regexp_matches(host, '[^.]*\.[^.]*\.[^.]*$')),
digits AS (SELECT rule, list_transform(range(1, 7), lambda k: CAST('0x' || substr(md5(rule), k, 1) AS INT)) AS d FROM domains),
events AS (
  SELECT rule, false AS allow, true AS adds, d[2] * 16 + d[3] AS day FROM digits WHERE d[1] < 6
  UNION ALL SELECT rule, false, false, d[2] * 16 + d[3] + 30 + d[5] * 8 FROM digits WHERE d[1] < 6 AND d[4] < 12
  UNION ALL SELECT rule, false, true, d[2] * 16 + d[3] + 200 + d[6] * 8 FROM digits WHERE d[1] < 6 AND d[4] < 4
  UNION ALL SELECT host, true, true, 181 FROM hosts WHERE host LIKE 'www.%'),
latest AS (
  SELECT c.page_id, e.rule, e.allow, max(e.day) AS day
  FROM captures c JOIN events e ON (c.host = e.rule OR c.host LIKE '%.' || e.rule) AND 1672531200 + e.day * 86400 <= c.fetched_at
  GROUP BY c.page_id, e.rule, e.allow),
active AS (
  SELECT l.page_id, l.rule, l.allow, 1672531200 + l.day * 86400 AS since,
    row_number() OVER (PARTITION BY l.page_id ORDER BY length(l.rule) DESC, l.allow DESC, l.rule DESC) AS r, count(*) OVER (PARTITION BY l.page_id) AS n
  FROM latest l WHERE (SELECT bool_and(e.adds) FROM events e WHERE e.rule = l.rule AND e.allow = l.allow AND e.day = l.day))
SELECT c.page_id, c.url, c.host, c.fetched_at, a.rule, a.since AS active_since, coalesce(a.n, 0) AS n_active, coalesce(a.allow, true) AS kept
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.r = 1
""",
    "op9_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN []
    WHEN len(t) = 1 THEN [t[1]]
    ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (
  SELECT doc_id AS src, doc_id AS node FROM documents
  UNION
  SELECT r.src, e.y FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.node) AS component_id, d.doc_id = min(r.node) AS kept
FROM documents d JOIN r ON r.src = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
""",
    "op10_linededup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, ln, body, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(body), '[	-
 ]+'), lambda w: w <> ''))) AS ws FROM l),
first AS (
  SELECT ws, len(ws) AS n, min((doc_id, ln)) AS pos FROM t WHERE len(ws) >= 1 GROUP BY ws),
-- any order of the words serves: here that of their digests
p AS (
  SELECT pos, n, unnest(list_transform(list_sort(list_transform(ws, lambda w: md5(w) || w)), lambda w: w[33:])[:n - CAST(ceil(n * 80 / 100.0) AS INT) + 1]) AS w FROM first),
c AS (
  SELECT DISTINCT a.pos AS x, b.pos AS y FROM p a JOIN p b ON a.w = b.w AND a.pos < b.pos
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
sim AS (
  SELECT DISTINCT c.y FROM c JOIN first a ON a.pos = c.x JOIN first b ON b.pos = c.y
  WHERE 100 * len(list_intersect(a.ws, b.ws)) >= 80 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
gone AS (
  SELECT t.doc_id, t.ln FROM t JOIN first f ON f.ws = t.ws LEFT JOIN sim ON sim.y = f.pos
  WHERE (t.doc_id, t.ln) <> f.pos OR sim.y IS NOT NULL),
left_over AS (
  SELECT l.doc_id, string_agg(l.body, chr(10) ORDER BY l.ln) FILTER (g.ln IS NULL) AS text, count(g.ln) AS n_removed
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.ln = l.ln GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(o.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN left_over o ON o.doc_id = d.doc_id
""",
}
