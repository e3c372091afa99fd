"""Scans, views and small re-rankers, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.functions import text as T
from millrace.operators import relational, retrieve, segments
from millrace.plans.registry import query
from millrace.plans.retrieval_queries import SQL_BM25, _ranked
from millrace.plans.text_queries import SQL_TOKENS
from millrace.sources.tables import table

SQL_POOL = f"""{SQL_BM25}, p AS (SELECT r.query_id, r.doc_id, r.rank, r.bm25, list_slice(list_distinct({SQL_TOKENS.format("b.text")}), 1, 1000) AS qt, lower(d.text) AS low
  FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= 10)"""


def _pool(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return retrieve.with_rows(_ranked(spark, sf_dir), docs.select("doc_id", "text")).join(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id")


@query("substring_rerank", f"""
WITH {SQL_POOL}, h AS (SELECT query_id, doc_id, bm25, len(list_filter(qt, lambda t: contains(low, t))) / len(qt) AS hit FROM p),
sb AS (SELECT query_id, doc_id, round(0.3 * hit + 0.7 * least(1, bm25 / 50), 9) AS score FROM h), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sb)
SELECT query_id, doc_id, score, rank::INT AS rank FROM z WHERE rank <= 5""")
def substring_rerank(spark, sf_dir):
    rated = _pool(spark, sf_dir).select("query_id", "doc_id", "rank", F.least(F.lit(1.0), F.col("bm25") / 50).alias("score"), retrieve.substring_overlap(T.tokens(F.col("q")), F.col("text"), 1000).alias("hit_ratio"))
    return retrieve.lexical_boost(rated).select("query_id", "doc_id", "score", "rank")


@query("domain_fusion", f"""
WITH {SQL_POOL}, h AS (SELECT query_id, doc_id, len(list_filter(qt, lambda t: contains(low, t))) / len(qt) AS hit, (bm25 % 10) / 10 AS dense FROM p)
SELECT query_id, doc_id, round(greatest(-1, least(1, 2 * (0.6 * greatest(0, least(1, (dense + 1) / 2)) + 0.32 * hit + 0.08 * hit) - 1)), 6) AS score FROM h""")
def domain_fusion(spark, sf_dir):
    hit = retrieve.substring_overlap(T.tokens(F.col("q")), F.col("text"), 1000)
    rated = _pool(spark, sf_dir).select("query_id", "doc_id", ((F.col("bm25") % 10) / 10).alias("dense"), hit.alias("hit"))
    return rated.select("query_id", "doc_id", F.round(retrieve.domain_score(F.col("dense"), F.col("hit"), F.col("hit")), 6).alias("score"))


@query("relation_adjacency", """WITH n AS (SELECT a.conv_id, a.turn AS source, b.turn AS neighbour, abs(a.turn - b.turn) AS d FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) BETWEEN 1 AND 6)
SELECT conv_id || ':' || source AS source, coalesce(list(neighbour ORDER BY neighbour) FILTER (WHERE d <= 2), [])::BIGINT[] AS near, coalesce(list(neighbour ORDER BY neighbour) FILTER (WHERE d > 2), [])::BIGINT[] AS far FROM n GROUP BY ALL""")
def relation_adjacency(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("item"))
    pairs = relational.neighbours(turns, "conv_id", "turn", "item").withColumn("source", F.concat_ws(":", "conv_id", "source"))
    return retrieve.adjacency(pairs)


@query("strategy_view", "SELECT 'a' AS strategy, count(*)::BIGINT AS n, count(c_acctbal)::BIGINT AS with_balance FROM customer UNION ALL SELECT 'b', count(*), 0 FROM nation UNION ALL SELECT 'c', count(*), count(s_acctbal) FROM supplier")
def strategy_view(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return retrieve.strategy_view(a=a, b=b, c=c).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("with_balance"))


@query("ascii_stripped", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[A-Za-z0-9_./:$#@-]+', ' ', 'g'), '\s+', ' ', 'g')) AS rest FROM documents")
def ascii_stripped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.without_ascii_anchors(F.col("text")).alias("rest"))


SQL_SHORT_TEXT = "CASE item_id % 3 WHEN 0 THEN 'Using JdbcTemplate.query with spring.datasource.url and HTTP2Client, ' || text WHEN 1 THEN 'The custom Type of ABCD ' || text ELSE text END"


@query("compressed_queries", f"""
WITH q AS (SELECT item_id, trim(regexp_replace({SQL_SHORT_TEXT}, '\\s+', ' ', 'g')) AS text, {SQL_SHORT_TEXT} AS raw FROM benchmark),
t AS (SELECT item_id, text, list_filter(list_transform(regexp_extract_all(raw, '@[A-Za-z][A-Za-z0-9_]+|[A-Za-z][A-Za-z0-9_.:/+-]{{2,}}'), lambda x: trim(x, '.,;:!?()[]{{}}<>"''`')), lambda x: length(x) >= 3 AND lower(x) NOT IN {P.GENERIC_TERMS_EN}
  AND (starts_with(x, '@') OR regexp_matches(x, '[._/:-]') OR regexp_matches(x, '[0-9]') OR (regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '\\p{{Ll}}') AND length(x) >= 4) OR (regexp_matches(substr(x, 2), '\\p{{Lu}}') AND regexp_matches(x, '\\p{{Ll}}')))) AS ts FROM q),
d AS (SELECT item_id, text, list_slice(list_filter(ts, lambda x, i: list_position(list_transform(ts, lambda y: lower(y)), lower(x)) = i), 1, 8) AS ts FROM t),
v AS (SELECT item_id, text, CASE WHEN len(ts) > 0 THEN list_filter([ts[1] || ' how?', CASE WHEN len(ts) > 1 THEN ts[1] || ' ' || ts[2] || ' how?' END, CASE WHEN len(ts) > 2 THEN ts[1] || ' ' || ts[2] || ' ' || ts[3] || '?' END], lambda x: length(x) BETWEEN 3 AND 72)
  ELSE list_filter([rtrim(array_to_string(list_slice(string_split(text, ' '), 1, 3), ' '), '?.!') || '?'], lambda x: length(x) BETWEEN 3 AND 72) END AS vs FROM d)
SELECT item_id, coalesce(vs[1], rtrim(substr(text, 1, 64)) || '?') AS short, len(vs)::INT AS variants FROM v""")
def compressed_queries(spark, sf_dir):
    k = F.col("item_id") % 3
    text = F.when(k == 0, F.concat(F.lit("Using JdbcTemplate.query with spring.datasource.url and HTTP2Client, "), "text")).when(k == 1, F.concat(F.lit("The custom Type of ABCD "), "text")).otherwise(F.col("text"))
    made = P.short_query_variants(text, F.array().cast("array<string>"), F.lit("procedure"), "en")
    return table(spark, sf_dir, "benchmark").select("item_id", made.alias("v")).select("item_id", F.get("v", F.lit(0)).alias("short"), (F.size("v") - 1).alias("variants"))


@query("markdown_segments")
def markdown_segments(spark, sf_dir):
    return segments.segmented(table(spark, sf_dir, "documents"))
