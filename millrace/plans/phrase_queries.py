"""Anchor phrases, content and hint tokens, answer metrics, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.operators import evaluate
from millrace.plans.registry import query
from millrace.plans.text_queries import SQL_TECHNICAL, SQL_TOKENS, SQL_UNWRAPPED
from millrace.sources.tables import table

#: Texts with annotations, joints, capitals and stop words among the words of a passage.
SQL_MARKED = "CASE WHEN item_id % 2 = 0 THEN '@Bean (RestTemplate), spring security: v2 HTTP2Client ' || text ELSE text || ' spring.datasource.url [foo_bar] 12 ab config API JSON' END"


def _marked(spark, sf_dir):
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("@Bean (RestTemplate), spring security: v2 HTTP2Client "), "text")).otherwise(F.concat("text", F.lit(" spring.datasource.url [foo_bar] 12 ab config API JSON")))
    return table(spark, sf_dir, "benchmark").select("item_id", text.alias("text"))


def _sql_found(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(text, '{pattern}'), lambda x: {SQL_UNWRAPPED.format('x')})"


_MARKER = SQL_TECHNICAL.format("x")
_ORDERED = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"


@query("anchor_tokens", f"""WITH m AS (SELECT item_id, {SQL_MARKED} AS text FROM benchmark), t AS (SELECT item_id, list_filter({_sql_found(P.ANCHOR_TOKEN)}, lambda x: x <> '' AND lower(x) NOT IN {P.ANCHOR_STOPWORDS} AND {_MARKER} AND length(x) <= 120 AND len(regexp_extract_all(x, '\\.')) <= 6 AND lower(x) NOT IN {P.EN_FUNCTIONAL}) AS t FROM m)
SELECT item_id, array_to_string(list_slice({_ORDERED.format("t")}, 1, 8), ' ') AS tokens FROM t""")
def anchor_tokens(spark, sf_dir):
    return _marked(spark, sf_dir).select("item_id", F.array_join(P.anchor_tokens(F.col("text"), F.lit("en")), " ").alias("tokens"))


@query("content_tokens", f"""WITH m AS (SELECT item_id, {SQL_MARKED} AS text FROM benchmark), t AS (SELECT item_id, list_transform(list_filter({_sql_found(P.CONTENT_TOKEN)}, lambda x: x <> '' AND lower(x) NOT IN {P.GENERIC_CONTENT} AND NOT regexp_full_match(x, '[0-9]+') AND length(x) >= 2 AND (length(x) >= 3 OR {_MARKER})), lambda x: lower(x)) AS t FROM m)
SELECT item_id, array_to_string(list_slice({_ORDERED.format("t")}, 1, 24), ' ') AS tokens FROM t""")
def content_tokens(spark, sf_dir):
    return _marked(spark, sf_dir).select("item_id", F.array_join(P.content_tokens(F.col("text")), " ").alias("tokens"))


_HINT = f"""lower(x) NOT IN {P.GENERIC_HINTS} AND (starts_with(x, '@') OR regexp_matches(x, '[._/:-]') OR regexp_matches(x, '[0-9]') OR (regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '\\p{{Ll}}') AND length(x) >= 4) OR (regexp_matches(substr(x, 2), '\\p{{Lu}}') AND regexp_matches(x, '\\p{{Ll}}')))
  AND length(x) BETWEEN 3 AND 120 AND len(regexp_extract_all(x, '\\.')) <= 6 AND lower(x) NOT IN {P.EN_FUNCTIONAL} AND ({_MARKER} OR lower(x) NOT IN {P.ANCHOR_STOPWORDS})"""


@query("hint_tokens", f"""WITH m AS (SELECT item_id, {SQL_MARKED} AS text FROM benchmark), t AS (SELECT item_id, text, list_filter({_sql_found(P.ANCHOR_TOKEN)}, lambda x: x <> '' AND lower(x) NOT IN {P.ANCHOR_STOPWORDS} AND {_MARKER} AND length(x) <= 120 AND len(regexp_extract_all(x, '\\.')) <= 6 AND lower(x) NOT IN {P.EN_FUNCTIONAL}) AS t FROM m),
u AS (SELECT item_id, list_filter(list_concat(list_slice({_ORDERED.format("t")}, 1, 12), {_sql_found(P.HINT_TOKEN)}), lambda x: x <> '' AND {_HINT}) AS t FROM t) SELECT item_id, array_to_string(list_slice({_ORDERED.format("t")}, 1, 6), ' ') AS tokens FROM u""")
def hint_tokens(spark, sf_dir):
    return _marked(spark, sf_dir).select("item_id", F.array_join(P.hint_tokens(F.col("text"), F.lit("en"), 6), " ").alias("tokens"))


@query("product_aliases", """WITH p AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) || CASE p_size % 4 WHEN 0 THEN '_docs' WHEN 1 THEN '-Reference' WHEN 2 THEN '' ELSE '_doc' END AS raw FROM part), k AS (SELECT raw, replace(lower(trim(raw)), '_', '-') AS k FROM p)
SELECT raw, array_to_string(list_sort(list_distinct(list_filter([k, CASE WHEN k LIKE '_%-reference' THEN left(k, -10) END, CASE WHEN k LIKE '_%-docs' THEN left(k, -5) END, CASE WHEN k LIKE '_%-doc' THEN left(k, -4) END], lambda x: x IS NOT NULL))), ',') AS aliases FROM k""")
def product_aliases(spark, sf_dir):
    size = F.col("p_size") % 4
    raw = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.when(size == 0, "_docs").when(size == 1, "-Reference").when(size == 2, "").otherwise("_doc"))
    return table(spark, sf_dir, "part").select(raw.alias("raw")).distinct().select("raw", F.array_join(P.product_aliases(F.col("raw")), ",").alias("aliases"))


@query("chunk_overlap_parse", f"""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{P.OVERLAP_LABEL}' || chr(10) || left(text, 40) || chr(10) || chr(10) || text WHEN 1 THEN '{P.OVERLAP_LABEL}' || text ELSE text END AS t FROM documents),
p AS (SELECT doc_id, t, starts_with(t, '{P.OVERLAP_LABEL}') AND contains(t, chr(10) || chr(10)) AS labelled, instr(t, chr(10) || chr(10)) AS cut FROM c), h AS (SELECT *, left(t, cut::INT - 1) AS head FROM p)
SELECT doc_id, CASE WHEN labelled AND contains(head, chr(10)) THEN length(head) - instr(head, chr(10)) ELSE 0 END::INT AS overlap_chars, md5(CASE WHEN labelled THEN substr(t, cut + 2) ELSE t END) AS content FROM h""")
def chunk_overlap_parse(spark, sf_dir):
    label, k = F.lit(P.OVERLAP_LABEL), F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(label, F.lit("\n"), F.left("text", F.lit(40)), F.lit("\n\n"), "text")).when(k == 1, F.concat(label, "text")).otherwise(F.col("text"))
    found = table(spark, sf_dir, "documents").select("doc_id", P.overlap_of_chunk(text).alias("o"))
    return found.select("doc_id", F.col("o.overlap_chars").cast("int").alias("overlap_chars"), F.md5(F.col("o.content").cast("binary")).alias("content"))


@query("encoder_prefixes", "SELECT 'query' AS kind, md5(string_agg('query: ' || text, '|' ORDER BY item_id)) AS digest FROM benchmark UNION ALL SELECT 'plain', md5(string_agg(text, '|' ORDER BY item_id)) FROM benchmark")
def encoder_prefixes(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")

    def digest(kind: str, text):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", text.alias("t")))), lambda x: x["t"]), "|")
        return rows.agg(F.md5(joined.cast("binary")).alias("digest")).select(F.lit(kind).alias("kind"), "digest")

    return digest("query", P.encoder_text(F.col("text"), "intfloat/multilingual-e5-small", "query")).union(digest("plain", P.encoder_text(F.col("text"), "hash", "query")))


def _ratio(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}), 0), 0)"


@query("answer_metrics", f"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS ans, a.text || ' ' || left(b.text, 60) AS ctx, CASE WHEN a.turn % 2 = 0 THEN '' ELSE left(a.text, 50) END AS pts, 'chunk-' || a.conv_id % 7 || ' ' || left(b.text, 20) AS ids, ['c' || a.conv_id % 5, 'c' || a.turn % 5, 'c9'] AS want, ['c' || (a.conv_id + 1) % 5, 'c' || a.turn % 5] AS got
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
t AS (SELECT *, list_distinct({SQL_TOKENS.format("q")}) AS tq, list_distinct({SQL_TOKENS.format("ans")}) AS ta, list_distinct({SQL_TOKENS.format("ctx")}) AS tc, list_distinct({SQL_TOKENS.format("coalesce(nullif(pts, ''), array_to_string(want, ' '))")}) AS tp, list_distinct({SQL_TOKENS.format("ids")}) AS ti, len(list_filter(want, lambda x: list_contains(got, x))) AS cov FROM p),
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(ans, '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(ctx, '\\s+'), lambda x: x <> '') AS c FROM p),
g AS (SELECT conv_id, turn, unnest(list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: array_to_string(a[i:i+2], ' '))) AS g, 1 AS own FROM w UNION ALL SELECT conv_id, turn, unnest(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: array_to_string(c[i:i+2], ' '))), 0 FROM w),
n AS (SELECT conv_id, turn, g, sum(own) AS a, count(*) - sum(own) AS b FROM g GROUP BY ALL), f AS (SELECT conv_id, turn, coalesce(sum(least(a, b)) / nullif(sum(a), 0), 0) AS copied FROM n GROUP BY ALL)
SELECT t.conv_id, t.turn, round({_ratio("tp", "ta")}, 9) AS correctness, round({_ratio("ta", "tc")}, 9) AS grounding, round(greatest(0, 1 - {_ratio("ta", "tc")}), 9) AS hallucination_rate, round({_ratio("tq", "ta")}, 9) AS answer_relevance,
  round(1 - least(1, coalesce(copied, 0)), 9) AS faithfulness, round({_ratio("ti", "ta")}, 9) AS keyword_overlap, round(cov / 3, 9) AS context_recall, round(cov / 2, 9) AS context_precision FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.turn = t.turn""")
def answer_metrics(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ans"))
    c, t = F.col("conv_id"), F.col("turn")
    name = lambda x: F.concat(F.lit("c"), (x % 5).cast("string"))
    rows = turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("q"), "ans", F.concat("text", F.lit(" "), F.left("ans", F.lit(60))).alias("ctx"), F.when(t % 2 == 0, "").otherwise(F.left("text", F.lit(50))).alias("pts"),
        F.concat(F.lit("chunk-"), (c % 7).cast("string"), F.lit(" "), F.left("ans", F.lit(20))).alias("ids"), F.array(name(c), name(t), F.lit("c9")).alias("want"), F.array(name(c + 1), name(t)).alias("got"))
    names = ("correctness", "grounding", "hallucination_rate", "answer_relevance", "faithfulness", "keyword_overlap", "context_recall", "context_precision")
    out = evaluate.answer_metrics(rows, "q", "ans", "ctx", "pts", "ids", "want", "got")
    return out.select("conv_id", "turn", *(F.round(n, 9).alias(n) for n in names))
