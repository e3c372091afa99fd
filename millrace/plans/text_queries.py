"""Queries over single texts, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.registry import query
from millrace.sources.tables import table

SQL_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_./-]+|[가-힣]+'), lambda t: lower(t))"
SQL_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("text_token_counts", r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_./-]+|[가-힣]+'))::BIGINT AS n_tokens,
  len(regexp_extract_all(text, '[A-Za-z0-9_./:@$-]+|[^\p{L}\p{N}_\s]'))::BIGINT AS n_length_tokens FROM documents""")
def text_token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"), T.token_length(F.col("text")).alias("n_length_tokens"))


@query("text_ratios", r"""
SELECT doc_id, round(len(regexp_extract_all(text, '[가-힣]')) / length(regexp_replace(text, '\s', '', 'g')), 9) AS korean_ratio,
  round(len(regexp_extract_all(text, '[^A-Za-z0-9가-힣\s]')) / length(regexp_replace(text, '\s', '', 'g')), 9) AS special_ratio FROM documents""")
def text_ratios(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.round(T.korean_ratio(text), 9).alias("korean_ratio"), F.round(T.special_ratio(text), 9).alias("special_ratio"))


@query("sentence_stats", f"""
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest
FROM (SELECT doc_id, {SQL_SENTENCES.format("text")} AS s FROM documents)""")
def sentence_stats(spark, sf_dir):
    cut = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return cut.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("extractive_summary", f"""
SELECT doc_id, CASE WHEN len(s) = 0 THEN left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 240) ELSE array_to_string(s[1:2], ' ') END AS summary
FROM (SELECT doc_id, text, {SQL_SENTENCES.format("text")} AS s FROM documents)""")
def extractive_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.extractive_summary(F.col("text")).alias("summary"))


def _sql_translate(column: str) -> str:
    for source, target in T.TRANSLATIONS.items():
        column = rf"regexp_replace({column}, '\b{source}\b', '{target}', 'gi')"
    return column


@query("word_translation", f"SELECT item_id, {_sql_translate('text')} AS translated FROM benchmark")
def word_translation(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.translate_words(F.col("text")).alias("translated"))


@query("copy_ratio_ngram", r"""
WITH p AS (SELECT d.doc_id, b.text AS q, d.text AS r FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '') AS q, list_filter(regexp_split_to_array(r, '\s+'), lambda x: x <> '') AS r FROM p),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(q) - 2, 1)), lambda i: array_to_string(q[i:i+3], ' '))) AS g, 1 AS own FROM w
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(r) - 2, 1)), lambda i: array_to_string(r[i:i+3], ' '))), 0 FROM w),
c AS (SELECT doc_id, g, sum(own) AS a, count(*) - sum(own) AS b FROM g GROUP BY ALL)
SELECT w.doc_id, round(coalesce(sum(least(a, b)) / nullif(sum(a), 0), 0), 9) AS copied FROM w LEFT JOIN c ON c.doc_id = w.doc_id GROUP BY w.doc_id""")
def copy_ratio_ngram(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    size = bench.agg(F.count(F.lit(1)).alias("n"))
    docs = _docs(spark, sf_dir).crossJoin(F.broadcast(size)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    pairs = docs.join(bench.select("item_id", F.col("text").alias("q")), "item_id")
    return pairs.select("doc_id", F.round(T.copy_ratio(F.col("q"), F.col("text")), 9).alias("copied"))


@query("content_ids", """
SELECT doc_id, 'doc_' || substr(sha1(text), 1, 16) AS content_id, sha1(text) AS checksum, sha256(text) AS sha256, md5(text) AS md5,
  'chk_' || substr(sha1(doc_id || ':0'), 1, 16) AS chunk_id FROM documents""")
def content_ids(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return _docs(spark, sf_dir).select(
        "doc_id", T.content_id(F.col("text"), "doc").alias("content_id"), F.sha1(raw).alias("checksum"), F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"),
        T.content_id(F.concat(F.col("doc_id").cast("string"), F.lit(":0")), "chk").alias("chunk_id"))


@query("name_uuids", f"""
WITH h AS (SELECT page_id, sha1(unhex('{T.URL_NAMESPACE}') || encode(url)) AS h FROM pages)
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  lower(hex((('0x' || substr(h, 17, 2))::UTINYINT::INT % 64) + 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def name_uuids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.name_uuid(F.col("url")).alias("uuid"))


@query("title_fingerprints", r"""
SELECT k AS title_key, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc FROM (
  SELECT doc_id, lower(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'))) AS k FROM documents) GROUP BY k""")
def title_fingerprints(spark, sf_dir):
    keyed = _docs(spark, sf_dir).select("doc_id", T.term_key(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("title_key"))
    return keyed.groupBy("title_key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


SQL_UNWRAPPED = "trim(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '.,;:!?()[]{{}}<>\"''`')"
SQL_TECHNICAL = r"(length({0}) >= 3 AND (starts_with({0}, '@') OR regexp_matches({0}, '[._/:-]') OR (regexp_matches({0}, '[A-Za-z]') AND regexp_matches({0}, '[0-9]')) OR (regexp_matches({0}, '\p{{Lu}}') AND regexp_matches({0}, '\p{{Ll}}'))))"


@query("technical_token_markers", f"""
WITH t AS (SELECT DISTINCT {SQL_UNWRAPPED.format("w")} AS token FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents))
SELECT token, {SQL_TECHNICAL.format("token")} AS technical FROM t WHERE token <> '' AND regexp_matches(token, '[0-9@_/]')""")
def technical_token_markers(spark, sf_dir):
    split = _docs(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("w"))
    found = split.where(F.col("w").rlike("[0-9@_/]")).select(T.unwrapped(F.col("w")).alias("token")).distinct()
    return found.where((F.col("token") != "") & F.col("token").rlike("[0-9@_/]")).select("token", T.is_technical(F.col("token")).alias("technical"))


@query("language_guess", "SELECT lang, CASE WHEN len(regexp_extract_all(text, '[가-힣]')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'ko' ELSE 'en' END AS script, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def language_guess(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang", T.guess_language(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


def _sql_spaced(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[_-]', ' ', 'g'), '[^0-9a-z@가-힣]+', ' ', 'g'))"


@query("variant_match", f"""
WITH v AS (SELECT * FROM (VALUES ('creative-commons'), ('Apache License'), ('all rights'), ('the'), ('is_tion')) t(variant)),
m AS (SELECT doc_id, variant, {_sql_spaced("text")} AS t, {_sql_spaced("variant")} AS s FROM documents, v)
SELECT variant, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc FROM m
WHERE contains(' ' || t || ' ', ' ' || s || ' ') OR ((contains(s, ' ') OR starts_with(s, '@')) AND contains(replace(t, ' ', ''), replace(s, ' ', ''))) GROUP BY variant""")
def variant_match(spark, sf_dir):
    variants = F.array(*map(F.lit, ("creative-commons", "Apache License", "all rights", "the", "is_tion")))
    found = _docs(spark, sf_dir).select("doc_id", F.explode(T.variants_in_text(F.col("text"), variants)).alias("variant"))
    return found.groupBy("variant").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("answer_overlap_metrics", f"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS ans FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
t AS (SELECT conv_id, turn, list_distinct({SQL_TOKENS.format("q")}) AS q, list_distinct({SQL_TOKENS.format("ans")}) AS a FROM p)
SELECT conv_id, turn, round(coalesce(len(list_intersect(q, a)) / nullif(len(q), 0), 0), 9) AS relevance,
  round(coalesce(len(list_intersect(a, q)) / nullif(len(a), 0), 0), 9) AS grounding,
  round(greatest(0, 1 - coalesce(len(list_intersect(a, q)) / nullif(len(a), 0), 0)), 9) AS hallucination FROM t""")
def answer_overlap_metrics(spark, sf_dir):
    from millrace.operators.evaluate import answer_metrics

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = turns.join(answers, ["conv_id", "turn"])
    scored = answer_metrics(pairs, query="text", answer="answer", context="text", points="answer")
    return scored.select("conv_id", "turn", F.round("answer_relevance", 9).alias("relevance"), F.round("grounding", 9).alias("grounding"), F.round("hallucination_rate", 9).alias("hallucination"))
