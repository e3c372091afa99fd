"""Routing, rewriting, memory and anchor queries, with their DuckDB statements.

Texts and flags of queries, candidates and memories are made from columns of the test tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import inverted, rewrite
from millrace.operators import relational as R
from millrace.plans.registry import query
from millrace.plans.relational_queries import SQL_COOC, _cooccurrence
from millrace.plans.retrieval_queries import SQL_BM25, SQL_TWO_LISTS, _two_lists
from millrace.plans.text_queries import SQL_SENTENCES, SQL_TECHNICAL, SQL_TOKENS
from millrace.sources.tables import table

ORDER_TEXT = """CASE o_orderstatus WHEN 'F' THEN 'compare JdbcTemplate and R2dbcClient configuration, error when deploying order ' || o_orderkey WHEN 'O' THEN 'open status of ' || lower(o_orderpriority)
  ELSE 'how do I set spring.datasource.url for ' || o_custkey || ' please' END"""


def _sql_any(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


SQL_MULTI = " OR ".join(f"regexp_matches(q, '{p}')" for p in rewrite.MULTI_CONDITION)


@query("router_strategy", f"""
WITH q AS (SELECT o_orderkey, {ORDER_TEXT} AS q FROM orders),
s AS (SELECT *, len(regexp_extract_all(q, '{rewrite.ROUTER_TOKEN}')) AS tokens, least(8, len(list_distinct(list_transform(regexp_extract_all(q, '{rewrite.TECHNICAL_ANCHOR}'), lambda x: lower(x))))) AS n FROM q),
g AS (SELECT *, list_filter([CASE WHEN {_sql_any("q", rewrite.COMPLEX_TERMS)} THEN 'complex_terms' END, CASE WHEN {SQL_MULTI} THEN 'multi_condition' END,
  CASE WHEN n >= 2 AND {_sql_any("q", rewrite.TROUBLE_TERMS)} THEN 'technical_troubleshooting' END], lambda x: x IS NOT NULL) AS signals FROM s)
SELECT o_orderkey, CASE WHEN tokens >= 8 AND len(signals) >= 2 THEN 'agentic_multi_query' WHEN n > 0 THEN 'anchor_aware_rewrite' ELSE 'selective_rewrite' END AS strategy,
  CASE WHEN tokens >= 8 AND len(signals) >= 2 THEN 'agentic_complex_query:' || array_to_string(signals, '_and_') WHEN n > 0 THEN 'anchor_injection_enabled_and_technical_anchor_detected' ELSE 'rewrite_backed_mode_ready' END AS reason FROM g""")
def router_strategy(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ORDER_TEXT).alias("q"))
    return asked.select("o_orderkey", rewrite.route(F.col("q"), agentic=True).alias("r")).select("o_orderkey", "r.*")


@query("memory_rerank", f"""
WITH {SQL_TWO_LISTS},
raw AS (SELECT query_id, list(doc_id) AS chunks, list(doc_id % 50) AS docs FROM l WHERE source = 1 GROUP BY query_id),
m AS (SELECT l.query_id, l.doc_id AS memory_id, l.rank AS before, least(1, score / 50) AS similarity, coalesce(chunks, []) AS chunks, coalesce(docs, []) AS docs, list_distinct({SQL_TOKENS.format("b.text")}) AS qt, {SQL_TOKENS.format("d.text")} AS dt
  FROM l JOIN benchmark b ON b.item_id = l.query_id JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN raw ON raw.query_id = l.query_id WHERE l.source = 0),
f AS (SELECT *, list_contains(chunks, memory_id)::INT AS chunk_overlap, list_contains(docs, memory_id % 50)::INT AS doc_overlap, coalesce(len(list_intersect(qt, dt)) / nullif(len(qt), 0), 0) AS anchor_overlap FROM m),
z AS (SELECT *, round_even(greatest(0, least(1, 0.34 * greatest(0, least(1, (similarity + 1) / 2)) + 0.2 * chunk_overlap + 0.12 * doc_overlap + 0.18 * anchor_overlap + 0.1 * (1.0 / before) + 0.06 * (memory_id % 2))), 6) AS rerank_score FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_overlap DESC, doc_overlap DESC, before, memory_id) AS after FROM z)
SELECT query_id, memory_id, rerank_score, after::INT AS after FROM k WHERE after <= 5""")
def memory_rerank(spark, sf_dir):
    from millrace.functions import text as T

    lists = _two_lists(spark, sf_dir)
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    raw = lists.where("source = 1").groupBy("query_id").agg(F.collect_list("doc_id").alias("raw_chunks"), F.collect_list(F.col("doc_id") % 50).alias("raw_docs"))
    none = F.array().cast("array<bigint>")
    rows = lists.where("source = 0").join(docs.select("doc_id", F.col("text").alias("dt")), "doc_id").join(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("qt")), "query_id").join(raw, "query_id", "left")
    rows = rows.select(
        "query_id", F.col("doc_id").alias("memory_id"), F.col("rank").alias("before"), F.least(F.lit(1.0), F.col("score") / 50).alias("similarity"), F.array("doc_id").alias("target_chunks"), (F.col("doc_id") % 50).alias("target_doc"),
        F.coalesce("raw_chunks", none).alias("raw_chunks"), F.coalesce("raw_docs", none).alias("raw_docs"), T.tokens(F.col("qt")).alias("raw_tokens"), T.tokens(F.col("dt")).alias("memory_tokens"),
        (1 / F.col("rank")).alias("utility"), (F.col("doc_id") % 2).alias("product"))
    return rewrite.memory_features(rows).select("query_id", "memory_id", "rerank_score", "after")


@query("memory_guided_query", f"""
WITH m AS (SELECT page_id // 5 AS query_id, 'index ' || (page_id // 5) AS query_text, page_id % 5 + 1 AS rank, url AS memory_text FROM pages),
t AS (SELECT query_id, rank, {SQL_TOKENS.format("query_text")} AS own, unnest(list_distinct({SQL_TOKENS.format("memory_text")})) AS token FROM m),
w AS (SELECT query_id, token, round(sum(1 / rank), 9) AS w FROM t WHERE {SQL_TECHNICAL.format("token")} AND NOT list_contains(own, token) AND length(token) <= 40 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, length(token), token) AS k FROM w),
p AS (SELECT query_id, string_agg(token, ' ' ORDER BY k) AS hints FROM k WHERE k <= 3 GROUP BY query_id)
SELECT q.query_id, q.query_text || coalesce(' ' || hints, '') AS guided FROM (SELECT DISTINCT query_id, query_text FROM m) q LEFT JOIN p USING (query_id)""")
def memory_guided_query(spark, sf_dir):
    number = F.floor(F.col("page_id") / 5)
    rows = table(spark, sf_dir, "pages").select(number.alias("query_id"), F.concat(F.lit("index "), number.cast("string")).alias("query_text"), (F.col("page_id") % 5 + 1).alias("rank"), F.col("url").alias("memory_text"))
    return rewrite.guided_query(rows)


CANDIDATES = """o_custkey AS query_id, o_orderkey AS seq, lower(o_orderpriority) || ' status' AS raw,
  CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderpriority) || ' status' WHEN 1 THEN lower(o_orderpriority) || ' order status' WHEN 2 THEN 'status' ELSE lower(o_orderpriority) || ' status of the order in the warehouse of ' || o_custkey END AS candidate"""


@query("candidate_ladder", f"""
WITH c AS (SELECT {CANDIDATES}, (o_orderkey % 10) / 10.0 AS gain, (o_orderkey % 7) / 7.0 AS alignment, o_orderkey % 11 = 0 AS risky, o_orderkey % 13 = 0 AS missing, o_orderkey % 5 = 0 AS guard FROM orders),
t AS (SELECT *, list_filter(list_distinct({SQL_TOKENS.format("raw")}), lambda x: {SQL_TECHNICAL.format("x")}) AS own, {SQL_TOKENS.format("candidate")} AS kept, greatest(1, length(regexp_replace(candidate, '\\s', '', 'g'))) / greatest(1, length(regexp_replace(raw, '\\s', '', 'g'))) AS ratio FROM c),
p AS (SELECT *, coalesce(len(list_intersect(own, kept)) / nullif(len(own), 0), 1) AS tech FROM t),
s AS (SELECT *, round(greatest(0, least(1, greatest(0, least(1, 0.6 * gain + 0.28 * tech + 0.12 * alignment)) - greatest(0, ratio - 1) * 0.08 - (1 - tech) * 0.22 - (1 - tech) * 0.12)), 9) AS final_score FROM p),
j AS (SELECT *, CASE WHEN raw = candidate THEN 'candidate_same_as_raw' WHEN risky THEN 'intent_risk_high' WHEN ratio > 1.85 THEN 'verbosity_exceeds_limit' WHEN tech < 0.72 THEN 'preservation_below_floor' WHEN missing THEN 'missing_memory_target'
  WHEN guard THEN 'raw_loss_guard_top1_lost' WHEN round(final_score - 0.5, 9) < 0.03 THEN 'delta_below_threshold' ELSE '' END AS rejection FROM s)
SELECT query_id, arg_max(seq, k) AS seq, arg_max(candidate, k) AS candidate, arg_max(final_score, k) AS final_score, arg_max(rejection, k) AS rejection, arg_max(rejection, k) = '' AS applied
FROM (SELECT *, ((rejection = '')::INT, final_score, -seq) AS k FROM j) GROUP BY query_id""")
def candidate_ladder(spark, sf_dir):
    key = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in CANDIDATES.split(",\n")[0].split(", ")[:2]], "o_orderkey", "lower(o_orderpriority) || ' status' AS raw", CANDIDATES.split(",\n")[1].strip())
    rows = rows.select(
        "query_id", "seq", "raw", "candidate", ((key % 10) / 10.0).alias("gain"), ((key % 7) / 7.0).alias("alignment"), F.lit(0.5).alias("raw_reference"), none.alias("anchors"), none.alias("preserved"), none.alias("added"),
        F.when(key % 11 == 0, "high").otherwise("low").alias("intent_risk"), F.lit(True).alias("memory_index_valid"), (key % 13 == 0).alias("missing_target"), (key % 5 == 0).alias("guard"))
    return rewrite.pick(rewrite.judge_candidates(rows))


@query("simple_decision", """
WITH e AS (SELECT user_id AS query_id, event_id AS seq, event_type AS candidate, least(1, value / 50) AS top1, least(1, value / 80) AS top3, (event_id % 10) / 10.0 AS memory, 0.4 AS raw_confidence FROM events),
c AS (SELECT *, round(0.6 * top1 + 0.3 * top3 + 0.1 * memory, 12) AS confidence FROM e)
SELECT query_id, arg_max(candidate, (confidence, -seq)) AS candidate, round(max(confidence), 9) AS confidence, max(confidence) - 0.4 >= 0.05 AS adopted FROM c GROUP BY query_id""")
def simple_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("candidate"), F.least(F.lit(1.0), F.col("value") / 50).alias("top1"), F.least(F.lit(1.0), F.col("value") / 80).alias("top3"),
        ((F.col("event_id") % 10) / 10.0).alias("memory"), F.lit(0.4).alias("raw_confidence"))
    return rewrite.simple_decision(rows).withColumn("confidence", F.round("confidence", 9))


@query("agentic_subqueries", """
WITH i AS (SELECT c_custkey AS query_id, c_name AS query, unnest([c_mktsegment, lower(c_mktsegment), '', CASE WHEN c_acctbal > 0 THEN 'rich' ELSE ' ' END]) AS text, unnest([c_acctbal / 5000, 0.5, 1, 0.25]) AS weight, unnest([0, 1, 2, 3]) AS pos FROM customer WHERE c_acctbal > -500
  UNION ALL SELECT c_custkey, c_name, '', 1, 0 FROM customer WHERE c_acctbal <= -500),
f AS (SELECT query_id, trim(text) AS text, greatest(0, least(1, weight)) AS weight, pos FROM i WHERE trim(text) <> ''),
u AS (SELECT query_id, arg_min(text, pos) AS text, arg_min(weight, pos) AS weight, min(pos) AS pos FROM f GROUP BY query_id, lower(text)),
k AS (SELECT query_id, text, weight, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM u)
SELECT query_id, text, round(weight, 9) AS weight, place::INT AS place FROM k WHERE place <= 3 UNION ALL SELECT c_custkey, c_name, 1, 1 FROM customer WHERE c_custkey NOT IN (SELECT query_id FROM u)""")
def agentic_subqueries(spark, sf_dir):
    item = lambda t, w: F.struct(t.alias("text"), w.cast("double").alias("weight"))
    segment = F.col("c_mktsegment")
    full = F.array(item(segment, F.col("c_acctbal") / 5000), item(F.lower(segment), F.lit(0.5)), item(F.lit(""), F.lit(1)), item(F.when(F.col("c_acctbal") > 0, "rich").otherwise(" "), F.lit(0.25)))
    plans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"), F.when(F.col("c_acctbal") > -500, full).otherwise(F.array(item(F.lit(""), F.lit(1)))).alias("items"))
    return rewrite.subqueries(plans).withColumn("weight", F.round("weight", 9))


@query("anchor_resolution", """
WITH a AS (SELECT p_partkey AS alias_id, p_name AS normal FROM part), m AS (SELECT p_name AS normal, count(DISTINCT p_brand) AS n, min(p_brand) AS id FROM part WHERE p_size > 48 GROUP BY 1), o AS (SELECT p_name AS normal, count(DISTINCT p_type) AS n, min(p_type) AS id FROM part WHERE p_retailprice > 1900 GROUP BY 1)
SELECT alias_id, a.normal, CASE WHEN m.n = 1 THEN 'mapped' WHEN m.n > 1 THEN 'ambiguous' WHEN o.n = 1 THEN 'self_fallback' WHEN o.n > 1 THEN 'ambiguous_self_fallback' ELSE 'miss' END AS status,
  CASE WHEN m.n = 1 THEN m.id WHEN m.n IS NULL AND o.n = 1 THEN o.id END AS term_id, (coalesce(m.n = 1, FALSE) OR (m.n IS NULL AND coalesce(o.n = 1, FALSE))) AS used_for_scoring FROM a LEFT JOIN m USING (normal) LEFT JOIN o USING (normal)""")
def anchor_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    aliases = part.select(F.col("p_partkey").alias("alias_id"), F.col("p_name").alias("normal"))
    approved = part.where("p_size > 48").select(F.col("p_name").alias("normal"), F.col("p_brand").alias("term_id"))
    own = part.where("p_retailprice > 1900").select(F.col("p_name").alias("normal"), F.col("p_type").alias("term_id"))
    return rewrite.resolve_anchors(aliases, approved, own)


@query("anchor_expansion", f"""
WITH {SQL_COOC}, r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, shared DESC, related) AS rank FROM s), rel AS (SELECT seed, related, score FROM r WHERE rank <= 5),
sd AS (SELECT l_orderkey AS query_id, l_suppkey AS seed, max(l_quantity) AS priority FROM lineitem GROUP BY ALL),
j AS (SELECT sd.query_id, sd.seed, sd.priority, rel.related, rel.score FROM sd JOIN rel USING (seed) WHERE NOT EXISTS (SELECT 1 FROM sd x WHERE x.query_id = sd.query_id AND x.seed = rel.related)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, seed ORDER BY score DESC, related) AS k FROM j),
o AS (SELECT query_id, related, arg_max(seed, (priority, score, seed)) AS seed, arg_max(score, (priority, score, seed)) AS score, arg_max(priority, (priority, score, seed)) AS priority FROM k WHERE k <= 2 GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, score DESC, related) AS place FROM o) SELECT query_id, related, seed, score, place::INT AS place FROM z WHERE place <= 8""")
def anchor_expansion(spark, sf_dir):
    relations = R.top_n(_cooccurrence(spark, sf_dir), ["seed"], [F.desc("score"), F.desc("shared"), F.col("related")], 5).select("seed", "related", "score")
    seeds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("seed")).agg(F.max("l_quantity").alias("priority"))
    return rewrite.expand_anchors(seeds, relations)


FLAGS = {"raw": "l_quantity > 25", "final": "l_discount < 0.07", "chunk": "l_returnflag = 'R'", "doc": "l_linestatus = 'F'", "retrieved": "l_tax > 0.05", "memory": "l_quantity < 5", "glossary": "l_tax < 0.02", "added": "l_quantity < 15"}


@query("anchor_grounding", f"""
WITH f AS (SELECT l_orderkey, l_linenumber, {", ".join(f"({sql}) AS {name}_" for name, sql in FLAGS.items())} FROM lineitem),
s AS (SELECT *, CASE WHEN chunk_ THEN 1.0 WHEN doc_ THEN 0.75 WHEN retrieved_ THEN 0.55 WHEN memory_ THEN 0.35 WHEN glossary_ THEN 0.25 ELSE 0 END AS g,
  CASE WHEN raw_ AND final_ THEN 1.0 WHEN final_ AND (chunk_ OR doc_) THEN 0.85 WHEN chunk_ OR doc_ THEN 0.7 WHEN final_ AND retrieved_ THEN 0.55 WHEN final_ AND (memory_ OR glossary_) THEN 0.45 WHEN final_ THEN 0.25 ELSE 0 END AS i,
  CASE WHEN (raw_ AND final_) OR chunk_ THEN 0.0 WHEN doc_ THEN 0.15 WHEN retrieved_ OR memory_ OR glossary_ THEN 0.3 WHEN added_ AND final_ THEN 0.85 WHEN final_ THEN 0.6 ELSE 0.4 END AS d, chunk_ OR doc_ OR retrieved_ OR memory_ OR glossary_ AS ok FROM f),
o AS (SELECT *, greatest(0, least(1, 0.55 * g + 0.35 * i - 0.25 * d + CASE WHEN raw_ AND final_ THEN 0.1 ELSE 0 END)) AS overall FROM s)
SELECT label, count(*)::BIGINT AS n, round(avg(overall), 6) AS overall FROM (SELECT overall, CASE WHEN final_ AND added_ AND NOT ok THEN 'risky' WHEN final_ AND NOT ok THEN 'unsupported' WHEN chunk_ OR overall >= 0.7 OR (raw_ AND final_ AND ok) THEN 'useful'
  WHEN doc_ OR retrieved_ OR memory_ OR glossary_ OR overall >= 0.4 THEN 'neutral' ELSE 'unknown' END AS label FROM o) GROUP BY label""")
def anchor_grounding(spark, sf_dir):
    flags = [F.expr(sql) for sql in FLAGS.values()]
    judged = table(spark, sf_dir, "lineitem").select(rewrite.grounding(*flags).alias("g")).select("g.*")
    return judged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 6).alias("overall"))


SQL_SUB = f"""p AS (SELECT item_id AS query_id, {SQL_SENTENCES.format("text")} AS s FROM benchmark), sub AS (SELECT query_id * 100 + i AS item_id, s[i] AS text FROM p, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i))"""


@query("agentic_rrf", f"""WITH {SQL_SUB}, {SQL_BM25.replace("FROM benchmark", "FROM sub")}, m AS (SELECT query_id // 100 AS query_id, doc_id, round(sum(1 / (60 + rank)), 12) AS rrf, max(bm25) AS best FROM r WHERE rank <= 10 GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, doc_id) AS rank FROM m) SELECT query_id, doc_id, rrf, best, rank::INT AS rank FROM z WHERE rank <= 10""")
def agentic_rrf(spark, sf_dir):
    """The sentences of a passage stand for the subqueries of a plan."""
    parts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(T.sentences(F.col("text"))).alias("seq", "text"))
    return rewrite.subquery_search(inverted.packs_of(spark, sf_dir), parts)
