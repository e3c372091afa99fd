"""Smaller controls of runs: histories, resume points, failure policies, merges that count repeats, guards, JSON overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evaluate, gate, memory, reports, retrieve, rewrite
from millrace.plans.gate_queries import SQL_DECIDED, _decided, _rules
from millrace.plans.registry import query
from millrace.plans.retrieval_queries import SQL_TWO_LISTS, _two_lists
from millrace.plans.rewrite_queries import ORDER_TEXT, SQL_MULTI, _sql_any
from millrace.sources.tables import table


@query("gating_history", f"""WITH RECURSIVE {SQL_DECIDED}, hg AS (SELECT de.*, reasons FROM de JOIN rr USING (item_id))
SELECT item_id, s.o::INT AS stage_order, s.n AS stage_name, s.p AS passed, round(s.v, 9) AS score, s.r AS reason FROM hg, LATERAL (VALUES (1, 'rule_filter', rule_ok, NULL::DOUBLE, nullif(array_to_string(reasons, ','), '')), (2, 'llm_self_eval', p2, llm_avg, CASE WHEN p2 IS FALSE THEN 'llm_self_eval_failed' END),
  (3, 'retrieval_utility', p3, utility, CASE WHEN p3 IS FALSE THEN 'utility_failed' END), (4, 'diversity_dedup', p4, novelty, CASE WHEN p4 IS FALSE THEN 'diversity_failed' END), (5, 'final_score', p5, final_score, CASE WHEN p5 IS FALSE THEN 'final_score_failed' END), (6, 'approved', accepted, final_score, CASE WHEN NOT accepted THEN rejected_stage END)) s(o, n, p, v, r)""")
def gating_history(spark, sf_dir):
    """Six rows of each query: what each stage said, with its score and reason, and the approval."""
    decided = _decided(spark, sf_dir).join(_rules(spark, sf_dir).select("item_id", "reasons"), "item_id")
    return gate.full_history(decided, "item_id").withColumn("score", F.round("score", 9))


@query("resume_points", """WITH m AS (SELECT o_orderpriority AS batch, o_orderkey AS k, o_orderstatus = 'F' OR o_orderkey < 300 AS done FROM orders), l AS (SELECT batch, max(k) FILTER (WHERE done) AS last_done FROM m GROUP BY batch)
SELECT batch, any_value(last_done) AS last_done, count(*) FILTER (WHERE NOT done AND k < last_done)::BIGINT AS skipped, min(k) FILTER (WHERE NOT done) AS resume_at FROM m JOIN l USING (batch) GROUP BY batch""")
def resume_points(spark, sf_dir):
    """Where the work on each batch of orders goes on, and whether its last finished order is a checkpoint."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    return memory.resume_points(items, items.where("o_orderstatus = 'F' OR k < 300"), "batch", "k")


@query("token_tails", r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT *, len(regexp_extract_all(t, '[A-Za-z0-9_./:@$-]+|[^\p{L}\p{N}_\s]')) AS n, regexp_replace(replace(t, chr(1), ' '), '([A-Za-z0-9_./:@$-]+|[^\p{L}\p{N}_\s])', chr(1) || '\1', 'g') AS m FROM d)
SELECT doc_id, md5(regexp_replace(CASE WHEN n <= 20 THEN t ELSE array_to_string(list_slice(string_split(m, chr(1)), -20, -1), '') END, '^\s+|\s+$', '', 'g')) AS tail FROM c""")
def token_tails(spark, sf_dir):
    """What a chunk hands on to the next as overlap: its last tokens, with the text between them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.token_tail(F.col("text"), 20).cast("binary")).alias("tail"))


@query("rrf_repeats", f"""WITH {SQL_TWO_LISTS}, m AS (SELECT query_id, doc_id // 10 AS doc_id, round(sum(1 / (60 + rank)), 12) AS rrf, max(score) AS best FROM l GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM m)
SELECT query_id, doc_id, rrf, best, rank::INT AS rank FROM z WHERE rank <= 5""")
def rrf_repeats(spark, sf_dir):
    """The other published merge: chunks of one document count each time, and ties go by id alone."""
    lists = _two_lists(spark, sf_dir).withColumn("doc_id", F.expr("doc_id div 10"))
    return retrieve.rrf(lists, 5, count_repeats=True).select("query_id", "doc_id", "rrf", "best", "rank")


@query("router_anchors_first", f"""
WITH q AS (SELECT o_orderkey, {ORDER_TEXT} AS q, o_orderkey % 10 > 0 AS ready FROM orders),
s AS (SELECT *, len(regexp_extract_all(q, '{rewrite.ROUTER_TOKEN}')) AS tokens, least(8, len(list_distinct(list_transform(regexp_extract_all(q, '{rewrite.TECHNICAL_ANCHOR}'), lambda x: lower(x))))) AS n FROM q),
g AS (SELECT *, list_filter([CASE WHEN {_sql_any("q", rewrite.COMPLEX_TERMS)} THEN 'complex_terms' END, CASE WHEN {SQL_MULTI} THEN 'multi_condition' END, CASE WHEN n >= 2 AND {_sql_any("q", rewrite.TROUBLE_TERMS)} THEN 'technical_troubleshooting' END], lambda x: x IS NOT NULL) AS signals FROM s)
SELECT o_orderkey, CASE WHEN NOT ready THEN 'raw_only' WHEN n >= 2 AND tokens >= 3 THEN 'raw_only' WHEN tokens >= 8 AND len(signals) >= 2 THEN 'agentic_multi_query' ELSE 'selective_rewrite' END AS strategy,
  CASE WHEN NOT ready THEN 'rewrite_readiness_failed' WHEN n >= 2 AND tokens >= 3 THEN 'specific_technical_query' WHEN tokens >= 8 AND len(signals) >= 2 THEN 'agentic_complex_query:' || array_to_string(signals, '_and_') ELSE 'rewrite_backed_mode_ready' END AS reason FROM g""")
def router_anchors_first(spark, sf_dir):
    """The other published order, without anchor injection: specific technical queries stay raw before agentic signals count."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ORDER_TEXT).alias("q"), (F.col("o_orderkey") % 10 > 0).alias("ready"))
    return asked.select("o_orderkey", rewrite.route(F.col("q"), agentic=True, rewrite_ready=F.col("ready"), inject=False, agentic_first=False).alias("r")).select("o_orderkey", "r.*")


@query("raw_loss_guard", f"""WITH {SQL_TWO_LISTS}, a AS (SELECT query_id, list(doc_id ORDER BY rank) FILTER (WHERE source = 0 AND rank <= 5) AS raw, list(doc_id ORDER BY rank) FILTER (WHERE source = 1 AND rank <= 5) AS other, list(least(1, score / 40) ORDER BY rank) FILTER (WHERE source = 0) AS s FROM l GROUP BY query_id),
b AS (SELECT query_id, coalesce(raw, []) AS raw, coalesce(other, []) AS other, CASE WHEN len(coalesce(s, [])) = 0 THEN 0 ELSE 0.7 * (s[1] + 1) / 2 + 0.3 * list_avg(list_transform(list_slice(s, 1, 3), lambda x: (x + 1) / 2)) END AS confidence FROM a)
SELECT query_id, round(confidence, 9) AS confidence, list_contains(other, raw[1]) AS first_kept, round(len(list_intersect(raw, other)) / len(raw), 9) AS overlap, confidence >= 0.7 AND NOT list_contains(other, raw[1]) AND len(list_intersect(raw, other)) / len(raw) < 0.4 AS lost FROM b WHERE len(raw) > 0""")
def raw_loss_guard(spark, sf_dir):
    """Whether the technical list would lose what the lexical list is sure of."""
    top = lambda source: F.transform(F.sort_array(F.collect_list(F.when((F.col("source") == source) & (F.col("rank") <= 5), F.struct("rank", "doc_id")))), lambda x: x["doc_id"])
    scores = F.transform(F.sort_array(F.collect_list(F.when(F.col("source") == 0, F.struct("rank", F.least(F.lit(1.0), F.col("score") / 40).alias("s"))))), lambda x: x["s"])
    rows = _two_lists(spark, sf_dir).groupBy("query_id").agg(top(0).alias("raw"), top(1).alias("other"), scores.alias("s")).where(F.size("raw") > 0).withColumn("confidence", evaluate.confidence(F.col("s")))
    overlap = F.size(F.array_intersect("raw", "other")) / F.size("raw")
    lost = retrieve.raw_loss_guard(F.col("raw"), F.col("other"), F.col("confidence"), 0.7, 0.4)
    return rows.select("query_id", F.round("confidence", 9).alias("confidence"), F.array_contains("other", F.get("raw", F.lit(0))).alias("first_kept"), F.round(overlap, 9).alias("overlap"), lost.alias("lost"))


SQL_POLICY = """WITH c AS (SELECT c_custkey AS query_id, CASE WHEN c_acctbal > 0 THEN [lower(c_mktsegment) || ' market'] END AS made, [lower(c_mktsegment), c_name] AS heuristic FROM customer)"""


@query("rewrite_failures", f"""{SQL_POLICY} SELECT query_id, 'heuristic_fallback' AS policy, array_to_string(coalesce(made, heuristic), '|') AS candidates, CASE WHEN made IS NULL THEN 'heuristic' ELSE 'model' END AS origin FROM c
UNION ALL SELECT query_id, 'skip_to_raw', array_to_string(coalesce(made, []), '|'), CASE WHEN made IS NULL THEN 'raw' ELSE 'model' END FROM c""")
def rewrite_failures(spark, sf_dir):
    """What is judged where the model gave no candidates, under two policies; the third ends the run."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_acctbal") > 0, F.array(F.concat(F.lower("c_mktsegment"), F.lit(" market")))).alias("made"), F.array(F.lower("c_mktsegment"), F.col("c_name")).alias("heuristic"))
    under = lambda policy: rewrite.with_failure_policy(rows, policy).select("query_id", F.lit(policy).alias("policy"), F.array_join("candidates", "|").alias("candidates"), "origin")
    return under("heuristic_fallback").unionByName(under("skip_to_raw"))


@query("eligible_memories", """SELECT doc_id AS memory_id FROM documents WHERE (doc_id % 3 = 0) AND (doc_id % 5 = 1) AND source IN ('src0', 'src1', 'src2')""")
def eligible_memories(spark, sf_dir):
    """Memories of one preset, one gating run and some strategies."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), F.concat(F.lit("p"), F.col("doc_id") % 3).alias("preset"), F.concat(F.lit("run"), F.col("doc_id") % 5).alias("run"), F.col("source").alias("strategy"))
    return memory.eligible(held, "p0", "run1", ("src0", "src1", "src2")).select("memory_id")


@query("overlaid_json", """SELECT event_id, '{"a":{"k":' || (event_id % 7) || ',"t":["' || event_type || '",null]},"b":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '{"old":1}' END || ',"c":null' || CASE WHEN event_id % 3 = 0 THEN ',"d":' || user_id ELSE '' END || '}' AS merged FROM events""")
def overlaid_json(spark, sf_dir):
    """Objects with nested values laid over each other."""
    e = F.col("event_id")
    nested = F.to_json(F.struct((e % 7).alias("k"), F.array(F.col("event_type"), F.lit(None).cast("string")).alias("t")))
    old = F.concat(F.lit('{"b":{"old":1},"a":'), nested, F.lit(',"c":{"gone":[1,2]}}'))
    new = F.concat(F.lit('{"c":null'), F.when(e % 2 == 0, ',"b":true').otherwise(""), F.when(e % 3 == 0, F.concat(F.lit(',"d":'), F.col("user_id").cast("string"))).otherwise(""), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", reports.overlaid_json(old, new).alias("merged"))
