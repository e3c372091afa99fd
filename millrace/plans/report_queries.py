"""Experiment scans, summaries and roll-ups over the relational tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import reports as R
from millrace.plans.registry import query
from millrace.sources.tables import table

SQL_RAW = """raw AS (SELECT o_orderkey AS id, substr('ABCDEFG', (o_orderkey % 7 + 1)::INT, 1) AS generation_strategy, CASE WHEN o_custkey % 3 = 0 THEN 'b' || o_custkey % 5 END AS generation_batch_id, 'r' || o_orderkey % 4 AS experiment_run_id,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'fr' END AS query_language, CASE WHEN o_orderkey % 5 = 0 THEN 'own' ELSE '' END AS language_profile, CASE WHEN o_orderstatus = 'F' THEN 'code_mixed' ELSE 'definition' END AS query_type FROM orders)"""
SQL_RAW_OUT = """SELECT {0} AS scan, id, generation_strategy, coalesce(nullif(query_language, ''), CASE WHEN generation_strategy IN ('E', 'F') THEN 'en' ELSE 'ko' END) AS query_language,
  coalesce(nullif(language_profile, ''), CASE WHEN generation_strategy IN ('E', 'F') THEN 'en' WHEN query_type = 'code_mixed' THEN 'code_mixed' ELSE 'ko' END) AS language_profile FROM raw WHERE {1}"""


@query("raw_query_scan", f"""WITH {SQL_RAW} {SQL_RAW_OUT.format("'batch'", "generation_strategy IN ('A', 'E') AND generation_batch_id IN ('b1', 'b3')")} UNION ALL {SQL_RAW_OUT.format("'run'", "generation_strategy = 'F' AND experiment_run_id = 'r2'")}""")
def raw_query_scan(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.substring(F.lit("ABCDEFG"), (key % 7 + 1).cast("int"), F.lit(1)).alias("generation_strategy"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string"))).alias("generation_batch_id"),
        F.concat(F.lit("r"), (key % 4).cast("string")).alias("experiment_run_id"), F.when(key % 3 == 0, "").when(key % 3 == 1, "fr").alias("query_language"), F.when(key % 5 == 0, "own").otherwise("").alias("language_profile"),
        F.when(F.col("o_orderstatus") == "F", "code_mixed").otherwise("definition").alias("query_type"))
    out = lambda name, rows: rows.select(F.lit(name).alias("scan"), "id", "generation_strategy", "query_language", "language_profile")
    return out("batch", R.raw_queries(raw, ["A", "E"], ["b1", " b3 "], ["r0"])).union(out("run", R.raw_queries(raw, ["F"], [" "], ["r2"])))


@query("eval_sample_scan", """SELECT s.l_orderkey AS sample_id, coalesce(nullif(CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'en' END, ''), CASE WHEN o_orderstatus = 'F' THEN 'en' END, 'ko') AS query_language
  FROM lineitem s JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 3 AND o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0)""")
def eval_sample_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    samples = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "en").alias("query_language"), "o_orderstatus")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 2 == 0).alias("active"))
    return R.eval_samples(samples, items, F.when(F.col("o_orderstatus") == "F", "en")).select("sample_id", "query_language")


@query("array_overlap_filter", "SELECT o_custkey, n FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p, count(*)::BIGINT AS n FROM orders GROUP BY 1) WHERE list_has_any(p, ['1-URGENT', '5-LOW'])")
def array_overlap_filter(spark, sf_dir):
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("n"))
    return R.overlapping(held, "p", ["1-URGENT", "5-LOW"]).select("o_custkey", "n")


@query("json_array_overlap", "SELECT user_id, n FROM (SELECT user_id, list(DISTINCT event_type) AS t, count(*)::BIGINT AS n FROM events GROUP BY 1) WHERE list_has_any(t, ['error', 'signup'])")
def json_array_overlap(spark, sf_dir):
    held = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_set("event_type")).alias("t"), F.count(F.lit(1)).alias("n"))
    return R.json_overlapping(held, "t", ["error", "signup"]).select("user_id", "n")


@query("document_search", """SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%0007%' OR c_mktsegment ILIKE '%0007%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderpriority ILIKE '%urgent%0007%' OR o_orderkey::VARCHAR ILIKE '%0007%'))
  OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_custkey AND n_name ILIKE '%0007%')""")
def document_search(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").cast("string").alias("key"))
    nation = table(spark, sf_dir, "nation")
    return R.searched(table(spark, sf_dir, "customer"), "0007", ["c_name", "c_mktsegment"], "c_custkey", (orders, "o_custkey", ["o_orderpriority", "key"]), (nation, "n_nationkey", ["n_name"])).select("c_custkey", "c_name")


@query("owned_embeddings", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'memory' ELSE 'chunk' END AS owner_type, (vec_id % 150 + 1)::VARCHAR AS owner_id FROM embeddings)
  SELECT vec_id, c_custkey, c_name FROM e JOIN customer ON owner_type = 'memory' AND owner_id = c_custkey::VARCHAR""")
def owned_embeddings(spark, sf_dir):
    vec = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(vec % 2 == 0, "memory").otherwise("chunk").alias("owner_type"), (vec % 150 + 1).cast("string").alias("owner_id"))
    return R.owned(e, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "memory", "c_custkey").select("vec_id", "c_custkey", "c_name")


@query("unreferenced_rows", """SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)
  AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey AND c_mktsegment = 'BUILDING') AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM pages WHERE page_id = p_partkey)""")
def unreferenced_rows(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    held = [(t("lineitem").where("l_quantity > 45"), "l_partkey"), (t("orders"), "o_orderkey"), (t("supplier"), "s_suppkey"), (t("customer").where("c_mktsegment = 'BUILDING'"), "c_custkey"), (t("nation"), "n_nationkey"), (t("region"), "r_regionkey"), (t("pages"), "page_id")]
    return R.unreferenced(t("part").select("p_partkey"), "p_partkey", *held)


@query("compatibility_view", "SELECT s_suppkey, s_name, NULL::VARCHAR AS s_domain, s_nationkey::VARCHAR AS s_nationkey, NULL::DOUBLE AS s_score FROM supplier")
def compatibility_view(spark, sf_dir):
    return R.compatible(table(spark, sf_dir, "supplier"), {"s_suppkey": "bigint", "s_name": "string", "s_domain": "string", "s_nationkey": "string", "s_score": "double"})


SQL_ANCHORS = """a AS (SELECT l_suppkey AS run_id, l_orderkey AS detail_id, CASE l_linenumber % 4 WHEN 0 THEN 'useful' WHEN 1 THEN 'risky' WHEN 2 THEN 'unsupported' END AS label, CASE WHEN l_returnflag = 'N' THEN 'added_by_rewrite' ELSE 'raw' END AS anchor_source,
  CASE WHEN l_tax > 0.04 THEN l_quantity > 30 END AS by_chunk, l_discount > 0.08 AS by_doc, l_discount AS score FROM lineitem WHERE l_suppkey % 9 <> 0)"""


@query("anchor_run_summary", f"""WITH {SQL_ANCHORS}, g AS (SELECT *, coalesce(by_chunk, FALSE) OR coalesce(by_doc, FALSE) AS gr FROM a),
s AS (SELECT run_id, count(*) AS total_anchor_count, count(DISTINCT detail_id) AS anchor_evaluated_sample_count, count(*) FILTER (WHERE label = 'useful') AS useful_anchor_count, count(*) FILTER (WHERE label = 'risky') AS risky_anchor_count,
  count(*) FILTER (WHERE label = 'unsupported') AS unsupported_anchor_count, count(*) FILTER (WHERE gr) AS grounded_anchor_count, count(*) FILTER (WHERE anchor_source = 'added_by_rewrite') AS added_anchor_count, count(*) FILTER (WHERE anchor_source = 'added_by_rewrite' AND gr) AS added_anchor_grounded_count,
  count(DISTINCT detail_id) FILTER (WHERE label = 'useful' OR gr) AS supported_rewrite_sample_count, avg(score) AS score FROM g GROUP BY run_id),
d AS (SELECT l_suppkey AS run_id, count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber <= 2) AS rewrite_applied_sample_count FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1)
SELECT s_suppkey AS run_id, coalesce(total_anchor_count, 0)::BIGINT AS total_anchor_count, coalesce(anchor_evaluated_sample_count, 0)::BIGINT AS anchor_evaluated_sample_count, coalesce(useful_anchor_count, 0)::BIGINT AS useful_anchor_count, coalesce(risky_anchor_count, 0)::BIGINT AS risky_anchor_count,
  coalesce(unsupported_anchor_count, 0)::BIGINT AS unsupported_anchor_count, coalesce(grounded_anchor_count, 0)::BIGINT AS grounded_anchor_count, coalesce(added_anchor_count, 0)::BIGINT AS added_anchor_count, coalesce(added_anchor_grounded_count, 0)::BIGINT AS added_anchor_grounded_count,
  coalesce(supported_rewrite_sample_count, 0)::BIGINT AS supported_rewrite_sample_count, coalesce(rewrite_applied_sample_count, 0)::BIGINT AS rewrite_applied_sample_count, round(score, 9) AS avg_anchor_relevance_score,
  round(useful_anchor_count / nullif(total_anchor_count, 0), 9) AS anchor_precision, round(grounded_anchor_count / nullif(total_anchor_count, 0), 9) AS grounded_rate, round(risky_anchor_count / nullif(total_anchor_count, 0), 9) AS risky_rate,
  round(added_anchor_grounded_count / nullif(added_anchor_count, 0), 9) AS added_grounded_rate, round(coalesce(supported_rewrite_sample_count, 0) / nullif(coalesce(rewrite_applied_sample_count, 0), 0), 9) AS supported_rate FROM supplier LEFT JOIN s ON s.run_id = s_suppkey LEFT JOIN d ON d.run_id = s_suppkey""")
def anchor_run_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    run, n = F.col("l_suppkey").alias("run_id"), F.col("l_linenumber") % 4
    anchors = lines.where("l_suppkey % 9 <> 0").select(
        run, F.col("l_orderkey").alias("detail_id"), F.when(n == 0, "useful").when(n == 1, "risky").when(n == 2, "unsupported").alias("label"), F.when(F.col("l_returnflag") == "N", "added_by_rewrite").otherwise("raw").alias("anchor_source"),
        F.when(F.col("l_tax") > 0.04, F.col("l_quantity") > 30).alias("by_chunk"), (F.col("l_discount") > 0.08).alias("by_doc"), F.col("l_discount").alias("score"))
    details = lines.where("l_suppkey % 4 <> 0").select(run, F.col("l_orderkey").alias("detail_id"), (F.col("l_linenumber") <= 2).alias("rewrite_applied"))
    out = R.anchor_run_summary(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id")), details, anchors)
    return out.select(*(F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query("label_summary", """WITH c AS (SELECT l_suppkey AS run_id, l_orderkey AS sample_id, l_orderkey * 10 + l_linenumber AS candidate_id FROM lineitem),
l AS (SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS candidate_id, CASE l_linenumber WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid' ELSE 'partial' END AS label_value FROM lineitem WHERE l_quantity > 40)
SELECT run_id, count(DISTINCT sample_id)::BIGINT AS sample_count, count(*)::BIGINT AS candidate_count, count(label_value)::BIGINT AS labeled_count, count(*) FILTER (WHERE label_value = 'valid')::BIGINT AS valid_count, count(*) FILTER (WHERE label_value = 'invalid')::BIGINT AS invalid_count,
  count(*) FILTER (WHERE label_value = 'partial')::BIGINT AS partial_count, round(coalesce(count(*) FILTER (WHERE label_value = 'valid') / nullif(count(label_value), 0), 0), 9) AS precision, round(coalesce(count(*) FILTER (WHERE label_value = 'invalid') / nullif(count(label_value), 0), 0), 9) AS noise_ratio
FROM c LEFT JOIN l USING (run_id, candidate_id) GROUP BY run_id""")
def label_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id")
    candidates = lines.select(F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("sample_id"), key)
    value = F.when(F.col("l_linenumber") == 1, "valid").when(F.col("l_linenumber") == 2, "invalid").otherwise("partial")
    labels = lines.where("l_quantity > 40").select(F.col("l_suppkey").alias("run_id"), key, value.alias("label_value"))
    out = R.label_summary(candidates, labels, ["run_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "noise_ratio")})


SQL_MODES = f"""v AS (SELECT {list(R.MODES)!r} AS m), rows AS (SELECT m[(l_orderkey % 11 + 1)::INT] AS mode, CASE WHEN l_linenumber < 6 THEN l_linenumber % 3 = 0 END AS rewrite_applied, l_discount AS mrr, l_tax AS ndcg, l_discount * 2 AS recall, l_quantity / 50 AS hit, 0.05 AS raw_mrr,
  CASE WHEN l_linenumber > 1 THEN l_quantity END AS elapsed_ms, l_tax - l_discount AS confidence_delta, l_quantity > 45 AS degraded FROM lineitem, v)"""


@query("mode_report", f"""WITH {SQL_MODES}, b AS (SELECT avg(mrr) AS bm, avg(ndcg) AS bn FROM rows WHERE mode = 'raw_only')
SELECT mode, count(*)::BIGINT AS n, round(avg(recall), 9) AS recall, round(avg(hit), 9) AS hit, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg, round(avg(coalesce(elapsed_ms, 0)), 9) AS avg_latency_ms, round(avg(coalesce(confidence_delta, 0)), 9) AS avg_confidence_delta,
  count(*) FILTER (WHERE degraded)::BIGINT AS degraded_query_count, round(avg(CASE WHEN rewrite_applied THEN 1.0 ELSE 0.0 END), 9) AS adoption_rate, round(coalesce(count(*) FILTER (WHERE rewrite_applied AND mrr < raw_mrr) / nullif(count(*) FILTER (WHERE rewrite_applied), 0), 0), 9) AS bad_rewrite_rate,
  round(CASE WHEN mode IN {R.REJECTING!r} THEN avg(CASE WHEN rewrite_applied THEN 0.0 ELSE 1.0 END) ELSE 0 END, 9) AS rewrite_rejection_rate, CASE WHEN mode = 'raw_only' THEN 0.0 ELSE round(avg(mrr) - any_value(bm), 9) END AS rewrite_gain_mrr, CASE WHEN mode = 'raw_only' THEN 0.0 ELSE round(avg(ndcg) - any_value(bn), 9) END AS rewrite_gain_ndcg FROM rows, b GROUP BY mode""")
def mode_report(spark, sf_dir):
    """All evaluation modes in one pass: a column names the mode, so that no mode has a plan of its own."""
    modes = F.array(*map(F.lit, R.MODES))
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.get(modes, (F.col("l_orderkey") % 11).cast("int")).alias("mode"), F.when(n < 6, n % 3 == 0).alias("rewrite_applied"), F.col("l_discount").alias("mrr"), F.col("l_tax").alias("ndcg"), (F.col("l_discount") * 2).alias("recall"), (F.col("l_quantity") / 50).alias("hit"),
        F.lit(0.05).alias("raw_mrr"), F.when(n > 1, F.col("l_quantity")).alias("elapsed_ms"), (F.col("l_tax") - F.col("l_discount")).alias("confidence_delta"), (F.col("l_quantity") > 45).alias("degraded"))
    out = R.mode_report(rows, ["recall", "hit", "mrr", "ndcg"])
    return out.select(*(F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query("call_summary", """SELECT o_orderstatus AS run, round(avg(coalesce(CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 END, 0)), 9) AS avg_llm_calls, sum(o_custkey % 4)::BIGINT AS llm_call_count, sum(o_orderkey % 2)::BIGINT AS planner_call_count, sum(o_orderkey % 3)::BIGINT AS rewrite_call_count,
  count(*) FILTER (WHERE o_orderkey % 5 = 0)::BIGINT AS selected_raw_count, count(*) FILTER (WHERE o_orderkey % 5 = 1)::BIGINT AS selected_selective_count, count(*) FILTER (WHERE o_orderkey % 5 = 2)::BIGINT AS selected_anchor_count, count(*) FILTER (WHERE o_orderkey % 5 = 3)::BIGINT AS selected_agentic_count FROM orders GROUP BY 1""")
def call_summary(spark, sf_dir):
    key, calls = F.col("o_orderkey"), F.col("o_custkey") % 4
    chosen = F.get(F.array(*map(F.lit, ("raw_only", "selective_rewrite", "anchor_aware_rewrite", "agentic_multi_query", "other"))), (key % 5).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run"), F.when(calls > 0, calls).alias("llm_call_count"), (key % 2).alias("planner_call_count"), (key % 3).alias("rewrite_call_count"), chosen.alias("selected_strategy"))
    return R.call_summary(rows, ["run"]).withColumn("avg_llm_calls", F.round("avg_llm_calls", 9))


@query("diagnostics_rollup", """WITH r AS (SELECT o_orderstatus AS run, o_custkey % 2 = 0 AS enabled, o_custkey % 3 AS seeds, o_custkey % 7 AS candidates, o_custkey % 2 AS accepted, o_orderpriority AS k1, o_orderkey % 4 AS k2 FROM orders),
s AS (SELECT run, count(*) FILTER (WHERE enabled)::BIGINT AS enabled_sample_count, sum(seeds)::BIGINT AS seed_anchor_count, sum(candidates)::BIGINT AS expanded_anchor_count, sum(accepted)::BIGINT AS accepted_expanded_anchor_count FROM r GROUP BY run),
m AS (SELECT run, string_agg(k1 || '=' || n, ',' ORDER BY k1) AS source_distribution FROM (SELECT run, k1, sum(k2 + 1) AS n FROM r GROUP BY ALL) GROUP BY run)
SELECT s.*, round(1 - accepted_expanded_anchor_count / expanded_anchor_count, 9) AS anchor_dedup_rate, source_distribution FROM s JOIN m USING (run)""")
def diagnostics_rollup(spark, sf_dir):
    cust = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run"), (cust % 2 == 0).alias("enabled"), (cust % 3).alias("seeds"), (cust % 7).alias("candidates"), (cust % 2).alias("accepted"), F.create_map("o_orderpriority", F.col("o_orderkey") % 4 + 1).alias("source_distribution"))
    out = R.diagnostics_rollup(rows, ["run"], ["source_distribution"])
    flat = F.array_join(F.transform(F.map_entries("source_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumns({"anchor_dedup_rate": F.round("anchor_dedup_rate", 9), "source_distribution": flat})


SQL_META = """CASE o_orderkey % 5 WHEN 0 THEN '{"builder":"build-eval-dataset"}' WHEN 1 THEN '{"generation_mode":"corpus_grounded_new_query"}' WHEN 2 THEN '{"query_style":"short_user"}' WHEN 3 THEN '{"builder":"x"}' END"""


@query("origin_distribution", f"""WITH m AS (SELECT {SQL_META}::JSON AS j FROM orders) SELECT CASE WHEN j ->> 'builder' = 'build-eval-dataset' THEN 'build-eval-dataset' WHEN j ->> 'generation_mode' = 'corpus_grounded_new_query' THEN 'corpus_grounded_new_query'
  WHEN j ->> 'query_style' = 'short_user' THEN 'short_user_other' ELSE 'other_or_none' END AS origin, count(*)::BIGINT AS n FROM m GROUP BY 1""")
def origin_distribution(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    meta = F.when(k == 0, '{"builder":"build-eval-dataset"}').when(k == 1, '{"generation_mode":"corpus_grounded_new_query"}').when(k == 2, '{"query_style":"short_user"}').when(k == 3, '{"builder":"x"}')
    return table(spark, sf_dir, "orders").groupBy(R.origin(meta).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@query("signature_matches", """WITH s AS (SELECT o_custkey, list_sort(list(o_orderkey % 3)) AS ids, ' ' || any_value(c_name) || '  Q' AS q FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
a AS (SELECT * FROM s WHERE o_custkey % 2 = 0), b AS (SELECT ids, q FROM s WHERE o_custkey % 2 = 1 UNION ALL SELECT [9], q FROM s WHERE o_custkey % 4 = 0),
x AS (SELECT ids IN (SELECT ids FROM b) AS i, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) IN (SELECT lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) FROM b) AS q FROM a)
SELECT count(*)::BIGINT AS built, count(*) FILTER (WHERE i)::BIGINT AS id_matches, round(count(*) FILTER (WHERE i) / count(*), 4) AS id_rate, count(*) FILTER (WHERE q)::BIGINT AS query_matches, round(count(*) FILTER (WHERE q) / count(*), 4) AS query_rate FROM x""")
def signature_matches(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sets = orders.groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey") % 3).alias("ids")).join(customer.select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit(" "), "c_name", F.lit("  Q")).alias("q")), "o_custkey")
    other = sets.where("o_custkey % 2 = 1").select("ids", "q").union(sets.where("o_custkey % 4 = 0").select(F.array(F.lit(9).cast("long")), "q"))
    return R.signature_matches(sets.where("o_custkey % 2 = 0"), other, "ids", "q")


@query("candidate_hits", """SELECT coalesce(CASE WHEN l_linenumber < 6 THEN l_shipmode END, '') AS candidate_label, count(*)::BIGINT AS rows, count(*) FILTER (WHERE l_quantity > 25)::BIGINT AS hit, count(*) FILTER (WHERE l_quantity > 25 AND l_tax < 0.03)::BIGINT AS rawmiss_hit,
  count(*) FILTER (WHERE l_quantity > 25 AND l_discount > 0.05)::BIGINT AS eligible_hit FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def candidate_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") < 6, F.concat("l_returnflag", "l_linestatus")).alias("candidate_label"), (F.col("l_quantity") > 25).cast("int").alias("candidate_hit"), (F.col("l_tax") >= 0.03).cast("int").alias("raw_hit"), (F.col("l_discount") > 0.05).alias("eligible"))
    return R.candidate_hits(rows)


SQL_VARIANTS = "r AS (SELECT l_returnflag AS variant, CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'q' END AS query, CASE WHEN l_suppkey % 3 > 0 THEN (l_partkey % 14 + 1)::INT END AS first_rank, l_suppkey % 2 = 0 AS memory_target, l_suppkey % 4 = 0 AS trusted_target FROM lineitem)"


def _variants(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("variant"), F.when(n == 0, "").when(n > 1, "q").alias("query"), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_partkey") % 14 + 1).cast("int")).alias("first_rank"),
        (F.col("l_suppkey") % 2 == 0).alias("memory_target"), (F.col("l_suppkey") % 4 == 0).alias("trusted_target"))


@query("variant_matrix", f"""WITH {SQL_VARIANTS} SELECT variant, count(*) FILTER (WHERE query <> '' AND first_rank <= 5)::BIGINT AS hit_count, round(count(*) FILTER (WHERE query <> '' AND first_rank <= 5) / 5000, 9) AS hit_rate, count(*) FILTER (WHERE coalesce(query, '') = '')::BIGINT AS missing_variant_count,
  count(*) FILTER (WHERE query <> '' AND first_rank IS NOT NULL)::BIGINT AS ranked_count, round(avg(first_rank) FILTER (WHERE query <> ''), 9) AS mean_rank_when_found FROM r GROUP BY variant""")
def variant_matrix(spark, sf_dir):
    return R.variant_matrix(_variants(spark, sf_dir), 5000).withColumns({c: F.round(c, 9) for c in ("hit_rate", "mean_rank_when_found")})


@query("memory_probe", f"""WITH {SQL_VARIANTS}, x AS (SELECT *, coalesce(query <> '', FALSE) AS t, CASE WHEN query <> '' THEN first_rank END AS k FROM r), y AS (SELECT *, coalesce(k <= 5, FALSE) AS h, coalesce(k <= 10, FALSE) AS f FROM x)
SELECT variant, count(*) FILTER (WHERE h)::BIGINT AS raw_hit_count, count(*) FILTER (WHERE f)::BIGINT AS raw_found10_count, count(*) FILTER (WHERE NOT t)::BIGINT AS missing_variant_count, count(k)::BIGINT AS ranked_count, round(avg(k), 9) AS mean_rank_when_found,
  count(*) FILTER (WHERE t AND memory_target)::BIGINT AS memory_target_count, count(*) FILTER (WHERE t AND trusted_target)::BIGINT AS trusted_target_count, count(*) FILTER (WHERE NOT h AND t AND memory_target)::BIGINT AS rawmiss_memory_target_count,
  count(*) FILTER (WHERE NOT h AND t AND trusted_target)::BIGINT AS rawmiss_trusted_target_count, count(*) FILTER (WHERE NOT h AND f AND t AND trusted_target)::BIGINT AS rawmiss_found10_trusted_target_count FROM y GROUP BY variant""")
def memory_probe(spark, sf_dir):
    return R.memory_probe(_variants(spark, sf_dir)).withColumn("mean_rank_when_found", F.round("mean_rank_when_found", 9))


@query("nested_metric_sum", """WITH m AS (SELECT o_orderstatus AS step, o_orderdate AS t, CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN '' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 10)::VARCHAR END AS b FROM orders)
SELECT step, sum(coalesce(nullif(a, '')::BIGINT, b::BIGINT, 0))::BIGINT AS total FROM m WHERE t >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY GROUP BY step""")
def nested_metric_sum(spark, sf_dir):
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = F.when(k % 4 == 0, F.col("o_custkey").cast("string")).when(k % 4 == 1, "")
    b = F.when(k % 3 == 0, (F.col("o_custkey") % 10).cast("string"))
    rows = orders.select(F.col("o_orderstatus").alias("step"), "o_orderdate", F.to_json(F.struct(a.alias("inserted"), F.struct(b.alias("inserted")).alias("dedupe_summary"))).alias("metrics"))
    recent = rows.crossJoin(F.broadcast(orders.agg(F.max("o_orderdate").alias("now")))).where(F.col("o_orderdate") >= F.col("now") - F.expr("INTERVAL 30 DAYS"))  # one row
    return recent.groupBy("step").agg(F.sum(R.nested_metric(F.col("metrics"), "inserted")).alias("total"))


@query("run_labels", "SELECT o_orderkey, 'run-' || row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS label FROM orders")
def run_labels(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", "run-").select("o_orderkey", "label")


@query("text_pool_by_id", "SELECT doc_id, source FROM documents WHERE contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'token') ORDER BY doc_id LIMIT 20")
def text_pool_by_id(spark, sf_dir):
    return R.text_pool(table(spark, sf_dir, "documents"), F.array(F.lit("License"), F.lit("token")), "text", "doc_id", 20).select("doc_id", "source")


@query("compression_order", """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS grp, ['far', 'NEAR', 'multi', 'single', 'x'][(l_partkey % 5 + 1)::INT] AS a, ['follow_up', 'comparison', 'procedure', 'reason', 'code_mixed', 'short_user', 'definition', 'y'][(l_suppkey % 8 + 1)::INT] AS t, l_tax AS s FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE lower(a) WHEN 'far' THEN 0 WHEN 'near' THEN 1 WHEN 'multi' THEN 1 WHEN 'single' THEN 2 ELSE 9 END, CASE t WHEN 'follow_up' THEN 0 WHEN 'comparison' THEN 1 WHEN 'procedure' THEN 2 WHEN 'reason' THEN 3 WHEN 'code_mixed' THEN 4 WHEN 'short_user' THEN 5 WHEN 'definition' THEN 6 ELSE 9 END, s DESC, id) AS place FROM c)
SELECT grp, id, place::INT AS place FROM r WHERE place <= 80""")
def compression_order(spark, sf_dir):
    from millrace.operators import relational

    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("grp"), pick(("far", "NEAR", "multi", "single", "x"), "l_partkey").alias("a"), pick((*R.QUERY_TYPES, "y"), "l_suppkey").alias("t"), F.col("l_tax").alias("s"))
    return relational.top_n(rows, ["grp"], R.compression_order(F.col("a"), F.col("t"), F.col("s"), F.col("id")), 80, "place").select("grp", "id", "place")


@query("key_sets", """SELECT 'both' AS part, count(*)::BIGINT AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'left', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'right', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)""")
def key_sets(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n("both", a.intersect(b)).union(n("left", a.subtract(b))).union(n("right", b.subtract(a)))


@query("first_expected_rank", """WITH e AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 2 = 0 THEN [(o_custkey % 50)::VARCHAR, ' '] ELSE [''] END AS c, [(o_custkey % 20)::VARCHAR] AS d FROM orders),
r AS (SELECT l_orderkey AS sample_id, (l_partkey % 50)::VARCHAR AS chunk_id, (l_partkey % 20)::VARCHAR AS document_id, l_linenumber AS rank FROM lineitem)
SELECT e.sample_id, min(CASE WHEN (e.sample_id % 2 = 0 AND chunk_id = c[1]) OR (e.sample_id % 2 <> 0 AND document_id = d[1]) THEN rank END)::INT AS first_rank FROM e LEFT JOIN r ON r.sample_id = e.sample_id GROUP BY e.sample_id""")
def first_expected_rank(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    expected = table(spark, sf_dir, "orders").select(k.alias("sample_id"), F.when(k % 2 == 0, F.array((c % 50).cast("string"), F.lit(" "))).otherwise(F.array(F.lit(""))).alias("chunk_ids"), F.array((c % 20).cast("string")).alias("doc_ids"))
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_partkey") % 50).cast("string").alias("chunk_id"), (F.col("l_partkey") % 20).cast("string").alias("document_id"), F.col("l_linenumber").alias("rank"))
    return R.first_expected_rank(ranked, expected)


@query("first_rank_per_document", "SELECT l_orderkey AS query_id, l_suppkey AS document_id, min(l_linenumber)::INT AS first_rank FROM lineitem GROUP BY ALL")
def first_rank_per_document(spark, sf_dir):
    return R.first_rank_per_document(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("rank")))


@query("merged_json", """SELECT event_id, '{' || array_to_string(list_filter(['"a":"' || event_type || '"', CASE WHEN event_id % 3 > 0 THEN '"b":"' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END || '"' END, CASE WHEN event_id % 2 = 0 THEN '"c":"' || user_id || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS merged FROM events""")
def merged_json(spark, sf_dir):
    e = F.col("event_id")
    old = F.to_json(F.struct(F.col("event_type").alias("a"), F.when(e % 3 > 0, "old").alias("b")))
    new = F.when(e % 2 == 0, F.to_json(F.struct(F.when(e % 3 > 0, "new").alias("b"), F.col("user_id").cast("string").alias("c"))))
    return table(spark, sf_dir, "events").select("event_id", R.merged_json(old, new).alias("merged"))


@query("uuid_guard", """SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE regexp_full_match(u, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}'))::BIGINT AS valid FROM (SELECT CASE event_id % 3 WHEN 0 THEN '123e4567-E89b-12d3-a456-' || lpad(event_id::VARCHAR, 12, '0') WHEN 1 THEN 'x' || event_id END AS u FROM events)""")
def uuid_guard(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit("123e4567-E89b-12d3-a456-"), F.lpad(e.cast("string"), 12, "0"))).when(e % 3 == 1, F.concat(F.lit("x"), e.cast("string")))
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.is_uuid(text)).alias("valid"))


@query("insert_statements", """SELECT 'INSERT INTO nation_copy (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ' || '''' || replace(n_name || '''s', '''', '''''') || '''' || ', ' || coalesce(CASE WHEN n_regionkey > 0 THEN n_regionkey END::VARCHAR, 'NULL') || ') ON CONFLICT (n_nationkey) DO UPDATE SET n_name = EXCLUDED.n_name, n_regionkey = EXCLUDED.n_regionkey;' AS statement FROM nation""")
def insert_statements(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("'s")).alias("n_name"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey"))
    return R.insert_statements(nation, "nation_copy", ["n_nationkey"])


@query("shadow_sync", """WITH old AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, upper(c_name) || '!' AS title FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.c_custkey, new.c_custkey) AS c_custkey, CASE WHEN new.c_custkey IS NOT NULL THEN title ELSE c_name END AS c_name, c_mktsegment FROM old FULL JOIN new ON old.c_custkey = new.c_custkey""")
def shadow_sync(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    new = customer.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.upper("c_name"), F.lit("!")).alias("title"))
    return R.shadow_sync(customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_mktsegment"), new, "c_custkey", {"title": "c_name"})


@query("domain_propagation", """SELECT c_custkey, CASE WHEN c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 'd1' ELSE c_mktsegment END AS domain_id FROM customer""")
def domain_propagation(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("domain_id"))
    return R.with_domain(rows, "c_custkey", F.col("c_nationkey") == 3, table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey"), F.lit("d1")).select("c_custkey", "domain_id")


@query("crawl_frontier", """WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, (o_orderkey % 900) AS b FROM orders), r(u, d) AS (SELECT 1::BIGINT, 0 UNION SELECT b, d + 1 FROM r JOIN l ON a = u WHERE d < 4) SELECT u AS url, min(d)::INT AS depth FROM r GROUP BY u""")
def crawl_frontier(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 900).alias("target"))
    return R.reachable(links, spark.range(1, 2).select(F.col("id").alias("url")), 4)


@query("group_counts", """SELECT 'status' AS shape, o_orderstatus AS key, count(*)::BIGINT AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY 2
  UNION ALL SELECT 'nation', n_name, count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 2""")
def group_counts(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    shape = lambda name, df, c: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("shape"), "key", "n")
    by_nation = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    zero = nation.join(by_nation, nation["n_nationkey"] == by_nation["c_nationkey"], "left").select(F.lit("nation").alias("shape"), F.col("n_name").alias("key"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return shape("status", orders, "o_orderstatus").union(shape("priority", orders, "o_orderpriority")).union(shape("segment", customer, "c_mktsegment")).union(zero)
