"""Gating queries, with their DuckDB statements. Passages stand for generated queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import gate, retrieve
from millrace.plans.registry import query
from millrace.plans.retrieval_queries import SQL_BM25, SQL_HASH
from millrace.plans.text_queries import SQL_TOKENS
from millrace.sources.tables import table

SQL_RULE = r"""
g AS (SELECT item_id, text, item_id % 2 = 0 AS short FROM benchmark),
rr AS (SELECT item_id, list_filter([
  CASE WHEN length(trim(text)) < (CASE WHEN short THEN 4 ELSE 8 END) OR length(trim(text)) > (CASE WHEN short THEN 120 ELSE 200 END) THEN 'length_out_of_range' END,
  CASE WHEN len(regexp_extract_all(trim(text), '[A-Za-z0-9_./-]+|[가-힣]+')) NOT BETWEEN 2 AND 40 THEN 'token_count_out_of_range' END,
  CASE WHEN len(regexp_extract_all(trim(text), '[^A-Za-z0-9가-힣\s]')) / length(regexp_replace(trim(text), '\s', '', 'g')) > 0.03 THEN 'special_ratio_high' END], lambda x: x IS NOT NULL) AS reasons FROM g)"""
#: Model scores are input columns; here a fixed rule of the item number.
SQL_LLM = """
ll AS (SELECT item_id, 3 + item_id % 3 AS grounded, 2 + item_id % 4 AS answerable, 3 + item_id % 2 AS user_like, 4 AS naturalness, 3 + (item_id * 7) % 3 AS copy_control FROM benchmark)"""
CONFIG = gate.GateConfig(max_tokens=40, special=0.03, same_chunk=0.3, same_doc=0.4)


def _rules(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    no = F.lit(False)
    return bench.select("item_id", gate.rule_reasons(F.col("text"), F.lit(""), F.lit(True), F.col("item_id") % 2 == 0, no, no, CONFIG).alias("reasons"))


@query("rule_gate", f"WITH {SQL_RULE} SELECT item_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM rr")
def rule_gate(spark, sf_dir):
    return _rules(spark, sf_dir).select("item_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("passed"))


@query("rejection_histogram", f"WITH {SQL_RULE} SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(reasons) AS reason FROM rr) GROUP BY reason")
def rejection_histogram(spark, sf_dir):
    return _rules(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


SQL_UTILITY = f"""{SQL_BM25},
tg AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ut AS (SELECT b.item_id, count(tg.doc_id) AS targets, list(r.rank ORDER BY r.rank) FILTER (WHERE r.rank IS NOT NULL) AS ranks
  FROM benchmark b LEFT JOIN tg USING (item_id) LEFT JOIN r ON r.query_id = b.item_id AND r.doc_id = tg.doc_id AND r.rank <= 10 GROUP BY b.item_id),
uv AS (SELECT item_id, targets, coalesce(len(ranks), 0) AS hits, CASE WHEN ranks[1] = 1 THEN 1.0 WHEN ranks[1] <= 3 THEN 0.85 WHEN ranks[1] <= 5 THEN 0.7 WHEN ranks[1] <= 10 THEN 0.6 ELSE 0.0 END AS base FROM ut),
us AS (SELECT item_id, targets, round(CASE WHEN targets <= 1 THEN base WHEN hits = 0 THEN 0.0 ELSE least(1.0, base + CASE WHEN hits = 1 THEN 0.05 ELSE 0.12 END) END, 9) AS utility FROM uv)"""


def _utility(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    targets = retrieve.containing(docs, bench).withColumnRenamed("item_id", "query_id")
    ranked = retrieve.top_k(retrieve.bm25(docs, bench), "bm25", 10).select("query_id", "doc_id", "rank")
    found = targets.join(ranked, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("targets"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    every = bench.select(F.col("item_id")).join(found.withColumnRenamed("query_id", "item_id"), "item_id", "left")
    ranks = F.coalesce("ranks", F.array().cast("array<int>"))
    return every.select("item_id", F.coalesce("targets", F.lit(0).cast("long")).alias("targets"), F.round(gate.utility(ranks, F.coalesce("targets", F.lit(0)), F.lit(None).cast("int"), F.lit(False)), 9).alias("utility"))


@query("utility_buckets", f"WITH {SQL_UTILITY} SELECT item_id, targets, utility FROM us")
def utility_buckets(spark, sf_dir):
    return _utility(spark, sf_dir)


def _decided(spark, sf_dir):
    item = F.col("item_id")
    scores = F.struct((3 + item % 3).alias("grounded"), (2 + item % 4).alias("answerable"), (3 + item % 2).alias("user_like"), F.lit(4).alias("naturalness"), (3 + (item * 7) % 3).alias("copy_control"))
    rows = _rules(spark, sf_dir).join(_utility(spark, sf_dir), "item_id").select(
        "item_id", (item % 3).alias("method"), (F.size("reasons") == 0).alias("rule_ok"), gate.llm_pass(scores).alias("llm_ok"), gate.llm_mean(scores).alias("llm_avg"), "utility")
    vectors = table(spark, sf_dir, "benchmark").select("item_id", V.dense_hash_embedding(T.tokens(F.col("text"))).alias("embedding"))
    asked = rows.join(vectors, "item_id").select((item % 2).alias("batch"), item.alias("seq"), item.alias("id"), (item % 8).alias("chunk_id"), (item % 4).alias("doc_id"), "embedding", "rule_ok", "llm_ok", "llm_avg", "utility")
    compared = gate.sequential_gate(asked, CONFIG).select(F.col("id").alias("item_id"), "diversity_ok", "novelty")
    return gate.decide(rows.join(compared, "item_id"), CONFIG)


SQL_DECIDED = f"""{SQL_UTILITY}, {SQL_RULE}, {SQL_LLM}, {SQL_HASH.format("b", "item_id", SQL_TOKENS.format("text"), "benchmark")},
di AS (SELECT item_id, item_id % 3 AS method, len(reasons) = 0 AS rule_ok, (grounded >= 4 AND answerable >= 3 AND user_like >= 3 AND copy_control >= 3) AS llm_ok,
  (grounded + answerable + user_like + naturalness + copy_control) / 25.0 AS llm_avg, utility, item_id % 2 AS batch, row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id) AS i FROM rr JOIN us USING (item_id) JOIN ll USING (item_id)),
d1 AS (SELECT *, CASE WHEN rule_ok THEN llm_ok END AS p2 FROM di), d2 AS (SELECT *, CASE WHEN rule_ok AND p2 IS NOT FALSE THEN utility >= 0.7 END AS p3, rule_ok AND p2 IS NOT FALSE AND utility >= 0.7 AS can FROM d1),
sm AS (SELECT a.item_id, b.i, coalesce(sum(x.value * y.value), 0) AS c FROM di a JOIN di b ON a.batch = b.batch LEFT JOIN bn x ON x.item_id = a.item_id LEFT JOIN bn y ON y.item_id = b.item_id AND y.slot = x.slot GROUP BY a.item_id, b.i),
sl AS (SELECT item_id, list(c ORDER BY i) AS sims FROM sm GROUP BY item_id), bl AS (SELECT batch, list(item_id ORDER BY i) AS items FROM di GROUP BY batch),
sq AS (SELECT d2.*, sims, items FROM d2 JOIN sl USING (item_id) JOIN bl USING (batch)),
rc(batch, i, item_id, acc, nov, dok) AS (SELECT batch, 0::BIGINT, NULL::BIGINT, []::BIGINT[], NULL::DOUBLE, NULL::BOOLEAN FROM bl UNION ALL
  SELECT batch, i, item_id, CASE WHEN can AND dok AND 0.5 * utility + 0.35 * llm_avg + 0.15 * nov >= 0.75 THEN list_append(acc, i) ELSE acc END, nov, dok FROM (
  SELECT q.batch, q.i, q.item_id, acc, can, utility, llm_avg, CASE WHEN can THEN greatest(0, 1 - coalesce(list_max(list_transform(acc, lambda a: sims[a])), 0)) END AS nov,
    CASE WHEN can THEN coalesce(list_max(list_transform(list_filter(acc, lambda a: items[a] % 8 = q.item_id % 8), lambda a: sims[a])), 0) <= {CONFIG.same_chunk} AND coalesce(list_max(list_transform(list_filter(acc, lambda a: items[a] % 4 = q.item_id % 4), lambda a: sims[a])), 0) <= {CONFIG.same_doc} END AS dok
  FROM rc JOIN sq q ON q.batch = rc.batch AND q.i = rc.i + 1)),
d3 AS (SELECT d2.*, dok AS p4, nov AS novelty FROM d2 JOIN rc USING (batch, i)),
d4 AS (SELECT *, CASE WHEN can AND p4 IS NOT FALSE THEN 0.5 * utility + 0.35 * llm_avg + 0.15 * novelty END AS final_score FROM d3),
dd AS (SELECT *, final_score >= 0.75 AS p5 FROM d4),
de AS (SELECT *, rule_ok AND p2 IS NOT FALSE AND p3 IS NOT FALSE AND p4 IS NOT FALSE AND p5 IS NOT FALSE AS accepted,
  CASE WHEN NOT rule_ok THEN 'rule_filter' WHEN p2 IS FALSE THEN 'llm_self_eval' WHEN p3 IS FALSE THEN 'retrieval_utility' WHEN p4 IS FALSE THEN 'diversity_dedup' WHEN p5 IS FALSE THEN 'final_score' ELSE 'approved' END AS rejected_stage FROM dd)"""


@query("gate_decisions", f"WITH RECURSIVE {SQL_DECIDED} SELECT item_id, rule_ok AS rule_filter, p2 AS llm_self_eval, p3 AS retrieval_utility, p4 AS diversity_dedup, round(final_score, 9) AS final_score, accepted, rejected_stage FROM de")
def gate_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("item_id", *(F.col(f"pass_{s}").alias(s) for s in gate.STAGES[:4]), F.round("final_score", 9).alias("final_score"), "accepted", "rejected_stage")


@query("gating_funnel", f"""WITH RECURSIVE {SQL_DECIDED} SELECT method, count(*)::BIGINT AS generated, count(*) FILTER (WHERE rule_ok)::BIGINT AS rule_filter, count(*) FILTER (WHERE rule_ok AND p2)::BIGINT AS llm_self_eval,
  count(*) FILTER (WHERE rule_ok AND p2 AND p3)::BIGINT AS retrieval_utility, count(*) FILTER (WHERE rule_ok AND p2 AND p3 AND p4)::BIGINT AS diversity_dedup, count(*) FILTER (WHERE accepted)::BIGINT AS accepted FROM de GROUP BY method""")
def gating_funnel(spark, sf_dir):
    return gate.funnel(_decided(spark, sf_dir), ["method"])


@query("stage_unpivot", f"""WITH RECURSIVE {SQL_DECIDED} SELECT item_id, s.stage_order::INT AS stage_order, s.stage_name, s.passed FROM de, LATERAL (VALUES (1, 'rule_filter', rule_ok), (2, 'llm_self_eval', p2), (3, 'retrieval_utility', p3), (4, 'diversity_dedup', p4), (5, 'final_score', p5)) s(stage_order, stage_name, passed)""")
def stage_unpivot(spark, sf_dir):
    return gate.history(_decided(spark, sf_dir), "item_id")


@query("stage_results", f"""WITH RECURSIVE {SQL_DECIDED}, f AS (SELECT method, count(*) AS g, count(*) FILTER (WHERE rule_ok) AS a, count(*) FILTER (WHERE rule_ok AND p2) AS b, count(*) FILTER (WHERE rule_ok AND p2 AND p3) AS c, count(*) FILTER (WHERE rule_ok AND p2 AND p3 AND p4) AS d FROM de GROUP BY method)
SELECT method, o::INT AS stage_order, s AS stage_name, i::BIGINT AS input_count, p::BIGINT AS passed_count, (i - p)::BIGINT AS rejected_count FROM f, LATERAL (VALUES (1, 'rule_filter', g, a), (2, 'llm_self_eval', a, b), (3, 'retrieval_utility', b, c), (4, 'diversity_dedup', c, d)) x(o, s, i, p)""")
def stage_results(spark, sf_dir):
    return gate.stage_results(_decided(spark, sf_dir), "method")


@query("stage_cutoff", f"WITH RECURSIVE {SQL_DECIDED} SELECT 'rule' AS level, count(*)::BIGINT AS n FROM de WHERE coalesce(rule_ok, TRUE) UNION ALL SELECT 'utility', count(*) FROM de WHERE coalesce(rule_ok, TRUE) AND coalesce(p2, TRUE) AND coalesce(p3, TRUE)")
def stage_cutoff(spark, sf_dir):
    rows = _decided(spark, sf_dir)
    n = F.count(F.lit(1)).alias("n")
    return gate.cutoff(rows, "rule_filter").agg(n).select(F.lit("rule").alias("level"), "n").union(gate.cutoff(rows, "retrieval_utility").agg(n).select(F.lit("utility").alias("level"), "n"))


@query("greedy_diversity")
def greedy_diversity(spark, sf_dir):
    """Vectors by label as gating batches, in order of their ids; vectors without a label are a batch of their own."""
    vec, yes = F.col("vec_id"), F.lit(True)
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("batch"), vec.alias("seq"), vec.alias("id"), (vec % 8).alias("chunk_id"), (vec % 4).alias("doc_id"), "embedding", yes.alias("rule_ok"), yes.alias("llm_ok"), F.lit(1.0).alias("llm_avg"), F.lit(1.0).alias("utility"))
    return gate.sequential_gate(rows, gate.GateConfig(same_chunk=0.5, same_doc=0.6))


def _persisted(spark, sf_dir):
    """Decisions as they are kept: with a time, one reason or a list of them."""
    item = F.col("id")
    rows = _decided(spark, sf_dir).withColumnRenamed("item_id", "id")
    bad = F.when(~F.col("accepted"), F.col("rejected_stage"))
    return rows.select("id", (item % 7).alias("created_at"), (item % 2).alias("batch"), "accepted", *(f"pass_{s}" for s in gate.STAGES[:4]), F.when(item % 3 > 0, F.array(bad, F.lit("low"), F.lit(" "))).alias("rejection_reasons"), bad.alias("rejected_reason"))


@query("resume_counters", f"""WITH RECURSIVE {SQL_DECIDED} SELECT count(*)::BIGINT AS generated, count(*) FILTER (WHERE rule_ok)::BIGINT AS rule_filter, count(*) FILTER (WHERE rule_ok AND p2)::BIGINT AS llm_self_eval, count(*) FILTER (WHERE rule_ok AND p2 AND p3)::BIGINT AS retrieval_utility,
  count(*) FILTER (WHERE rule_ok AND p2 AND p3 AND p4)::BIGINT AS diversity_dedup, count(*) FILTER (WHERE accepted)::BIGINT AS final_approved, count(*) FILTER (WHERE NOT accepted)::BIGINT AS rejected, arg_max(item_id, (item_id % 7, item_id)) AS last_processed FROM de""")
def resume_counters(spark, sf_dir):
    return gate.resume_counters(_persisted(spark, sf_dir))


@query("resume_rejections", f"""WITH RECURSIVE {SQL_DECIDED}, y AS (SELECT unnest(CASE WHEN item_id % 3 > 0 THEN [rejected_stage, 'low'] ELSE [rejected_stage] END) AS reason FROM de WHERE NOT accepted) SELECT reason, count(*)::BIGINT AS n FROM y GROUP BY reason""")
def resume_rejections(spark, sf_dir):
    return gate.resume_rejections(_persisted(spark, sf_dir))


@query("accepted_seeds", f"""WITH RECURSIVE {SQL_DECIDED} SELECT item_id % 2 AS batch, row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id % 7, item_id)::INT AS seq, item_id AS id, item_id % 8 AS chunk_id, item_id % 4 AS doc_id, left(benchmark.text, 50) AS query_text FROM de JOIN benchmark USING (item_id) WHERE accepted""")
def accepted_seeds(spark, sf_dir):
    item = F.col("item_id")
    raw = table(spark, sf_dir, "benchmark").select(item.alias("id"), (item % 8).alias("chunk_id"), (item % 4).alias("doc_id"), F.left("text", F.lit(50)).alias("query_text"))
    return gate.accepted_seeds(_persisted(spark, sf_dir), raw)
