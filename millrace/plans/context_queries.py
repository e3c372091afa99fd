"""Small projections and lookups of the evaluation runtime, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import anchors
from millrace.functions import phrases as P
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import memory, retrieve
from millrace.plans.registry import query
from millrace.plans.retrieval_queries import SQL_TWO_LISTS, _two_lists
from millrace.plans.text_queries import SQL_SENTENCES
from millrace.sources.tables import table


@query("vector_redimension", "SELECT vec_id, 384 AS size, round(list_sum(embedding::DOUBLE[]), 6) AS total, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def vector_redimension(spark, sf_dir):
    fitted = table(spark, sf_dir, "embeddings").select("vec_id", V.fit_dimension(F.col("embedding").cast("array<double>")).alias("v"))
    return fitted.select("vec_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("parent_lookup", r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), s AS (SELECT page_id, u, regexp_extract(u, '^(.*)/[^/]*$', 1) AS up FROM p), f AS (SELECT u, min(page_id) AS parent FROM s GROUP BY u)
SELECT s.page_id, f.parent FROM s LEFT JOIN f ON f.u = s.up""")
def parent_lookup(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u")).withColumn("up", F.regexp_extract("u", "^(.*)/[^/]*$", 1))
    first = paths.groupBy(F.col("u").alias("up")).agg(F.min("page_id").alias("parent"))
    return paths.join(first, "up", "left").select("page_id", "parent")


@query("null_safe_update", "SELECT o_orderkey, c_nationkey IS DISTINCT FROM (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 25 END) AS changed FROM orders JOIN customer ON o_custkey = c_custkey")
def null_safe_update(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    stored = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 25)
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", (~F.col("c_nationkey").eqNullSafe(stored)).alias("changed"))


@query("trusted_memories", f"WITH {SQL_TWO_LISTS} SELECT m.query_id, m.doc_id FROM l m WHERE m.source = 0 AND EXISTS (SELECT 1 FROM l r WHERE r.source = 1 AND r.query_id = m.query_id AND (r.doc_id = m.doc_id OR r.doc_id // 10 = m.doc_id // 10))")
def trusted_memories(spark, sf_dir):
    lists = _two_lists(spark, sf_dir).select("query_id", "source", F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 10).alias("doc_id"))
    found = memory.trusted(lists.where("source = 0"), lists.where("source = 1"))
    return found.select("query_id", F.col("chunk_id").alias("doc_id"))


@query("prompt_context", f"WITH {SQL_TWO_LISTS} SELECT l.query_id, l.rank::INT AS rank, left(d.text, 240) AS excerpt, d.source AS product FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE l.source = 0 AND l.rank <= 3")
def prompt_context(spark, sf_dir):
    top = _two_lists(spark, sf_dir).where("source = 0 AND rank <= 3").select("query_id", "rank", "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(240)).alias("excerpt"), F.col("source").alias("product"))
    return retrieve.with_rows(top, docs).select("query_id", "rank", "excerpt", "product")


SQL_CONTEXT = """c AS (SELECT conv_id, turn, coalesce(text, '') AS raw, trim(coalesce(CASE WHEN turn % 2 = 0 THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END, '')) AS p, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS e, CASE WHEN turn % 2 = 1 THEN 'memory of ' || role END AS m FROM conversations)"""


def _context(spark, sf_dir):
    from pyspark.sql.window import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("raw"), F.when(turn % 2 == 0, before).alias("p"), F.when(turn % 3 == 0, F.col("role")).otherwise("").alias("e"), F.when(turn % 2 == 1, F.concat(F.lit("memory of "), "role")).alias("m"))


@query("template_rewrites", f"""WITH {SQL_CONTEXT} SELECT conv_id, turn, 'explicit_standalone' AS label, CASE WHEN p <> '' OR e <> '' THEN trim(p || ' 이후 맥락에서 ' || raw || '를 독립 질문으로 재작성해 주세요. ' || e) ELSE raw || '를 스프링 기술 문서 기준으로 독립 질문 형태로 상세히 설명해 주세요.' END AS query FROM c
UNION ALL SELECT conv_id, turn, 'memory_anchored', raw || ' 관련하여 ' || coalesce(m, raw) FROM c UNION ALL SELECT conv_id, turn, 'task_or_error_focused', raw || '가 실패하거나 오류가 날 때 점검 순서를 알려주세요.' FROM c""")
def template_rewrites(spark, sf_dir):
    made = P.template_rewrites(F.col("raw"), F.col("m"), F.col("p"), F.col("e"))
    return _context(spark, sf_dir).select("conv_id", "turn", F.inline(made))


@query("heuristic_rewrites", f"""WITH {SQL_CONTEXT}, s AS (SELECT *, coalesce(nullif(trim(concat_ws(' ', nullif(p, ''), nullif(raw, ''), nullif(e, ''))), ''), raw) AS s FROM c), g AS (SELECT *, s || CASE WHEN turn % 4 = 1 THEN '  ' ELSE ' ' || m END AS g FROM s)
SELECT conv_id, turn, 'standalone' AS label, s AS query, 0 AS source_memory_index, 'low' AS intent_risk FROM g UNION ALL SELECT conv_id, turn, 'expanded', g, greatest(1, turn % 3)::INT, 'medium' FROM g
WHERE g IS NOT NULL AND trim(regexp_replace(g, '\\s+', ' ', 'g')) <> '' AND lower(trim(regexp_replace(g, '\\s+', ' ', 'g'))) <> lower(trim(regexp_replace(s, '\\s+', ' ', 'g')))""")
def heuristic_rewrites(spark, sf_dir):
    """Rewrites without a model: the query in its session, and the same with a hint of its best memory."""
    alone = P.standalone_text(F.col("raw"), F.col("p"), F.col("e"))
    hinted = F.when(F.col("m").isNotNull(), F.concat(alone, F.when(F.col("turn") % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), "m"))))
    made = P.standalone_rewrites(F.col("raw"), hinted, F.col("turn") % 3, F.col("p"), F.col("e"))
    return _context(spark, sf_dir).select("conv_id", "turn", F.inline(made))


@query("alias_normal_forms", r"""SELECT DISTINCT p_name AS alias, p_type AS kind, CASE WHEN p_type = 'ECONOMY' THEN '@' || lower(replace(p_name, ' ', '_')) ELSE lower(replace(p_name, ' ', ' ')) END AS normal FROM part""")
def alias_normal_forms(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_type").alias("kind")).distinct()
    economy = F.col("kind") == "ECONOMY"
    raw = F.when(economy, F.replace("alias", F.lit(" "), F.lit("_"))).otherwise(F.replace("alias", F.lit(" "), F.lit("-")))
    return part.select("alias", "kind", anchors.normal_alias(raw, F.lit("en"), F.when(economy, "annotation").otherwise("concept")).alias("normal"))
