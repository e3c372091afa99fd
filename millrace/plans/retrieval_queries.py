"""Retrieval, fusion and evaluation queries, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import dense, evaluate, inverted, retrieve, search, vector_index
from millrace.plans.registry import query
from millrace.plans.text_queries import SQL_TOKENS
from millrace.sources.stored import durable, stored_once
from millrace.sources.tables import table

SQL_BM25 = f"""
q AS (SELECT DISTINCT item_id, unnest({SQL_TOKENS.format("text")}) AS token FROM benchmark),
dl AS (SELECT doc_id, len({SQL_TOKENS.format("text")}) AS dl FROM documents),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({SQL_TOKENS.format("text")}) AS token FROM documents) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT q.item_id AS query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25
  FROM tf JOIN df USING (token) JOIN q USING (token) JOIN dl USING (doc_id), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM s)"""
SQL_TECH_SETS = f"""
qs AS (SELECT item_id, list_filter(list_distinct({SQL_TOKENS.format("text")}), lambda t: regexp_matches(t, '[A-Za-z0-9]')) AS q FROM benchmark),
ds AS (SELECT doc_id, list_filter(list_distinct({SQL_TOKENS.format("text")}), lambda t: regexp_matches(t, '[A-Za-z0-9]')) AS d FROM documents)"""
SQL_HASH = """
{0}t AS (SELECT {1}, unnest({2}) AS token FROM {3}),
{0}h AS (SELECT {1}, ('0x' || substr(sha1(token), 1, 16))::UBIGINT AS h FROM {0}t),
{0}v AS (SELECT {1}, (h % 384)::INT AS slot, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS v FROM {0}h GROUP BY ALL HAVING sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) <> 0),
{0}n AS (SELECT {1}, slot, v / sqrt(sum(v * v) OVER (PARTITION BY {1})) AS value FROM {0}v)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _bench(spark, sf_dir):
    return table(spark, sf_dir, "benchmark")


def _ranked(spark, sf_dir, k=10):
    return search.lists(inverted.packs_of(spark, sf_dir), _bench(spark, sf_dir), k, (1,)).select("query_id", "doc_id", F.col("score").alias("bm25"), "rank")


@query("bm25_top10", f"WITH {SQL_BM25} SELECT query_id, doc_id, bm25, rank::INT AS rank FROM r WHERE rank <= 10")
def bm25_top10(spark, sf_dir):
    return retrieve.top_k(retrieve.bm25(_docs(spark, sf_dir), _bench(spark, sf_dir)), "bm25", 10).select("query_id", "doc_id", "bm25", "rank")


@query("bm25_indexed_top10", f"WITH {SQL_BM25} SELECT query_id, doc_id, bm25, rank::INT AS rank FROM r WHERE rank <= 10")
def bm25_indexed_top10(spark, sf_dir):
    """The same from the stored index, blocks whose bound is too low left out."""
    found = inverted.bm25_top_k(inverted.index_of(spark, sf_dir), _bench(spark, sf_dir))
    return found.select("query_id", "doc_id", "bm25", "rank")


@query("index_terms", f"""WITH {SQL_BM25.replace("WHERE token IN (SELECT token FROM q) ", "")} SELECT token, df::BIGINT AS df, most::BIGINT AS most FROM (SELECT token, count(*) AS df, max(tf) AS most FROM tf GROUP BY token)""")
def index_terms(spark, sf_dir):
    """Document frequency and greatest count of every token, from the stored terms."""
    return inverted.index_of(spark, sf_dir).terms.select("token", "df", "most")


@query("technical_overlap_top10", f"""
WITH {SQL_TECH_SETS}, x AS (SELECT item_id AS query_id, doc_id, round(len(list_intersect(q, d)) / sqrt(len(q) * len(d)), 9) AS technical FROM qs, ds WHERE len(list_intersect(q, d)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY technical DESC, doc_id) AS rank FROM x) SELECT query_id, doc_id, technical, rank::INT AS rank FROM r WHERE rank <= 10""")
def technical_overlap_top10(spark, sf_dir):
    return search.lists(inverted.packs_of(spark, sf_dir), _bench(spark, sf_dir), 10, (2,)).select("query_id", "doc_id", F.col("score").alias("technical"), "rank")


@query("hash_embedding_sparse", f"WITH {SQL_HASH.format('', 'item_id', SQL_TOKENS.format('text'), 'benchmark')} SELECT item_id, slot, round(value, 9) AS value FROM n")
def hash_embedding_sparse(spark, sf_dir):
    vec = V.hash_embedding(_bench(spark, sf_dir), "item_id", T.tokens(F.col("text")))
    return vec.select("item_id", "slot", F.round("value", 9).alias("value"))


@query("hash_embedding_cosine", f"""
WITH {SQL_HASH.format('', 'conv_id, turn', SQL_TOKENS.format('text'), 'conversations').replace('PARTITION BY conv_id, turn', 'PARTITION BY conv_id, turn')}
SELECT a.conv_id, a.turn, round(sum(a.value * b.value), 9) AS cosine FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.slot = b.slot GROUP BY ALL""")
def hash_embedding_cosine(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    vec = V.hash_embedding(turns, "k", T.tokens(F.col("text"))).select("k.conv_id", "k.turn", "slot", "value")
    after = vec.select("conv_id", (F.col("turn") - 1).alias("turn"), "slot", F.col("value").alias("next"))
    return vec.join(after, ["conv_id", "turn", "slot"]).groupBy("conv_id", "turn").agg(F.round(F.sum(F.col("value") * F.col("next")), 9).alias("cosine"))


SQL_DENSE = f"""{SQL_BM25}, {SQL_TECH_SETS}, {SQL_HASH.format('d', 'doc_id', SQL_TOKENS.format('text'), 'documents')}, {SQL_HASH.format('q', 'item_id', SQL_TOKENS.format('text'), 'benchmark')},
dd AS (SELECT qn.item_id AS query_id, dn.doc_id, sum(dn.value * qn.value) AS dense FROM qn JOIN dn ON dn.slot = qn.slot GROUP BY ALL),
x AS (SELECT qs.item_id AS query_id, ds.doc_id, coalesce(s.bm25, 0) AS bm25, coalesce(dense, 0) AS dense, coalesce(len(list_intersect(q, d)) / nullif(sqrt(len(q) * len(d)), 0), 0) AS technical
  FROM qs CROSS JOIN ds LEFT JOIN s ON s.query_id = qs.item_id AND s.doc_id = ds.doc_id LEFT JOIN dd ON dd.query_id = qs.item_id AND dd.doc_id = ds.doc_id)"""
SQL_FUSED = """round(greatest(-1, least(1, 2 * ({0} * greatest(0, least(1, (dense + 1) / 2)) + {1} * CASE WHEN top > 0 THEN greatest(0, bm25 / top) ELSE 0 END + {2} * technical) - 1)), 9)"""


def _sql_hybrid(weights):
    return f"""WITH {SQL_DENSE}, t AS (SELECT *, max(bm25) OVER (PARTITION BY query_id) AS top FROM x), f AS (SELECT query_id, doc_id, {SQL_FUSED.format(*weights)} AS score FROM t),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, score, rank::INT AS rank FROM z WHERE rank <= 10"""


@query("hybrid_top10", _sql_hybrid((0.58, 0.34, 0.08)))
def hybrid_top10(spark, sf_dir):
    return search.packed_hybrid(inverted.packs_of(spark, sf_dir), _bench(spark, sf_dir))


@query("dense_only_top10", _sql_hybrid((1, 0, 0)))
def dense_only_top10(spark, sf_dir):
    return search.packed_hybrid(inverted.packs_of(spark, sf_dir), _bench(spark, sf_dir), mode="dense_only")


@query("bm25_only_top10", _sql_hybrid((0, 1, 0)))
def bm25_only_top10(spark, sf_dir):
    return search.packed_hybrid(inverted.packs_of(spark, sf_dir), _bench(spark, sf_dir), mode="bm25_only")


@query("pooled_hybrid_top10", f"""WITH {SQL_DENSE}, k1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, doc_id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS r2, row_number() OVER (PARTITION BY query_id ORDER BY round(technical, 9) DESC, doc_id) AS r3 FROM x),
po AS (SELECT query_id, doc_id, round(dense, 9) AS dense, round(technical, 9) AS technical FROM k1 WHERE r1 <= 20 OR (r2 <= 20 AND bm25 > 0) OR (r3 <= 20 AND technical > 0)),
st2 AS (SELECT query_id, count(*) AS n, avg(dl.dl) AS avgdl FROM po JOIN dl USING (doc_id) GROUP BY query_id),
h AS (SELECT po.query_id, po.doc_id, tf.token, tf.tf, dl.dl FROM po JOIN q ON q.item_id = po.query_id JOIN tf ON tf.doc_id = po.doc_id AND tf.token = q.token JOIN dl ON dl.doc_id = po.doc_id),
f2 AS (SELECT query_id, token, count(*) AS df FROM h GROUP BY ALL),
b2 AS (SELECT h.query_id, h.doc_id, round(sum(ln(1 + (st2.n - f2.df + 0.5) / (f2.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * h.dl / st2.avgdl))), 9) AS bm25 FROM h JOIN f2 USING (query_id, token) JOIN st2 USING (query_id) GROUP BY ALL),
y AS (SELECT po.query_id, po.doc_id, dense, technical, coalesce(b2.bm25, 0) AS bm25, max(coalesce(b2.bm25, 0)) OVER (PARTITION BY po.query_id) AS top FROM po LEFT JOIN b2 ON b2.query_id = po.query_id AND b2.doc_id = po.doc_id),
w AS (SELECT query_id, doc_id, {SQL_FUSED.format(0.58, 0.34, 0.08)} AS score FROM y), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM w) SELECT query_id, doc_id, score, rank::INT AS rank FROM z WHERE rank <= 10""")
def pooled_hybrid_top10(spark, sf_dir):
    return search.pooled_hybrid(inverted.packs_of(spark, sf_dir), _bench(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


SQL_NEAREST = """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 10"""


@query("dense_top10", SQL_NEAREST)
def dense_top10(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return dense.search(vectors, queries, 10)


def _vector_index(spark, sf_dir):
    folder = stored_once(spark, "vectors", [f"{sf_dir}/embeddings.parquet"], lambda f: vector_index.build(table(spark, sf_dir, "embeddings"), f))
    return vector_index.open_index(spark, folder)


@query("ann_top10")
def ann_top10(spark, sf_dir):
    """Nearest vectors through the stored cells; :func:`ann_recall` and the tests hold them against all vectors."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search(_vector_index(spark, sf_dir), asked, 10)


@query("index_scan_top10", SQL_NEAREST)
def index_scan_top10(spark, sf_dir):
    """The same index with every cell looked into, which is exact: all vectors are in it, once, with their directions."""
    index = _vector_index(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search(index, asked, 10, probes=len(index.centres))


@query("ann_recall")
def ann_recall(spark, sf_dir):
    """Of the ten nearest of each query, how many the same index finds."""
    return vector_index.recall(ann_top10(spark, sf_dir), dense_top10(spark, sf_dir))


SQL_TWO_LISTS = f"""{SQL_BM25}, {SQL_TECH_SETS},
tx AS (SELECT item_id AS query_id, doc_id, round(len(list_intersect(q, d)) / sqrt(len(q) * len(d)), 9) AS technical FROM qs, ds WHERE len(list_intersect(q, d)) > 0),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY technical DESC, doc_id) AS rank FROM tx),
l AS (SELECT query_id, doc_id, bm25 AS score, rank, 0 AS source FROM r WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, technical, rank, 1 FROM tr WHERE rank <= 10)"""


def _two_lists(spark, sf_dir):
    """The lexical list (source 0) and the technical one (source 1), from one pass."""
    found = search.lists(inverted.packs_of(spark, sf_dir), _bench(spark, sf_dir), 10, (1, 2))
    return found.select("query_id", "doc_id", "score", "rank", (F.col("kind") - 1).alias("source"))


@query("rrf_merge", f"""
WITH {SQL_TWO_LISTS}, m AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 12) AS rrf, max(score) AS best FROM l GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, doc_id) AS rank FROM m) SELECT query_id, doc_id, rrf, best, rank::INT AS rank FROM z WHERE rank <= 10""")
def rrf_merge(spark, sf_dir):
    return retrieve.rrf(_two_lists(spark, sf_dir)).select("query_id", "doc_id", "rrf", "best", "rank")


@query("interleave_merge", f"""
WITH {SQL_TWO_LISTS}, f AS (SELECT query_id, doc_id, min(rank * 10 + source) AS slot FROM l GROUP BY ALL),
z AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS place FROM f) SELECT query_id, doc_id, place::INT AS place FROM z WHERE place <= 10""")
def interleave_merge(spark, sf_dir):
    return retrieve.interleave(_two_lists(spark, sf_dir))


@query("max_score_merge", f"""
WITH {SQL_TWO_LISTS}, m AS (SELECT query_id, doc_id, max(score) AS score FROM l GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) SELECT query_id, doc_id, score, rank::INT AS rank FROM z WHERE rank <= 10""")
def max_score_merge(spark, sf_dir):
    return retrieve.max_score(_two_lists(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


@query("pool_union_first_wins", f"WITH {SQL_TWO_LISTS} SELECT query_id, doc_id, arg_min(score, source) AS score, min(source)::INT AS source FROM l GROUP BY ALL")
def pool_union_first_wins(spark, sf_dir):
    lists = _two_lists(spark, sf_dir)
    return retrieve.union_pools(lists.where("source = 0"), lists.where("source = 1"))


@query("trigram_similarity_top5", """
WITH g AS (SELECT 'q' || o_orderpriority AS id, 'q' AS kind, o_orderpriority AS text FROM (SELECT DISTINCT o_orderpriority FROM orders) UNION ALL SELECT p_partkey::VARCHAR, 'd', p_name || ' ' || p_type || ' low' FROM part),
w AS (SELECT id, kind, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM g),
t AS (SELECT id, kind, list_distinct(flatten(list(list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM w GROUP BY ALL),
s AS (SELECT substr(q.id, 2) AS query_id, d.id::BIGINT AS doc_id, len(list_intersect(q.t, d.t)) AS shared, len(q.t) + len(d.t) AS total FROM t q, t d WHERE q.kind = 'q' AND d.kind = 'd'),
r AS (SELECT query_id, doc_id, round(shared / (total - shared), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(shared / (total - shared), 9) DESC, doc_id) AS rank FROM s WHERE shared > 0)
SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def trigram_similarity_top5(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderpriority").alias("text")).distinct()
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type", F.lit("low")).alias("text"))
    return retrieve.trigram_pool(items, asked, 5)


@query("pattern_pool_top5", """
WITH p AS (SELECT * FROM (VALUES (1, ['license', 'commons', 'rights']), (2, ['password', 'token']), (3, ['@mail', '(', '+1'])) t(query_id, patterns)),
h AS (SELECT query_id, doc_id, len(list_filter(patterns, lambda x: contains(lower(text), x))) AS hits FROM documents, p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM h WHERE hits > 0) SELECT query_id, doc_id, hits::INT AS hits, rank::INT AS rank FROM r WHERE rank <= 5""")
def pattern_pool_top5(spark, sf_dir):
    asked = spark.createDataFrame([(1, ["license", "commons", "rights"]), (2, ["password", "token"]), (3, ["@mail", "(", "+1"])], "query_id int, patterns array<string>")
    return retrieve.pattern_pool(_docs(spark, sf_dir), asked, 5)


@query("ilike_any_pool", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' OR p_name ILIKE 'red%' OR p_type ILIKE 'red%'")
def ilike_any_pool(spark, sf_dir):
    hit = F.expr("p_name ILIKE ANY ('%ring%', 'red%') OR p_type ILIKE ANY ('%ring%', 'red%')")
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", "p_name", "p_type")


SQL_METRICS = f"""{SQL_BM25},
e AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
j AS (SELECT e.query_id, e.doc_id, r.rank FROM e LEFT JOIN r ON r.query_id = e.query_id AND r.doc_id = e.doc_id AND r.rank <= 10),
m AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) / count(*) AS recall_at_5, CASE WHEN count(*) FILTER (WHERE rank <= 5) > 0 THEN 1.0 ELSE 0.0 END AS hit_at_5,
  coalesce(1.0 / min(rank), 0) AS mrr_at_10, least(1, sum(CASE WHEN rank IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) / list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg_at_10, min(rank)::BIGINT AS first_rank FROM j GROUP BY query_id)"""


@query("retrieval_metrics", f"WITH {SQL_METRICS} SELECT query_id, round(recall_at_5, 9) AS recall_at_5, hit_at_5, round(mrr_at_10, 9) AS mrr_at_10, round(ndcg_at_10, 9) AS ndcg_at_10, first_rank FROM m")
def retrieval_metrics(spark, sf_dir):
    """The flagship: BM25 top 10 of each passage, judged by the documents that hold it."""
    expected = retrieve.containing(_docs(spark, sf_dir), _bench(spark, sf_dir)).withColumnRenamed("item_id", "query_id")
    found = evaluate.retrieval_metrics(_ranked(spark, sf_dir), expected, "query_id", "doc_id")
    return found.select("query_id", *(F.round(m, 9).alias(m) for m in evaluate.METRICS), "first_rank")


@query("mode_summary", f"""
WITH {SQL_METRICS}, {SQL_TECH_SETS},
tx AS (SELECT item_id AS query_id, doc_id, round(len(list_intersect(q, d)) / sqrt(len(q) * len(d)), 9) AS technical FROM qs, ds WHERE len(list_intersect(q, d)) > 0),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY technical DESC, doc_id) AS rank FROM tx),
j2 AS (SELECT e.query_id, e.doc_id, tr.rank FROM e LEFT JOIN tr ON tr.query_id = e.query_id AND tr.doc_id = e.doc_id AND tr.rank <= 10),
m2 AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) / count(*) AS recall_at_5, CASE WHEN count(*) FILTER (WHERE rank <= 5) > 0 THEN 1.0 ELSE 0.0 END AS hit_at_5, coalesce(1.0 / min(rank), 0) AS mrr_at_10 FROM j2 GROUP BY query_id),
u AS (SELECT 'raw' AS mode, recall_at_5, hit_at_5, mrr_at_10 FROM m UNION ALL SELECT 'technical', recall_at_5, hit_at_5, mrr_at_10 FROM m2),
a AS (SELECT mode, count(*)::BIGINT AS n, avg(recall_at_5) AS recall_at_5, avg(hit_at_5) AS hit_at_5, avg(mrr_at_10) AS mrr_at_10 FROM u GROUP BY mode)
SELECT mode, n, round(recall_at_5, 9) AS recall_at_5, round(hit_at_5, 9) AS hit_at_5, round(mrr_at_10, 9) AS mrr_at_10, round(mrr_at_10 - (SELECT mrr_at_10 FROM a WHERE mode = 'raw'), 9) AS gain_mrr_at_10 FROM a""")
def mode_summary(spark, sf_dir):
    expected = durable(retrieve.containing(_docs(spark, sf_dir), _bench(spark, sf_dir)).withColumnRenamed("item_id", "query_id"))  # both modes are judged by it
    lists = _two_lists(spark, sf_dir)
    modes = {"raw": lists.where("source = 0"), "technical": lists.where("source = 1")}
    rows = None
    for mode, ranked in modes.items():
        own = evaluate.retrieval_metrics(ranked, expected, "query_id", "doc_id").withColumn("mode", F.lit(mode))
        rows = own if rows is None else rows.unionByName(own)
    found = evaluate.mode_summary(rows)
    return found.select("mode", "n", *(F.round(m, 9).alias(m) for m in ("recall_at_5", "hit_at_5", "mrr_at_10", "gain_mrr_at_10")))


@query("retrieval_shift", f"""
WITH {SQL_TWO_LISTS}, a AS (SELECT query_id, list(doc_id ORDER BY rank) FILTER (WHERE source = 0 AND rank <= 5) AS x, list(doc_id ORDER BY rank) FILTER (WHERE source = 1 AND rank <= 5) AS y FROM l GROUP BY query_id)
SELECT query_id, round(0.7 * (1 - len(list_intersect(x, y)) / len(list_distinct(x || y))) + 0.3 * (x[1] <> y[1])::INT, 9) AS shift,
  (len(list_intersect(x, y)) / len(x) < 0.4 AND NOT list_contains(y, x[1])) AS guard FROM a WHERE x IS NOT NULL AND y IS NOT NULL""")
def retrieval_shift(spark, sf_dir):
    ids = _two_lists(spark, sf_dir).where("rank <= 5").groupBy("query_id").agg(
        *(F.transform(F.sort_array(F.collect_list(F.when(F.col("source") == s, F.struct("rank", "doc_id")))), lambda r: r["doc_id"]).alias(n) for s, n in ((0, "x"), (1, "y"))))
    both = ids.where((F.size("x") > 0) & (F.size("y") > 0))
    return both.select("query_id", F.round(retrieve.retrieval_shift(F.col("x"), F.col("y")), 9).alias("shift"), retrieve.raw_loss_guard(F.col("x"), F.col("y"), F.lit(1.0), 0.5, 0.4).alias("guard"))


@query("confidence_scores", f"""
WITH {SQL_BM25}, t AS (SELECT query_id, list(least(1, bm25 / 50) ORDER BY rank) FILTER (WHERE rank <= 3) AS s FROM r GROUP BY query_id),
u AS (SELECT query_id, list_transform(s, lambda x: greatest(0, least(1, (x + 1) / 2))) AS u FROM t)
SELECT query_id, round(0.7 * u[1] + 0.3 * list_sum(u) / len(u), 9) AS retrieval_only, round(0.45 * u[1] + 0.2 * list_sum(u) / len(u) + 0.35 * 0.75, 9) AS with_memory FROM u""")
def confidence_scores(spark, sf_dir):
    top = _ranked(spark, sf_dir, 3).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.least(F.lit(1.0), F.col("bm25") / 50).alias("s")))), lambda x: x["s"]).alias("s"))
    return top.select("query_id", F.round(evaluate.confidence(F.col("s")), 9).alias("retrieval_only"), F.round(evaluate.confidence(F.col("s"), F.lit(0.5)), 9).alias("with_memory"))


@query("run_comparison", f"""
WITH {SQL_TWO_LISTS}, a AS (SELECT query_id, list(doc_id ORDER BY rank) AS x FROM l WHERE source = 0 AND rank <= 3 AND score > 20 GROUP BY 1), b AS (SELECT query_id, list(doc_id ORDER BY rank) AS y FROM l WHERE source = 1 AND rank <= 3 AND score > 0.2 GROUP BY 1)
SELECT query_id, CASE WHEN x IS NULL THEN 'right_only' WHEN y IS NULL THEN 'left_only' WHEN x = y THEN 'exact' WHEN list_sort(x) = list_sort(y) THEN 'reordered' ELSE 'different' END AS state,
  coalesce(len(list_intersect(x, y)), 0)::INT AS shared FROM a FULL JOIN b USING (query_id)""")
def run_comparison(spark, sf_dir):
    """Two result lists, each without weak hits, so that either may lack samples: a full outer comparison."""
    strong = _two_lists(spark, sf_dir).where("rank <= 3 AND score > IF(source = 0, 20, 0.2)")
    lists = strong.groupBy("query_id", "source").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    return evaluate.compare_runs(lists.where("source = 0"), lists.where("source = 1"), ["query_id"], "ids")
