"""Retrieval over inverted indexes: BM25, technical overlap, hybrid fusion, pools, merges.

Only postings of tokens that some query has are built: texts are tokenised in the scan, matching
tokens are counted by (document, token) with a combine before the shuffle, and all scores are
equi-joins on tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.functions import vectors as V

K1, B = 1.2, 0.75
#: Default fusion weights: dense, BM25, technical.
FUSION = (0.58, 0.34, 0.08)
RRF_K = 60
#: Queries whose trigrams are sent to every task at most.
FEW_QUERIES = 1000
#: Rows found that are sent to every task at most, where they meet a table of texts.
FEW_ROWS = 1 << 17


def exploded(tokens: Column) -> Column:
    """One row for each token, and a null one for none: unlike ``explode`` it makes Catalyst put no filter on the tokens under the scan, where texts would be cut twice."""
    return F.explode_outer(tokens)


def query_tokens(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``(query_id, token)``."""
    return queries.select(F.col(id_col).alias("query_id"), exploded(F.array_distinct(T.tokens(F.col(text_col)))).alias("token")).where("token IS NOT NULL")


def postings(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, token, tf, dl)`` of the tokens in ``wanted``; dl is the document's number of tokens."""
    cut = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("t"))
    spread = cut.select("doc_id", F.size("t").alias("dl"), exploded(F.col("t")).alias("token"))
    return spread.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: number of documents and their mean number of tokens."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum(T.token_count(F.col(text_col))) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avgdl"))


def bm25_statistics(docs: DataFrame, queries: DataFrame, query_id: str = "item_id", text_col: str = "text") -> tuple[int, float, DataFrame]:
    """Documents, mean length, and ``(token, df)`` of the tokens that some query has."""
    wanted = query_tokens(queries, query_id, "text").select("token").distinct()
    seen = docs.select(exploded(F.array_distinct(T.tokens(F.col(text_col)))).alias("token")).join(wanted, "token", "left_semi")
    stats = corpus_stats(docs, text_col).first()
    return stats["n_docs"], float(stats["avgdl"] or 0.0), seen.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", digits: int = 9) -> DataFrame:
    """``(query_id, doc_id, bm25)`` of every document that shares a token with the query."""
    wanted = query_tokens(queries, query_id, query_text)
    post = postings(docs, wanted, id_col, text_col)
    # both uses of the postings read the same columns, so that they are shuffled once and that shuffle is read twice
    df = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("dl").alias("most"), F.max("tf").alias("often"))
    rated = post.join(df, "token").where("dl <= most AND tf <= often").crossJoin(F.broadcast(corpus_stats(docs, text_col)))  # the statistics are one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))
    weights = rated.select("token", "doc_id", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)).alias("w"))
    return weights.join(wanted, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), digits).alias("bm25"))


def top_k(scored: DataFrame, score: str, k: int, by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their ``rank``; ties by ``tie``. Spark limits each group before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_rows(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found`` with the columns of ``docs``: few rows are sent to the tasks that scan the table, so that no text is shuffled. ``found`` has to be stored, as it is counted."""
    few = found.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return docs.join(F.broadcast(found) if few else found.hint("merge"), key)


def technical_overlap(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``(query_id, doc_id, technical)``: shared technical tokens by the root of the product of set sizes."""
    wanted = queries.select(F.col(query_id).alias("query_id"), T.technical_tokens(T.tokens(F.col(query_text))).alias("q")).select("query_id", F.size("q").alias("nq"), exploded(F.col("q")).alias("token")).where("token IS NOT NULL")
    own = docs.select(F.col(id_col).alias("doc_id"), T.technical_tokens(T.tokens(F.col(text_col))).alias("d")).select("doc_id", F.size("d").alias("nd"), exploded(F.col("d")).alias("token"))
    shared = own.join(wanted, "token").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("nq").alias("nq"), F.first("nd").alias("nd"))
    return shared.select("query_id", "doc_id", (F.col("n") / F.sqrt(F.col("nq") * F.col("nd"))).alias("technical"))


def fusion_weights(mode: str = "hybrid", weights: tuple[float, float, float] = FUSION) -> tuple[float, float, float]:
    if mode == "bm25_only":
        return 0.0, 1.0, 0.0
    if mode == "dense_only":
        return 1.0, 0.0, 0.0
    positive = tuple(max(0.0, w) for w in weights)
    total = sum(positive)
    return tuple(w / total for w in positive) if total > 0 else FUSION


def fuse(pool: DataFrame, mode: str = "hybrid", weights: tuple[float, float, float] = FUSION) -> DataFrame:
    """Add ``score`` in -1..1 from ``dense`` (cosine), ``bm25`` and ``technical`` of each query's pool."""
    dense, lexical, technical = fusion_weights(mode, weights)
    most = F.max("bm25").over(Window.partitionBy("query_id"))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("dense") + 1) / 2))
    bm = F.when(most > 0, F.greatest(F.lit(0.0), F.col("bm25") / most)).otherwise(0.0)
    combined = dense * unit + lexical * bm + technical * F.col("technical")
    return pool.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * combined - 1)))


def union_pools(*pools: DataFrame) -> DataFrame:
    """Union of ``(query_id, doc_id, score)`` pools; of equal items the row of the first pool stays."""
    marked = reduce(DataFrame.unionByName, (p.select("query_id", "doc_id", "score").withColumn("source", F.lit(i)) for i, p in enumerate(pools)))
    return marked.groupBy("query_id", "doc_id").agg(F.min_by("score", "source").alias("score"), F.min("source").alias("source"))


def rrf(results: DataFrame, k: int = 10, rrf_k: int = RRF_K, count_repeats: bool = False) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, source, doc_id, score, rank)``.

    A document counts once in a list, at its first rank (``count_repeats`` counts each). Order: fused
    score, best original score, id; with ``count_repeats`` only fused score and id.
    """
    if not count_repeats:
        results = results.groupBy("query_id", "source", "doc_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    merged = results.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.greatest(F.lit(1), F.lit(rrf_k)) + F.col("rank"))), 12).alias("rrf"), F.max("score").alias("best"), F.max_by("source", F.struct("score", -F.col("source"))).alias("representative"))
    keys = [F.desc("rrf"), *([] if count_repeats else [F.desc("best")]), F.col("doc_id")]
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys))).where(F.col("rank") <= max(1, k))


def interleave(results: DataFrame, k: int = 10) -> DataFrame:
    """Lists taken in turn by (rank, source), each document at its first place."""
    first = results.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "source")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "doc_id", "place")


def max_score(results: DataFrame, k: int = 10) -> DataFrame:
    """Each document at its greatest score; ties by id."""
    best = results.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_k(best, "score", k)


def rerank(pool: DataFrame, scores: DataFrame | None, k: int = 5) -> DataFrame:
    """Order by external relevance scores in 0..1 (mapped to -1..1) if given, else pass the input order through."""
    if scores is None:
        return pool.where(F.col("rank") <= k)
    joined = pool.drop("score").join(scores.select("query_id", "doc_id", (2 * F.col("relevance") - 1).alias("score")), ["query_id", "doc_id"])
    return top_k(joined.drop("rank"), "score", k)


def pattern_pool(docs: DataFrame, patterns: DataFrame, k: int = 10, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """``(query_id, doc_id, hits)``: for each query the documents that hold most of its lower-case patterns.

    ``patterns(query_id, patterns array<string>)`` of any size: distinct patterns are matched in one
    pass over the documents (:func:`millrace.operators.search.literal_matches`), then counted by query.
    """
    from millrace.operators.search import literal_matches

    asked = patterns.select("query_id", F.explode("patterns").alias("p")).select("query_id", F.lower("p").alias("pattern"))
    distinct = asked.select("pattern").distinct().withColumn("pattern_id", F.xxhash64("pattern"))
    low = docs.select("doc_id", F.lower(F.concat_ws("\n", *columns)).alias("text"))
    hits = literal_matches(low, distinct).join(asked.withColumn("pattern_id", F.xxhash64("pattern")), "pattern_id")
    return top_k(hits.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("hits")), "hits", k)


def trigram_pool(items: DataFrame, queries: DataFrame, k: int = 10, floor: float = 0.0) -> DataFrame:
    """Top k by trigram similarity for ``items(doc_id, text)`` and ``queries(query_id, text)``, by postings.

    Spark estimates the trigrams of the items by the size of the texts and would send them all through the driver. So the
    side to send is named here: that of the queries if they are few, else none.
    """
    own = items.select("doc_id", V.trigrams(F.col("text")).alias("g")).select("doc_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    asked = queries.select("query_id", V.trigrams(F.col("text")).alias("g")).select("query_id", F.size("g").alias("nq"), F.explode("g").alias("gram"))
    few = queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES
    shared = own.join(F.broadcast(asked) if few else asked.hint("merge"), "gram").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n"), F.first("nq").alias("nq"))
    scored = shared.select("query_id", "doc_id", F.round(F.col("both") / (F.col("n") + F.col("nq") - F.col("both")), 9).alias("score"))
    return top_k(scored.where(F.col("score") > floor), "score", k)


def containing(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", passage_id: str = "item_id") -> DataFrame:
    """``(item_id, doc_id)`` where the text holds the passage literally, whatever its length or script."""
    from millrace.operators.search import literal_matches

    found = literal_matches(docs, passages, id_col, "text", passage_id, "text")
    return found.select(F.col("pattern_id").alias("item_id"), "doc_id")


def retrieval_shift(left: Column, right: Column) -> Column:
    """0.7 of the Jaccard distance of two id lists and 0.3 if their first ids differ."""
    union = F.size(F.array_union(left, right))
    distance = 1 - F.size(F.array_intersect(left, right)) / F.greatest(union, F.lit(1))
    first = (F.size(left) > 0) & (F.size(right) > 0) & (F.get(left, F.lit(0)) != F.get(right, F.lit(0)))
    return F.when(union == 0, 0.0).otherwise(0.7 * distance + 0.3 * first.cast("int"))


def raw_loss_guard(raw: Column, candidate: Column, raw_score: Column, floor: float, least_overlap: float, need_top1: bool = True) -> Column:
    """Whether a candidate loses a confident raw result: first id gone and too little overlap."""
    kept = F.coalesce(F.array_contains(candidate, F.get(raw, F.lit(0))), F.lit(False))
    overlap = F.size(F.array_intersect(raw, candidate)) / F.greatest(F.size(F.array_distinct(raw)), F.lit(1))
    lost = ~kept if need_top1 else F.lit(True)
    return (F.size(raw) > 0) & (raw_score >= floor) & lost & (overlap < least_overlap)


def substring_overlap(query_terms: Column, text: Column, most: int = 16) -> Column:
    """Share of the first ``most`` distinct terms that occur anywhere in the text."""
    terms = F.slice(F.array_distinct(query_terms), 1, most)
    low = F.lower(text)
    return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: low.contains(t))), F.size(terms)), F.lit(0.0))


def domain_score(dense: Column, lexical: Column, technical: Column, weights: tuple[float, float, float] = (0.60, 0.32, 0.08)) -> Column:
    """The other published fusion: substring overlaps instead of BM25, mapped to -1..1."""
    a, b, c = fusion_weights("hybrid", weights)
    combined = a * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dense + 1) / 2)) + b * lexical + c * technical
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * combined - 1))


def lexical_boost(ranked: DataFrame, share: float = 0.3, k: int = 5) -> DataFrame:
    """Re-rank by ``share`` of the substring hit ratio and the rest of the old score."""
    boosted = ranked.withColumn("score", F.round(share * F.col("hit_ratio") + (1 - share) * F.col("score"), 9))
    return top_k(boosted.drop("rank"), "score", k)


def adjacency(relations: DataFrame, source: str = "source", kind: str = "kind", target: str = "neighbour") -> DataFrame:
    """Near and far neighbours of each source as sorted arrays."""
    pick = lambda k: F.sort_array(F.collect_set(F.when(F.col(kind) == k, F.col(target))))
    return relations.groupBy(source).agg(pick("near").alias("near"), pick("far").alias("far"))


def strategy_view(**frames: DataFrame) -> DataFrame:
    """Union of the tables of several strategies; ``strategy`` names the table, absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("strategy", F.lit(name)) for name, df in frames.items()))
