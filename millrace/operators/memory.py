"""Memory snapshots: building from gated queries, lookup, incremental embeddings, resume state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.operators import gate


def build_snapshot(gated: DataFrame, chunks: DataFrame, level: str = "final_score") -> DataFrame:
    """Memory entries of the gated queries that passed up to ``level``, with a preview of their chunk.

    ``gated(query_id, query_text, chunk_id, pass_*, final_score, utility)``, ``chunks(chunk_id, doc_id, product,
    content)``. The entry id is a name-based UUID of query and chunk, so building again gives the same ids.
    """
    kept = gate.cutoff(gated, level)
    joined = kept.join(chunks, "chunk_id")
    return joined.select(
        T.name_uuid(F.concat_ws(":", F.lit("memory"), F.col("query_id").cast("string"), F.col("chunk_id").cast("string"))).alias("memory_id"),
        "query_id", "query_text", "chunk_id", "doc_id", "product", F.left("content", F.lit(700)).alias("preview"), "utility", "final_score")


def missing(items: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What is still to be materialised: all with ``force``, else items whose key is not among ``done``."""
    return items if force else items.join(done.select(key), key, "left_anti")


def top_memories(memories: DataFrame, queries: DataFrame, n: int = 5, product: str | None = None, strategies: tuple[str, ...] = ()) -> DataFrame:
    """Top n eligible memories of each query by shared technical tokens, then by utility."""
    able = memories
    if product is not None:
        able = able.where(F.col("product") == product)
    if strategies:
        able = able.where(F.col("strategy").isin(*strategies))
    own = able.select("memory_id", "utility", F.explode(F.array_distinct(T.tokens(F.col("query_text")))).alias("token"))
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    shared = own.join(asked, "token").groupBy("query_id", "memory_id").agg(F.count(F.lit(1)).alias("shared"), F.first("utility").alias("utility"))
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("utility"), "memory_id")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def trusted(memories: DataFrame, raw: DataFrame) -> DataFrame:
    """Memories whose target is among the raw results of their query, by chunk or by document."""
    by = raw.groupBy("query_id").agg(F.collect_set("chunk_id").alias("_c"), F.collect_set("doc_id").alias("_d"))
    joined = memories.join(by, "query_id")
    return joined.where(F.array_contains("_c", F.col("chunk_id")) | F.array_contains("_d", F.col("doc_id"))).drop("_c", "_d")


def pending(queries: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """Resume point: queries not done yet."""
    return queries.join(done.select(key).distinct(), key, "left_anti").orderBy(order, key)


def resume_points(items: DataFrame, done: DataFrame, group: str, key: str) -> DataFrame:
    """``(group, last_done, skipped, resume_at)``: whether a run may go on behind its last processed item.

    ``skipped`` counts items before the last processed one that were not processed: only where it is 0 is the
    last one a checkpoint. ``resume_at`` is the first unprocessed item, null if none is left.
    """
    marked = items.select(group, key).join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    last = marked.where("_done").groupBy(group).agg(F.max(key).alias("last_done"))
    rest = marked.join(last, group, "left")
    open_ = F.col("_done").isNull()
    return rest.groupBy(group).agg(F.max("last_done").alias("last_done"), F.count_if(open_ & F.coalesce(F.col(key) < F.col("last_done"), F.lit(False))).alias("skipped"), F.min(F.when(open_, F.col(key))).alias("resume_at"))


def eligible(memories: DataFrame, preset: str | None = None, run: str | None = None, strategies: tuple[str, ...] = ()) -> DataFrame:
    """Memories of a gating preset, a gating run and a set of strategies; what is not given does not filter."""
    for name, value in (("preset", preset), ("run", run)):
        if value is not None:
            memories = memories.where(F.col(name) == value)
    return memories.where(F.col("strategy").isin(*strategies)) if strategies else memories


def run_record(run_id: str, metrics: dict[str, float], started: str, finished: str) -> dict[str, str]:
    """A row for the run log; metrics are JSON with sorted keys."""
    import json

    return {"run_id": run_id, "started": started, "finished": finished, "metrics": json.dumps(metrics, sort_keys=True)}


def bounded_evidence(text: Column, most: int = 700) -> Column:
    """Whole paragraphs from the start while they fit; a first paragraph that is too long is cut."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.trim(p) != "")

    def add(acc: Column, p: Column) -> Column:
        joined = F.when(acc["text"] == "", p).otherwise(F.concat(acc["text"], F.lit("\n\n"), p))
        fits = ~acc["full"] & (F.length(joined) <= most)
        return F.struct(F.when(fits, joined).when((acc["text"] == "") & ~acc["full"], F.left(p, F.lit(most))).otherwise(acc["text"]).alias("text"), (~fits).alias("full"))

    return F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), add, lambda a: a["text"])
