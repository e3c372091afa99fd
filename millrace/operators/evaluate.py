"""Retrieval and answer evaluation: metrics by sample, summaries by mode, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

METRICS = ("recall_at_5", "hit_at_5", "mrr_at_10", "ndcg_at_10")


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, sample: str = "sample_id", item: str = "item_id") -> DataFrame:
    """Recall@5, Hit@5, MRR@10 and nDCG@10 of each sample with expected items.

    ``ranked(sample, item, rank)`` and ``expected(sample, item)``; the first rank of an item counts, and
    the ideal of nDCG is the smaller of 10 and the number expected. One join on (sample, item), one
    aggregate by sample.
    """
    first = ranked.where("rank <= 10").groupBy(sample, item).agg(F.min("rank").alias("rank"))
    judged = expected.select(sample, item).distinct().join(first, [sample, item], "left")
    rank = F.col("rank")
    by = judged.groupBy(sample).agg(
        F.count_if(rank <= 5).alias("hits"), F.count(F.lit(1)).alias("wanted"), F.min("rank").alias("first"),
        F.sum(F.when(rank.isNotNull(), 1 / F.log2(rank + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("wanted").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return by.select(
        sample,
        (F.col("hits") / F.col("wanted")).alias("recall_at_5"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_at_5"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_at_10"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dcg") / ideal)).alias("ndcg_at_10"),
        F.col("first").cast("long").alias("first_rank"),
    )


def answer_metrics(rows: DataFrame, query: str, answer: str, context: str, points: str, ids: str | None = None, expected: str | None = None, found: str | None = None) -> DataFrame:
    """The token-overlap answer metrics added to ``rows``; faithfulness falls with verbatim copying.

    With ``ids`` (expected chunk and document ids as text), ``expected`` and ``found`` (arrays of chunk ids)
    also keyword overlap, context recall and context precision. Key points that are empty give way to
    the expected ids.
    """
    grounding = T.overlap_ratio(F.col(answer), F.col(context))
    wanted = F.col(points) if expected is None else F.coalesce(F.nullif(F.col(points), F.lit("")), F.array_join(expected, " "))
    out = [
        T.overlap_ratio(wanted, F.col(answer)).alias("correctness"), grounding.alias("grounding"), F.greatest(F.lit(0.0), 1 - grounding).alias("hallucination_rate"),
        T.overlap_ratio(F.col(query), F.col(answer)).alias("answer_relevance"), (1 - F.least(F.lit(1.0), T.copy_ratio(F.col(answer), F.col(context), 3))).alias("faithfulness"),
    ]
    if ids is not None:
        covered = F.size(F.filter(expected, lambda x: F.array_contains(found, x)))
        out += [
            T.overlap_ratio(F.col(ids), F.col(answer)).alias("keyword_overlap"), (covered / F.greatest(F.lit(1), F.size(expected))).alias("context_recall"),
            (covered / F.greatest(F.lit(1), F.size(found))).alias("context_precision"),
        ]
    return rows.select("*", *out)


def mode_summary(metrics: DataFrame, mode: str = "mode", baseline: str = "raw") -> DataFrame:
    """Means by mode and the gain of each mode over the baseline mode (one row, so it is broadcast)."""
    means = metrics.groupBy(mode).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in METRICS))
    base = means.where(F.col(mode) == baseline).select(*(F.col(m).alias(f"base_{m}") for m in METRICS)).limit(1)
    return means.join(F.broadcast(base), how="left").select(mode, "n", *METRICS, *((F.col(m) - F.col(f"base_{m}")).alias(f"gain_{m}") for m in METRICS))


def compare_runs(left: DataFrame, right: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """Full outer comparison of ranked id lists: exact, same set in another order, or different."""
    both = left.select(*keys, F.col(ids).alias("l")).join(right.select(*keys, F.col(ids).alias("r")), keys, "full_outer")
    state = (
        F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").when(F.col("l") == F.col("r"), "exact")
        .when(F.sort_array("l") == F.sort_array("r"), "reordered").otherwise("different")
    )
    return both.select(*keys, state.alias("state"), F.size(F.array_intersect(F.coalesce("l", F.array().cast(left.schema[ids].dataType)), F.coalesce("r", F.array().cast(left.schema[ids].dataType)))).alias("shared"))


def confidence(scores: Column, affinity: Column | None = None) -> Column:
    """Confidence from ranked scores in -1..1: top 1 and mean of top 3, with memory affinity if given."""
    unit = F.transform(F.slice(scores, 1, 3), lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s + 1) / 2)))
    top3 = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(unit), F.lit(1))
    top1 = F.coalesce(F.get(unit, F.lit(0)), F.lit(0.0))
    if affinity is None:
        value = 0.70 * top1 + 0.30 * top3
    else:
        value = 0.45 * top1 + 0.20 * top3 + 0.35 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (affinity + 1) / 2))
    return F.when(F.size(scores) == 0, 0.0).otherwise(value)
