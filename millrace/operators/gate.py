"""Quality gates for generated queries: rules, model scores, retrieval utility, diversity, decisions.

Stage results are three-valued: null means the stage did not run. Scores of language models and
rerankers are input columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

# Fixed default weights and limits, part of the results' definition.
UTILITY = {
    "target_top1": 1.00, "target_top3": 0.85, "target_top5": 0.70, "target_top10": 0.60, "same_doc_top3": 0.55, "same_doc_top5": 0.40,
    "outside_top5": 0.00, "multi_partial_bonus": 0.05, "multi_full_bonus": 0.12,
}
FINAL = {"utility": 0.50, "llm": 0.35, "novelty": 0.15}
LLM_FIELDS = {"grounded": 4, "answerable": 3, "user_like": 3, "naturalness": 3, "copy_control": 3}
STAGES = ("rule_filter", "llm_self_eval", "retrieval_utility", "diversity_dedup", "final_score")


@dataclass(frozen=True)
class GateConfig:
    """Which stages run, and their limits."""

    preset: str = "full_gating"
    enabled: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(STAGES[:4], True))
    utility_threshold: float = 0.70
    same_chunk: float = 0.93
    same_doc: float = 0.96
    final_threshold: float = 0.75
    min_tokens: int = 2
    max_tokens: int = 20
    special: float = 0.20


def rule_reasons(text: Column, source: Column, english: Column, short: Column, code_mixed: Column, exempt: Column, config: GateConfig = GateConfig()) -> Column:
    """Reasons, in a fixed order, why a query text breaks the rules; empty if it passes."""
    plain = F.trim(text)
    size = F.length(plain)
    least = F.when(short, 4).otherwise(8)
    most = F.when(short, F.when(english, 120).otherwise(60)).otherwise(F.when(english, 200).otherwise(100))
    count = T.token_count(plain)
    copied = T.copy_ratio(plain, source, 4)
    floor = F.when(code_mixed, 0.20).otherwise(0.40)
    checks = {
        "length_out_of_range": (size < least) | (size > most),
        "token_count_out_of_range": (count < config.min_tokens) | (count > config.max_tokens),
        "special_ratio_high": ~exempt & (T.special_ratio(plain) > config.special),
        "copy_ratio_high": copied > F.when(english, 0.85).otherwise(0.60),
        "korean_ratio_low": (~english | code_mixed) & (T.korean_ratio(plain) < floor),
    }
    return F.array_compact(F.array(*(F.when(bad, reason) for reason, bad in checks.items())))


def llm_pass(scores: Column) -> Column:
    """Whether every field of a score struct reaches its limit."""
    ok = F.lit(True)
    for name, least in LLM_FIELDS.items():
        ok = ok & (scores[name] >= least)
    return ok


def llm_mean(scores: Column) -> Column:
    return sum((scores[name] for name in LLM_FIELDS), F.lit(0)) / (5.0 * len(LLM_FIELDS))


def rank_value(rank: Column, weights: dict[str, float] = UTILITY) -> Column:
    return (
        F.when(rank == 1, weights["target_top1"]).when(rank <= 3, weights["target_top3"]).when(rank <= 5, weights["target_top5"])
        .when(rank <= 10, weights["target_top10"]).otherwise(weights["outside_top5"])
    )


def utility(ranks: Column, targets: Column, doc_rank: Column, single: Column, weights: dict[str, float] = UTILITY) -> Column:
    """Retrieval utility from the ranks of found targets (array), the number of targets, and the best rank
    of the target document (used only where several targets were wanted and none was found)."""
    hits, best = F.size(ranks), F.array_min(ranks)
    bonus = F.when(hits == 1, weights["multi_partial_bonus"]).when(hits >= 2, weights["multi_full_bonus"]).otherwise(0.0)
    fallback = F.when(doc_rank <= 3, weights["same_doc_top3"]).when(doc_rank <= 5, weights["same_doc_top5"]).otherwise(F.least(F.lit(1.0), F.lit(weights["outside_top5"])))
    many = F.when(hits == 0, fallback).otherwise(F.least(F.lit(1.0), rank_value(best, weights) + bonus))
    return F.when(single | (targets <= 1), rank_value(F.get(ranks, F.lit(0)), weights)).otherwise(many)


def decide(rows: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """Stage results and decision for rows with ``rule_ok``, ``llm_ok``, ``llm_avg``, ``utility``,
    ``diversity_ok`` and ``novelty``: three-valued ``pass_<stage>``, ``final_score``, ``accepted``,
    ``rejected_stage``. A disabled stage passes; a stage after a failed one is null."""
    on = config.enabled
    yes, unknown = F.lit(True), F.lit(None).cast("boolean")
    failed = lambda c: F.coalesce(~c, F.lit(False))
    rule = F.col("rule_ok") if on["rule_filter"] else yes
    one = rows.withColumn("pass_rule_filter", rule)
    one = one.withColumn("pass_llm_self_eval", F.when(F.col("pass_rule_filter"), F.col("llm_ok")).otherwise(unknown) if on["llm_self_eval"] else yes)
    one = one.withColumn("_run_utility", F.col("pass_rule_filter") & ~failed(F.col("pass_llm_self_eval")))
    useful = F.col("utility") >= config.utility_threshold
    one = one.withColumn("pass_retrieval_utility", F.when(F.col("_run_utility"), useful).otherwise(unknown) if on["retrieval_utility"] else yes)
    one = one.withColumn("_run_diversity", F.col("_run_utility") & ~failed(F.col("pass_retrieval_utility")))
    one = one.withColumn("pass_diversity_dedup", F.when(F.col("_run_diversity"), F.col("diversity_ok")).otherwise(unknown) if on["diversity_dedup"] else yes)
    final = FINAL["utility"] * F.col("utility") + FINAL["llm"] * F.coalesce(F.col("llm_avg"), F.lit(0.0)) + FINAL["novelty"] * F.col("novelty")
    one = one.withColumn("final_score", F.when(F.col("_run_diversity") & ~failed(F.col("pass_diversity_dedup")), final))
    one = one.withColumn("pass_final_score", F.col("final_score") >= config.final_threshold)
    bad = {s: failed(F.col(f"pass_{s}")) for s in STAGES}
    counted = {"ungated": (), "rule_only": STAGES[:1], "rule_plus_llm": STAGES[:2]}.get(config.preset, STAGES)
    accepted = yes
    for s in counted:
        accepted = accepted & ~bad[s]
    stage = F.lit("approved")
    for s in reversed(STAGES):
        if s == "final_score" or on[s]:
            stage = F.when(bad[s], s).otherwise(stage)
    return one.drop("_run_utility", "_run_diversity").withColumns({"accepted": accepted, "rejected_stage": stage})


def funnel(decided: DataFrame, by: list[str]) -> DataFrame:
    """Counts of rows that passed each stage and all before it, one pass."""
    counts, passed = [F.count(F.lit(1)).alias("generated")], F.lit(True)
    for s in STAGES[:4]:
        passed = passed & F.coalesce(F.col(f"pass_{s}"), F.lit(False))
        counts.append(F.count_if(passed).alias(s))
    return decided.groupBy(*by).agg(*counts, F.count_if("accepted").alias("accepted"))


def history(decided: DataFrame, id_col: str) -> DataFrame:
    """One row for each query and stage: ``stage_order, stage_name, passed``."""
    rows = F.array(*(F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage_name"), F.col(f"pass_{s}").alias("passed")) for i, s in enumerate(STAGES, 1)))
    return decided.select(id_col, F.inline(rows))


def full_history(decided: DataFrame, id_col: str) -> DataFrame:
    """One row for each query and each of six stages, approval the last: ``stage_order, stage_name, passed, score, reason``.

    ``decided`` is that of :func:`decide`, with ``reasons`` (array) of the rule stage. A stage that passed
    or was not run has no reason; the rule stage has no score.
    """
    failed = lambda s, why: F.when(~F.coalesce(F.col(f"pass_{s}"), F.lit(True)), why)
    rules = F.nullif(F.array_join("reasons", ","), F.lit(""))
    rows = [
        (F.col("pass_rule_filter"), F.lit(None).cast("double"), rules), (F.col("pass_llm_self_eval"), F.col("llm_avg"), failed("llm_self_eval", "llm_self_eval_failed")), (F.col("pass_retrieval_utility"), F.col("utility"), failed("retrieval_utility", "utility_failed")),
        (F.col("pass_diversity_dedup"), F.col("novelty"), failed("diversity_dedup", "diversity_failed")), (F.col("pass_final_score"), F.col("final_score"), failed("final_score", "final_score_failed")),
        (F.col("accepted"), F.col("final_score"), F.when(~F.col("accepted"), F.col("rejected_stage"))),
    ]
    names = (*STAGES, "approved")
    spread = F.array(*(F.struct(F.lit(i).alias("stage_order"), F.lit(n).alias("stage_name"), p.alias("passed"), s.cast("double").alias("score"), r.alias("reason")) for i, (n, (p, s, r)) in enumerate(zip(names, rows, strict=True), 1)))
    return decided.select(id_col, F.inline(spread))


def stage_results(decided: DataFrame, by: str) -> DataFrame:
    """Input, passed and rejected counts of each stage: the passed of one are the input of the next."""
    from pyspark.sql.window import Window

    counts = funnel(decided, [by])
    steps = F.array(*(F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage_name"), F.col(s).alias("passed_count")) for i, s in enumerate(STAGES[:4], 1)))
    flat = counts.select(by, "generated", F.inline(steps))
    before = F.coalesce(F.lag("passed_count").over(Window.partitionBy(by).orderBy("stage_order")), F.col("generated"))
    return flat.select(by, "stage_order", "stage_name", before.alias("input_count"), "passed_count", (before - F.col("passed_count")).alias("rejected_count"))


def cutoff(decided: DataFrame, level: str) -> DataFrame:
    """Rows that no stage up to ``level`` rejected (null counts as passed)."""
    for s in STAGES[: STAGES.index(level) + 1]:
        decided = decided.where(F.coalesce(F.col(f"pass_{s}"), F.lit(True)))
    return decided


def resume_counters(results: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """One row of counters replayed from persisted results ``(id, created_at, accepted, pass_<stage>)``: rows by stage passed, decisions, and the last id processed.

    A stage that is switched off counts as passed.
    """
    passed, stages = F.lit(True), []
    for s in STAGES[:4]:
        passed = passed & F.coalesce(F.col(f"pass_{s}"), F.lit(not config.enabled[s]))
        stages.append(F.count_if(passed).alias(s))
    yes = F.coalesce(F.col("accepted"), F.lit(False))
    last = F.max_by("id", F.struct("created_at", "id")).alias("last_processed")
    return results.agg(F.count(F.lit(1)).alias("generated"), *stages, F.count_if(yes).alias("final_approved"), F.count_if(~yes).alias("rejected"), last)


def resume_rejections(results: DataFrame) -> DataFrame:
    """``(reason, n)`` of rejected persisted results: all their reasons, or the one reason kept where there is no list."""
    listed = F.filter(F.coalesce("rejection_reasons", F.array().cast("array<string>")), lambda r: F.trim(r) != "")
    kept = F.when(F.size(listed) > 0, listed).when(F.coalesce("rejected_reason", F.lit("")) != "", F.array("rejected_reason")).otherwise(F.array().cast("array<string>"))
    return results.where(~F.coalesce(F.col("accepted"), F.lit(False))).select(F.explode(kept).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def accepted_seeds(results: DataFrame, raw: DataFrame) -> DataFrame:
    """``(batch, seq, id, chunk_id, doc_id, query_text)`` of the accepted, in the order they were decided: what a resumed run compares with first."""
    from pyspark.sql.window import Window

    kept = results.where("accepted").select("id", "created_at", "batch")
    order = Window.partitionBy("batch").orderBy("created_at", "id")
    return kept.join(raw, "id").withColumn("seq", F.row_number().over(order)).select("batch", "seq", "id", "chunk_id", "doc_id", "query_text")


def sequential_gate(rows: DataFrame, config: GateConfig = GateConfig(), batch: str = "batch", order: str = "seq") -> DataFrame:
    """``(batch, id, diversity_ok, novelty)``: what each query of a gating batch is compared with are the queries accepted before it.

    ``rows(batch, order, id, chunk_id, doc_id, embedding, rule_ok, llm_ok, llm_avg, utility)``, all stages
    before diversity decided. Diversity looks at the accepted of the same chunk and of the same document,
    novelty (1 minus the greatest cosine) at all accepted of the batch; a query is accepted as :func:`decide`
    accepts it, so later rows depend on earlier ones. Rows of a batch stream through one task in order (ties
    by id) with the accepted vectors as carried state; batches run in parallel, null is a batch, chunk and document
    like any other. A stage that does not run gives nulls.
    """
    import numpy as np
    import pyarrow as pa

    on, counted = config.enabled, {"ungated": 0, "rule_only": 1, "rule_plus_llm": 2}.get(config.preset, 5)

    class Accepted:
        def __init__(self) -> None:
            self.vectors, self.places = np.zeros((64, 1)), {}
            self.n = 0

        def greatest(self, v: np.ndarray, key=None) -> float:
            at = slice(0, self.n) if key is None else self.places.get(key, [])
            near = self.vectors[at] @ v if v.shape[0] == self.vectors.shape[1] else np.zeros(0)
            return float(near.max()) if len(near) else 0.0

        def add(self, v: np.ndarray, *keys) -> None:
            if self.n == 0:
                self.vectors = np.zeros((64, len(v)))
            if self.n == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            if len(v) == self.vectors.shape[1]:
                self.vectors[self.n] = v
                for k in keys:
                    self.places.setdefault(k, []).append(self.n)
                self.n += 1

    def run(batches):
        now, held = object(), Accepted()
        for part in batches:
            ok, fresh = [], []
            for r in part.to_pylist():
                if r["batch"] != now:
                    now, held = r["batch"], Accepted()
                rule = r["rule_ok"] is not False if on["rule_filter"] else True
                llm = (r["llm_ok"] if rule else None) if on["llm_self_eval"] else True
                runs = rule and llm is not False
                useful = (r["utility"] >= config.utility_threshold if runs else None) if on["retrieval_utility"] else True
                runs = runs and useful is not False
                good = novelty = final = None
                v = np.asarray(r["embedding"] or [], float)
                v = v / norm if (norm := np.linalg.norm(v)) > 0 else v
                chunk, doc = ("chunk", r["chunk_id"]), ("doc", r["doc_id"])
                if runs:
                    novelty = max(0.0, 1.0 - held.greatest(v))
                    good = held.greatest(v, chunk) <= config.same_chunk and held.greatest(v, doc) <= config.same_doc
                    if good or not on["diversity_dedup"]:
                        final = FINAL["utility"] * r["utility"] + FINAL["llm"] * (r["llm_avg"] or 0.0) + FINAL["novelty"] * novelty >= config.final_threshold
                passed = (rule, llm, useful, good if on["diversity_dedup"] else True, final)
                if all(x is not False for x in passed[:counted]):
                    held.add(v, chunk, doc)
                ok.append(good)
                fresh.append(novelty)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_()), pa.array(fresh, pa.float64())], names=["batch", "id", "diversity_ok", "novelty"])

    slim = rows.select(F.col(batch).cast("string").alias("batch"), F.col("id").cast("bigint").alias("id"), F.col(order).alias("_o"), "chunk_id", "doc_id", "embedding", "rule_ok", "llm_ok", "llm_avg", "utility")
    dealt = slim.repartition("batch").sortWithinPartitions("batch", "_o", "id").drop("_o")
    return dealt.mapInArrow(run, "batch string, id bigint, diversity_ok boolean, novelty double")
