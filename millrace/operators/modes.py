"""Evaluation modes as one plan: what modes share is computed once, and each mode reads its part.

Raw queries and the subqueries of agentic plans are units; their lists and memories come from one pass.
All texts that any mode wants to try, candidates and memory-guided queries alike, are judged together in a
second pass, told apart by a ``group``; equal texts are retrieved once. The modes are views of these two
results, united with a column ``mode``; the router's view takes each query's rows from the mode it chose.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.functions import text as T
from millrace.operators import evaluate, hints, retrieve, rewrite, selective
from millrace.sources.stored import durable

#: Groups of candidates, and the modes that are decisions over them.
DECISIONS = {"selective_rewrite": "plain", "rewrite_always": "always", "selective_rewrite_with_session": "session", "anchor_aware_rewrite": "anchors"}
#: Memory modes and the gating preset that each asks.
PRESETS = {"memory_only_ungated": "ungated", "memory_only_rule_only": "rule_only", "memory_only_full_gating": "full_gating"}
ANCHORS_ADDED = 3


def units_of(samples: DataFrame, plans: DataFrame) -> DataFrame:
    """``(unit, query_id, seq, text, profile, product, previous_question, previous_summary)``: each query (seq 0) and its subqueries."""
    whole = samples.select("query_id", F.lit(0).alias("seq"), "text", "profile", "product", "previous_question", "previous_summary")
    none = F.lit(None).cast("string")
    parts = plans.select("query_id", "seq", F.col("text").alias("part")).join(samples.select("query_id", "profile", "product"), "query_id")
    parts = parts.select("query_id", F.col("seq").cast("int").alias("seq"), F.col("part").alias("text"), "profile", "product", none.alias("previous_question"), none.alias("previous_summary"))
    return whole.unionByName(parts).select(F.xxhash64("query_id", "seq").alias("unit"), "*")


def _row(group: str, seq: int, label: str, text: Column, index: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(group).alias("group"), F.lit(seq).alias("seq"), F.lit(label).alias("label"), text.alias("text"), none.alias("preserved"), none.alias("added"), (F.lit(0) if index is None else index).cast("int").alias("source_memory"), F.lit("low").alias("intent_risk"))


def candidates_of(state: DataFrame) -> DataFrame:
    """Candidates of every group for ``state`` of units (``query_id`` is the unit) with guided texts; subqueries have the plain ones only."""
    raw, guided = F.col("text"), F.col("guided")
    before, summary = F.col("previous_question"), F.col("previous_summary")
    session = P.standalone_text(raw, before, summary)
    trusted = F.filter("memories", lambda m: m["trusted"])
    anchors = F.transform(hints.anchor_candidates(raw, trusted, T.guess_language(raw)), lambda a: a["term"])
    fresh = F.slice(F.filter(anchors, lambda a: ~F.lower(raw).contains(F.lower(a))), 1, ANCHORS_ADDED)
    expanded = lambda group, text: [_row(group, 1, "standalone", text), F.when(F.size("memories") > 0, _row(group, 2, "expanded", F.concat(text, F.substr(guided, F.length(raw) + 1)), F.lit(1)))]
    anchored = F.when(F.size(fresh) > 0, _row("anchors", 3, "anchored", F.concat_ws(" ", raw, F.array_join(fresh, " "))))
    every = F.array(*expanded("plain", raw), *expanded("always", raw), *expanded("session", session), *expanded("anchors", raw), anchored)
    spread = state.select("query_id", "seq", F.explode(F.array_compact(every)).alias("x")).where("seq = 0 OR x.group = 'plain'")
    return spread.select("query_id", "x.*")


def guided_texts(samples: DataFrame, memories: Mapping[str, DataFrame], retrievers: Mapping[str, selective.Retriever], n: int = 5) -> DataFrame:
    """``(preset, query_id, guided)``: each query with hints of its nearest memories of each preset; only where hints make it another text."""
    found = []
    for preset, held in memories.items():
        near = retrievers[preset].pool(samples, n).join(held.select("memory_id", F.col("query_text").alias("memory_text")), "memory_id").join(samples.select("query_id", "text"), "text")
        guided = rewrite.guided_query(near.select("query_id", F.col("text").alias("query_text"), F.col("before").alias("rank"), "memory_text"))
        found.append(guided.select(F.lit(preset).alias("preset"), "query_id", "guided"))
    every = reduce(DataFrame.unionByName, found).join(samples.select("query_id", "text"), "query_id")
    return every.where(F.lower(T.single_spaced(F.col("guided"))) != F.lower(T.single_spaced(F.col("text")))).drop("text")


def run_modes(samples: DataFrame, plans: DataFrame, memories: Mapping[str, DataFrame], retrievers: Mapping[str, selective.Retriever], preset: str = "full_gating", policy: selective.Policy | None = None, agentic: bool = True, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(mode, query_id, doc_id, score, rank)`` of all eleven modes, and ``(mode, query_id, applied, reason, chosen)``.

    ``samples(query_id, text, profile, product, previous_question, previous_summary)``, ``plans(query_id, seq,
    text)`` (seq from 1), ``memories`` and ``retrievers`` by preset; ``preset`` is the one that gated memories
    and rewrites use. A query without a plan is its own plan. A query for which nothing is retrieved has no rows.
    """
    units = units_of(samples, plans)
    as_samples = units.select(F.col("unit").alias("query_id"), "text", "profile", "product")
    full = selective.with_memories(as_samples, memories[preset], retrievers[preset])
    hinted = full.select("query_id", "text", F.posexplode_outer("memories").alias("pos", "m")).select("query_id", F.col("text").alias("query_text"), (F.col("pos") + 1).alias("rank"), F.col("m.query_text").alias("memory_text"))
    more = units.select(F.col("unit").alias("query_id"), F.col("query_id").alias("parent"), "seq", "previous_question", "previous_summary")
    state = durable(full.join(rewrite.guided_query(hinted), "query_id").join(more, "query_id"))  # what all modes read of the raw queries

    guided = guided_texts(samples, memories, retrievers)
    as_rows = guided.select(F.xxhash64("query_id", F.lit(0)).alias("query_id"), F.col("guided"), "preset").select("query_id", _row("", 1, "guided", F.col("guided"), F.lit(0)).alias("x"), F.concat(F.lit("memory_"), "preset").alias("g"))
    tried = candidates_of(state).unionByName(as_rows.select("query_id", "x.*", "g").withColumn("group", F.col("g")).drop("g"))
    judged = durable(selective.judge(state, tried, retrievers[preset], policy, force=F.col("group") == "always").select("query_id", "group", "seq", "label", "text", "final_score", "raw_reference", "rejection", "ids", "scores"))

    whole = state.where("seq = 0")
    raw = whole.select(F.lit("raw_only").alias("mode"), F.col("parent").alias("query_id"), F.posexplode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("scores").alias("score"))).alias("pos", "x")).select("mode", "query_id", "x.doc_id", "x.score", (F.col("pos") + 1).alias("rank"))
    groups = F.array(*(F.lit(g) for g in DECISIONS.values()))
    asked = state.withColumn("group", F.explode(groups)).where("seq = 0 OR group = 'plain'")
    decided = durable(selective.decide(asked, judged.where(F.col("group").isin(*DECISIONS.values())), ("group", "query_id")).withColumnRenamed("seq", "candidate"))
    finals = selective.final_lists(decided, "replace", k, ("group", "query_id")).join(more.select("query_id", "parent", "seq"), "query_id")
    lists = [raw]
    lists += [finals.where((F.col("group") == g) & (F.col("seq") == 0)).select(F.lit(mode).alias("mode"), F.col("parent").alias("query_id"), "doc_id", "score", "rank") for mode, g in DECISIONS.items()]

    # a plan's subqueries, each decided on its own, meet by reciprocal ranks; the query itself stands for a missing plan
    planned = more.where("seq > 0").select("parent").distinct()
    parts = finals.where("group = 'plain'").join(planned.withColumn("planned", F.lit(True)), "parent", "left").where("(seq > 0) = coalesce(planned, false)")
    merged = retrieve.rrf(parts.select(F.col("parent").alias("query_id"), F.col("seq").alias("source"), "doc_id", "score", "rank"), k)
    lists.append(merged.select(F.lit("agentic_multi_query").alias("mode"), "query_id", "doc_id", F.col("rrf").alias("score"), "rank"))

    tried_memories = whole.select("query_id", "parent", F.col("ids").alias("raw_ids"), F.col("scores").alias("raw_scores"))
    for mode, name in {**PRESETS, "memory_only_gated": preset}.items():
        of = judged.where(F.col("group") == f"memory_{name}").select("query_id", F.col("ids").alias("new_ids"), F.col("scores").alias("new_scores"))
        both = tried_memories.join(of, "query_id", "left").select(F.col("parent").alias("query_id"), "raw_ids", "raw_scores", "new_ids", "new_scores")
        lists.append(selective.final_lists(both, "max_score", k).select(F.lit(mode).alias("mode"), "query_id", "doc_id", "score", "rank"))

    routed = whole.select(F.col("parent").alias("query_id"), rewrite.route(F.col("text"), agentic=agentic, memory_ready=F.lit(True)).alias("r")).select("query_id", F.col("r.strategy").alias("chosen"), F.col("r.reason").alias("router_reason"))
    every = durable(reduce(DataFrame.unionByName, lists))
    router = every.join(routed.select("query_id", F.col("chosen").alias("mode")), ["query_id", "mode"]).select(F.lit("strategy_router").alias("mode"), "query_id", "doc_id", "score", "rank")

    own = decided.join(more.select("query_id", "parent", "seq"), "query_id").where("seq = 0")
    names = F.create_map(*(F.lit(x) for mode, g in DECISIONS.items() for x in (g, mode)))
    decisions = own.select(names[F.col("group")].alias("mode"), F.col("parent").alias("query_id"), "applied", "reason", F.lit(None).cast("string").alias("chosen"))
    decisions = decisions.unionByName(routed.select(F.lit("strategy_router").alias("mode"), "query_id", (F.col("chosen") != "raw_only").alias("applied"), F.col("router_reason").alias("reason"), "chosen"))
    return every.unionByName(router), decisions


def mode_metrics(lists: DataFrame, expected: DataFrame, samples: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """``(mode, query_id)`` with retrieval metrics of every mode and every sample with expected items; nothing retrieved counts as nothing found."""
    sample = F.struct("mode", "query_id").alias("sample_id")
    ranked = lists.select(sample, F.col("doc_id").alias("item_id"), "rank")
    every = expected.join(samples.select("query_id"), "query_id", "left_semi").withColumn("mode", F.explode(F.array(*(F.lit(m) for m in modes))))
    found = evaluate.retrieval_metrics(ranked, every.select(sample, F.col("doc_id").alias("item_id")))
    return found.select("sample_id.mode", "sample_id.query_id", *evaluate.METRICS, "first_rank")
