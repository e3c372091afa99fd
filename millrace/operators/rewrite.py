"""Query rewriting: routing, memory features, candidate scores and guards, anchors and their grounding.

Candidate texts, retrieval lists and similarities are input columns; nothing here calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.functions.text import let

# Fixed patterns, words and weights, part of the results' definition.
ROUTER_TOKEN = "[A-Za-z0-9_./:$#-]+|[가-힣]+"
TECHNICAL_ANCHOR = (
    r"(?i)(?:\b[A-Za-z][A-Za-z0-9_$]*(?:Exception|Error|Config|Configuration|Properties|Client|Template|Repository|Controller|Service|Filter|Chain|Manager|Factory)\b)"
    r"|(?:\b[A-Za-z][A-Za-z0-9_]*[./:$#-][A-Za-z0-9_./:$#-]*\b)|(?:\b[A-Z][A-Za-z0-9_]+[A-Z][A-Za-z0-9_]*\b)|(?:\b[A-Za-z]+\d+[A-Za-z0-9_]*\b)"
)
COMPLEX_TERMS = (
    "비교", "차이", "원인", "해결", "순서", "장애", "설정", "확인", "오류", "에러", "실패", "compare", "difference", "cause", "resolve", "troubleshoot", "sequence", "order",
    "failure", "error", "exception", "setting", "configuration", "check", "verify",
)
TROUBLE_TERMS = ("장애", "오류", "에러", "실패", "연결 오류", "원인", "해결", "troubleshoot", "error", "exception", "failure", "failed", "timeout", "connection error")
MULTI_CONDITION = (
    r"(?i)[A-Za-z0-9_./:$#-]+\s*(?:and|vs\.?|versus|/|,)\s*[A-Za-z0-9_./:$#-]+", r"[가-힣A-Za-z0-9_./:$#-]+(?:와|과)\s*[가-힣A-Za-z0-9_./:$#-]+",
    r"(?i)(?:에서|when|while|during).+(?:할 때|오류|장애|error|failure|exception)", r"(?:연결 오류|배포 환경|확인해야 할 설정|설정.*확인|원인.*해결)",
    r"(?i)(?:difference between|compare .+ and|check .+ configuration|deployment environment)",
)
MEMORY_WEIGHTS = {"similarity": 0.34, "chunk_overlap": 0.20, "doc_overlap": 0.12, "anchor_overlap": 0.18, "utility": 0.10, "product": 0.06}
CANDIDATE_WEIGHTS = (0.60, 0.28, 0.12)
POLICY = {
    "min_improvement": 0.03, "preservation_floor": 0.72, "max_length_ratio": 1.85, "min_retrieval_gain": 0.0,
    "verbosity": 0.08, "critical_drop": 0.22, "anchor_drop": 0.12, "coverage_floor": 0.5,
}


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.lower(text).contains(t)
    return found


def route(query: Column, agentic: bool = False, min_tokens: int = 8, rewrite_ready: Column | None = None, memory_ready: Column | None = None, inject: bool = True, agentic_first: bool = True) -> Column:
    """Struct ``(strategy, reason)``: raw, agentic, anchor-aware or selective rewrite.

    Agentic planning is off unless asked for. ``agentic_first=False`` is the other published order, which
    asks for anchors before agentic signals.
    """
    ready = F.lit(True) if rewrite_ready is None else rewrite_ready
    memory = F.lit(True) if memory_ready is None else memory_ready
    tokens = F.coalesce(F.regexp_count(query, F.lit(ROUTER_TOKEN)), F.lit(0))
    anchors = F.least(F.lit(8), F.size(F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(TECHNICAL_ANCHOR), F.lit(0)), F.lower))))
    multi = F.lit(False)
    for pattern in MULTI_CONDITION:
        multi = multi | query.rlike(pattern)
    signals = F.array_compact(F.array(
        F.when(has_any(query, COMPLEX_TERMS), "complex_terms"), F.when(multi, "multi_condition"),
        F.when((anchors >= 2) & has_any(query, TROUBLE_TERMS), "technical_troubleshooting")))
    korean = query.rlike(T.HANGUL)

    def decision(strategy: str, reason: Column | str) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    def ladder(n: Column, s: Column) -> Column:
        complex_ = (F.lit(agentic) & (tokens >= min_tokens) & (F.size(s) >= 2), decision("agentic_multi_query", F.concat(F.lit("agentic_complex_query:"), F.array_join(s, "_and_"))))
        aware = (F.lit(inject) & (n > 0), decision("anchor_aware_rewrite", "anchor_injection_enabled_and_technical_anchor_detected"))
        specific = ((n >= 2) & ~korean & (tokens >= 3), decision("raw_only", "specific_technical_query"))
        steps = [complex_, aware, specific] if agentic_first else [aware, specific, complex_]
        out = F.when(~ready, decision("raw_only", "rewrite_readiness_failed")).when(~memory, decision("raw_only", "memory_candidates_unavailable"))
        for condition, result in steps:
            out = out.when(condition, result)
        return out.otherwise(decision("selective_rewrite", "rewrite_backed_mode_ready"))

    return let(anchors, lambda n: let(signals, lambda s: ladder(n, s)))


def memory_features(rows: DataFrame, by: str = "query_id", n: int = 5) -> DataFrame:
    """Re-rank memories: ``rows(query_id, memory_id, before, similarity, target_chunks, target_doc, raw_chunks,
    raw_docs, raw_tokens, memory_tokens, utility, product)``; adds features, score and ``after``, keeps n."""
    shared = F.size(F.array_intersect("target_chunks", "raw_chunks"))
    least = F.greatest(F.lit(1), F.least(F.size(F.array_distinct("target_chunks")), F.size(F.array_distinct("raw_chunks"))))
    features = {
        "similarity_norm": unit((F.col("similarity") + 1) / 2),
        "chunk_overlap": shared / least,
        "doc_overlap": F.array_contains("raw_docs", F.col("target_doc")).cast("double"),
        "anchor_overlap": F.coalesce(F.try_divide(F.size(F.array_intersect("raw_tokens", "memory_tokens")), F.size(F.array_distinct("raw_tokens"))), F.lit(0.0)),
    }
    with_features = rows.withColumns(features)
    w = MEMORY_WEIGHTS
    score = unit(
        w["similarity"] * F.col("similarity_norm") + w["chunk_overlap"] * F.col("chunk_overlap") + w["doc_overlap"] * F.col("doc_overlap")
        + w["anchor_overlap"] * F.col("anchor_overlap") + w["utility"] * F.col("utility") + w["product"] * F.col("product"))
    scored = with_features.withColumn("rerank_score", F.bround(score, 6))
    order = Window.partitionBy(by).orderBy(F.desc("rerank_score"), F.desc("chunk_overlap"), F.desc("doc_overlap"), "before", "memory_id")
    return scored.withColumn("after", F.row_number().over(order)).where(F.col("after") <= n)


def guided_query(memories: DataFrame, most: int = 3, top: int = 5) -> DataFrame:
    """``(query_id, guided)``: the query with up to ``most`` technical hint tokens of its best memories.

    ``memories(query_id, query_text, rank, memory_text)``; a token weighs the sum of 1 / rank, ties go to
    the shorter, then the first by alphabet; tokens of the query itself do not count.
    """
    best = memories.where(F.col("rank") <= top)
    own = F.transform(T.tokens(F.col("query_text")), lambda t: t)
    hints = best.select("query_id", "rank", own.alias("own"), F.explode(F.array_distinct(T.tokens(F.col("memory_text")))).alias("token"))
    usable = hints.where(T.is_technical(F.col("token")) & ~F.array_contains("own", F.col("token")) & (F.length("token") <= 40))
    weighed = usable.groupBy("query_id", "token").agg(F.round(F.sum(1 / F.col("rank")), 9).alias("w"))
    order = Window.partitionBy("query_id").orderBy(F.desc("w"), F.length("token"), "token")
    picked = weighed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]), " ").alias("hints"))
    queries = memories.groupBy("query_id").agg(F.first("query_text").alias("query_text"))
    return queries.join(picked, "query_id", "left").select("query_id", F.concat_ws(" ", F.trim("query_text"), "hints").alias("guided"))


def preservation(raw: Column, candidate: Column, anchors: Column) -> Column:
    """Terminology preservation: 0.7 of kept technical tokens, 0.3 of kept anchors; 1 where there are none."""
    own = F.filter(F.array_distinct(T.tokens(raw)), T.is_technical)
    kept = T.tokens(candidate)
    technical = F.coalesce(F.try_divide(F.size(F.array_intersect(own, kept)), F.size(own)), F.lit(1.0))
    low = F.array_distinct(F.transform(anchors, F.lower))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(low, kept)), F.size(low)), technical)
    return F.struct(technical.alias("technical"), overlap.alias("anchors"), unit(0.7 * technical + 0.3 * overlap).alias("score"))


def memory_alignment(raw: Column, candidate: Column) -> Column:
    return unit(0.7 * unit((candidate + 1) / 2) + 0.3 * unit((candidate - raw + 1) / 2))


def coverage(text: Column, terms: Column) -> Column:
    """Share of the terms that occur in the text; 1 without terms."""
    return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: T.variant_in_text(text, t))), F.size(terms)), F.lit(1.0))


def judge_candidates(rows: DataFrame, policy: dict[str, float] = POLICY, force: bool = False) -> DataFrame:
    """Score and rejection reason of rewrite candidates.

    ``rows`` has ``query_id, seq, raw, candidate, gain, alignment, raw_reference, anchors, preserved, added,
    intent_risk, memory_index_valid, missing_target, guard``; adds ``final_score``, ``margin``, ``rejection``
    (empty if eligible).
    """
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    keyed = rows.withColumn("_p", preservation(F.col("raw"), F.col("candidate"), F.col("anchors")))
    keyed = keyed.withColumn("length_ratio", F.greatest(F.lit(1), F.length(bare(F.col("candidate")))) / F.greatest(F.lit(1), F.length(bare(F.col("raw")))))
    gain, term, memory = CANDIDATE_WEIGHTS
    weighted = unit((gain * F.col("gain") + term * F.col("_p.score") + memory * F.col("alignment")) / (gain + term + memory))
    penalties = (
        F.greatest(F.lit(0.0), F.col("length_ratio") - 1) * policy["verbosity"] + F.greatest(F.lit(0.0), 1 - F.col("_p.technical")) * policy["critical_drop"]
        + F.greatest(F.lit(0.0), 1 - F.col("_p.anchors")) * policy["anchor_drop"])
    scored = keyed.withColumn("final_score", F.round(unit(weighted - penalties), 9)).withColumn("margin", F.round(F.col("final_score") - F.col("raw_reference"), 9))
    same = F.lower(T.single_spaced(F.col("raw"))) == F.lower(T.single_spaced(F.col("candidate")))
    reasons = (
        (same, "candidate_same_as_raw"), (F.col("intent_risk") == "high", "intent_risk_high"), (~F.col("memory_index_valid"), "invalid_source_memory_index"),
        (coverage(F.col("candidate"), F.col("preserved")) < policy["coverage_floor"], "preserved_raw_terms_missing"),
        (coverage(F.col("candidate"), F.col("added")) < policy["coverage_floor"], "added_anchor_coverage_below_floor"),
        (F.col("length_ratio") > policy["max_length_ratio"], "verbosity_exceeds_limit"), (F.col("_p.score") < policy["preservation_floor"], "preservation_below_floor"),
        (F.col("gain") < policy["min_retrieval_gain"], "retrieval_gain_below_floor"), (F.col("missing_target"), "missing_memory_target"),
        (F.col("guard") & F.lit(not force), "raw_loss_guard_top1_lost"), ((F.col("margin") < policy["min_improvement"]) & F.lit(not force), "delta_below_threshold"),
    )
    ladder = F.lit("")
    for condition, reason in reversed(reasons):
        ladder = F.when(condition, reason).otherwise(ladder)
    return scored.withColumns({"preservation": F.col("_p.score"), "rejection": ladder}).drop("_p")


#: What becomes of a query whose candidates could not be made.
FAILURE_POLICIES = ("fail_run", "skip_to_raw", "heuristic_fallback")


def with_failure_policy(rows: DataFrame, policy: str = "fail_run") -> DataFrame:
    """``rows(query_id, made, heuristic)`` with the ``candidates`` that are judged and their ``origin``.

    ``made`` is null where the candidates of a query failed. The policy (an unknown one fails) then takes the
    heuristic candidates, or none, so that the raw query stays, or ends the run with an error that names the query.
    """
    name = policy.strip().lower().replace("-", "_")
    failed = F.col("made").isNull()
    if name == "heuristic_fallback":
        other = F.col("heuristic")
    elif name == "skip_to_raw":
        other = F.slice("heuristic", 1, 0)
    else:
        other = F.when(failed, F.raise_error(F.concat(F.lit("no rewrite candidates for query "), F.col("query_id").cast("string"))).cast(rows.schema["heuristic"].dataType))
    origin = F.when(~failed, "model").when(F.lit(name == "heuristic_fallback"), "heuristic").otherwise("raw")
    return rows.withColumns({"candidates": F.when(failed, other).otherwise(F.col("made")), "origin": origin})


def pick(judged: DataFrame) -> DataFrame:
    """For each query the best eligible candidate, else the best; the first of equals."""
    order = F.struct((F.col("rejection") == "").cast("int"), "final_score", -F.col("seq"))
    return judged.groupBy("query_id").agg(F.max_by(F.struct("seq", "candidate", "final_score", "rejection"), order).alias("best")).select("query_id", "best.*", (F.col("best.rejection") == "").alias("applied"))


def simple_decision(rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """The other published rule: the most confident candidate (0.6 top 1, 0.3 top 3, 0.1 memory), adopted if
    it gains ``threshold`` over the raw query. ``rows(query_id, seq, candidate, top1, top3, memory, raw_confidence)``."""
    confident = rows.withColumn("confidence", 0.6 * F.col("top1") + 0.3 * F.col("top3") + 0.1 * F.col("memory"))
    best = confident.groupBy("query_id").agg(F.max_by(F.struct("candidate", "confidence", "raw_confidence"), F.struct("confidence", -F.col("seq"))).alias("b"))
    return best.select("query_id", "b.candidate", "b.confidence", (F.col("b.confidence") - F.col("b.raw_confidence") >= threshold).alias("adopted"))


def subqueries(plans: DataFrame, n: int = 3) -> DataFrame:
    """Normalised agentic plans: ``plans(query_id, query, items array<struct<text, weight>>)``.

    Blank and repeated texts (in either case) go, weights lie in 0..1, at most n stay; without any the
    query itself is the plan.
    """
    spread = plans.select("query_id", F.posexplode("items").alias("pos", "item")).where(F.trim("item.text") != "")
    first = spread.select("query_id", "pos", F.trim("item.text").alias("text"), unit(F.coalesce("item.weight", F.lit(1.0))).alias("weight"))
    unique = first.groupBy("query_id", F.lower("text").alias("_k")).agg(F.min_by(F.struct("pos", "text", "weight"), "pos").alias("x")).select("query_id", "x.*")
    kept = unique.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("place") <= n).drop("pos")
    bare = plans.join(kept, "query_id", "left_anti").select("query_id", F.col("query").alias("text"), F.lit(1.0).alias("weight"), F.lit(1).alias("place"))
    return kept.select("query_id", "text", "weight", "place").unionByName(bare)


def resolve_anchors(aliases: DataFrame, approved: DataFrame, terms: DataFrame) -> DataFrame:
    """Resolution of ``aliases(alias_id, normal)``: one approved mapping is mapped, several ambiguous; else the
    term's own form decides likewise; else a miss. ``approved(normal, term_id)``, ``terms(normal, term_id)``."""
    count = lambda df, name: df.groupBy("normal").agg(F.count_distinct("term_id").alias(f"n_{name}"), F.min("term_id").alias(f"id_{name}"))
    joined = aliases.join(count(approved, "map"), "normal", "left").join(count(terms, "own"), "normal", "left")
    status = (
        F.when(F.col("n_map") == 1, "mapped").when(F.col("n_map") > 1, "ambiguous").when(F.col("n_own") == 1, "self_fallback")
        .when(F.col("n_own") > 1, "ambiguous_self_fallback").otherwise("miss"))
    term = F.when(status == "mapped", F.col("id_map")).when(status == "self_fallback", F.col("id_own"))
    return joined.select("alias_id", "normal", status.alias("status"), term.alias("term_id"), term.isNotNull().alias("used_for_scoring"))


def expand_anchors(seeds: DataFrame, relations: DataFrame, per_seed: int = 2, total: int = 8, floor: float = 0.5) -> DataFrame:
    """Related terms of each query's seeds: at most ``per_seed`` for a seed, then ``total`` for the query.

    ``seeds(query_id, seed, priority)``, ``relations(seed, related, score)``; a related term that is a seed
    does not count, and comes once, under its best seed.
    """
    own = seeds.groupBy("query_id").agg(F.collect_set("seed").alias("own"))
    joined = seeds.join(relations.where(F.col("score") >= floor), "seed").join(own, "query_id").where(~F.array_contains("own", F.col("related")))
    ranked = joined.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.desc("score"), "related"))).where(F.col("k") <= per_seed)
    once = ranked.groupBy("query_id", "related").agg(F.max_by(F.struct("seed", "priority", "score"), F.struct("priority", "score", "seed")).alias("x"))
    order = Window.partitionBy("query_id").orderBy(F.desc("x.priority"), F.desc("x.score"), "related")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= total).select("query_id", "related", "x.seed", "x.score", "place")


def grounding(raw: Column, final: Column, expected_chunk: Column, expected_doc: Column, retrieved: Column, memory: Column, glossary: Column, added: Column) -> Column:
    """Grounding, intent, drift, overall score and label of an anchor from where it appears."""
    support = F.when(expected_chunk, 1.0).when(expected_doc, 0.75).when(retrieved, 0.55).when(memory, 0.35).when(glossary, 0.25).otherwise(0.0)
    expected = expected_chunk | expected_doc
    intent = (
        F.when(raw & final, 1.0).when(final & expected, 0.85).when(expected, 0.70).when(final & retrieved, 0.55).when(final & (memory | glossary), 0.45).when(final, 0.25).otherwise(0.0))
    weak = retrieved | memory | glossary
    drift = F.when((raw & final) | expected_chunk, 0.0).when(expected_doc, 0.15).when(weak, 0.30).when(added & final, 0.85).when(final, 0.60).otherwise(0.40)
    overall = unit(0.55 * support + 0.35 * intent - 0.25 * drift + F.when(raw & final, 0.10).otherwise(0.0))
    grounded = expected | weak
    label = (
        F.when(final & added & ~grounded, "risky").when(final & ~grounded, "unsupported").when(expected_chunk | (overall >= 0.70) | (raw & final & grounded), "useful")
        .when(expected_doc | weak | (overall >= 0.40), "neutral").otherwise("unknown"))
    return F.struct(support.alias("grounding"), intent.alias("intent"), drift.alias("drift"), overall.alias("overall"), label.alias("label"))


def subquery_search(packs: DataFrame, subqueries: DataFrame, pool: int = 10, k: int = 10) -> DataFrame:
    """Agentic retrieval: each subquery searches on its own (BM25), the lists of a query meet by reciprocal ranks.

    ``subqueries(query_id, seq, text)``; gives ``(query_id, doc_id, rrf, best, rank)``. All subqueries are
    searched in the same passes over the packs, told apart by a number made of query and place; no pair of subquery and document is shuffled.
    """
    from millrace.operators import retrieve, search

    asked = subqueries.select(F.xxhash64("query_id", "seq").alias("item_id"), "query_id", "seq", "text")
    found = search.lists(packs, asked.select("item_id", "text"), pool, (1,)).select(F.col("query_id").alias("item_id"), "doc_id", "score", "rank")
    lists = found.join(asked.select("item_id", "query_id", F.col("seq").alias("source")), "item_id").select("query_id", "source", "doc_id", "score", "rank")
    return retrieve.rrf(lists, k).select("query_id", "doc_id", "rrf", "best", "rank")
