"""Selective rewriting from end to end: candidates are retrieved, compared with the raw list, and one is adopted or none.

Everything that a decision needs comes out of retrieval. Texts of a step are retrieved together, each
distinct text once: first the raw queries, whose lists order and mark the memories, then all candidates.
What remains is columns: gain, terminology, alignment, targets of memories, the guard against a lost raw
result, penalties, and the first reason against a candidate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.functions import text as T
from millrace.functions.text import let, single_spaced
from millrace.operators import evaluate, hints, retrieve, rewrite
from millrace.operators.rewrite import unit
from millrace.sources.stored import durable

#: Results that count for overlap with a memory's targets, and for shift and guard.
DEPTH, TOP = 10, 5
MEMORY = "array<struct<after: int, memory_id: bigint, query_text: string, similarity: double, target_chunks: array<bigint>, target_doc: bigint, product: string, glossary: array<string>, canonical: array<struct<term_id: string, variants: array<string>>>, trusted: boolean>>"
#: Canonical groups of a memory: a term and its forms.
CANONICAL = "array<struct<term_id: string, variants: array<string>>>"


@dataclass(frozen=True)
class Policy:
    """Weights, floors, penalties and bonuses (fixed values of the published rule), and what a profile of queries changes."""

    retrieval: float = 0.60
    terminology: float = 0.28
    alignment: float = 0.12
    shift: float = 0.03
    min_improvement: float = 0.03
    preservation_floor: float = 0.72
    max_length_ratio: float = 1.85
    max_compact_chars: float = 0.0
    min_gain: float = 0.0
    preserved_floor: float = 1.0
    added_floor: float = 0.67
    underspecified: float = 0.72
    guard_floor: float = 0.78
    guard_overlap: float = 0.20
    verbosity: float = 0.08
    token_drop: float = 0.22
    anchor_drop: float = 0.12
    target_missing: float = 0.10
    target_presence: float = 0.06
    hit_margin: float = 0.0
    hit_selection: float = 0.0
    profiles: dict[str, dict[str, float]] = field(default_factory=lambda: {
        "short_user": {"min_improvement": 0.02, "preservation_floor": 0.68, "max_length_ratio": 2.10, "underspecified": 0.66, "verbosity": 0.035, "target_missing": 0.06, "target_presence": 0.10},
        "code_mixed": {"min_improvement": 0.05, "preservation_floor": 0.86, "max_length_ratio": 1.60, "retrieval": 0.56, "terminology": 0.34, "alignment": 0.10},
        "troubleshooting": {"max_length_ratio": 2.20},
    })

    def of(self, profile: Column) -> Column:
        """Struct of the values for each row's profile."""
        values = {k: v for k, v in asdict(self).items() if k != "profiles"}

        def value(name: str) -> Column:
            out = F.lit(values[name])
            for key, changed in self.profiles.items():
                out = F.when(profile == key, F.lit(changed[name])).otherwise(out) if name in changed else out
            return out

        return F.struct(*(value(k).alias(k) for k in values))


@dataclass(frozen=True)
class Retriever:
    """How texts are searched: both take ``(item_id, text)`` and a number, and give ``(query_id, doc_id, score, rank)``, scores in -1..1."""

    chunks: Callable[[DataFrame, int], DataFrame]
    memories: Callable[[DataFrame, int], DataFrame]
    doc_of: Callable[[Column], Column]

    def lists(self, texts: DataFrame, k: int = DEPTH) -> DataFrame:
        """``(text, ids, docs, scores)``: the ranked list of each distinct text, retrieved once for all that share it."""
        asked = distinct_texts(texts)
        row = F.struct("rank", F.col("doc_id").alias("id"), self.doc_of(F.col("doc_id")).alias("doc"), "score")
        found = self.chunks(asked, k).groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("x"))
        joined = asked.join(found, asked["item_id"] == found["query_id"], "left")
        pick = lambda name, kind: F.coalesce(F.col("x")[name], F.array().cast(f"array<{kind}>")).alias({"id": "ids", "doc": "docs", "score": "scores"}[name])
        return joined.select("text", pick("id", "bigint"), pick("doc", "bigint"), pick("score", "double"))

    def pool(self, texts: DataFrame, n: int) -> DataFrame:
        """``(text, memory_id, similarity, before)``: the n nearest memories of each distinct text."""
        asked = distinct_texts(texts)
        return self.memories(asked, n).join(asked, F.col("query_id") == F.col("item_id")).select("text", F.col("doc_id").alias("memory_id"), F.col("score").alias("similarity"), F.col("rank").alias("before"))


def distinct_texts(texts: DataFrame) -> DataFrame:
    return texts.select("text").where("text IS NOT NULL").distinct().select(F.xxhash64("text").alias("item_id"), "text")


def own_tokens(text: Column, language: Column, content: int = 18, technical: int = 18) -> Column:
    """Content tokens and technical tokens of a text, folded."""
    return F.array_distinct(F.concat(P.content_tokens(text, content), F.transform(P.anchor_tokens(text, language, technical), F.lower)))


def with_memories(samples: DataFrame, memories: DataFrame, retriever: Retriever, pool: int = 20, n: int = 5) -> DataFrame:
    """``samples(query_id, text, profile, product)`` with raw lists ``ids, docs, scores`` and ``memories`` in re-ranked order.

    ``memories(memory_id, query_text, target_chunks, target_doc, product, glossary, utility)`` and, if there are
    any, ``canonical`` groups (array of term_id and variants). A memory is trusted if one of its targets is
    among the raw results.
    """
    if "canonical" not in memories.columns:
        memories = memories.withColumn("canonical", F.lit(None).cast(CANONICAL))
    language = T.guess_language(F.col("text"))
    raw = durable(samples.select("query_id", "text", "profile", "product").join(retriever.lists(samples), "text"))  # read for the memories and for the result
    near = retriever.pool(samples, pool).join(memories.withColumnRenamed("product", "memory_product"), "memory_id")
    rows = raw.withColumnRenamed("product", "sample_product").join(near, "text").select(
        "query_id", "memory_id", "before", "similarity", "target_chunks", "target_doc", F.slice("ids", 1, DEPTH).alias("raw_chunks"), F.slice("docs", 1, DEPTH).alias("raw_docs"), "query_text", "glossary", F.col("canonical").cast(CANONICAL).alias("canonical"), "memory_product",
        own_tokens(F.col("text"), language).alias("raw_tokens"),
        F.array_distinct(F.concat(own_tokens(F.col("query_text"), language, 18, 12), F.flatten(F.transform(F.coalesce("glossary", F.array().cast("array<string>")), lambda g: own_tokens(g, language, 8, 4))))).alias("memory_tokens"),
        unit(F.coalesce("utility", F.lit(0.0))).alias("utility"), F.coalesce((F.col("memory_product") == F.col("sample_product")).cast("double"), F.lit(0.0)).alias("product"),
    )
    ordered = rewrite.memory_features(rows, n=n)
    trusted = (F.col("chunk_overlap") > 0) | (F.col("doc_overlap") > 0)
    item = F.struct("after", "memory_id", "query_text", "similarity", "target_chunks", "target_doc", F.col("memory_product").alias("product"), "glossary", "canonical", trusted.alias("trusted"))
    held = ordered.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).cast(MEMORY).alias("memories"))
    return raw.join(held, "query_id", "left").withColumn("memories", F.coalesce("memories", F.array().cast(MEMORY)))


def ratio(part: Column, whole: Column, default: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(default))


def canonical_hits(text: Column, memories: Column) -> Column:
    """Terms of the memories' canonical groups of which a text has a form."""
    groups = F.flatten(F.transform(memories, lambda m: F.coalesce(m["canonical"], F.array().cast(CANONICAL))))
    return F.array_distinct(F.transform(F.filter(groups, lambda g: F.size(T.variants_in_text(text, g["variants"])) > 0), lambda g: g["term_id"]))


def terminology(raw: Column, candidate: Column, anchors: Column, language: Column, memories: Column | None = None) -> Column:
    """Struct ``(technical, anchors, score)``: shares of technical tokens and of anchors that the candidate kept; 1 where there are none.

    If the query mentions canonical terms of the ``memories``, the share of these that the candidate still
    mentions, in whatever form, is the least that each of the three can be.
    """
    fold = lambda a: F.array_distinct(F.transform(a, F.lower))
    own, kept = fold(P.anchor_tokens(raw, language, 24)), fold(P.anchor_tokens(candidate, language, 24))
    technical = ratio(F.size(F.array_intersect(own, kept)), F.size(own))
    wanted = fold(anchors)
    overlap = F.when(F.size(wanted) > 0, ratio(F.size(F.array_intersect(wanted, kept)), F.size(wanted))).otherwise(technical)
    if memories is None:
        return F.struct(technical.alias("technical"), overlap.alias("anchors"), unit(0.70 * technical + 0.30 * overlap).alias("score"))
    hits = F.struct(canonical_hits(raw, memories).alias("raw"), canonical_hits(candidate, memories).alias("candidate"), technical.alias("t"), overlap.alias("a"))

    def with_canonical(x: Column) -> Column:
        share = F.when(F.size(x["raw"]) > 0, F.size(F.array_intersect(x["raw"], x["candidate"])) / F.size(x["raw"])).otherwise(0.0)
        t, a = F.greatest(x["t"], share), F.greatest(x["a"], share)
        return F.struct(t.alias("technical"), a.alias("anchors"), F.greatest(unit(0.70 * t + 0.30 * a), share).alias("score"))

    return let(hits, with_canonical)


def memory_targets(raw: Column, candidate: Column, memories: Column) -> Column:
    """Struct ``(tokens, raw, candidate)``: content tokens that the first memory stands for, and how many each text has."""
    top = F.get(memories, F.lit(0))
    terms = F.flatten(F.transform(F.coalesce(top["glossary"], F.array().cast("array<string>")), lambda g: P.content_tokens(g, 8)))
    every = F.array_distinct(F.concat(F.coalesce(P.content_tokens(top["query_text"], 12), F.array().cast("array<string>")), terms))
    product = P.content_tokens(F.translate(F.coalesce(top["product"], F.lit("")), "-_", "  "), 4, generic=True)
    tokens = F.when(F.size(memories) > 0, F.array_except(every, product)).otherwise(F.array().cast("array<string>"))
    has = lambda t: F.size(F.array_intersect(P.content_tokens(t, 12), tokens))
    return F.struct(tokens.alias("tokens"), has(raw).alias("raw"), has(candidate).alias("candidate"))


def judge(state: DataFrame, candidates: DataFrame, retriever: Retriever, policy: Policy | None = None, threshold: float = 0.0, force: Column | bool = False) -> DataFrame:
    """Every candidate with what retrieval says of it, its score and its rejection (empty if it may be adopted).

    ``state`` is that of :func:`with_memories`; ``candidates(query_id, seq, label, text, preserved, added,
    source_memory, intent_risk)``. A candidate labelled standalone is judged without memories. ``force``
    lifts the guard and the least improvement.
    """
    policy, force = policy or Policy(), F.lit(force) if isinstance(force, bool) else force
    raw = state.select(
        "query_id", F.col("text").alias("raw"), F.col("ids").alias("raw_ids"), F.col("docs").alias("raw_docs"), "memories", "profile", policy.of(F.coalesce("profile", F.lit(""))).alias("p"),
        evaluate.confidence(F.col("scores")).alias("raw_score"), F.coalesce(F.get("memories", F.lit(0))["similarity"], F.lit(0.0)).alias("raw_affinity"), T.guess_language(F.col("text")).alias("language"),
    )
    texts = durable(candidates)  # read by both searches and by the join
    affinity = retriever.pool(texts, 1).select("text", F.col("similarity").alias("affinity"))
    rows = texts.join(retriever.lists(texts), "text").join(affinity, "text", "left").withColumn("affinity", F.coalesce("affinity", F.lit(0.0))).join(raw, "query_id")
    p = lambda name: F.col("p")[name]
    uses = F.lower(F.trim("label")) != "standalone"
    score = evaluate.confidence(F.col("scores"))
    shift = retrieve.retrieval_shift(F.slice("raw_ids", 1, TOP), F.slice("ids", 1, TOP))
    trusted = F.filter("memories", lambda m: m["trusted"])
    nobody = F.array().cast(MEMORY)
    anchors = F.transform(hints.anchor_candidates(F.col("raw"), F.when(uses, trusted).otherwise(nobody), F.col("language")), lambda a: a["term"])
    index, n = F.coalesce(F.col("source_memory"), F.lit(0)), F.size("memories")
    named = F.when((index > 0) & (index <= n), F.get("memories", index - 1))
    first = F.when(~uses, nobody).when(named.isNotNull(), F.concat(F.array(named), F.filter("memories", lambda _, i: i != index - 1))).otherwise(F.col("memories"))
    hit = lambda ids, docs: (F.size(F.array_intersect(named["target_chunks"], F.slice(ids, 1, DEPTH))) > 0, F.array_contains(F.slice(docs, 1, DEPTH), named["target_doc"]))
    (raw_chunk, raw_doc), (chunk, doc) = hit("raw_ids", "raw_docs"), hit("ids", "docs")
    found = F.filter("preserved", lambda t: T.variant_in_text(F.col("raw"), t))
    seen = rows.withColumns({
        "score": score, "shift": shift, "terminology": terminology(F.col("raw"), F.col("text"), anchors, F.col("language"), F.when(uses, trusted).otherwise(nobody)),
        "alignment": rewrite.memory_alignment(F.col("raw_affinity"), F.when(uses, F.col("affinity")).otherwise(F.col("raw_affinity"))),
        "targets": memory_targets(F.col("raw"), F.col("text"), first), "index_valid": index <= n,
        "improved": F.coalesce((chunk & ~raw_chunk) | (doc & ~raw_doc), F.lit(False)),
        "guard": retrieve.raw_loss_guard(F.slice("raw_ids", 1, TOP), F.slice("ids", 1, TOP), F.col("raw_score"), p("guard_floor"), p("guard_overlap")),
        "preserved_share": ratio(F.size(F.filter(found, lambda t: T.variant_in_text(F.col("text"), t))), F.size(found)), "added_share": rewrite.coverage(F.col("text"), F.col("added")),
        "chars": F.length(F.regexp_replace("text", r"\s", "")),
    })
    weigh = lambda gain, kept, aligned: F.when(
        p("retrieval") + p("terminology") + p("alignment") > 0, unit((p("retrieval") * gain + p("terminology") * kept + p("alignment") * aligned) / (p("retrieval") + p("terminology") + p("alignment")))
    ).otherwise(unit(gain))
    gain = unit(F.col("score") + F.when(F.col("score") >= F.col("raw_score"), p("shift") * F.col("shift")).otherwise(0.0))
    under = (F.coalesce("profile", F.lit("")) == "short_user") & (unit((F.col("raw_affinity") + 1) / 2) >= p("underspecified")) & (F.size("targets.tokens") > 0) & (F.col("targets.raw") == 0)
    length = F.greatest(F.lit(1), F.col("chars")) / F.greatest(F.lit(1), F.length(F.regexp_replace("raw", r"\s", "")))
    weighed = seen.withColumns({"gain": gain, "missing_target": under & (F.col("targets.candidate") == 0), "length_ratio": length})
    penalties = (
        F.greatest(F.lit(0.0), F.col("length_ratio") - 1) * p("verbosity") + F.greatest(F.lit(0.0), 1 - F.col("terminology.technical")) * p("token_drop")
        + F.greatest(F.lit(0.0), 1 - F.col("terminology.anchors")) * p("anchor_drop") + F.when(F.col("missing_target"), p("target_missing")).otherwise(0.0))
    bonuses = F.when(F.col("targets.candidate") > F.col("targets.raw"), p("target_presence")).otherwise(0.0) + F.when(F.col("improved"), p("hit_selection")).otherwise(0.0)
    aligned_raw = rewrite.memory_alignment(F.col("raw_affinity"), F.col("raw_affinity"))
    scored = weighed.withColumns({
        "final_score": F.round(unit(weigh(F.col("gain"), F.col("terminology.score"), F.col("alignment")) + bonuses - penalties), 9),
        "raw_reference": F.round(weigh(F.col("raw_score"), F.lit(1.0), aligned_raw), 9),
    })
    margin = F.round(F.col("final_score") - F.col("raw_reference") + F.when(F.col("improved"), p("hit_margin")).otherwise(0.0), 9)
    risk = F.lower(F.trim(F.coalesce("intent_risk", F.lit("medium"))))
    long = (F.col("length_ratio") > p("max_length_ratio")) & ~((p("max_compact_chars") > 0) & (F.col("chars") <= p("max_compact_chars")))
    reasons = (
        (F.lower(single_spaced(F.col("raw"))) == F.lower(single_spaced(F.col("text"))), "candidate_same_as_raw"), (risk == "high", "intent_risk_high"), (~F.col("index_valid"), "invalid_source_memory_index"),
        (F.col("preserved_share") < p("preserved_floor"), "preserved_raw_terms_missing"), (F.col("added_share") < p("added_floor"), "added_anchor_coverage_below_floor"), (long, "verbosity_exceeds_limit"),
        (F.col("terminology.score") < p("preservation_floor"), "preservation_below_floor"), (F.col("gain") < p("min_gain"), "retrieval_gain_below_floor"), (F.col("missing_target"), "missing_memory_target"),
        (F.col("guard") & ~F.col("improved") & ~force, "raw_loss_guard_top1_lost"), ((F.col("margin") < F.greatest(F.lit(threshold), p("min_improvement"))) & ~force, "delta_below_threshold"),
    )
    ladder = F.lit("")
    for condition, reason in reversed(reasons):
        ladder = F.when(condition, reason).otherwise(ladder)
    return scored.withColumn("margin", margin).withColumn("rejection", ladder)


def decide(state: DataFrame, judged: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``(query_id, seq, label, final_text, final_score, raw_reference, rejection, applied, reason)``: the best eligible candidate of each query, else the best, else none."""
    order = F.struct((F.col("rejection") == "").cast("int"), "final_score", -F.col("seq"))
    best = judged.groupBy(*by).agg(F.max_by(F.struct("seq", "label", "text", "final_score", "raw_reference", "rejection", "ids", "scores"), order).alias("b"))
    joined = state.select(*by, F.col("text").alias("raw"), F.col("ids").alias("raw_ids"), F.col("scores").alias("raw_scores")).join(best, list(by), "left")
    applied = F.coalesce(F.col("b.rejection") == "", F.lit(False))
    return joined.select(
        *by, "b.seq", "b.label", F.when(applied, F.col("b.text")).otherwise(F.col("raw")).alias("final_text"), "b.final_score", "b.raw_reference", applied.alias("applied"),
        F.when(F.col("b").isNull(), "no_candidate").when(applied, "delta_above_threshold").otherwise(F.col("b.rejection")).alias("reason"),
        "raw_ids", "raw_scores", F.when(applied, F.col("b.ids")).alias("new_ids"), F.when(applied, F.col("b.scores")).alias("new_scores"),
    )


def final_lists(decided: DataFrame, strategy: str = "replace", k: int = DEPTH, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of each decision: the adopted list, or raw and adopted lists in turn, or by their greater scores; the raw list where none was adopted."""
    spread = lambda ids, scores, source: decided.select(*by, F.lit(source).alias("source"), (F.col("new_ids").isNotNull()).alias("applied"), F.posexplode(F.arrays_zip(F.col(ids).alias("doc_id"), F.col(scores).alias("score"))).alias("pos", "x")).select(*by, "source", "applied", (F.col("pos") + 1).alias("rank"), "x.doc_id", "x.score")
    every = spread("raw_ids", "raw_scores", 0).unionByName(spread("new_ids", "new_scores", 1))
    used = every.where("NOT applied OR source = 1") if strategy == "replace" else every
    order = {"replace": F.struct("rank", "source"), "interleave": F.struct("rank", "source"), "max_score": F.struct((-F.col("score")).alias("s"), "source", "rank")}[strategy]
    first = used.groupBy(*by, "doc_id").agg(F.min(order).alias("at"), F.max("score").alias("score"))
    from pyspark.sql.window import Window

    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("at", "doc_id"))).where(F.col("rank") <= k).select(*by, "doc_id", "score", "rank")
