"""Scans, summaries and roll-ups of experiment tables: filtered counts, guarded ratios, merged maps, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Modes of an evaluation run, in order; those of the second list can reject a rewrite.
MODES = (
    "raw_only", "memory_only_ungated", "memory_only_rule_only", "memory_only_full_gating", "memory_only_gated", "rewrite_always",
    "selective_rewrite", "selective_rewrite_with_session", "anchor_aware_rewrite", "agentic_multi_query", "strategy_router",
)
REJECTING = ("rewrite_always", "selective_rewrite", "selective_rewrite_with_session", "anchor_aware_rewrite", "strategy_router")
#: Fixed priorities of candidates for short evaluation queries.
ANSWERABILITY = {"far": 0, "near": 1, "multi": 1, "single": 2}
QUERY_TYPES = {"follow_up": 0, "comparison": 1, "procedure": 2, "reason": 3, "code_mixed": 4, "short_user": 5, "definition": 6}


def filled(value: Column, *others: Column) -> Column:
    """The first that is not null, an empty string counting as null."""
    return F.coalesce(F.nullif(value, F.lit("")), *others)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; null where the whole is zero or null."""
    return F.try_divide(part.cast("double"), whole)


def raw_queries(rows: DataFrame, strategies: list[str], batches: list[str] | None = None, runs: list[str] | None = None) -> DataFrame:
    """Raw queries of some strategies, of the given batches or, only if no batch is given, of the given runs, with defaults for language and profile."""
    found = rows.where(F.col("generation_strategy").isin(strategies))
    batches, runs = ([v.strip() for v in x or () if v.strip()] for x in (batches, runs))
    if batches:
        found = found.where(F.col("generation_batch_id").isin(batches))
    elif runs:
        found = found.where(F.col("experiment_run_id").isin(runs))
    english = F.col("generation_strategy").isin("E", "F")
    language = F.when(english, "en").otherwise("ko")
    profile = F.when(english, "en").when(F.col("query_type") == "code_mixed", "code_mixed").otherwise("ko")
    return found.withColumns({"query_language": filled(F.col("query_language"), language), "language_profile": filled(F.col("language_profile"), profile)})


def eval_samples(samples: DataFrame, items: DataFrame | None = None, dataset_language: Column | None = None) -> DataFrame:
    """Evaluation samples, of one dataset's active items if these are given; the language falls back to the dataset's, then to ``ko``."""
    if items is not None:
        samples = samples.join(items.where("active").select("sample_id").distinct(), "sample_id", "left_semi")
    return samples.withColumn("query_language", filled(F.col("query_language"), *([] if dataset_language is None else [dataset_language]), F.lit("ko")))


def overlapping(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose array holds any of the values."""
    return rows.where(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))))


def json_overlapping(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose JSON array of strings holds any of the values."""
    return rows.where(F.coalesce(F.arrays_overlap(F.from_json(column, "array<string>"), F.array(*map(F.lit, values))), F.lit(False)))


def searched(documents: DataFrame, term: str, columns: list[str], key: str, *children: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """Documents with the term, in either case, in one of their columns or in one of a child's (``(rows, key, columns)`` each)."""
    like = lambda cs: reduce(lambda a, b: a | b, (F.lower(F.coalesce(F.col(c), F.lit(""))).contains(term.lower()) for c in cs))
    hits = [documents.where(like(columns)).select(key)]
    hits += [rows.where(like(cs)).select(F.col(k).alias(key)) for rows, k, cs in children]
    return documents.join(reduce(DataFrame.union, hits).distinct(), key, "left_semi")


def owned(embeddings: DataFrame, owners: DataFrame, owner_type: str, id_col: str) -> DataFrame:
    """Embeddings joined to their owners on the composite key (type, id)."""
    return embeddings.where(F.col("owner_type") == owner_type).join(owners, embeddings["owner_id"] == owners[id_col].cast("string"))


def unreferenced(rows: DataFrame, key: str, *references: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key no reference table holds, by one anti join with the union of their keys."""
    held = reduce(DataFrame.union, (df.select(F.col(c).alias(key)) for df, c in references)).where(F.col(key).isNotNull()).distinct()
    return rows.join(held, key, "left_anti")


def compatible(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A view with the wanted columns (name to type) over a table that may lack some: those are null."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()))


def anchor_run_summary(runs: DataFrame, details: DataFrame, anchors: DataFrame) -> DataFrame:
    """Counts of rewrite anchors by run with guarded ratios; runs without anchors have zeros, and nulls for ratios.

    ``details(run_id, detail_id, rewrite_applied)``; ``anchors(run_id, detail_id, label, anchor_source,
    by_chunk, by_doc, score)``.
    """
    grounded = F.coalesce(F.col("by_chunk"), F.lit(False)) | F.coalesce(F.col("by_doc"), F.lit(False))
    label = lambda x: F.count_if(F.col("label") == x)
    added = F.col("anchor_source") == "added_by_rewrite"
    a = anchors.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_anchor_count"), F.count_distinct("detail_id").alias("anchor_evaluated_sample_count"), label("useful").alias("useful_anchor_count"), label("risky").alias("risky_anchor_count"),
        label("unsupported").alias("unsupported_anchor_count"), F.count_if(grounded).alias("grounded_anchor_count"), F.count_if(added).alias("added_anchor_count"), F.count_if(added & grounded).alias("added_anchor_grounded_count"),
        F.count_distinct(F.when((F.col("label") == "useful") | grounded, F.col("detail_id"))).alias("supported_rewrite_sample_count"), F.avg("score").alias("avg_anchor_relevance_score"))
    d = details.groupBy("run_id").agg(F.count_distinct(F.when(F.col("rewrite_applied"), F.col("detail_id"))).alias("rewrite_applied_sample_count"))
    joined = runs.join(a, "run_id", "left").join(d, "run_id", "left")
    counts = [c for c in (*a.columns[1:-1], "rewrite_applied_sample_count")]
    out = joined.select("run_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), "avg_anchor_relevance_score")
    per = {
        "anchor_precision": ("useful_anchor_count", "total_anchor_count"), "grounded_rate": ("grounded_anchor_count", "total_anchor_count"), "risky_rate": ("risky_anchor_count", "total_anchor_count"),
        "added_grounded_rate": ("added_anchor_grounded_count", "added_anchor_count"), "supported_rate": ("supported_rewrite_sample_count", "rewrite_applied_sample_count"),
    }
    return out.select("*", *(ratio(F.col(x), F.nullif(F.col(y), F.lit(0).cast("long"))).alias(n) for n, (x, y) in per.items()))


def label_summary(candidates: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Labelled candidates: counts by value, precision and noise ratio (0 where nothing is labelled)."""
    rows = candidates.join(labels, [*by, "candidate_id"], "left")
    value = lambda v: F.count_if(F.col("label_value") == v)
    counted = rows.groupBy(*by).agg(
        F.count_distinct("sample_id").alias("sample_count"), F.count(F.lit(1)).alias("candidate_count"), F.count("label_value").alias("labeled_count"),
        value("valid").alias("valid_count"), value("invalid").alias("invalid_count"), value("partial").alias("partial_count"))
    share = lambda c: F.coalesce(ratio(F.col(c), F.col("labeled_count")), F.lit(0.0))
    return counted.select("*", share("valid_count").alias("precision"), share("invalid_count").alias("noise_ratio"))


def mode_report(rows: DataFrame, metrics: list[str], mrr: str = "mrr", ndcg: str = "ndcg", baseline: str = "raw_only") -> DataFrame:
    """Summary by evaluation mode: means, adoption, rejection and bad-rewrite rates, degraded queries, gain over the baseline mode.

    ``rows(mode, rewrite_applied, raw_mrr, confidence_delta, elapsed_ms, degraded, *metrics)``.
    """
    applied = F.coalesce(F.col("rewrite_applied"), F.lit(False))
    rejection = F.when(F.col("mode").isin(*REJECTING), 1 - F.col("adoption_rate")).otherwise(0.0)
    base = rows.where(F.col("mode") == baseline).agg(F.avg(mrr).alias("_mrr"), F.avg(ndcg).alias("_ndcg"))  # one row
    out = rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics), F.avg(F.coalesce("elapsed_ms", F.lit(0.0))).alias("avg_latency_ms"), F.avg(F.coalesce("confidence_delta", F.lit(0.0))).alias("avg_confidence_delta"),
        F.count_if(F.coalesce(F.col("degraded"), F.lit(False))).alias("degraded_query_count"), F.avg(applied.cast("double")).alias("adoption_rate"),
        F.coalesce(ratio(F.count_if(applied & (F.col(mrr) < F.col("raw_mrr"))), F.count_if(applied)), F.lit(0.0)).alias("bad_rewrite_rate"),
    ).crossJoin(F.broadcast(base))
    gain = lambda m, b: F.when(F.col("mode") == baseline, 0.0).otherwise(F.col(m) - F.coalesce(b, F.lit(0.0)))
    return out.select("*", rejection.alias("rewrite_rejection_rate"), gain(mrr, "_mrr").alias("rewrite_gain_mrr"), gain(ndcg, "_ndcg").alias("rewrite_gain_ndcg")).drop("_mrr", "_ndcg")


def call_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Model calls and selected strategies."""
    calls = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("llm_call_count", "planner_call_count", "rewrite_call_count")]
    kinds = {"raw": "raw_only", "selective": "selective_rewrite", "anchor": "anchor_aware_rewrite", "agentic": "agentic_multi_query"}
    return rows.groupBy(*by).agg(F.avg(F.coalesce("llm_call_count", F.lit(0))).alias("avg_llm_calls"), *calls, *(F.count_if(F.col("selected_strategy") == v).alias(f"selected_{k}_count") for k, v in kinds.items()))


def merged_counts(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Maps of counts merged by key: ``(by, merged map)``."""
    flat = rows.select(*by, F.explode(column).alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum("_v").alias("_n"))
    return flat.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_n")))).alias(column))


def diagnostics_rollup(rows: DataFrame, by: list[str], maps: list[str]) -> DataFrame:
    """Sums of anchor diagnostics and their merged distributions.

    ``rows(enabled, seeds, candidates, accepted, *maps)``; rows with all of these null are left out.
    """
    rows = rows.where(F.coalesce(*(F.col(c).cast("string") for c in ("enabled", "seeds", "candidates", "accepted"))).isNotNull())
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    out = rows.groupBy(*by).agg(F.count_if("enabled").alias("enabled_sample_count"), total("seeds").alias("seed_anchor_count"), total("candidates").alias("expanded_anchor_count"), total("accepted").alias("accepted_expanded_anchor_count"))
    out = out.withColumn("anchor_dedup_rate", F.coalesce(1 - ratio(F.col("accepted_expanded_anchor_count"), F.col("expanded_anchor_count")), F.lit(0.0)))
    return reduce(lambda a, m: a.join(merged_counts(rows, m, by), by, "left"), maps, out)


def origin(metadata: Column) -> Column:
    """Where an evaluation sample comes from, by its JSON metadata."""
    field = lambda k: F.get_json_object(metadata, f"$.{k}")
    return (
        F.when(field("builder") == "build-eval-dataset", "build-eval-dataset").when(field("generation_mode") == "corpus_grounded_new_query", "corpus_grounded_new_query")
        .when(field("query_style") == "short_user", "short_user_other").otherwise("other_or_none"))


def signature_matches(samples: DataFrame, synthetic: DataFrame, ids: str, query: str) -> DataFrame:
    """One row: built samples, and how many share their sorted id list or their normalised query with a synthetic query (4 digits)."""
    own = samples.select(F.sort_array(ids).alias("_s"), F.lower(F.trim(F.regexp_replace(query, r"\s+", " "))).alias("_q"))
    sets = synthetic.select(F.sort_array(ids).alias("_s")).distinct().withColumn("_by_ids", F.lit(1))
    texts = synthetic.select(F.lower(F.trim(F.regexp_replace(query, r"\s+", " "))).alias("_q")).distinct().withColumn("_by_query", F.lit(1))
    n, rate = F.count(F.lit(1)), lambda c: F.coalesce(F.round(ratio(F.count(c), F.count(F.lit(1))), 4), F.lit(0.0))
    return own.join(sets, "_s", "left").join(texts, "_q", "left").agg(n.alias("built"), F.count("_by_ids").alias("id_matches"), rate("_by_ids").alias("id_rate"), F.count("_by_query").alias("query_matches"), rate("_by_query").alias("query_rate"))


def candidate_hits(rows: DataFrame) -> DataFrame:
    """Hits by candidate label, on raw misses and among eligible candidates."""
    hit = F.col("candidate_hit") == 1
    return rows.groupBy(F.coalesce("candidate_label", F.lit("")).alias("candidate_label")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("hit"), F.count_if((F.col("raw_hit") == 0) & hit).alias("rawmiss_hit"), F.count_if(F.col("eligible") & hit).alias("eligible_hit"))


def variant_matrix(rows: DataFrame, samples: int | Column) -> DataFrame:
    """Hits within 5, rate over all samples, missing variants, and the mean of the ranks found: ``rows(variant, query, first_rank)``."""
    there = F.col("query") != ""
    rank = F.when(there, F.col("first_rank"))
    hits = F.count_if(rank <= 5)
    return rows.groupBy("variant").agg(
        hits.alias("hit_count"), (hits / F.greatest(F.lit(1), F.max(samples) if isinstance(samples, Column) else F.lit(samples))).alias("hit_rate"),
        F.count_if(~F.coalesce(there, F.lit(False))).alias("missing_variant_count"), F.count(rank).alias("ranked_count"), F.avg(rank).alias("mean_rank_when_found"))


def memory_probe(rows: DataFrame) -> DataFrame:
    """Nine counts by variant of ``rows(variant, query, first_rank, memory_target, trusted_target)``."""
    there = F.coalesce(F.col("query") != "", F.lit(False))
    rank = F.when(there, F.col("first_rank"))
    hit, found = F.coalesce(rank <= 5, F.lit(False)), F.coalesce(rank <= 10, F.lit(False))
    memory, trusted = there & F.col("memory_target"), there & F.col("trusted_target")
    return rows.groupBy("variant").agg(
        F.count_if(hit).alias("raw_hit_count"), F.count_if(found).alias("raw_found10_count"), F.count_if(~there).alias("missing_variant_count"), F.count(rank).alias("ranked_count"),
        F.avg(rank).alias("mean_rank_when_found"), F.count_if(memory).alias("memory_target_count"), F.count_if(trusted).alias("trusted_target_count"), F.count_if(~hit & memory).alias("rawmiss_memory_target_count"),
        F.count_if(~hit & trusted).alias("rawmiss_trusted_target_count"), F.count_if(~hit & found & trusted).alias("rawmiss_found10_trusted_target_count"))


def nested_metric(column: Column, key: str, outer: str = "dedupe_summary") -> Column:
    """A whole number from JSON, at the top or within ``outer``; 0 where neither is filled."""
    at = lambda p: F.nullif(F.get_json_object(column, p), F.lit("")).cast("bigint")
    return F.coalesce(at(f"$.{key}"), at(f"$.{outer}.{key}"), F.lit(0).cast("bigint"))


def numbered(rows: DataFrame, time: str, key: str, prefix: str, parts: int = 64) -> DataFrame:
    """``label`` = prefix and the place of each row by (time, key), without one task for all rows.

    Rows are dealt by range; a small count of each range gives the places where ranges begin.
    """
    dealt = rows.repartitionByRange(parts, F.col(time), F.col(key)).sortWithinPartitions(time, key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = dealt.withColumn("_in", F.col("_at") - (F.col("_part").cast("long") * F.lit(1 << 33)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    return placed.join(F.broadcast(begins), "_part").withColumn("label", F.concat(F.lit(prefix), (F.col("_before") + F.col("_in") + 1).cast("string"))).drop("_part", "_at", "_in", "_before")


def text_pool(rows: DataFrame, terms: Column, text: str, key: str, k: int) -> DataFrame:
    """The first k rows by id that hold any of the terms (a pool ordered by id, not by score)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return rows.where(F.exists(terms, lambda t: low.contains(F.lower(t)))).orderBy(key).limit(k)


def compression_order(answerability: Column, query_type: Column, score: Column, key: Column) -> list[Column]:
    """Sort keys: answerability, type priority, falling score, id."""
    place = lambda c, table: reduce(lambda w, kv: w.when(F.lower(c) == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0)).otherwise(9)
    return [place(answerability, ANSWERABILITY), place(query_type, QUERY_TYPES), score.desc(), key]


def first_expected_rank(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """``(sample_id, first_rank)``: the first rank of an expected chunk or, only for samples without expected chunks, of an expected document.

    ``ranked(sample_id, chunk_id, document_id, rank)``, ``expected(sample_id, chunk_ids, doc_ids)``.
    """
    ids = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    joined = expected.select("sample_id", ids("chunk_ids").alias("c"), ids("doc_ids").alias("d")).join(ranked, "sample_id", "left")
    hit = F.when(F.size("c") > 0, F.array_contains("c", F.col("chunk_id"))).otherwise(F.array_contains("d", F.col("document_id")))
    return joined.groupBy("sample_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"))


def first_rank_per_document(ranked: DataFrame) -> DataFrame:
    """Each document of a query at its first rank."""
    return ranked.groupBy("query_id", "document_id").agg(F.min("rank").alias("first_rank"))


def overlaid_json(column: Column, patch: Column) -> Column:
    """A JSON object with the fields of ``patch`` put over it, values of any kind kept as they are; keys in order.

    As with the JSON ``||`` of databases only the outermost fields are merged, and a null field stays one. A
    null object counts as empty.
    """
    read = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    old, new = read(column), read(patch)
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(F.map_contains_key(new, k), F.try_element_at(new, k)).otherwise(F.try_element_at(old, k)))))


def merged_json(column: Column, patch: Column) -> Column:
    """A flat JSON object with the fields of ``patch`` put over it and null fields taken out; keys in order."""
    both = F.map_zip_with(*(F.coalesce(F.from_json(c, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for c in (column, patch)), lambda k, a, b: F.coalesce(b, a))
    entries = F.array_sort(F.filter(F.map_entries(both), lambda e: e["value"].isNotNull()))
    return F.to_json(F.map_from_entries(entries))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))


def insert_statements(rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """``(statement)``: an INSERT for each row that updates on conflict; strings are quoted, nulls are NULL."""
    literal = lambda c, kind: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if kind == "string" else F.col(c).cast("string"), F.lit("NULL"))
    values = F.concat_ws(", ", *(literal(c, kind) for c, kind in rows.dtypes))
    sets = ", ".join(f"{c} = EXCLUDED.{c}" for c in rows.columns if c not in keys)
    action = f"DO UPDATE SET {sets}" if sets else "DO NOTHING"
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES ("), values, F.lit(f") ON CONFLICT ({', '.join(keys)}) {action};")).alias("statement"))


def shadow_sync(shadow: DataFrame, source: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """A legacy table brought up to its source: renamed columns (source to shadow), other shadow rows and columns stay."""
    renamed = source.select(F.col(key), *(F.col(a).alias(f"_n_{b}") for a, b in columns.items()), F.lit(True).alias("_there"))
    joined = shadow.withColumn("_old", F.lit(True)).join(renamed, key, "full_outer")
    new = set(columns.values())
    return joined.select(key, *(F.when(F.col("_there"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in shadow.columns if c != key))


def with_domain(rows: DataFrame, key: str, run: Column, linked: DataFrame, value: Column, column: str = "domain_id") -> DataFrame:
    """Set the domain of rows of a run, or of rows that the linked table names; others keep theirs."""
    flags = linked.select(F.col(linked.columns[0]).alias(key)).distinct().withColumn("_linked", F.lit(True))
    return rows.join(flags, key, "left").withColumn(column, F.when(run | F.coalesce("_linked", F.lit(False)), value).otherwise(F.col(column))).drop("_linked")


def reachable(links: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``(url, depth)`` of the pages a crawl reaches breadth first in at most ``depth`` steps: ``links(source, target)``, ``starts(url)``.

    A join for each step, of the new pages only; the plan grows with ``depth``, which is a small parameter.
    """
    seen = starts.select("url").distinct().withColumn("depth", F.lit(0))
    edges = links.select("source", "target").distinct()
    fringe = seen
    for step in range(1, depth + 1):
        found = fringe.join(edges, fringe["url"] == edges["source"]).select(F.col("target").alias("url")).distinct()
        fringe = found.join(seen, "url", "left_anti").withColumn("depth", F.lit(step))
        seen = seen.union(fringe)
    return seen
