"""Selective rewriting and evaluation modes: decisions from retrieval, shared passes, views that agree with their parts."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate, hints, inverted, modes, reports, retrieve, rewrite, search, selective
from millrace.plans import selective_queries as Q
from millrace.sources.tables import table

SF = "/root/testdata/sf0.001"
DOCS = [
    (10, "RestTemplate timeout settings explained"), (11, "RestTemplate read timeout and connect timeout"), (20, "JdbcTemplate batch update guide"),
    (21, "batch update with JdbcTemplate and retries"), (30, "kafka listener retry topics"), (31, "plain words about nothing"),
]
MEMORIES = [(1, "RestTemplate timeout", [11], 1, "src0", ["ConnectTimeout"], 0.9), (2, "JdbcTemplate batch", [20], 2, "src1", [], 0.5), (3, "kafka retry topics", [30], 3, "src0", [], 0.1)]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("world")
    inverted.build(spark.createDataFrame(DOCS, "doc_id long, text string"), str(folder / "docs"))
    memories = spark.createDataFrame(MEMORIES, "memory_id long, query_text string, target_chunks array<long>, target_doc long, product string, glossary array<string>, utility double").cache()
    inverted.build(memories, str(folder / "memories"), "memory_id", "query_text")
    chunks, held = (inverted.open_index(spark, str(folder / n)).packs for n in ("docs", "memories"))
    calls = {"chunks": [], "memories": 0}

    def search_chunks(asked, k):
        calls["chunks"].append(sorted(r["text"] for r in asked.collect()))
        return search.packed_hybrid(chunks, asked, k)

    def search_memories(asked, n):
        calls["memories"] += 1
        return search.packed_hybrid(held, asked, n, mode="dense_only")

    retriever = selective.Retriever(search_chunks, search_memories, lambda c: (c - c % 10) / 10)
    samples = spark.createDataFrame([(1, "timeout of RestTemplate", None, "src0"), (2, "batch", "short_user", "src1"), (3, "unseen xyzzy", None, None)], "query_id long, text string, profile string, product string")
    return samples, memories, retriever, calls


def judged(spark, world, rows, policy=None, **more):
    samples, memories, retriever, _ = world
    state = selective.with_memories(samples, memories, retriever, 3, 2)
    schema = "query_id long, seq int, label string, text string, preserved array<string>, added array<string>, source_memory int, intent_risk string"
    found = selective.judge(state, spark.createDataFrame(rows, schema), retriever, policy, **more)
    return state, {(r["query_id"], r["seq"]): r for r in found.collect()}, found


def test_memories_are_ordered_by_what_was_retrieved(world):
    samples, memories, retriever, _ = world
    state = {r["query_id"]: r for r in selective.with_memories(samples, memories, retriever, 3, 3).collect()}
    assert state[1]["memories"][0]["memory_id"] == 1 and state[1]["memories"][0]["trusted"]
    assert state[2]["memories"][0]["memory_id"] == 2
    assert len(state[1]["ids"]) == len(DOCS) and state[1]["docs"][0] == state[1]["ids"][0] // 10
    assert [m["after"] for m in state[3]["memories"]] == [1, 2, 3]


def test_every_reason(spark, world):
    rows = [
        (1, 1, "standalone", "Timeout  of RestTemplate", [], [], 0, "low"), (1, 2, "expanded", "timeout RestTemplate ConnectTimeout", [], [], 1, "high"), (1, 3, "expanded", "RestTemplate connect timeout", [], [], 9, "low"),
        (1, 4, "expanded", "connect timeout settings", ["RestTemplate"], [], 1, "low"), (1, 5, "expanded", "RestTemplate timeout", [], ["kafka", "topics"], 1, "low"), (1, 6, "expanded", "RestTemplate timeout " * 9, [], [], 1, "low"),
        (1, 7, "expanded", "connect and read timeout here", [], [], 1, "low"), (2, 1, "expanded", "batch kaf", [], [], 2, "low"), (2, 2, "expanded", "topics", [], [], 0, "low"),
    ]
    _, got, _ = judged(spark, world, rows)
    assert [got[1, k]["rejection"] for k in range(1, 8)] == [
        "candidate_same_as_raw", "intent_risk_high", "invalid_source_memory_index", "preserved_raw_terms_missing", "added_anchor_coverage_below_floor", "verbosity_exceeds_limit", "preservation_below_floor",
    ]
    strict = selective.Policy(guard_floor=0.0, guard_overlap=1.01, min_gain=0.0, max_length_ratio=9)
    _, held, _ = judged(spark, world, rows, strict)
    assert held[2, 2]["rejection"] in ("raw_loss_guard_top1_lost", "delta_below_threshold", "missing_memory_target")
    _, forced, _ = judged(spark, world, rows, strict, force=True)
    assert "raw_loss_guard_top1_lost" not in {r["rejection"] for r in forced.values()} and "delta_below_threshold" not in {r["rejection"] for r in forced.values()}


def test_scores_are_those_of_the_rule(spark, world):
    """One candidate by hand from its lists."""
    samples, memories, retriever, _ = world
    state, got, _ = judged(spark, world, [(1, 1, "expanded", "RestTemplate connect timeout", [], [], 1, "low")])
    raw, row = {r["query_id"]: r for r in state.collect()}[1], got[1, 1]
    unit = lambda x: max(0.0, min(1.0, x))
    confidence = lambda s: 0.7 * unit((s[0] + 1) / 2) + 0.3 * sum(unit((x + 1) / 2) for x in s[:3]) / 3
    a, b = raw["ids"][:5], row["ids"][:5]
    shift = 0.7 * (1 - len(set(a) & set(b)) / len(set(a) | set(b))) + 0.3 * (a[0] != b[0])
    base, own = confidence(row["scores"]), confidence(raw["scores"])
    gain = unit(base + (0.03 * shift if base >= own else 0))
    assert row["gain"] == pytest.approx(gain) and row["shift"] == pytest.approx(shift) and row["score"] == pytest.approx(base)
    x, y = raw["memories"][0]["similarity"], row["affinity"]
    align = lambda p, q: unit(0.7 * unit((q + 1) / 2) + 0.3 * unit((q - p + 1) / 2))
    assert row["alignment"] == pytest.approx(align(x, y))
    # both technical tokens of the query stay; the anchors are RestTemplate, ConnectTimeout (the memory's term) and nothing else
    assert (row["terminology"]["technical"], row["terminology"]["anchors"]) == (1.0, 0.5)
    length = len("RestTemplateconnecttimeout") / len("timeoutofRestTemplate")
    score = 0.60 * gain + 0.28 * (0.7 + 0.3 * 0.5) + 0.12 * align(x, y) + 0.06 * (row["targets"]["candidate"] > row["targets"]["raw"]) - 0.08 * (length - 1) - 0.12 * 0.5
    assert row["final_score"] == pytest.approx(unit(score), abs=1e-8)
    assert row["raw_reference"] == pytest.approx(0.60 * own + 0.28 + 0.12 * align(x, x), abs=1e-8)


def test_canonical_forms_preserve_terminology(spark, world):
    """A query's term may be kept in another form of its canonical group, if a trusted memory knows the group."""
    samples, memories, retriever, _ = world
    forms = spark.createDataFrame([(1, [("t1", ["RestTemplate", "rest client"]), ("t2", ["JdbcTemplate"])])], f"memory_id long, canonical {selective.CANONICAL}")
    state = selective.with_memories(samples, memories.join(forms, "memory_id", "left"), retriever, 3, 2)
    schema = "query_id long, seq int, label string, text string, preserved array<string>, added array<string>, source_memory int, intent_risk string"
    rows = [(1, 1, "expanded", "timeout of the rest client", [], [], 1, "low"), (1, 2, "standalone", "timeout of the rest client", [], [], 0, "low"), (1, 3, "expanded", "timeout of a thing", [], [], 1, "low")]
    got = {r["seq"]: r["terminology"].asDict() for r in selective.judge(state, spark.createDataFrame(rows, schema), retriever).collect()}
    assert got[1] == {"technical": 1.0, "anchors": 1.0, "score": 1.0} and got[2]["score"] == got[3]["score"] == 0.0


def test_decisions_and_lists(spark, world):
    rows = [(1, 1, "expanded", "RestTemplate timeout", [], [], 1, "low"), (1, 2, "expanded", "RestTemplate timeout RestTemplate", [], [], 1, "low"), (2, 1, "expanded", "batch", [], [], 1, "low")]
    state, _, found = judged(spark, world, rows, selective.Policy(min_improvement=-1.0), threshold=-1.0)
    decided = selective.decide(state, found)
    by = {r["query_id"]: r for r in decided.collect()}
    assert by[1]["applied"] and by[1]["reason"] == "delta_above_threshold" and by[1]["final_text"].startswith("RestTemplate")
    assert not by[2]["applied"] and by[2]["reason"] == "candidate_same_as_raw" and by[2]["final_text"] == "batch"
    assert not by[3]["applied"] and by[3]["reason"] == "no_candidate" and by[3]["final_text"] == "unseen xyzzy"
    for strategy in ("replace", "interleave", "max_score"):
        lists = {}
        for r in selective.final_lists(decided, strategy, 4).orderBy("query_id", "rank").collect():
            lists.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        old, new = (list(zip(by[1][f"{k}_ids"], by[1][f"{k}_scores"], strict=True)) for k in ("raw", "new"))
        if strategy == "replace":
            expected = new[:4]
            assert lists[1] == expected and lists[2] == list(zip(by[2]["raw_ids"], by[2]["raw_scores"], strict=True))[:4]
        elif strategy == "interleave":
            seen = []
            for d, _ in (x for pair in zip(old, new, strict=True) for x in pair):
                seen += [d] * (d not in seen)
            assert [d for d, _ in lists[1]] == seen[:4]
        else:
            best = {}
            for d, s in [*old, *new]:
                best[d] = max(best.get(d, -2), s)
            assert [s for _, s in lists[1]] == sorted(best.values(), reverse=True)[:4]


def test_ordered_merge_of_hints(spark):
    memories = [(7, "ask HTTP2Client now", ["RestTemplate", "plain", "foo_bar"]), (8, "RESTTEMPLATE v2.1 again", None)]
    row = spark.createDataFrame([("@Bean RestTemplate", memories, []), ("nothing", [], [])], "raw string, memories array<struct<memory_id: long, query_text: string, glossary: array<string>>>, c array<string>")
    out = [[tuple(x) for x in r[0]] for r in row.select(hints.anchor_candidates(F.col("raw"), F.col("memories"), F.lit("en"))).collect()]
    assert out == [[("@Bean", "raw_query", None), ("RestTemplate", "raw_query", None), ("foo_bar", "memory_glossary", "7"), ("HTTP2Client", "memory_query", "7"), ("v2.1", "memory_query", "8")], []]
    two = row.select(hints.terminology_hints(F.col("raw"), F.col("memories"), F.lit("en"), 2).alias("h")).first()["h"]
    assert [x["term"] for x in two] == ["@Bean", "RestTemplate"]


@pytest.fixture(scope="module")
def all_modes(spark):
    """The registered plan over the smallest tables, with every search of the documents noted."""
    calls = []
    asked, (lists, decisions) = None, (None, None)
    plain = search.packed_hybrid

    def noted(packs, queries, k=10, mode="hybrid", **more):
        if mode == "hybrid":
            calls.append({r["text"] for r in queries.collect()})
        return plain(packs, queries, k, mode, **more)

    search.packed_hybrid = noted
    try:
        asked, (lists, decisions) = Q._modes(spark, SF)
    finally:
        search.packed_hybrid = plain
    return asked, lists.cache(), decisions.cache(), calls


def rows_of(df, mode):
    return {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.where(F.col("mode") == mode).collect()}


def test_raw_queries_and_candidates_are_each_searched_once(all_modes):
    asked, lists, _, calls = all_modes
    raw = {r["text"] for r in asked.collect()}
    assert len(calls) == 2 and raw <= calls[0]
    assert {r["mode"] for r in lists.select("mode").distinct().collect()} == set(reports.MODES)


def test_views_agree_with_their_parts(spark, all_modes):
    asked, lists, decisions, _ = all_modes
    packs = inverted.index_of(spark, SF).packs
    alone = search.packed_hybrid(packs, asked.select(F.col("query_id").alias("item_id"), "text"), 10)
    assert rows_of(lists, "raw_only") == {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in alone.collect()}
    assert rows_of(lists, "memory_only_gated") == rows_of(lists, "memory_only_full_gating")
    chosen = {r["query_id"]: r["chosen"] for r in decisions.where("mode = 'strategy_router'").collect()}
    routed = rows_of(lists, "strategy_router")
    for mode in set(chosen.values()):
        own = {k: v for k, v in rows_of(lists, mode).items() if chosen[k[0]] == mode}
        assert own == {k: v for k, v in routed.items() if chosen[k[0]] == mode}
    applied = {(r["mode"], r["query_id"]): r["applied"] for r in decisions.collect()}
    raw = rows_of(lists, "raw_only")
    for mode in modes.DECISIONS:
        own = rows_of(lists, mode)
        for q in chosen:
            if not applied[mode, q]:
                assert {k: v for k, v in own.items() if k[0] == q} == {k: v for k, v in raw.items() if k[0] == q}
    # queries without a plan are their own plan, so their documents are those of the decision on them
    bare = {r["query_id"] for r in asked.where("query_id % 3 = 0").collect()}
    plain, agentic = rows_of(lists, "selective_rewrite"), rows_of(lists, "agentic_multi_query")
    assert all({v[0] for k, v in plain.items() if k[0] == q} == {v[0] for k, v in agentic.items() if k[0] == q} for q in bare)
    assert sum(applied[m, q] for m, q in applied if m == "rewrite_always") >= sum(applied[m, q] for m, q in applied if m == "selective_rewrite")


def test_guided_lists_are_merged_by_score(spark, all_modes):
    """One memory mode from its parts: memories, guided query, its list, the greater score of each document."""
    asked, lists, _, _ = all_modes
    held = Q.memories(spark, SF)
    index = Q.memory_index(spark, SF)
    near = search.packed_hybrid(index.packs, asked.select(F.col("query_id").alias("item_id"), "text"), 5, mode="dense_only")
    joined = near.join(held.select(F.col("memory_id").alias("doc_id"), F.col("query_text").alias("memory_text")), "doc_id").join(asked.select("query_id", F.col("text").alias("query_text")), "query_id")
    guided = rewrite.guided_query(joined.select("query_id", "query_text", "rank", "memory_text"))
    packs = inverted.index_of(spark, SF).packs
    new = search.packed_hybrid(packs, guided.select(F.col("query_id").alias("item_id"), F.col("guided").alias("text")), 10)
    old = search.packed_hybrid(packs, asked.select(F.col("query_id").alias("item_id"), "text"), 10)
    best = {}
    for r in [*old.collect(), *new.collect()]:
        key = r["query_id"], r["doc_id"]
        best[key] = max(best.get(key, -2), r["score"])
    got = rows_of(lists, "memory_only_ungated")
    for q in {k[0] for k in got}:
        assert [got[q, k][1] for k in range(1, 11)] == sorted((s for (i, _), s in best.items() if i == q), reverse=True)[:10]


def test_metrics_of_all_modes(spark, all_modes):
    asked, lists, _, _ = all_modes
    expected = retrieve.containing(table(spark, SF, "documents"), table(spark, SF, "benchmark")).select(F.col("item_id").alias("query_id"), "doc_id")
    got = modes.mode_metrics(lists, expected, asked, reports.MODES)
    plain = evaluate.retrieval_metrics(lists.where("mode = 'raw_only'").select(F.col("query_id").alias("sample_id"), F.col("doc_id").alias("item_id"), "rank"), expected.select(F.col("query_id").alias("sample_id"), F.col("doc_id").alias("item_id")))
    assert sorted(tuple(r)[1:] for r in got.where("mode = 'raw_only'").collect()) == sorted(tuple(r) for r in plain.collect())
    assert got.count() == len(reports.MODES) * plain.count()


def test_memories_are_cut_from_the_texts_once(spark):
    held = Q.memories(spark, SF)
    assert "documents.parquet" not in " ".join(held.inputFiles())
    assert sorted(map(tuple, held.select("memory_id", "query_text", "product").collect())) == sorted(map(tuple, Q._cut_memories(spark, SF).select("memory_id", "query_text", "product").collect()))
