"""The stored indexes: block-max top k against scoring everything, packs against texts, cells and recall, one build for many readers."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import dense, inverted, retrieve, search, vector_index
from millrace.sources.stored import stored_once
from millrace.sources.tables import table


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of very unlike lengths over a vocabulary with frequent and rare words."""
    g = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(words[min(int(g.expovariate(0.02)), 399)] for _ in range(n))
    rows = [(i, text(g.choice([1, 5, 20, 200]))) for i in range(900)] + [(900, None), (901, ""), (902, "... !!"), (-7, "가나 다라 w399 w399")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    asked = spark.createDataFrame([(i, text(g.choice([1, 3, 9]))) for i in range(60)] + [(60, ""), (61, "unseen"), (62, "가나 w399"), (63, None)], "item_id long, text string").cache()
    return docs, asked


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "inverted")
    inverted.build(corpus[0], folder, block_docs=8)
    return inverted.open_index(spark, folder)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("k", "first"), [(1, 1), (3, 2), (10, 4), (2000, 1)])
def test_block_max_top_k_is_exact(corpus, index, k, first):
    docs, asked = corpus
    plain = retrieve.top_k(retrieve.bm25(docs, asked), "bm25", k).select("query_id", "doc_id", "bm25", "rank")
    found = inverted.bm25_top_k(index, asked, k, first=first).select("query_id", "doc_id", "bm25", "rank")
    assert as_rows(found) == as_rows(plain)


def test_blocks_are_skipped_and_scores_agree(corpus, index):
    docs, asked = corpus
    assert inverted.blocks_skipped(index, asked, 3, first=4).agg(F.sum("skipped")).first()[0] > 0
    assert as_rows(inverted.bm25(index, asked)) == as_rows(retrieve.bm25(docs, asked))
    nine = lambda df: as_rows(df.select("query_id", "doc_id", F.round("technical", 9)))
    assert nine(inverted.technical_overlap(index, asked)) == nine(retrieve.technical_overlap(docs, asked))
    assert index.blocks.agg(F.max(F.size("held"))).first()[0] <= 8


def test_packs_score_as_texts_do(corpus, index, monkeypatch):
    """The fused score of every pair against plain hash vectors, BM25 and sets; blocks of queries change nothing."""
    docs, asked = corpus
    every = search.packed_hybrid(index.packs, asked, 2000)
    monkeypatch.setattr(search, "QUERIES", 7)
    assert as_rows(search.packed_hybrid(index.packs, asked, 3)) == as_rows(every.where("rank <= 3"))
    import re

    from millrace.functions.text import TOKEN

    cut = lambda t: [x.lower() for x in re.findall(TOKEN, t or "")]
    texts, queries = {r["doc_id"]: cut(r["text"]) for r in docs.collect()}, {r["item_id"]: cut(r["text"]) for r in asked.collect()}
    lexical = {(r["query_id"], r["doc_id"]): r["bm25"] for r in retrieve.bm25(docs, asked).collect()}
    technical = {(r["query_id"], r["doc_id"]): r["technical"] for r in retrieve.technical_overlap(docs, asked).collect()}
    vectors = {i: search.hash_vector(t) for i, t in texts.items()}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in every.collect()}
    assert len(got) == len(texts) * len(queries)
    for q, words in list(queries.items())[::7] + [(62, queries[62])]:
        v, most = search.hash_vector(words), max([0.0, *(lexical.get((q, d), 0.0) for d in texts)])
        for d in texts:
            bm = lexical.get((q, d), 0.0) / most if most else 0.0
            score = 2 * (0.58 * min(1, max(0, (v @ vectors[d] + 1) / 2)) + 0.34 * bm + 0.08 * technical.get((q, d), 0.0)) - 1
            assert got[q, d] == pytest.approx(max(-1, min(1, score)), abs=2e-9)
    assert as_rows(search.hybrid(docs, asked, 5)) == as_rows(every.where("rank <= 5"))


def test_empty_index(spark, corpus, tmp_path):
    inverted.build(corpus[0].where("false"), str(tmp_path / "none"))
    none = inverted.open_index(spark, str(tmp_path / "none"))
    assert inverted.bm25_top_k(none, corpus[1]).count() == 0 and search.packed_hybrid(none.packs, corpus[1]).count() == 0


def test_an_index_is_built_once_for_the_state_of_a_table(spark, tmp_path):
    path, built = str(tmp_path / "t.parquet"), []

    def build(folder):
        built.append(folder)
        spark.range(3).write.parquet(f"{folder}/x")

    spark.range(5).write.parquet(path)
    first = stored_once(spark, "probe", [path], build)
    assert stored_once(spark, "probe", [path], build) == first and len(built) == 1 and spark.read.parquet(f"{first}/x").count() == 3
    spark.range(9).write.mode("overwrite").parquet(path)
    assert stored_once(spark, "probe", [path], build) != first and len(built) == 2


def test_second_query_reads_no_text(spark):
    sf = "/root/testdata/sf0.001"
    asked = table(spark, sf, "benchmark")
    index = inverted.index_of(spark, sf)
    for found in (inverted.bm25_top_k(index, asked), search.packed_hybrid(inverted.index_of(spark, sf).packs, asked)):
        assert "documents.parquet" not in " ".join(found.inputFiles())


def vectors_of(spark, n, dim, seed, clusters):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(clusters, dim))
    v = centres[g.integers(0, clusters, n)] + 0.6 * g.normal(size=(n, dim))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def test_vector_index(spark, tmp_path):
    vectors = vectors_of(spark, 4000, 24, 1, 40)
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None, *[1.0] * 23]), (9005, [float("inf")] * 24)], vectors.schema)
    folder = str(tmp_path / "cells")
    vector_index.build(vectors.union(odd), folder, sample=1500)
    index = vector_index.open_index(spark, folder)
    assert index.probes < len(index.centres)
    held = index.blocks.select(F.explode("d.id").alias("id"))
    assert held.count() == 4000 == held.distinct().count()
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = dense.search(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), asked, 10)
    found = vector_index.search(index, asked.union(odd.select("vec_id", "embedding")), 10).cache()
    share = vector_index.recall(found, exact).agg(F.sum("hits") / F.sum("expected")).first()[0]
    assert share >= 0.9
    scores = {(r["query_id"], r["doc_id"]): r["score"] for r in dense.search(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), asked, 4000).collect()}
    assert all(scores[r["query_id"], r["doc_id"]] == pytest.approx(r["score"], abs=2e-9) for r in found.collect())
    assert found.where("query_id > 9000").count() == 0
    whole = vector_index.search(index, asked, 10, probes=len(index.centres))
    assert as_rows(whole.select("query_id", "doc_id", "rank")) == as_rows(exact.select("query_id", "doc_id", "rank"))
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan


def test_vector_index_of_copies_and_of_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    same = spark.range(700).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    vector_index.build(same, str(tmp_path / "same"))
    index = vector_index.open_index(spark, str(tmp_path / "same"))
    assert index.blocks.agg(F.max(F.size("d"))).first()[0] < 100  # one cell, many blocks
    asked = same.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [r["doc_id"] for r in vector_index.search(index, asked, 4).orderBy("rank").collect()] == [0, 1, 2, 4]
    vector_index.build(same.where("false"), str(tmp_path / "none"))
    assert vector_index.search(vector_index.open_index(spark, str(tmp_path / "none")), asked, 4).count() == 0


def test_recall_over_the_given_vectors(spark):
    from millrace.plans import registry

    rows = registry.queries()["ann_recall"](spark, "/root/testdata/sf0.01")
    assert rows.agg(F.sum("hits") / F.sum("expected")).first()[0] >= 0.9


def test_lists_come_from_packs_alone_and_shuffle_no_pairs(spark, corpus, tmp_path):
    """Both lists against scoring every pair; packs are made without postings, rows of one id add up, and a pass ends in k rows a task."""
    docs, asked = corpus
    inverted.write_packs(docs, str(tmp_path / "packs"))
    packs = inverted.read_packs(spark, str(tmp_path / "packs"))
    found = search.lists(packs, asked, 5, (1, 2))
    plain = {1: retrieve.bm25(docs, asked).withColumnRenamed("bm25", "score"), 2: retrieve.technical_overlap(docs, asked).select("query_id", "doc_id", F.round("technical", 9).alias("score"))}
    for kind, scored in plain.items():
        assert as_rows(found.where(F.col("kind") == kind).select("query_id", "doc_id", "score", "rank")) == as_rows(retrieve.top_k(scored, "score", 5).select("query_id", "doc_id", "score", "rank"))
    again = spark.createDataFrame([(1, "a b b"), (1, "b c"), (2, "c"), (3, None)], "doc_id long, text string")
    inverted.write_packs(again, str(tmp_path / "again"))
    items = {r["doc_id"]: r for r in inverted.read_packs(spark, str(tmp_path / "again")).where("kind = 'docs'").selectExpr("inline(items)").collect()}
    assert {i: (r["dl"], r["nt"], sorted(r["tf"])) for i, r in items.items()} == {1: (3, 2, [1, 1, 3]), 2: (1, 1, [1]), 3: (0, 0, [])}


def test_a_pass_makes_only_the_scores_asked_for():
    """Each kind alone is what it is among all; packs of odd letters, repeated rows and none hold what their texts do."""
    texts = [["a\u0130b AiK a a"], ["a \u212a", "a k"], [None], [], ["... !! \uac00\ub098 x"]]
    packs = list(inverted._numbered(iter([pa.record_batch([pa.array(range(5)), pa.array(texts, pa.list_(pa.string()))], names=["id", "texts"])])))
    items = packs[0].column(0).flatten()
    assert items.field("dl").to_pylist() == [5, 2, 0, 0, 3] and items.field("nt").to_pylist() == [3, 2, 0, 0, 1]
    t = items.field("t")[0].values.to_numpy()[:3]
    block = search.QueryBlock(np.array([7]), np.zeros(3, np.int64), t, np.ones(3), np.ones(3), np.ones(3), 5, 2.0)
    every = block.scores(items)
    assert all(m.any() for m in every[1:])
    for kind in (0, 1, 2):
        alone = block.scores(items, (kind,))
        assert np.array_equal(alone[kind + 1], every[kind + 1]) and not any(alone[k + 1].any() for k in (0, 1, 2) if k != kind)


def test_trigrams_of_items_are_never_broadcast(spark):
    items = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("item low "), F.col("id").cast("string")).alias("text"))
    asked = spark.createDataFrame([("low", "low"), ("9", "9")], "query_id string, text string")
    few = retrieve.trigram_pool(items, asked, 3)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan.replace(" ", "") or "strategy=broadcast" in plan
    retrieve.FEW_QUERIES, kept = 1, retrieve.FEW_QUERIES
    try:
        many = retrieve.trigram_pool(items, asked, 3)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    finally:
        retrieve.FEW_QUERIES = kept
    assert as_rows(few) == as_rows(many)


def test_pairs_of_blocks_go_to_python_by_bytes(spark):
    same = spark.range(30).select(F.col("id").alias("doc_id"), F.array(F.col("id") + 1.0, F.lit(2.0)).alias("embedding"))
    asked = same.where("doc_id < 2").select(F.col("doc_id").alias("query_id"), "embedding")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 30)
    found = dense.search(same, asked, 3)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == dense.PAIR_BYTES
    assert found.where("query_id = 0").orderBy("rank").first()["doc_id"] == 1


def test_scores_follow_shared_tokens():
    """Common and rare tokens together give what a product of whole matrices gives; only common ones have a row of all queries."""
    g = np.random.default_rng(5)
    n, vocabulary = 200, np.sort(g.choice(1 << 40, 300, replace=False))
    has = g.random((300, n)) < np.where(np.arange(300) < 5, 0.5, 0.01)[:, None]
    has[:, 3] = False  # a query without known tokens keeps its place
    token, query = np.nonzero(has)
    tech = (np.arange(300) % 3 > 0)[token]
    block = search.QueryBlock(np.arange(n) * 7, query, vocabulary[token], np.ones(len(token)), 1.0 + token, tech, 1000, 12.0)
    assert block.common.shape == ((has[np.unique(token)].sum(axis=1) * search.COMMON > n).sum(), n) and block.common.shape[0] < 60 and len(block.queries) == has.sum()
    docs = [np.sort(g.choice(300, size, replace=False)) for size in (0, 1, 40, 120)]
    items = pa.array([{"doc_id": i, "dl": 2 * len(d), "nt": int((d % 3 > 0).sum()), "t": vocabulary[d].tolist(), "tf": [2] * len(d), "tech": (d % 3 > 0).tolist()} for i, d in enumerate(docs)], pa.struct(inverted.PACK_ITEM))
    _, _, lexical, technical = block.scores(items)
    idf = np.log(1 + (1000 - (1.0 + np.arange(300)) + 0.5) / (1.5 + np.arange(300)))
    for i, d in enumerate(docs):
        w = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 * len(d) / 12)) * np.isin(np.arange(300), d)
        assert np.allclose(lexical[i], w @ has, atol=2e-9)
        both = ((np.arange(300) % 3 > 0) & np.isin(np.arange(300), d)).astype(float) @ has
        size = np.sqrt((d % 3 > 0).sum() * (has & (np.arange(300) % 3 > 0)[:, None]).sum(axis=0))
        assert np.allclose(technical[i], np.where(size > 0, both / np.maximum(size, 1e-9), 0))
    assert [x.tolist() for x in map(np.sort, block.own)] == [np.flatnonzero(has[np.unique(token), q]).tolist() for q in range(n)]


def test_merge_keeps_the_best_of_each_query_in_any_order():
    """Rounded scores with many ties by id, in batches: what sorting everything gives. Scores that are not above the floor never count."""
    g = np.random.default_rng(8)
    score, ids = np.round(g.integers(0, 6, (90, 7)) / 3, 9), g.permutation(90) - 20
    score[:, 2] = 0
    for above in (-np.inf, 0.0):
        held = search._nothing(7, 5, 1, above)
        for at in range(0, 90, 8):
            noise = g.uniform(-4e-10, 4e-10, score[at : at + 8].shape)
            held = search._merge(held, score[at : at + 8] + noise, ids[at : at + 8], (score[at : at + 8] * 2,))
        for q in range(7):
            order = [i for i in np.lexsort((ids, -score[:, q])) if score[i, q] > above][:5]
            there = held[0][q] > above
            assert held[1][q][there].tolist() == ids[order].tolist() and held[0][q][there].tolist() == score[order, q].tolist()
            assert held[2][q][there].tolist() == np.round(score[order, q] * 2, 9).tolist()


def test_blocks_of_queries_are_bounded_by_their_tokens(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TOKENS", 10)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(f"t{k}" for k in range(n))) for i, n in enumerate((4, 4, 4, 30, 0, 1))], "item_id long, text string")
    blocks = list(search.query_blocks(search.packs_of(docs), asked))
    assert [b.ids.tolist() for b in blocks] == [[0, 1], [2], [3], [4, 5]]
    assert [b.ids.tolist() for b in search.query_blocks(search.packs_of(docs), asked, size=1)] == [[i] for i in range(6)]


def test_numbers_of_words_cut_together_are_those_of_each_text(monkeypatch):
    """Texts of any letters and spaces, rows of one id, packs that are full, and a task that forgets its words: what cutting each text alone gives."""
    texts = [["a b a", None, "B c"], [" \x1c\x85  "], [], [None], ["café A_b ./-"], ["가나a1가 Aİb K"], ["K k K \U0001f600x"], ["Ａ ßs\x00t �z"], ["x " * 300]]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], names=["id", "texts"])
    for docs, pieces, known in ((256, 4096, 500_000), (2, 4096, 500_000), (256, 2, 1)):
        monkeypatch.setattr(inverted, "PACK_DOCS", docs)
        monkeypatch.setattr(inverted, "PIECE_DOCS", pieces, raising=False)
        monkeypatch.setattr(inverted, "KNOWN", known)
        rows = [r for b in inverted._numbered(iter([batch])) for r in b.to_pylist()]
        items = [x for r in rows for x in r["items"] or ()]
        assert [x["doc_id"] for x in items] == list(range(len(texts))) and all(len(r["items"]) <= docs for r in rows if r["items"])
        df, length = {}, 0
        for x, own in zip(items, texts, strict=True):
            cut = [[w.lower() for w in inverted._TOKEN.findall(t)] for t in own if t is not None]
            number = {w: int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big", signed=True) for c in cut for w in c}
            technical = {w for w in number if any("0" <= ch <= "9" or "a" <= ch <= "z" for ch in w)}
            assert dict(zip(x["t"], x["tf"], strict=True)) == {t: sum(c.count(w) for c in cut) for w, t in number.items()}
            assert {t for t, is_one in zip(x["t"], x["tech"], strict=True) if is_one} == {number[w] for w in technical}
            assert (x["dl"], x["nt"]) == (max(map(len, cut), default=0), max((len(technical & set(c)) for c in cut), default=0))
            length += x["dl"]
            for t in number.values():
                df[t] = df.get(t, 0) + 1
        seen = [r for r in rows if r["seen"] is not None]
        assert (sum(r["docs"] for r in seen), sum(r["length"] for r in seen)) == (len(texts), length)
        assert {t: sum(p["df"] for r in seen for p in r["seen"] if p["t"] == t) for t in df} == df


def test_a_reader_of_packs_holds_a_small_row_group(spark, tmp_path, monkeypatch):
    """Packs of 100 and more in a row group made a reader run out of memory."""
    monkeypatch.setattr(inverted, "ROW_GROUP", 1 << 15, raising=False)
    docs = spark.range(256 * 130).coalesce(1).selectExpr("id AS doc_id", "concat('w', id, ' v') AS text")
    inverted.write_packs(docs, str(tmp_path / "packs"))
    made = [pq.ParquetFile(p).metadata for p in (tmp_path / "packs/kind=docs").glob("*.parquet")]
    assert sum(m.num_rows for m in made) >= 130 and max(m.row_group(i).num_rows for m in made for i in range(m.num_row_groups)) <= 20
    packs = inverted.read_packs(spark, str(tmp_path / "packs"))
    assert packs.where("kind = 'all'").select("n_docs", "avgdl").first() == (256 * 130, 2.0)
    assert packs.where("kind = 'terms'").agg(F.count("t"), F.max("df")).first() == (256 * 130 + 1, 256 * 130)


def test_terms_and_texts_are_not_shuffled_for_few_rows(spark, corpus, tmp_path, monkeypatch):
    """Terms meet the queries' tokens, and texts the rows found, where they are read; the same rows come out when there are too many to be sent."""
    docs, asked = corpus
    inverted.write_packs(docs, str(tmp_path / "packs"))
    packs = inverted.read_packs(spark, str(tmp_path / "packs"))
    found = search.lists(packs, asked, 5, (1,))
    few = retrieve.with_rows(found, docs.select("doc_id", "text"))
    assert "rightHint=(strategy=broadcast)" in few._jdf.queryExecution().optimizedPlan().toString().replace(" ", "")
    monkeypatch.setattr(retrieve, "FEW_ROWS", 0)
    many = retrieve.with_rows(found, docs.select("doc_id", "text"))
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString() and as_rows(few.select(many.columns)) == as_rows(many)
    blocks = [list(search.query_blocks(packs, asked))]
    monkeypatch.setattr(search, "QUERY_TOKENS", 0)
    blocks.append(list(search.query_blocks(packs, asked)))
    weights = [{q: sorted(b.idf[own].round(9)) for b in each for q, own in zip(b.ids.tolist(), b.own, strict=True)} for each in blocks]
    assert weights[0] == weights[1] and len(blocks[1]) > len(blocks[0])


def test_subqueries_are_searched_in_packs(spark, corpus, index):
    """The fused lists of subqueries are those of scoring every document, with repeated, empty and unseen subqueries, and no text is read."""
    from millrace.operators import rewrite

    docs, asked = corpus
    parts = asked.select((F.col("item_id") % 17).alias("query_id"), F.col("item_id").alias("seq"), "text")
    told = parts.select(F.xxhash64("query_id", "seq").alias("item_id"), "query_id", "seq", "text")
    plain = retrieve.top_k(retrieve.bm25(docs, told), "bm25", 5).select(F.col("query_id").alias("item_id"), "doc_id", F.col("bm25").alias("score"), "rank")
    lists = plain.join(told.select("item_id", "query_id", F.col("seq").alias("source")), "item_id").drop("item_id")
    expected = retrieve.rrf(lists, 5).select("query_id", "doc_id", "rrf", "best", "rank")
    found = rewrite.subquery_search(index.packs, parts, 5, 5)
    assert as_rows(found) == as_rows(expected) and found.count() > 50


def test_blocks_are_the_only_postings(spark, tmp_path):
    """Counts of every posting, token and document, with repeated and null ids, and nothing stored beside the blocks but what is said of them."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c d e"), (2, "b. !! b."), (3, None), (4, "..."), (None, "a z"), (None, "z")], "doc_id long, text string")
    inverted.write_blocks(docs, str(tmp_path / "x"), block_docs=2)
    assert {p.name for p in (tmp_path / "x").iterdir()} == {"blocks", "terms", "stats"}
    index = inverted.open_index(spark, str(tmp_path / "x"))
    assert {(r["doc_id"], r["token"], r["tf"], r["dl"]) for r in index.postings.collect() if r["doc_id"] == 1} == {(1, "a", 3, 4), (1, "b", 1, 4), (1, "c", 1, 4), (1, "d", 1, 4), (1, "e", 1, 4)}
    terms = {r["token"]: (r["df"], r["most"]) for r in index.terms.collect()}
    assert terms["a"] == (2, 3) and terms["z"] == (1, 2) and terms["c"] == (1, 1) and len(terms) == 8
    assert index.stats.first()["n_docs"] == 5
