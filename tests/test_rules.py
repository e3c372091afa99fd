"""Rules with known answers: categories, families, phrases, short queries, rewrites, literal matches, hybrid ranking."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.operators import dataset, inverted, reports, retrieve, search


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("kind", "text", "category"), [("short_user", "error", "short_user"), ("code_mixed", "x", "code_mixed"), ("follow_up", "fail", "follow_up"), ("definition", "It FAILED", "troubleshooting"), ("reason", "오류가 납니다", "troubleshooting"), (None, "how to configure", "general_ko")])
def test_categories(spark, kind, text, category):
    assert one(spark, dataset.category(F.lit(kind).cast("string"), F.lit(text))) == category


@pytest.mark.parametrize(("url", "doc", "family"), [("https://a.b/x/y/z", "d::1", "a.b/x"), ("https://a.b//x/", "d::1", "a.b/x"), ("https://a.b/", "d::1", "a.b"), ("", "d::1::2", "d"), (None, "d", "d"), ("no/host", "d::1", "/no")])
def test_families(spark, url, doc, family):
    assert one(spark, dataset.family(F.lit(url).cast("string"), F.lit(doc))) == family


def test_phrases(spark):
    functional = {"": True, "can be": True, "Supported": True, "config": True, "config.yml": False, "설정할 수 있습니다": True, "지원합니다": True, "JpaRepository를 사용합니다": False, "트랜잭션": False}
    for text, expected in functional.items():
        assert one(spark, P.is_functional(F.lit(text))) is expected, text
    assert [one(spark, P.is_valid_anchor(F.lit(t))) for t in ("ab", "a.b.c.d.e.f.g.h", "x" * 121, "@Bean", "'spring'")] == [False, False, False, True, False]
    assert one(spark, P.anchor_tokens(F.lit("Use @Bean, spring and RestTemplate; resttemplate v2 plain foo-bar."))) == ["Use", "@Bean", "RestTemplate", "foo-bar"]
    assert one(spark, P.content_tokens(F.lit("The spring Boot 12 ab a1 a1b 트랜잭션 가 사용 Tables tables"))) == ["the", "a1b", "트랜잭션", "tables"]
    assert one(spark, P.content_tokens(F.lit("spring one two three"), 2, True)) == ["spring", "one"]
    assert one(spark, P.hint_tokens(F.lit("JdbcTemplate HTTP2 JSON API plain spring.datasource.url usage"), F.lit("en"), 3)) == ["JdbcTemplate", "HTTP2", "spring.datasource.url"]
    assert one(spark, P.product_aliases(F.lit(" Spring_Boot_Docs "))) == ["spring-boot", "spring-boot-docs"] and one(spark, P.product_aliases(F.lit("-doc"))) == ["-doc"] and one(spark, P.product_aliases(F.lit(None).cast("string"))) == []
    label = P.OVERLAP_LABEL
    cases = {f"{label}\ntail text\n\nbody\n\nmore": (9, "body\n\nmore"), f"{label}\n\nbody": (0, "body"), f"{label} no end": (0, f"{label} no end"), "plain\n\ntext": (0, "plain\n\ntext")}
    for text, expected in cases.items():
        assert tuple(one(spark, P.overlap_of_chunk(F.lit(text)))) == expected
    assert one(spark, P.encoder_text(F.lit("x"), "intfloat/multilingual-E5-small", "query")) == "query: x" and one(spark, P.encoder_text(F.lit("x"), "hash", "query")) == "x"


def test_short_queries(spark):
    made = lambda text, kind, lang, terms=(): one(spark, P.short_query_variants(F.lit(text), F.array(*map(F.lit, terms)).cast("array<string>"), F.lit(kind), lang))
    assert made("How do I use JdbcTemplate with spring.datasource.url?", "procedure", "en") == ["JdbcTemplate how?", "JdbcTemplate spring.datasource.url how?", "How do I use JdbcTemplate with spring.datasource.url?"]
    assert made("트랜잭션 전파 방법", "reason", "ko", ["@Transactional", "설정"])[:3] == ["@Transactional 왜?", "@Transactional 트랜잭션 왜?", "@Transactional 트랜잭션 전파?"]
    assert made("what is it then?!", "short_user", "en") == ["what is it?", "what is it then?!?"]
    assert made("", "x", "en") == ["?"] and made("y" * 80, "definition", "ko") == ["y" * 64 + "?"]


def test_template_rewrites(spark):
    none = F.lit(None).cast("string")
    rows = one(spark, P.template_rewrites(F.lit("질문"), F.lit("기억"), none, none))
    assert [tuple(r) for r in rows] == [("explicit_standalone", "질문를 스프링 기술 문서 기준으로 독립 질문 형태로 상세히 설명해 주세요."), ("memory_anchored", "질문 관련하여 기억"), ("task_or_error_focused", "질문가 실패하거나 오류가 날 때 점검 순서를 알려주세요.")]
    rows = one(spark, P.template_rewrites(F.lit("q"), none, F.lit("before"), F.lit(" seen "), 2))
    assert [r["query"] for r in rows] == ["before 이후 맥락에서 q를 독립 질문으로 재작성해 주세요. seen", "q 관련하여 q"]
    alone = lambda *a: [tuple(r) for r in one(spark, P.standalone_rewrites(*a))]
    assert alone(F.lit("q"), none, F.lit(2), F.lit("before"), F.lit("seen")) == [("standalone", "before q seen", 0, "low")]
    assert alone(F.lit("q"), F.lit("Q  hint"), F.lit(0), none, none) == [("standalone", "q", 0, "low"), ("expanded", "Q  hint", 1, "medium")]
    assert alone(F.lit("q"), F.lit(" Q "), F.lit(2), none, none) == [("standalone", "q", 0, "low")]


def test_literal_matches(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the long passage of the text, with 日本語 and more"), (2, "Das ist τέλος"), (3, None), (4, ""), (5, "x" * 100)], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "passage of the text, with 日本語 and more"), (2, "日本語"), (3, "text"), (4, "τέλος"), (5, None), (6, ""), (7, "x" * 99 + "y"), (8, "x" * 99), (9, "two tokens"), (10, "passage of the text, with 日本語 and less")], "item_id long, text string")
    expected = {(1, 1), (2, 1), (3, 1), (4, 2), (8, 5), (6, 1), (6, 2), (6, 4), (6, 5)}
    for chars in (1 << 20, 10):
        monkeypatch.setattr(search, "PATTERN_CHARS", chars)
        assert {tuple(r) for r in retrieve.containing(docs, passages).collect()} == expected


def test_pattern_pool_has_no_limit(spark):
    docs = spark.createDataFrame([(1, "Alpha w17 beta"), (2, "w17 w18"), (3, None)], "doc_id long, text string")
    asked = spark.range(20_000).select(F.col("id").alias("query_id"), F.array(F.concat(F.lit("W"), F.col("id").cast("string"), F.lit(" ")), F.lit("beta")).alias("patterns"))
    got = {(r["query_id"], r["doc_id"]): r["hits"] for r in retrieve.pattern_pool(docs, asked.where("query_id IN (17, 18) OR query_id > 19000"), 1).collect()}
    assert got[17, 1] == 2 and got[18, 1] == 1 and got[19_999, 1] == 1
    assert retrieve.pattern_pool(docs, asked, 1).count() == 20_000


def test_hybrid_sees_documents_without_a_shared_token(spark, tmp_path):
    """Exact technical terms rank first by BM25; a document that shares no token still has a place by its vector."""
    docs = spark.createDataFrame([(1, "JNDI lookup of a DataSource"), (2, "plain words here"), (3, "other words there"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "JNDI DataSource"), (8, "")], "item_id long, text string")
    rows = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in search.hybrid(docs, asked, 4).collect()}
    assert rows[7, 1][0] == 1 and len(rows) == 8 and rows[7, 1][1] > rows[7, 2][1]
    assert [rows[8, k][0] for k in (1, 2, 3, 4)] == [1, 2, 3, 4]
    only = search.hybrid(docs, asked, 1, mode="bm25_only").where("query_id = 7").first()
    assert (only["doc_id"], only["score"]) == (1, 1.0)
    inverted.build(docs, str(tmp_path / "index"))
    pooled = {r["query_id"]: r["doc_id"] for r in search.pooled_hybrid(inverted.open_index(spark, str(tmp_path / "index")), asked, 2, 1).collect()}
    assert pooled == {7: 1, 8: 1}


def test_numbered_rows(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 50) for i in range(500)], "id long, at long")
    got = {r["id"]: r["label"] for r in reports.numbered(rows, "at", "id", "n", 7).collect()}
    assert got == {i: f"n{k}" for k, (_, i) in enumerate(sorted(((i * 7) % 50, i) for i in range(500)), 1)}


def test_probe_counts_and_ratios(spark):
    rows = spark.createDataFrame([("a", "q", 3), ("a", "q", 9), ("a", "q", None), ("a", "", 1), ("a", None, 2)], "variant string, query string, first_rank int")
    r = reports.variant_matrix(rows, 4).first()
    assert (r["hit_count"], r["hit_rate"], r["missing_variant_count"], r["ranked_count"], r["mean_rank_when_found"]) == (1, 0.25, 2, 2, 6.0)
    assert one(spark, reports.nested_metric(F.lit('{"a": "", "dedupe_summary": {"a": "7"}}'), "a")) == 7 and one(spark, reports.nested_metric(F.lit("{}"), "a")) == 0
    assert one(spark, reports.merged_json(F.lit('{"b": "1", "a": "2", "c": null}'), F.lit('{"a": "3"}'))) == '{"a":"3","b":"1"}'
    assert math.isclose(one(spark, reports.ratio(F.lit(1), F.lit(4))), 0.25) and one(spark, reports.ratio(F.lit(1), F.lit(0))) is None


def test_dataset_quotas(spark):
    """Quotas hold, families are on one side, and what is missing is made in turn; one family serves both sides."""
    schema = "id long, created_at long, query_text string, query_type string, family string, category string"
    rows = [(i, i, f"q{i}? more", "definition", f"f{i % 4}", ["general_ko", "short_user"][i % 3 == 0]) for i in range(40)]
    targets = {"dev": {"general_ko": 3, "short_user": 30, "code_mixed": 2}, "test": {"general_ko": 40}}
    out = dataset.build_dataset(spark.createDataFrame(rows, schema), targets, 30).collect()
    counts = {(s, c): sorted(r["place"] for r in out if (r["split"], r["category"]) == (s, c)) for s, cs in targets.items() for c in cs}
    assert counts == {(s, c): list(range(n)) for s, cs in targets.items() for c, n in cs.items()} and min(r["id"] for r in out) >= 10
    sides = {s: {r["id"] % 4 for r in out if r["split"] == s} for s in targets}
    assert not sides["dev"] & sides["test"] and len(sides["dev"]) == 2
    made = [r for r in out if r["made"]]
    assert {(r["category"], r["query_type"]) for r in made} == {("short_user", "short_user"), ("code_mixed", "code_mixed"), ("general_ko", "procedure")}
    assert all(r["query_text"] == f"q{r['id']} 빠르게?" for r in made if r["category"] == "short_user")
    one_family = dataset.build_dataset(spark.createDataFrame([(1, 1, "only", "x", "f", "general_ko")], schema), {"dev": {"general_ko": 1}, "test": {"general_ko": 2}}).collect()
    assert sorted((r["split"], r["place"], r["made"]) for r in one_family) == [("dev", 0, False), ("test", 0, False), ("test", 1, True)]
    assert dataset.build_dataset(spark.createDataFrame([], schema), targets).count() == 0
