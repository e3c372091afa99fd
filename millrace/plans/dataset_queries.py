"""Dataset, memory and import queries, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dataset, memory
from millrace.plans.gate_queries import SQL_DECIDED, _decided
from millrace.plans.registry import query
from millrace.plans.text_queries import SQL_TOKENS
from millrace.sources.tables import table

TYPES = {"definition": 0.3, "procedure": 0.4, "comparison": 0.2, "short_user": 0.1}
ANSWERS = {"single": 0.70, "near": 0.20, "far": 0.10}


def _sql_unit(seed: str, *parts: str) -> str:
    joined = " || ':' || ".join([f"'{seed}'", *parts])
    return f"(('0x' || substr(md5({joined}), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0)"


def _sql_choice(u: str, weights: dict[str, float]) -> str:
    out, passed, total = "CASE", 0.0, sum(weights.values())
    for name, w in weights.items():
        passed += w / total
        out += f" WHEN {u} < {passed!r} THEN '{name}'"
    return f"{out} ELSE '{list(weights)[-1]}' END"


@query("query_planning", f"""
WITH n AS (SELECT doc_id, greatest(0, round(2.0 + ({_sql_unit("plan", "doc_id")} * 1.8 - 0.9)))::INT AS n FROM documents), s AS (SELECT doc_id, unnest(range(1, n + 1)) AS seq FROM n)
SELECT doc_id, seq::INT AS seq, {_sql_choice(_sql_unit("plan:type", "doc_id", "seq"), TYPES)} AS query_type, {_sql_choice(_sql_unit("plan:answer", "doc_id", "seq"), ANSWERS)} AS answerability FROM s""")
def query_planning(spark, sf_dir):
    return dataset.plan_queries(table(spark, sf_dir, "documents"), 2.0, TYPES, ANSWERS, id_col="doc_id")


SQL_FAMILY = "concat_ws('/', regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1))"


@query("family_split", f"""SELECT page_id, {SQL_FAMILY} AS family, CASE WHEN {_sql_unit("split", SQL_FAMILY)} < 0.5 THEN 'dev' ELSE 'test' END AS split FROM pages""")
def family_split(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", dataset.family(F.col("url")).alias("family"))
    return dataset.split_families(pages)


@query("query_categories", """WITH q AS (SELECT CASE conv_id % 5 WHEN 0 THEN 'short_user' WHEN 1 THEN 'follow_up' ELSE 'definition' END AS t, coalesce(text, '') || CASE WHEN turn = 1 THEN ' FAILED' ELSE '' END AS text FROM conversations)
SELECT CASE WHEN t IN ('short_user', 'code_mixed', 'follow_up') THEN t WHEN regexp_matches(lower(text), '오류|에러|exception|failed|fail') THEN 'troubleshooting' ELSE 'general_ko' END AS category, count(*)::BIGINT AS n FROM q GROUP BY 1""")
def query_categories(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("conv_id") % 5 == 0, "short_user").when(F.col("conv_id") % 5 == 1, "follow_up").otherwise("definition")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") == 1, " FAILED").otherwise(""))
    return turns.groupBy(dataset.category(kind, text).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("category_summary", "SELECT o_orderpriority AS mode, o_orderstatus AS category, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY ALL")
def category_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("category"), "o_totalprice")
    return dataset.category_summary(rows, ["mode", "category"], ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("latency_summary", """WITH t AS (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value - 5 END AS total, CASE WHEN event_type = 'view' THEN value END AS pure FROM events)
SELECT event_type, round(avg(total) FILTER (WHERE total >= 0), 6) AS avg_total, count(*) FILTER (WHERE total >= 0)::BIGINT AS n_total, round(avg(pure) FILTER (WHERE pure >= 0), 6) AS avg_pure, count(*) FILTER (WHERE pure >= 0)::BIGINT AS n_pure FROM t GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select("event_type", F.when(F.col("event_id") % 10 != 0, F.col("value") - 5).alias("total"), F.when(F.col("event_type") == "view", F.col("value")).alias("pure"))
    found = dataset.latency_summary(rows, ["total", "pure"], ["event_type"])
    return found.withColumns({c: F.round(c, 6) for c in ("avg_total", "avg_pure")})


SQL_IMPORT = """
known AS (SELECT doc_id AS document_id, source AS url, split_part(text, chr(10), 1) AS title, md5(text) AS checksum, lang AS version, doc_id AS seq FROM documents WHERE n_chars < 2000),
batch AS (SELECT doc_id AS document_id, source AS url, split_part(text, chr(10), 1) AS title, md5(text) AS checksum, CASE WHEN n_chars < 1000 THEN lang ELSE lang || '2' END AS version, doc_id AS seq FROM documents)"""


def _import_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    make = lambda df, version: df.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("url"), F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), F.md5(F.col("text").cast("binary")).alias("checksum"), version.alias("version"), F.col("doc_id").alias("seq"))
    newer = F.when(F.col("n_chars") < 1000, F.col("lang")).otherwise(F.concat(F.col("lang"), F.lit("2")))
    return make(docs, newer), make(docs.where("n_chars < 2000"), F.col("lang"))


@query("import_decisions", rf"""
WITH {SQL_IMPORT}, k AS (SELECT *, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS t FROM known), b AS (SELECT *, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS t FROM batch),
u AS (SELECT url, checksum, coalesce(version, '') AS v, min(document_id) AS own FROM k GROUP BY ALL), h AS (SELECT t, checksum, min(document_id) AS own FROM k GROUP BY ALL),
j AS (SELECT b.*, k.document_id IS NOT NULL AS there, k.document_id IS NOT NULL AND (k.url, k.title, k.checksum, k.version) IS NOT DISTINCT FROM (b.url, b.title, b.checksum, b.version) AS same,
  coalesce(u.own, min(b.document_id) OVER (PARTITION BY b.url, b.checksum, coalesce(b.version, ''))) AS own_u, coalesce(h.own, min(b.document_id) OVER (PARTITION BY b.t, b.checksum)) AS own_t
  FROM b LEFT JOIN u ON u.url = b.url AND u.checksum = b.checksum AND u.v = coalesce(b.version, '') LEFT JOIN h ON h.t = b.t AND h.checksum = b.checksum LEFT JOIN k ON k.document_id = b.document_id)
SELECT document_id, CASE WHEN same THEN 'unchanged_content_skipped' WHEN own_u <> document_id THEN 'duplicate_url_skipped' WHEN own_t <> document_id THEN 'same_title_hash_skipped' WHEN there THEN 'updated' ELSE 'inserted' END AS action FROM j""")
def import_decisions(spark, sf_dir):
    return dataset.import_decisions(*_import_rows(spark, sf_dir))


@query("superseded_documents", "SELECT page_id AS document_id, last_value(page_id) OVER w = page_id AS active, nullif(last_value(page_id) OVER w, page_id) AS superseded_by FROM pages WINDOW w AS (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def superseded_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("url"), F.col("page_id").alias("seq"))
    return dataset.superseded(rows)


@query("alias_dry_run", """WITH a AS (SELECT p_partkey AS alias_id, p_brand AS term_id, p_name AS stored, CASE WHEN p_size = 1 THEN '' WHEN p_size < 25 THEN p_name || ' ' || p_brand ELSE p_name || p_size END AS normal FROM part),
s AS (SELECT normal, min(term_id) AS lo, max(term_id) AS hi FROM a WHERE normal <> '' GROUP BY normal)
SELECT alias_id, CASE WHEN normal = '' THEN 'invalid' WHEN lo <> hi THEN 'conflict' WHEN stored = normal THEN 'unchanged' ELSE 'would_update' END AS class FROM a LEFT JOIN s USING (normal)""")
def alias_dry_run(spark, sf_dir):
    normal = F.when(F.col("p_size") == 1, "").when(F.col("p_size") < 25, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.concat("p_name", F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("alias_id"), F.col("p_brand").alias("term_id"), F.col("p_name").alias("stored"), normal.alias("normal"))
    return dataset.alias_dry_run(rows)


@query("remap_anchors", "SELECT DISTINCT o_custkey AS query_id, l_suppkey AS term_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def remap_anchors(spark, sf_dir):
    orders, lines, suppliers = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier"))
    return dataset.remap_anchors(
        orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id")), lines.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("term_id")),
        suppliers.select(F.col("s_suppkey").alias("term_id"), (F.col("s_acctbal") > 0).alias("active")))


@query("memory_snapshot", f"""WITH RECURSIVE {SQL_DECIDED} SELECT b.item_id AS query_id, left(d.text, 700) AS preview, round(de.utility, 9) AS utility FROM de JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = b.item_id
WHERE coalesce(rule_ok, TRUE) AND coalesce(p2, TRUE) AND coalesce(p3, TRUE)""")
def memory_snapshot(spark, sf_dir):
    bench, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    gated = _decided(spark, sf_dir).join(bench, "item_id").withColumnsRenamed({"item_id": "query_id", "text": "query_text"}).withColumn("chunk_id", F.col("query_id"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("product"), F.col("text").alias("content"))
    return memory.build_snapshot(gated, chunks, "retrieval_utility").select("query_id", "preview", F.round("utility", 9).alias("utility"))


@query("top_memories", f"""
WITH m AS (SELECT page_id AS memory_id, page_id % 10 / 10.0 AS utility, unnest(list_distinct({SQL_TOKENS.format("url")})) AS token FROM pages),
q AS (SELECT item_id AS query_id, unnest(list_distinct({SQL_TOKENS.format("text || ' https index'")})) AS token FROM benchmark),
s AS (SELECT query_id, memory_id, count(*) AS shared, any_value(utility) AS utility FROM m JOIN q USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, utility DESC, memory_id) AS rank FROM s) SELECT query_id, memory_id, shared, rank::INT AS rank FROM r WHERE rank <= 5""")
def top_memories(spark, sf_dir):
    entries = table(spark, sf_dir, "pages").select(F.col("page_id").alias("memory_id"), (F.col("page_id") % 10 / 10.0).alias("utility"), F.col("url").alias("query_text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" https index")).alias("text"))
    return memory.top_memories(entries, asked).select("query_id", "memory_id", "shared", "rank")


@query("missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_embeddings(spark, sf_dir):
    return memory.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("json_reply_texts", """SELECT event_id, CASE event_type WHEN 'view' THEN nullif(trim(json_extract_string(props, '$.k')), '') WHEN 'click' THEN coalesce(nullif(trim(json_extract_string(props, '$.q')), ''), nullif(trim(json_extract_string(props, '$.k')), '')) END AS query_text FROM events""")
def json_reply_texts(spark, sf_dir):
    fields = {"view": ("k",), "click": ("q", "k")}
    return table(spark, sf_dir, "events").select("event_id", dataset.query_text(F.col("event_type"), F.col("props"), fields).alias("query_text"))


TARGETS = {"dev": {"general_ko": 12, "troubleshooting": 6, "short_user": 9, "follow_up": 4}, "test": {"general_ko": 8, "code_mixed": 3, "short_user": 5}}
SQL_HASHED = "('0x' || substr(md5({0}), 1, 12))::UBIGINT::DOUBLE / 16.0 ** 12"


@query("dataset_build", f"""
WITH c AS (SELECT conv_id * 100 + turn AS id, conv_id % 13 AS created_at, coalesce(text, '') AS q, 'f' || conv_id % 6 AS family, CASE WHEN conv_id % 5 = 0 THEN 'short_user' WHEN regexp_matches(lower(coalesce(text, '')), 'fail|exception') THEN 'troubleshooting' WHEN conv_id % 7 = 1 THEN 'follow_up' ELSE 'general_ko' END AS category, role AS t FROM conversations),
nw AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) - 1 AS new FROM c ORDER BY created_at DESC, id LIMIT 60),
fa AS (SELECT family, row_number() OVER (ORDER BY {SQL_HASHED.format("'dataset:' || family")}, family) AS fpos, count(*) OVER () AS n FROM (SELECT DISTINCT family FROM nw)),
de AS (SELECT family, unnest(CASE WHEN n = 1 THEN ['dev', 'test'] WHEN fpos <= n // 2 THEN ['dev'] ELSE ['test'] END) AS split FROM fa),
ow AS (SELECT split, category, id, q, t, new, row_number() OVER (PARTITION BY split, category ORDER BY {SQL_HASHED.format("'dataset:' || split || ':' || id")}, id) - 1 AS k, row_number() OVER (PARTITION BY split ORDER BY new) - 1 AS p FROM nw JOIN de USING (family)),
wa(split, category, want) AS (VALUES {", ".join(f"('{s}', '{c}', {n})" for s, cs in TARGETS.items() for c, n in cs.items())}),
ak AS (SELECT wa.*, (SELECT count(*) FROM ow WHERE ow.split = wa.split AND ow.category = wa.category) AS have, (SELECT count(*) FROM ow WHERE ow.split = wa.split) AS ns, (SELECT count(*) FROM nw) AS na FROM wa),
sh AS (SELECT ak.*, i FROM ak, LATERAL (SELECT unnest(range(0, want - have)) AS i) WHERE have < want),
fi AS (SELECT sh.split, sh.category, have + i AS place, ow.id, ow.q FROM sh JOIN ow ON have > 0 AND ow.split = sh.split AND ow.category = sh.category AND ow.k = i % have
  UNION ALL SELECT sh.split, sh.category, i, ow.id, ow.q FROM sh JOIN ow ON have = 0 AND ns > 0 AND ow.split = sh.split AND ow.p = i % ns UNION ALL SELECT sh.split, sh.category, i, nw.id, nw.q FROM sh JOIN nw ON have = 0 AND ns = 0 AND nw.new = i % na)
SELECT split, category, k::INT AS place, id, q AS query_text, t AS query_type, FALSE AS made FROM ow JOIN wa USING (split, category) WHERE k < want
UNION ALL SELECT split, category, place::INT, id, CASE category WHEN 'troubleshooting' THEN q || ' 실행 시 오류가 나는 경우 점검 포인트를 알려주세요.' WHEN 'short_user' THEN trim(split_part(q, '?', 1)) || ' 빠르게?' WHEN 'code_mixed' THEN q || ' 설정할 때 default property가 뭐야?'
  WHEN 'follow_up' THEN q || ' 그다음에는 뭘 하면 돼?' ELSE q || ' 실무 예시까지 포함해서 설명해 주세요.' END, CASE category WHEN 'troubleshooting' THEN 'reason' WHEN 'short_user' THEN 'short_user' WHEN 'code_mixed' THEN 'code_mixed' WHEN 'follow_up' THEN 'follow_up' ELSE 'procedure' END, TRUE FROM fi""")
def dataset_build(spark, sf_dir):
    conv, text = F.col("conv_id"), F.coalesce("text", F.lit(""))
    kind = F.when(conv % 5 == 0, "short_user").when(F.lower(text).rlike("fail|exception"), "troubleshooting").when(conv % 7 == 1, "follow_up").otherwise("general_ko")
    rows = table(spark, sf_dir, "conversations").select((conv * 100 + F.col("turn")).alias("id"), (conv % 13).alias("created_at"), text.alias("query_text"), F.col("role").alias("query_type"), F.concat(F.lit("f"), (conv % 6).cast("string")).alias("family"), kind.alias("category"))
    return dataset.build_dataset(rows, TARGETS, 60)
