"""Corpus ingest queries: URLs, pages, chunks, glossary, with DuckDB statements where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.operators import chunk, glossary, html_sections
from millrace.plans.registry import query
from millrace.plans.text_queries import SQL_TECHNICAL
from millrace.sources import urls
from millrace.sources.tables import table

RULES = urls.UrlRules(("http://", "https://"), ("//m.",))
SQL_NORMAL = r"""lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1)) || '://' || regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2) ||
  regexp_replace(regexp_replace(CASE WHEN regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) = '' THEN '/' ELSE regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) END, '/{{2,}}', '/', 'g'), '/$', '/index.html')"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("url_normalise", f"SELECT page_id, {SQL_NORMAL.format('url')} AS normal_url FROM pages")
def url_normalise(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.normal_url(F.col("url")).alias("normal_url"))


@query("url_admission", f"""
WITH n AS (SELECT page_id, {SQL_NORMAL.format("url")} || '.html' AS u FROM pages), p AS (SELECT *, regexp_replace(u, '^https?://', '') AS inside FROM n)
SELECT page_id, NOT contains(lower(u), '//m.') AND regexp_matches(u, '^https?://') AND NOT regexp_matches(split_part(inside, '/', 1), '^[0-9]+(?:\\.[0-9]+)*(?:[-.][A-Za-z0-9]+)?$')
  AND NOT regexp_matches(regexp_extract(u, '^[a-z]+://[^/]*(.*)$', 1), '[{{}}]') AS admitted FROM p""")
def url_admission(spark, sf_dir):
    address = F.concat(urls.normal_url(F.col("url")), F.lit(".html"))
    return _pages(spark, sf_dir).select("page_id", urls.admitted(address, RULES).alias("admitted"))


@query("page_links", r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS href FROM pages)
SELECT page_id, list_sort(list(DISTINCT origin || regexp_replace(regexp_replace(regexp_extract(href, '^([^?#]*)', 1), '/{2,}', '/', 'g'), '/$', '/index.html')))::VARCHAR[] AS links FROM h WHERE starts_with(href, '/') GROUP BY page_id""")
def page_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.links(F.col("html"), F.col("url")).alias("links")).where(F.size("links") > 0)


@query("page_metadata", f"""
SELECT page_id, {SQL_NORMAL.format("url")} AS canonical_url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
  regexp_extract(html, '(?i)<html\\b[^>]*\\blang=["'']([^"'']+)["'']', 1) AS language, sha1(html) AS content_hash, 'doc_' || substr(sha1('site:' || {SQL_NORMAL.format("url")}), 1, 16) AS document_id FROM pages""")
def page_metadata(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.page_metadata(F.col("html"), F.col("url"), F.lit("site")).alias("m")).select("page_id", "m.*")


@query("html_strip", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.plain_text(F.col("html")).alias("text"))


@query("page_sections")
def page_sections(spark, sf_dir):
    return html_sections.normalize_pages(_pages(spark, sf_dir)).drop("blocks")


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    return chunk.chunk_documents(chunk.paragraphs_as_sections(table(spark, sf_dir, "documents")))


@query("page_chunks")
def page_chunks(spark, sf_dir):
    return chunk.chunk_documents(chunk.gather_sections(html_sections.normalize_pages(_pages(spark, sf_dir))))


PRODUCTS = (("Example Net", ("example.net",)), ("Blog Engine", ("blog", "weblog")), ("Absent", ("no such name",)))
SQL_ALIAS = {"annotation": "[regexp_replace(form, '^@', '')]", "class_interface": "list_filter([regexp_replace(form, '^.*\\.', '')], lambda y: y <> form)"}
SQL_OCCURRENCES = " UNION ALL ".join([
    *(f"SELECT doc_id, '{kind}' AS term_type, trim(form) AS form, place, {SQL_ALIAS.get(kind, '[]::VARCHAR[]')} AS aliases FROM (SELECT doc_id, unnest(m) AS form, unnest(range(len(m))) AS place FROM (SELECT page_id AS doc_id, regexp_extract_all(u, '{pattern}', {group}) AS m FROM u))" for kind, pattern, group in glossary.PATTERNS),
    *(f"SELECT page_id, 'spring_product', '{name}', 0, {list(aliases)!r} FROM u WHERE regexp_matches(u, '(?i)\\b(?:{'|'.join(n.replace('.', '[.]') for n in (name, *aliases))})\\b')" for name, aliases in PRODUCTS),
    """SELECT page_id, 'cli_command', line, 0, []::VARCHAR[] FROM (SELECT page_id, trim(ltrim(trim(unnest(string_split(string_split(u, '```')[2], chr(10)))), '$')) AS line FROM u WHERE contains(u, '```')) WHERE regexp_matches(line, '^([.]/gradlew|gradle|mvn|java|jar|spring|docker|curl|http|kubectl|helm|psql)')""",
])
#: Page addresses with types, keys, artifacts and code put to them (ASCII: word boundaries beside other letters differ between the engines).
SQL_ADDRESS = "url || CASE page_id % 4 WHEN 0 THEN ' @Bean.Name org.acme.core.JdbcTemplate new Widget spring.jpa.show-sql spring-boot-starter-web' WHEN 1 THEN ' org.acme.lib:core-x:1.2 UserRepository' WHEN 2 THEN chr(10) || '```' || chr(10) || '$ mvn -q test' || chr(10) || 'echo no' || chr(10) || '```' ELSE '' END"


def _addresses(spark, sf_dir):
    k = F.col("page_id") % 4
    more = F.when(k == 0, " @Bean.Name org.acme.core.JdbcTemplate new Widget spring.jpa.show-sql spring-boot-starter-web").when(k == 1, " org.acme.lib:core-x:1.2 UserRepository").when(k == 2, "\n```\n$ mvn -q test\necho no\n```").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", more).alias("u"))


@query("glossary_terms", f"""
WITH u AS (SELECT page_id, {SQL_ADDRESS} AS u FROM pages), o AS (SELECT * FROM ({SQL_OCCURRENCES}) WHERE form <> ''),
s AS (SELECT term_type, lower(form) AS key, form, min((doc_id, place)) AS first, count(*) AS n, list_distinct(flatten(list(aliases))) AS al FROM o GROUP BY ALL),
t AS (SELECT term_type, key, arg_min(form, (-length(form), first, form)) AS canonical_form, sum(n) AS n, list_distinct(list_concat(list(form), flatten(list(al)))) AS forms FROM s GROUP BY ALL)
SELECT 'gls_' || substr(sha1(term_type || ':' || key), 1, 16) AS term_id, term_type, canonical_form, array_to_string(list_sort(list_filter(forms, lambda x: x <> canonical_form)), ',') AS aliases, n::BIGINT AS evidence_count,
  (SELECT count(DISTINCT doc_id) FROM o WHERE o.term_type = t.term_type AND lower(o.form) = t.key)::BIGINT AS n_docs, least(1, 0.55 + n * 0.05) AS confidence FROM t""")
def glossary_terms(spark, sf_dir):
    found = glossary.occurrences(_addresses(spark, sf_dir), products=PRODUCTS, concepts=False, id_col="page_id", text_col="u")
    return glossary.terms(found).select("term_id", "term_type", "canonical_form", F.array_join("aliases", ",").alias("aliases"), "evidence_count", "n_docs", "confidence")


@query("chunk_anchor_candidates", f"""
WITH u AS (SELECT page_id, {SQL_ADDRESS} AS u FROM pages), o AS (SELECT * FROM ({SQL_OCCURRENCES}) WHERE form <> ''),
t AS (SELECT term_type, lower(form) AS key, arg_min(form, (-length(form), doc_id, place, form)) AS canonical_form FROM o GROUP BY ALL)
SELECT DISTINCT doc_id // 10 AS document_id, doc_id AS chunk_id, o.term_type, canonical_form FROM o JOIN t ON t.term_type = o.term_type AND t.key = lower(o.form)""")
def chunk_anchor_candidates(spark, sf_dir):
    """Addresses stand for chunks, ten for a document."""
    chunks = _addresses(spark, sf_dir).select(F.col("page_id").alias("chunk_id"), F.expr("page_id div 10").alias("document_id"), F.col("u").alias("content"))
    return glossary.chunk_candidates(chunks, PRODUCTS, concepts=False)


@query("document_glossary")
def document_glossary(spark, sf_dir):
    return glossary.terms(glossary.occurrences(table(spark, sf_dir, "documents"), products=PRODUCTS))


SQL_GENERIC = ", ".join("'" + w.replace("'", "''") + "'" for w in (*glossary.GENERIC_WORDS, *glossary.STOPWORDS, *P.ANCHOR_STOPWORDS, *P.EN_FUNCTIONAL))


@query("keyphrase_candidates", f"""WITH u AS (SELECT page_id, {SQL_ADDRESS} AS u FROM pages), g AS (SELECT page_id, list_transform(list_filter(regexp_extract_all(u, '{glossary.GENERIC}'), lambda x: length(x) BETWEEN 3 AND 120 AND lower(x) NOT IN ('http', 'https', 'www') AND len(regexp_extract_all(x, '[.]')) <= 6 AND {SQL_TECHNICAL.format("x")}), lambda x: trim(x, '`''"()[]{{}}.,:;')) AS p FROM u)
SELECT page_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i AND length(x) BETWEEN 3 AND 120 AND lower(x) NOT IN ({SQL_GENERIC})), ' ') AS phrases FROM g""")
def keyphrase_candidates(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", F.array_join(glossary.keyphrase_candidates(F.col("u")), " ").alias("phrases"))


@query("alias_types", """
SELECT alias, CASE WHEN lower(alias) = lower(canonical) THEN 'same_case' WHEN contains(alias, '-') THEN 'kebab' WHEN contains(alias, '.') THEN 'dotted' WHEN contains(alias, ' ') THEN 'spaced'
  WHEN upper(alias) = alias AND regexp_matches(alias, '[A-Za-z]') AND length(alias) <= 12 THEN 'abbreviation' WHEN regexp_matches(alias, '[^\\x00-\\x7F]') THEN 'translated' ELSE 'same_case' END AS kind
FROM (SELECT DISTINCT p_name AS alias, p_type AS canonical FROM part UNION SELECT DISTINCT o_orderpriority, 'x' FROM orders UNION SELECT DISTINCT p_type, 'x' FROM part)""")
def alias_types(spark, sf_dir):
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    pairs = part.select(F.col("p_name").alias("alias"), F.col("p_type").alias("canonical")).union(orders.select("o_orderpriority", F.lit("x"))).union(part.select("p_type", F.lit("x"))).distinct()
    return pairs.select("alias", glossary.alias_type(F.col("alias"), F.col("canonical")).alias("kind"))


@query("glossary_evidence", r"""
WITH t AS (SELECT 'a' AS term_id, 'license' AS form UNION ALL SELECT 'b', 'password'),
m AS (SELECT term_id, doc_id, form, lower(text) AS low FROM documents, t WHERE contains(lower(text), form)),
p AS (SELECT term_id, doc_id, form, list_transform(string_split(low, form), lambda x: length(x)) AS p FROM m)
SELECT term_id, doc_id, (list_sum(p[1:i]) + (i - 1) * length(form))::BIGINT AS start, (list_sum(p[1:i]) + i * length(form))::BIGINT AS "end" FROM p, LATERAL (SELECT unnest(range(1, len(p))) AS i)""")
def glossary_evidence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    terms = F.array(F.struct(F.lit("a").alias("term_id"), F.lit("license").alias("form")), F.struct(F.lit("b").alias("term_id"), F.lit("password").alias("form")))
    wanted = docs.select("doc_id", F.inline(terms))
    found = glossary.evidence(docs, wanted)
    return found.select("term_id", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("keyphrase_mmr")
def keyphrase_mmr(spark, sf_dir):
    return glossary.keyphrases(table(spark, sf_dir, "documents"))
