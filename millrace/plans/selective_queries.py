"""Selective rewriting over the given tables, with its DuckDB statements.

Passages stand for samples: the first sentence is the raw query, and candidates are made of the sentences
and of the memories found. Documents labelled good are the memories; their first sentence is the query.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.functions import text as T
from millrace.operators import hints, inverted, modes, reports, retrieve, search, selective
from millrace.plans.phrase_queries import _MARKER, _ORDERED, _sql_found
from millrace.plans.registry import query
from millrace.plans.retrieval_queries import SQL_FUSED, SQL_HASH
from millrace.plans.text_queries import SQL_SENTENCES, SQL_TOKENS, _sql_spaced
from millrace.sources.stored import stored_once
from millrace.sources.tables import table

POLICY = selective.Policy(guard_floor=0.6, guard_overlap=0.4, hit_margin=0.01, hit_selection=0.02)
POOL, MEMORIES = 20, 5


def samples(spark, sf_dir):
    cut = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    profile = F.when(F.col("query_id") % 4 == 0, "short_user").when(F.col("query_id") % 4 == 1, "code_mixed")
    return cut.select("query_id", F.get("s", F.lit(0)).alias("text"), profile.alias("profile"), F.concat(F.lit("src"), F.col("query_id") % 5).alias("product"), "s")


def memories(spark, sf_dir):
    """The memories, cut from the texts once for the state of the tables: packs and joins read them from the shared folder."""
    sources = [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"]
    return spark.read.parquet(f"{stored_once(spark, 'memory-rows', sources, lambda folder: _cut_memories(spark, sf_dir).write.parquet(f'{folder}/rows'))}/rows")


def _cut_memories(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    first = table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "source", F.get(T.sentences(F.col("text")), F.lit(0)).alias("query_text")).where("query_text IS NOT NULL")
    return first.select(
        F.col("doc_id").alias("memory_id"), "query_text", F.array("doc_id").alias("target_chunks"), F.expr("doc_id div 10").alias("target_doc"), F.col("source").alias("product"),
        F.array().cast("array<string>").alias("glossary"), (F.col("doc_id") % 10 / 10.0).alias("utility"),
    )


def memory_index(spark, sf_dir):
    """Packs of the memories; no query asks for their postings or blocks."""
    return inverted.InvertedIndex(None, None, None, lambda: _packs(spark, sf_dir, "memories", memories(spark, sf_dir)))


def _packs(spark, sf_dir, name, held):
    build = lambda folder: inverted.write_packs(held, folder, "memory_id", "query_text")
    return inverted.read_packs(spark, stored_once(spark, name, [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"], build))


def retriever(spark, sf_dir):
    chunks, held = inverted.packs_of(spark, sf_dir), memory_index(spark, sf_dir).packs
    return selective.Retriever(lambda asked, k: search.packed_hybrid(chunks, asked, k), lambda asked, n: search.packed_hybrid(held, asked, n, mode="dense_only"), lambda chunk: (chunk - chunk % 10) / 10)


def candidates(state, cut):
    """Three candidates of each query: its first two sentences, itself with words of the best memory, and its first words."""
    rows = state.join(cut.select("query_id", "s"), "query_id")
    none, words = F.array().cast("array<string>"), F.split("text", " ")
    hint = F.slice(P.content_tokens(F.get("memories", F.lit(0))["query_text"]), 1, 3)
    made = lambda seq, label, text, preserved, added, index, risk: F.struct(F.lit(seq).alias("seq"), F.lit(label).alias("label"), text.alias("text"), preserved.alias("preserved"), added.alias("added"), index.cast("int").alias("source_memory"), risk.alias("intent_risk"))
    every = F.array(
        made(1, "standalone", F.concat_ws(" ", F.slice("s", 1, 2)), none, none, F.lit(0), F.lit("low")),
        made(2, "expanded", F.concat_ws(" ", F.col("text"), hint), none, F.coalesce(F.slice(hint, 1, 2), none), F.lit(1), F.lit("medium")),
        made(3, "compact", F.array_join(F.slice(words, 1, 6), " "), P.anchor_tokens(F.col("text"), F.lit("en"), 2), none, F.col("query_id") % 7, F.when(F.col("query_id") % 9 == 0, "high").otherwise("low")),
    )
    return rows.where(F.size("memories") > 0).select("query_id", F.explode(every).alias("x")).select("query_id", "x.*")


def judged(spark, sf_dir):
    cut, found = samples(spark, sf_dir), retriever(spark, sf_dir)
    state = selective.durable(selective.with_memories(cut, memories(spark, sf_dir), found, POOL, MEMORIES))
    return state, selective.judge(state, candidates(state, cut), found, POLICY)


def _sql_ordered(tokens: str, most: int) -> str:
    return f"list_slice({_ORDERED.format(tokens)}, 1, {most})"


SQL_ANCHOR = f"list_filter({_sql_found(P.ANCHOR_TOKEN)}, lambda x: x <> '' AND lower(x) NOT IN {P.ANCHOR_STOPWORDS} AND {_MARKER} AND length(x) <= 120 AND len(regexp_extract_all(x, '\\.')) <= 6 AND lower(x) NOT IN {P.EN_FUNCTIONAL})"
SQL_CONTENT = f"list_transform(list_filter({_sql_found(P.CONTENT_TOKEN)}, lambda x: x <> '' AND lower(x) NOT IN {P.GENERIC_CONTENT} AND NOT regexp_full_match(x, '[0-9]+') AND length(x) >= 2 AND (length(x) >= 3 OR {_MARKER})), lambda x: lower(x))"


def _sql_terms(name: str, texts: str) -> str:
    """Anchor and content tokens of distinct texts."""
    return f"{name}0 AS (SELECT text, {SQL_ANCHOR} AS a, {SQL_CONTENT} AS c FROM (SELECT DISTINCT text FROM {texts})), {name} AS (SELECT text, {_sql_ordered('a', 24)} AS anc, {_sql_ordered('c', 24)} AS con FROM {name}0)"


def _sql_lists(p: str, asked: str) -> str:
    """Ranked documents of each distinct text of ``asked``, and its nearest memories."""
    return f"""{p}q AS (SELECT text, {SQL_TOKENS.format("text")} AS t FROM (SELECT DISTINCT text FROM {asked})), {SQL_HASH.format(p + "h", "text", "t", p + "q")},
{p}b AS (SELECT text, doc_id, round(sum(w), 9) AS bm25 FROM (SELECT text, unnest(list_distinct(t)) AS token FROM {p}q) JOIN kw USING (token) GROUP BY ALL),
{p}d AS (SELECT h.text, kn.doc_id, sum(h.value * kn.value) AS dense FROM {p}hn h JOIN kn USING (slot) GROUP BY ALL),
{p}x AS (SELECT q.text, k.doc_id, coalesce(bm25, 0) AS bm25, coalesce(dense, 0) AS dense, coalesce(len(list_intersect(list_filter(list_distinct(q.t), lambda t: regexp_matches(t, '[A-Za-z0-9]')), d)) / nullif(sqrt(len(list_filter(list_distinct(q.t), lambda t: regexp_matches(t, '[A-Za-z0-9]'))) * len(d)), 0), 0) AS technical
  FROM {p}q q CROSS JOIN kl k LEFT JOIN {p}b b ON b.text = q.text AND b.doc_id = k.doc_id LEFT JOIN {p}d e ON e.text = q.text AND e.doc_id = k.doc_id),
{p}f AS (SELECT text, doc_id, {SQL_FUSED.format(0.58, 0.34, 0.08)} AS score FROM (SELECT *, max(bm25) OVER (PARTITION BY text) AS top FROM {p}x)),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) AS rank FROM {p}f),
{p}l AS (SELECT text, list(doc_id ORDER BY rank) AS ids, list(doc_id // 10 ORDER BY rank) AS docs, list(score ORDER BY rank) AS scores FROM {p}r WHERE rank <= 10 GROUP BY text),
{p}m AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, memory_id) AS before FROM (SELECT q.text, m.memory_id, round(coalesce(sum(h.value * mn.value), 0), 9) AS similarity FROM {p}q q CROSS JOIN mem m LEFT JOIN mn ON mn.memory_id = m.memory_id LEFT JOIN {p}hn h ON h.text = q.text AND h.slot = mn.slot GROUP BY ALL))"""


_UNIT = "greatest(0, least(1, {0}))"
_CONFIDENCE = "(0.7 * (({0}[1] + 1) / 2) + 0.3 * list_avg(list_transform(list_slice({0}, 1, 3), lambda x: (x + 1) / 2)))"
_SHIFT = "(0.7 * (1 - len(list_intersect(list_slice(raw_ids, 1, 5), list_slice(ids, 1, 5))) / len(list_distinct(list_concat(list_slice(raw_ids, 1, 5), list_slice(ids, 1, 5))))) + 0.3 * (raw_ids[1] <> ids[1])::INT)"


def _sql_policy(name: str) -> str:
    value, cases = asdict(POLICY)[name], "".join(f" WHEN '{k}' THEN {v[name]!r}" for k, v in POLICY.profiles.items() if name in v)
    return f"(CASE profile{cases} ELSE {value!r} END)" if cases else repr(value)


def _sql_has(text: str, term: str) -> str:
    t, s = _sql_spaced(text), _sql_spaced(term)
    return f"({s} <> '' AND (contains(' ' || {t} || ' ', ' ' || {s} || ' ') OR ((contains({s}, ' ') OR starts_with({s}, '@')) AND contains(replace({t}, ' ', ''), replace({s}, ' ', '')))))"


_p = _sql_policy
_WEIGH = "greatest(0, least(1, ({r} * {0} + {t} * {1} + {a} * {2}) / ({r} + {t} + {a})))".replace("{r}", _p("retrieval")).replace("{t}", _p("terminology")).replace("{a}", _p("alignment"))
_ALIGN = "greatest(0, least(1, 0.7 * greatest(0, least(1, ({1} + 1) / 2)) + 0.3 * greatest(0, least(1, ({1} - {0} + 1) / 2))))"

SQL_STATE = f"""
raw AS (SELECT query_id, s[1] AS text, CASE query_id % 4 WHEN 0 THEN 'short_user' WHEN 1 THEN 'code_mixed' END AS profile, 'src' || (query_id % 5) AS product, s FROM (SELECT item_id AS query_id, {SQL_SENTENCES.format("text")} AS s FROM benchmark) WHERE len(s) > 0),
mem AS (SELECT * FROM (SELECT doc_id AS memory_id, ({SQL_SENTENCES.format("text")})[1] AS query_text, source AS product, (doc_id % 10) / 10.0 AS utility FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE query_text IS NOT NULL),
kd AS (SELECT doc_id, {SQL_TOKENS.format("text")} AS t FROM documents), kl AS (SELECT doc_id, len(t) AS dl, list_filter(list_distinct(t), lambda t: regexp_matches(t, '[A-Za-z0-9]')) AS d FROM kd), kst AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM kl),
ktf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM kd) GROUP BY ALL), kdf AS (SELECT token, count(*) AS df FROM ktf GROUP BY token),
kw AS (SELECT token, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM ktf JOIN kdf USING (token) JOIN kl USING (doc_id), kst), {SQL_HASH.format("k", "doc_id", "t", "kd")},
{SQL_HASH.format("m", "memory_id", SQL_TOKENS.format("query_text"), "mem")}, {_sql_lists("p", "raw")}, {_sql_terms("rt", "raw")}, {_sql_terms("me", "(SELECT query_text AS text FROM mem)")},
rr AS (SELECT m.memory_id, m.before, m.similarity, raw.query_id, l.ids, l.docs, mem.query_text, mem.product, list_distinct(list_concat(list_slice(rt.con, 1, 18), list_transform(list_slice(rt.anc, 1, 18), lambda x: lower(x)))) AS own,
  list_distinct(list_concat(list_slice(me.con, 1, 18), list_transform(list_slice(me.anc, 1, 12), lambda x: lower(x)))) AS other, mem.utility, coalesce((mem.product = raw.product)::INT, 0) AS same
  FROM pm m JOIN raw USING (text) JOIN pl l USING (text) JOIN rt USING (text) JOIN mem ON mem.memory_id = m.memory_id JOIN me ON me.text = mem.query_text WHERE m.before <= {POOL}),
rs AS (SELECT *, list_contains(ids, memory_id)::INT AS co, list_contains(docs, memory_id // 10)::INT AS dov FROM rr),
rz AS (SELECT *, round_even(greatest(0, least(1, 0.34 * greatest(0, least(1, (similarity + 1) / 2)) + 0.2 * co + 0.12 * dov + 0.18 * coalesce(len(list_intersect(own, other)) / nullif(len(own), 0), 0) + 0.1 * utility + 0.06 * same)), 6) AS z FROM rs),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, co DESC, dov DESC, before, memory_id) AS after FROM rz),
state AS (SELECT raw.query_id, raw.text AS raw, raw.profile, raw.s, l.ids AS raw_ids, l.docs AS raw_docs, l.scores AS raw_scores, k.ms FROM raw JOIN pl l USING (text) JOIN (
  SELECT query_id, list({{'memory_id': memory_id, 'query_text': query_text, 'similarity': similarity, 'product': product, 'trusted': co + dov > 0}} ORDER BY after) AS ms FROM rk WHERE after <= {MEMORIES} GROUP BY query_id) k USING (query_id))"""
SQL_JUDGED = f"""{SQL_STATE},
h1 AS (SELECT state.*, list_slice(me.con, 1, 3) AS hint, rt.anc AS ranc, rt.con AS rcon FROM state JOIN me ON me.text = ms[1].query_text JOIN rt ON rt.text = state.raw),
cands AS (SELECT query_id, 1 AS seq, 'standalone' AS label, array_to_string(list_slice(s, 1, 2), ' ') AS text, []::VARCHAR[] AS preserved, []::VARCHAR[] AS added, 0 AS idx, 'low' AS risk FROM h1
  UNION ALL SELECT query_id, 2, 'expanded', concat_ws(' ', raw, CASE WHEN len(hint) > 0 THEN array_to_string(hint, ' ') END), [], list_slice(hint, 1, 2), 1, 'medium' FROM h1
  UNION ALL SELECT query_id, 3, 'compact', array_to_string(list_slice(string_split(raw, ' '), 1, 6), ' '), list_slice(ranc, 1, 2), [], query_id % 7, CASE WHEN query_id % 9 = 0 THEN 'high' ELSE 'low' END FROM h1),
{_sql_lists("c", "cands")}, {_sql_terms("ct", "cands")},
ma AS (SELECT query_id, list_filter(ms, lambda m: m.trusted) AS tr FROM state),
mu AS (SELECT query_id, i, tr[i].query_text AS q FROM ma, LATERAL (SELECT unnest(range(1, least(5, len(tr)) + 1)) AS i)),
mg AS (SELECT query_id, flatten(list(list_slice(anc, 1, 3) ORDER BY i)) AS terms FROM mu JOIN me ON me.text = mu.q GROUP BY query_id),
j0 AS (SELECT c.*, h.raw, h.profile, h.raw_ids, h.raw_docs, h.raw_scores, h.ms, h.ranc, h.rcon, l.ids, l.docs, l.scores, t.anc, t.con, coalesce(a.similarity, 0) AS affinity, h.ms[1].similarity AS raw_affinity, c.label <> 'standalone' AS uses,
    list_concat(list_slice(h.ranc, 1, 4), CASE WHEN c.label <> 'standalone' THEN coalesce(mg.terms, []) ELSE [] END) AS an0, CASE WHEN c.idx BETWEEN 1 AND len(h.ms) THEN h.ms[c.idx] END AS named
  FROM cands c JOIN h1 h USING (query_id) JOIN cl l ON l.text = c.text JOIN ct t ON t.text = c.text LEFT JOIN (SELECT text, similarity FROM cm WHERE before = 1) a ON a.text = c.text LEFT JOIN mg ON mg.query_id = c.query_id),
j1 AS (SELECT *, {_CONFIDENCE.format("scores")} AS score, {_CONFIDENCE.format("raw_scores")} AS raw_score, {_SHIFT} AS shift, {_sql_ordered("an0", 8)} AS anchors,
  coalesce(len(list_intersect(list_transform(ranc, lambda x: lower(x)), list_transform(anc, lambda x: lower(x)))) / nullif(len(ranc), 0), 1) AS tech,
  CASE WHEN NOT uses THEN NULL WHEN named IS NOT NULL THEN named ELSE ms[1] END AS top,
  coalesce((list_contains(ids, named.memory_id) AND NOT list_contains(raw_ids, named.memory_id)) OR (list_contains(docs, named.memory_id // 10) AND NOT list_contains(raw_docs, named.memory_id // 10)), FALSE) AS improved FROM j0),
j2 AS (SELECT j1.*, CASE WHEN len(anchors) > 0 THEN len(list_intersect(list_transform(anchors, lambda x: lower(x)), list_transform(j1.anc, lambda x: lower(x)))) / len(anchors) ELSE tech END AS kept,
  list_filter(list_slice(coalesce(me.con, []), 1, 12), lambda x: x <> lower(coalesce(top.product, '')) OR length(x) < 3) AS target, list_slice(j1.rcon, 1, 12) AS rc, list_slice(j1.con, 1, 12) AS cc FROM j1 LEFT JOIN me ON me.text = j1.top.query_text),
j3 AS (SELECT *, greatest(0, least(1, 0.7 * tech + 0.3 * kept)) AS term, greatest(0, least(1, score + CASE WHEN score >= raw_score THEN {_p("shift")} * shift ELSE 0 END)) AS gain, {_ALIGN.format("raw_affinity", "CASE WHEN uses THEN affinity ELSE raw_affinity END")} AS alignment,
  len(list_intersect(rc, target)) AS tr, len(list_intersect(cc, target)) AS tc, greatest(1, length(regexp_replace(text, '\\s', '', 'g'))) / greatest(1, length(regexp_replace(raw, '\\s', '', 'g'))) AS ratio,
  raw_score >= {_p("guard_floor")} AND NOT list_contains(list_slice(ids, 1, 5), raw_ids[1]) AND len(list_intersect(list_slice(raw_ids, 1, 5), list_slice(ids, 1, 5))) / len(list_slice(raw_ids, 1, 5)) < {_p("guard_overlap")} AS guard,
  list_filter(preserved, lambda x: {_sql_has("raw", "x")}) AS found FROM j2),
j4 AS (SELECT *, coalesce(profile = 'short_user', FALSE) AND greatest(0, least(1, (raw_affinity + 1) / 2)) >= {_p("underspecified")} AND len(target) > 0 AND tr = 0 AND tc = 0 AS missing,
  coalesce(len(list_filter(found, lambda x: {_sql_has("text", "x")})) / nullif(len(found), 0), 1) AS pshare, coalesce(len(list_filter(added, lambda x: {_sql_has("text", "x")})) / nullif(len(added), 0), 1) AS ashare FROM j3),
j5 AS (SELECT *, round(greatest(0, least(1, {_WEIGH.format("gain", "term", "alignment")} + CASE WHEN tc > tr THEN {_p("target_presence")} ELSE 0 END + CASE WHEN improved THEN {_p("hit_selection")} ELSE 0 END
  - greatest(0, ratio - 1) * {_p("verbosity")} - (1 - tech) * {_p("token_drop")} - greatest(0, 1 - kept) * {_p("anchor_drop")} - CASE WHEN missing THEN {_p("target_missing")} ELSE 0 END)), 9) AS final_score,
  round({_WEIGH.format("raw_score", "1.0", _ALIGN.format("raw_affinity", "raw_affinity"))}, 9) AS raw_reference FROM j4),
judged AS (SELECT *, CASE WHEN lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) THEN 'candidate_same_as_raw' WHEN risk = 'high' THEN 'intent_risk_high' WHEN idx > len(ms) THEN 'invalid_source_memory_index'
  WHEN pshare < {_p("preserved_floor")} THEN 'preserved_raw_terms_missing' WHEN ashare < {_p("added_floor")} THEN 'added_anchor_coverage_below_floor' WHEN ratio > {_p("max_length_ratio")} THEN 'verbosity_exceeds_limit' WHEN term < {_p("preservation_floor")} THEN 'preservation_below_floor'
  WHEN gain < {_p("min_gain")} THEN 'retrieval_gain_below_floor' WHEN missing THEN 'missing_memory_target' WHEN guard AND NOT improved THEN 'raw_loss_guard_top1_lost'
  WHEN round(final_score - raw_reference + CASE WHEN improved THEN {_p("hit_margin")} ELSE 0 END, 9) < {_p("min_improvement")} THEN 'delta_below_threshold' ELSE '' END AS rejection FROM j5)"""


@query("rewrite_judgements", f"WITH {SQL_JUDGED} SELECT query_id, seq, label, round(gain, 9) AS gain, round(shift, 9) AS shift, round(term, 9) AS terminology, round(alignment, 9) AS alignment, guard, improved, final_score, raw_reference, rejection FROM judged")
def rewrite_judgements(spark, sf_dir):
    """What retrieval says of each candidate, and why it is turned down."""
    nine = [F.round(c, 9).alias(n) for c, n in (("gain", "gain"), ("shift", "shift"), ("terminology.score", "terminology"), ("alignment", "alignment"))]
    return judged(spark, sf_dir)[1].select("query_id", "seq", "label", *nine, "guard", "improved", "final_score", "raw_reference", "rejection")


@query("selective_rewrite", f"""WITH {SQL_JUDGED}, b AS (SELECT query_id, arg_max({{'seq': seq, 'label': label, 'text': text, 'f': final_score, 'r': raw_reference, 'x': rejection, 'ids': ids}}, ((rejection = '')::INT, final_score, -seq)) AS b FROM judged GROUP BY query_id)
SELECT state.query_id, b.b.seq AS seq, b.b.label AS label, CASE WHEN b.b.x = '' THEN b.b.text ELSE raw END AS final_text, b.b.f AS final_score, b.b.r AS raw_reference, coalesce(b.b.x = '', FALSE) AS applied, CASE WHEN b.b.x = '' THEN 'delta_above_threshold' ELSE b.b.x END AS reason,
  (CASE WHEN b.b.x = '' THEN b.b.ids ELSE raw_ids END)[1] AS first_doc FROM state JOIN b USING (query_id)""")
def selective_rewrite(spark, sf_dir):
    """The decision for each query, from gain, alignment and guard that come out of retrieval."""
    state, every = judged(spark, sf_dir)
    decided = selective.decide(state, every)
    return decided.select("query_id", "seq", "label", "final_text", "final_score", "raw_reference", "applied", "reason", F.get(F.coalesce("new_ids", "raw_ids"), F.lit(0)).alias("first_doc"))


def _hint_rows(spark, sf_dir):
    """Five addresses of pages for each query; the glossary of a memory are the last parts of its address."""
    number = F.expr("page_id div 5")
    item = F.struct((F.col("page_id") % 5).alias("rank"), F.col("page_id").alias("memory_id"), F.col("url").alias("query_text"), F.slice(F.reverse(F.split("url", "/")), 1, 2).alias("glossary"))
    rows = table(spark, sf_dir, "pages").groupBy(number.alias("query_id")).agg(F.sort_array(F.collect_list(item)).alias("memories"))
    return rows.withColumn("raw", F.concat(F.lit("open index.html of RestTemplate v"), F.col("query_id")))


def _hint_out(rows, terms):
    return rows.select("query_id", F.posexplode(terms).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("place"), "x.term", "x.source", "x.memory_id")


_VALID = "length(x) BETWEEN 3 AND 120 AND len(regexp_extract_all(x, '\\.')) <= 6 AND lower(x) NOT IN {0} AND ({1} OR lower(x) NOT IN {2})".format(P.EN_FUNCTIONAL, _MARKER, P.ANCHOR_STOPWORDS)


def _sql_hints(of_query: int, of_memory: int, most: int) -> str:
    """Terms in turn, each list cut first, then the first of equal terms."""
    un = lambda x: f"trim(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '.,;:!?()[]{{}}<>\"''`')"
    return f"""WITH q AS (SELECT page_id // 5 AS query_id, page_id % 5 AS rank, page_id, url FROM pages), r AS (SELECT DISTINCT query_id, 'open index.html of RestTemplate v' || query_id AS text FROM q),
{_sql_terms("rt", "r")}, {_sql_terms("ut", "(SELECT url AS text FROM q)")},
e AS (SELECT query_id, -1 AS rank, 0 AS kind, generate_subscripts(list_slice(anc, 1, {of_query}), 1) AS i, unnest(list_slice(anc, 1, {of_query})) AS x, 'raw_query' AS source, NULL AS memory_id FROM r JOIN rt USING (text)
  UNION ALL SELECT query_id, rank, 1, i, {un("g")}, 'memory_glossary', page_id FROM (SELECT *, list_slice(list_reverse(string_split(url, '/')), 1, 2) AS l FROM q), LATERAL (SELECT unnest(l) AS g, generate_subscripts(l, 1) AS i)
  UNION ALL SELECT query_id, rank, 2, generate_subscripts(list_slice(anc, 1, {of_memory}), 1), unnest(list_slice(anc, 1, {of_memory})), 'memory_query', page_id FROM q JOIN ut ON ut.text = q.url),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(x) ORDER BY rank, kind, i) AS first FROM e WHERE x <> '' AND (source = 'raw_query' OR {_MARKER} OR source = 'memory_query') AND {_VALID}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, kind, i) AS place FROM v WHERE first = 1) SELECT query_id, place::INT AS place, x AS term, source, memory_id::VARCHAR AS memory_id FROM o WHERE place <= {most}"""


@query("anchor_candidates", _sql_hints(hints.OF_QUERY, hints.OF_MEMORY, hints.ANCHORS))
def anchor_candidates(spark, sf_dir):
    rows = _hint_rows(spark, sf_dir)
    return _hint_out(rows, hints.anchor_candidates(F.col("raw"), F.col("memories"), F.lit("en")))


@query("terminology_hints", _sql_hints(hints.HINTS_OF_QUERY, hints.HINTS_OF_MEMORY, hints.HINTS))
def terminology_hints(spark, sf_dir):
    rows = _hint_rows(spark, sf_dir)
    return _hint_out(rows, hints.terminology_hints(F.col("raw"), F.col("memories"), F.lit("en")))


SQL_CANON = """c AS (SELECT l_orderkey AS query_id, l_linenumber - 1 AS rank, l_partkey AS memory_id, p_name AS form, upper(p_type) AS alias, p_brand AS normal, lower(p_name) || '.v' || p_size AS other,
  CASE l_linenumber % 4 WHEN 0 THEN 'miss' WHEN 1 THEN 'self_fallback' ELSE 'Mapped' END AS status, CASE l_linestatus WHEN 'F' THEN 'approved' ELSE '' END AS review, l_tax > 0.07 AS pending, l_discount < 0.09 AS used FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("canonical_hints", f"""WITH {SQL_CANON}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, memory_id) AS k FROM c),
e AS (SELECT query_id, rank, memory_id, form, unnest([form, alias, normal, other]) AS t, unnest([1, 2, 3, 4]) AS i FROM g WHERE k <= 5 AND used AND NOT pending AND ((status = 'Mapped' AND review = 'approved') OR (status = 'self_fallback' AND review IN ('', 'approved')))),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(x) ORDER BY rank, memory_id, i) AS first FROM (SELECT *, trim(t) AS x FROM e) WHERE x <> '' AND {_VALID}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, memory_id, i) AS place FROM v WHERE first = 1) SELECT query_id, place::INT AS place, x AS term, trim(form) AS source, memory_id::VARCHAR AS memory_id FROM o WHERE place <= 12""")
def canonical_hints(spark, sf_dir):
    """Orders stand for queries, their first lines for memories with one canonical anchor each."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    status = F.when(F.col("l_linenumber") % 4 == 0, "miss").when(F.col("l_linenumber") % 4 == 1, "self_fallback").otherwise("Mapped")
    anchor = F.struct(
        F.col("p_name").alias("canonical_form"), F.upper("p_type").alias("display_alias"), F.col("p_brand").alias("normalized_alias"), F.concat(F.lower("p_name"), F.lit(".v"), F.col("p_size")).alias("canonical_normalized_form"),
        status.alias("resolution_status"), F.when(F.col("l_linestatus") == "F", "approved").otherwise("").alias("review_status"), (F.col("l_tax") > 0.07).alias("pending"), (F.col("l_discount") < 0.09).alias("used_for_scoring"),
    )
    item = F.struct((F.col("l_linenumber") - 1).alias("rank"), F.col("l_partkey").alias("memory_id"), F.array(anchor).alias("canonical"))
    rows = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_list(item)).alias("memories"))
    return _hint_out(rows, hints.canonical_hints(F.col("memories"), F.lit("en")))


def _modes(spark, sf_dir):
    """All modes: memories by source number stand for the gating presets, sentences of a passage for its plan, the passage before it for the session."""
    cut = samples(spark, sf_dir)
    before = cut.select((F.col("query_id") + 1).alias("query_id"), F.col("text").alias("previous_question"))
    asked = cut.join(before, "query_id", "left").withColumn("previous_summary", F.lit(None).cast("string"))
    plans = cut.where("query_id % 3 > 0").select("query_id", F.posexplode(F.slice("s", 1, 3)).alias("seq", "text")).withColumn("seq", F.col("seq") + 1)
    every = memories(spark, sf_dir)
    held = {"ungated": every, "rule_only": every.where("memory_id % 4 > 0"), "full_gating": every.where("memory_id % 4 > 1")}
    chunks = inverted.packs_of(spark, sf_dir)

    def searcher(preset):
        packs = _packs(spark, sf_dir, f"memories-{preset}", held[preset])
        return selective.Retriever(lambda asked, k: search.packed_hybrid(chunks, asked, k), lambda asked, n: search.packed_hybrid(packs, asked, n, mode="dense_only"), lambda chunk: (chunk - chunk % 10) / 10)

    return asked, modes.run_modes(asked, plans, held, {p: searcher(p) for p in held}, policy=POLICY)


@query("evaluation_modes")
def evaluation_modes(spark, sf_dir):
    """Eleven modes in one plan, with metrics against the documents that hold each passage; held against its parts in the tests."""
    asked, (lists, _) = _modes(spark, sf_dir)
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    expected = retrieve.containing(docs, bench).select(F.col("item_id").alias("query_id"), "doc_id")
    return modes.mode_metrics(lists, expected, asked, reports.MODES)


@query("mode_decisions")
def mode_decisions(spark, sf_dir):
    """What the rewriting modes decided for each query, and where the router sent it."""
    return _modes(spark, sf_dir)[1][1]
