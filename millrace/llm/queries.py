"""Registered queries of the subpackage: the thin ``opN_<name>`` queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, embed_dedup, fim, html_extract, langid, mixing, quality, secrets, sharding, simhash, toxicity, turn_repair
from millrace.llm.common import load


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(load(spark, sf_dir, "documents"), word_tokenizer_path(), with_ids=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


_RATIOS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)", "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)", "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-(word_chars / greatest(n_words, 1))",
}
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM win JOIN rep USING (doc_id, g), (VALUES (0), (1), (2)) t(o) GROUP BY doc_id),
c AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
f AS ({" UNION ALL ".join(f"SELECT doc_id, stratum, '{name}' AS ratio, {sql} AS value FROM b WHERE NOT base_failed" for name, sql in _RATIOS.items())}),
grid(ratio, step, cutoff) AS (VALUES {", ".join(f"('{name}', {len(cuts) - i}, {cut!r}::DOUBLE)" for name, cuts in quality.GRID.items() for i, cut in enumerate(cuts))}),
s AS (SELECT doc_id, stratum, ratio, min(step) AS step FROM f JOIN grid USING (ratio) WHERE value > cutoff GROUP BY ALL),
y AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
g AS (SELECT DISTINCT stratum, ratio, step FROM s JOIN y USING (doc_id) WHERE NOT good),
r AS (SELECT doc_id, s.stratum, min(g.step) AS step FROM s JOIN g ON g.stratum = s.stratum AND g.ratio = s.ratio AND g.step >= s.step GROUP BY ALL),
n AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM b JOIN y USING (doc_id) WHERE good AND NOT base_failed GROUP BY stratum),
k AS (SELECT h.stratum, h.step, n.n, n.strata, count(q.doc_id) AS k FROM (SELECT DISTINCT stratum, step FROM r JOIN y USING (doc_id) WHERE NOT good) h JOIN n USING (stratum)
  LEFT JOIN (SELECT r.* FROM r JOIN y USING (doc_id) WHERE good) q ON q.stratum = h.stratum AND q.step <= h.step GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {quality.ALPHA!r}::DOUBLE THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality.ALPHA!r}) + (n - j) * ln(1 - {quality.ALPHA!r}))) FROM range(0, k + 1) t(j)) END AS tail FROM k),
best AS (SELECT stratum, max(step) AS step FROM (SELECT *, max(CASE WHEN tail > {quality.DELTA!r} / strata THEN 1 ELSE 0 END) OVER (PARTITION BY stratum ORDER BY step) AS failed FROM p) WHERE failed = 0 GROUP BY stratum),
bad AS (SELECT doc_id FROM r JOIN best ON best.stratum = r.stratum AND r.step <= best.step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept, stratum FROM b
"""

OP6_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {embed_dedup.THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""

#: Production weights of the mix: the large source is brought down, later sources count for more.
MIX_WEIGHTS = {"src0": 0.12} | {f"src{i}": 0.02 + 0.002 * i for i in range(1, 20)} | {mixing.REST: 0.04}
MIX_EPOCHS = 1.0
MIX_SEED = 42


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED, copy_col="copy")


OP3_SQL = f"""
WITH w(g, w) AS (VALUES {", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in MIX_WEIGHTS.items())}),
d AS (SELECT *, coalesce((SELECT w.g FROM w WHERE w.g = source AND w.g <> '*'), '*') AS g FROM documents),
n AS (SELECT g, count(*) AS n FROM d GROUP BY g),
r AS (SELECT g, {MIX_EPOCHS} * coalesce(w, 0) / sum(coalesce(w, 0)) OVER () * sum(n) OVER () / n AS rate FROM n LEFT JOIN w USING (g)),
p AS (SELECT g, rate, greatest(1, ceil(rate / {mixing.PART}))::INT AS parts FROM r),
k AS (SELECT g, i AS k, exp(-rate / parts + CASE WHEN i = 0 THEN 0 ELSE i * ln(rate / parts) END - lgamma(i + 1)) AS mass FROM p, range(0, {mixing.TABLE + 1}) t(i) WHERE rate > 0),
c AS (SELECT g, k, sum(mass) OVER (PARTITION BY g ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, any_value(d.g) AS g, part, any_value(('0x' || substr(md5('{MIX_SEED}:' || doc_id || ':' || part), 1, 13))::UBIGINT::DOUBLE / 16.0 ** 13) AS u
      FROM d JOIN p ON d.g = p.g, range(1, p.parts + 1) t(part) GROUP BY doc_id, part),
t AS (SELECT doc_id, count(*) AS times FROM u JOIN c ON u.g = c.g AND c.cdf <= u.u GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy::INT AS copy FROM d JOIN t USING (doc_id), range(1, t.times + 1) x(copy)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    net = toxicity.train_on(docs, labels.where(langid.fold("doc_id", 5) != 0))
    return toxicity.score_toxicity(docs, net).select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.where(langid.fold("doc_id", 4) != 2))
    return langid.identify(docs, profiles).select("doc_id", (langid.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(load(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(load(spark, sf_dir, "pages"), carry=("url",))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digest(chat.format_chats(turns.union(extra)))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<also>', '\a') AS et,
    replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<also>', '\a'), ':', '\c') AS er,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS fresh
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(et) + CASE WHEN fresh THEN 4 + length(er) + 2 + 8 ELSE 6 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_rows(docs, shards=16).drop("text")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turn_repair.damage_turns(load(spark, sf_dir, "conversations"))
    return turn_repair.repair_digest(turn_repair.repair_conversations(damaged, present_col="present"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(fim.fill_in_middle(load(spark, sf_dir, "documents"), seed=42))


def _op12_sql() -> str:
    """The edits of each conversation from its last turn to its first: for each state the least (cost, audit), with the turns that are left."""
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, e: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)"
    best = lambda *options: f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"
    made = lambda cost, letter, rest, line=None: f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 'r': {f'list_prepend({line}, {rest}.r)' if line else f'{rest}.r'}}}"
    after = {"n": "u", "s": "u", "u": "a", "a": "u"}
    role = {"u": "user", "a": "assistant"}
    keeps = {"n": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}

    def row(state: str) -> str:
        kept = [f"CASE WHEN mark < 2 AND code = '{c}' THEN {made('5 * mark', 'K', f'b.{c}', 'line')} END" for c in keeps[state]]
        to = after[state]
        return best(made(2, "D", f"b.{state}"), *kept, f"CASE WHEN mark < 2 THEN {made('1 + 5 * mark', 'R', f'b.{to}', f"'{role[to]}:' || text")} END")

    inserted = lambda to, of: made(5, "I", f"{of}{to}", f"'{role[to]}:'")
    both = lambda of: f"{best(f'{of}u', inserted('a', of))} AS u, {best(f'{of}a', inserted('u', of))} AS a"
    never = "{'c': 1000000000::BIGINT, 'a': '~', 'r': []::VARCHAR[]}"
    done = "{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT *, {crc} % 20 AS f FROM k),
g AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE f <> 0),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {spaces}) AS bare FROM g),
j AS (SELECT *, left(role, 1) AS code, role || ':' || text AS line, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, i > 1 AS follows FROM h),
e AS (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS mark FROM j), m AS (SELECT conv_id, max(i) AS n FROM e GROUP BY conv_id),
b0 AS (SELECT conv_id, n, u, a, {best(done, inserted('u', ''))} AS n_, {best(never, inserted('u', ''))} AS s FROM (SELECT conv_id, n, {best(never, made(5, 'I', 'z', "'assistant:'"))} AS u, {best(done, made(5, 'I', 'y', "'user:'"))} AS a FROM (SELECT *, {done} AS z, {never} AS y FROM m))),
b(conv_id, i, n, s, u, a) AS (SELECT conv_id, n, n_, s, u, a FROM b0 UNION ALL
  SELECT conv_id, i, {best('xn', inserted('u', ''))}, {best('xs', inserted('u', ''))}, u, a FROM (SELECT conv_id, i, xn, xs, {both('x')} FROM (
  SELECT b.conv_id, b.i - 1 AS i, {row('n')} AS xn, {row('s')} AS xs, {row('u')} AS xu, {row('a')} AS xa FROM b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i))),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE follows AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.n.c, 0)::BIGINT AS cost, coalesce(b.n.a, '') AS audit, sha256(coalesce(array_to_string(b.n.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0
"""


OP12_SQL = _op12_sql()
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::UBIGINT::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS p, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS q, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(list_slice(t, 1, p), '') AS a, array_to_string(list_slice(t, p + 1, q), '') AS b, array_to_string(list_slice(t, q + 1, n), '') AS c FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_quality": op2_quality, "op3_mixing": op3_mixing, "op4_toxicity": op4_toxicity, "op5_langid": op5_langid, "op6_embeddings": op6_embeddings, "op7_secrets": op7_secrets, "op8_simhash": op8_simhash, "op9_html": op9_html, "op10_chat": op10_chat, "op11_sharding": op11_sharding, "op12_repair": op12_repair, "op13_fim": op13_fim}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op3_mixing": OP3_SQL, "op6_embeddings": OP6_SQL, "op10_chat": OP10_SQL, "op12_repair": OP12_SQL, "op13_fim": OP13_SQL}
