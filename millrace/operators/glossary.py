"""Glossary: term extraction by patterns, products and commands, canonical forms, evidence, keyphrases with MMR ranking."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.functions import text as T

# Fixed patterns of term types (type, pattern, group), stop words, generic words and command prefixes.
PATTERNS = (
    ("annotation", r"@\w+(?:\.\w+)*", 0),
    ("config_key", r"\b(?:spring|management|server|logging|security|data|jpa|hibernate|jdbc|r2dbc|flyway|liquibase|web|webflux|mvc|main|test|actuator|application)\.[a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)+\b", 0),
    ("dependency_artifact", r"\b(?:[a-z][a-z0-9_-]*\.)+[a-z][a-z0-9_-]*:[A-Za-z0-9_.-]+(?::[A-Za-z0-9_.-]+)?\b", 0),
    ("dependency_artifact", r"\bspring-(?:boot|cloud|data|security|session|ai|batch|integration)-[a-z0-9-]+\b", 0),
    ("class_interface", r"\b(?:[a-z_][\w$]*\.)+[A-Z][A-Za-z0-9_$]*\b", 0),
    ("class_interface", r"\b(?:class|interface|enum|record|extends|implements|new)\s+([A-Z][A-Za-z0-9_$]*)\b", 1),
    ("class_interface", r"\b[A-Z][A-Za-z0-9_$]*(?:Builder|Factory|Configurer|Template|Repository|Controller|Service|Configuration|Properties|Client|Manager|Resolver|Filter|Context|Bean|Application|Exception|Handler|Provider|Converter|Strategy|Endpoint|Details|Authentication|DataSource)\b", 0),
)
GENERIC = r"\b(?:[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+|[a-z][a-z0-9]+(?:[-_][a-z0-9]+){1,4}|[A-Za-z][A-Za-z0-9]*\.[A-Za-z0-9._-]+)\b"
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "over", "when", "where", "which", "while", "using",
    "used", "use", "your", "their", "they", "them", "then", "than", "also", "can", "could", "should", "would",
    "about", "after", "before", "have", "has", "had", "will", "may", "might", "must", "not", "are", "was", "were",
    "been", "being", "you", "our", "its", "it's", "any", "all", "each", "other", "more", "most", "some", "such",
    "api", "http", "https", "www", "docs", "doc", "guide", "reference", "section", "page",
)
GENERIC_WORDS = ("use", "used", "using", "support", "supported", "supports", "available", "required", "option", "options", "value", "values", "setting", "settings", "example", "examples", "guide", "section", "page", "document", "documents", "feature", "features", "request", "response")
COMMANDS = ("./gradlew", "gradle", "mvn", "java", "jar", "spring", "docker", "docker-compose", "curl", "http", "kubectl", "helm", "psql")
#: Score of a generic technical term among keyphrases.
GENERIC_SCORE = 1.8


def occurrences(docs: DataFrame, patterns: tuple = PATTERNS, products: tuple[tuple[str, tuple[str, ...]], ...] = (), commands: tuple[str, ...] = COMMANDS, concepts: bool = True, id_col: str = "doc_id", text_col: str = "text", code: Column | None = None) -> DataFrame:
    """``(doc_id, term_type, form, place, aliases)``: matches of every pattern in text order, products named (once a text), commands in fenced code, and concepts.

    ``code`` are the blocks of code of a text, if others than those between lines that begin with a fence.

    ``products`` are (canonical form, aliases). Annotations have their bare name as an alias, qualified
    types their last part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [_typed(text, kind, pattern, group) for kind, pattern, group in patterns]
    parts += [_products(text, products), _commands(text, commands, code)]
    if concepts:
        parts.append(F.transform(keyphrase_candidates(text), lambda x, i: _row("concept", x, i)))
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.concat(*parts))).where("form <> ''")


def _row(kind: str, form: Column, place: Column, aliases: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("term_type"), form.alias("form"), place.cast("int").alias("place"), (none if aliases is None else aliases).alias("aliases"))


def _typed(text: Column, kind: str, pattern: str, group: int) -> Column:
    aliases = None
    if kind == "annotation":
        aliases = lambda x: F.array(F.regexp_replace(x, "^@", ""))
    elif kind == "class_interface":
        aliases = lambda x: F.filter(F.array(F.regexp_replace(x, r"^.*\.", "")), lambda y: y != x)
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, i: _row(kind, F.trim(x), i, None if aliases is None else aliases(F.trim(x))))


def _products(text: Column, products: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    import re

    found = [F.when(text.rlike("(?i)\\b(?:" + "|".join(re.escape(n) for n in (name, *aliases)) + ")\\b"), _row("spring_product", F.lit(name), F.lit(0), F.array(*map(F.lit, aliases)).cast("array<string>"))) for name, aliases in products]
    return F.array_compact(F.array(*found)) if found else F.filter(F.array(_row("", F.lit(""), F.lit(0))), lambda x: F.lit(False))


def _commands(text: Column, prefixes: tuple[str, ...], code: Column | None = None) -> Column:
    """Lines of fenced code that begin with a command."""
    code = F.filter(F.split(text, "(?m)^```", -1), lambda _, i: i % 2 == 1) if code is None else code
    lines = F.flatten(F.transform(code, lambda c: F.split(c, r"\r?\n")))
    named = F.transform(lines, lambda x: F.trim(F.ltrim(F.trim(x), F.lit("$"))))
    starts = lambda x: F.exists(F.array(*map(F.lit, prefixes)), lambda p: x.startswith(p))
    return F.transform(F.filter(named, lambda x: (x != "") & starts(x)), lambda x, i: _row("cli_command", x, i))


def keyphrase_candidates(text: Column) -> Column:
    """Distinct generic technical terms of a text in order, as phrases; none that only hold generic or stop words."""
    kept = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GENERIC), F.lit(0)), lambda t: F.length(t).between(3, 120) & ~F.lower(t).isin("http", "https", "www") & (F.regexp_count(t, F.lit(r"\.")) <= 6) & P.has_marker(t))
    phrases = F.transform(F.array_distinct(kept), lambda t: F.btrim(t, F.lit("`'\"()[]{}.,:;")))
    generic = (*GENERIC_WORDS, *STOPWORDS)
    return F.array_distinct(F.filter(phrases, lambda t: P.is_valid_anchor(t) & ~F.lower(t).isin(*generic) & ~F.lower(t).isin(*P.ANCHOR_STOPWORDS)))


def terms(found: DataFrame) -> DataFrame:
    """One row for each type and lower-case form: the longest form is canonical (the earliest of equals), the
    other forms are aliases; documents are counted, evidence is the number of matches.

    Matches are first counted by surface form, so a frequent term is small before its forms meet.
    """
    forms = found.groupBy("term_type", F.lower("form").alias("key"), "form", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"), F.first("aliases").alias("aliases"))
    surface = forms.groupBy("term_type", "key", "form").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "place")).alias("first"), F.first("aliases").alias("aliases"))
    canonical = F.min_by("form", F.struct(-F.length("form"), F.col("first.doc_id"), F.col("first.place"), F.col("form")))
    by = surface.groupBy("term_type", "key").agg(canonical.alias("canonical_form"), F.array_sort(F.array_distinct(F.concat(F.collect_set("form"), F.flatten(F.collect_set("aliases"))))).alias("forms"), F.sum("n").alias("evidence_count"), F.min("first.doc_id").alias("first_doc"))
    counted = forms.groupBy("term_type", "key").agg(F.count_distinct("doc_id").alias("n_docs"))
    joined = by.join(counted, ["term_type", "key"])
    return joined.select(
        T.content_id(F.concat_ws(":", "term_type", "key"), "gls").alias("term_id"), "term_type", "canonical_form", F.array_remove("forms", F.col("canonical_form")).alias("aliases"),
        "evidence_count", "n_docs", "first_doc", F.least(F.lit(1.0), 0.55 + F.col("evidence_count") * 0.05).alias("confidence"),
    )


#: Fenced code within a chunk: a fence may stand anywhere in a line, its code begins on the next.
CODE_FENCE = r"```[^\n`]*\n([\s\S]*?)```"


def chunk_candidates(chunks: DataFrame, products: tuple[tuple[str, tuple[str, ...]], ...] = (), concepts: bool = True, id_col: str = "chunk_id", document_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """``(document_id, chunk_id, term_type, canonical_form)``: the terms of every chunk, each under its form over all chunks.

    A chunk stands for a section, its fenced code for that section's code blocks. Chunks without terms have no rows.
    """
    code = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(CODE_FENCE), F.lit(1))
    found = occurrences(chunks, products=products, concepts=concepts, id_col=id_col, text_col=text_col, code=code)
    named = terms(found).select("term_type", F.lower("canonical_form").alias("key"), "canonical_form")
    held = found.select(F.col("doc_id").alias("chunk_id"), "term_type", F.lower("form").alias("key")).distinct()
    of = chunks.select(F.col(id_col).alias("chunk_id"), F.col(document_col).alias("document_id"))
    return held.join(named, ["term_type", "key"]).join(of, "chunk_id").select("document_id", "chunk_id", "term_type", "canonical_form")


def alias_type(alias: Column, canonical: Column) -> Column:
    return (
        F.when(F.lower(alias) == F.lower(canonical), "same_case").when(alias.contains("-"), "kebab").when(alias.contains("."), "dotted").when(alias.contains(" "), "spaced")
        .when((F.upper(alias) == alias) & alias.rlike("[A-Za-z]") & (F.length(alias) <= 12), "abbreviation").when(alias.rlike(r"[^\x00-\x7F]"), "translated").otherwise("same_case")
    )


def evidence(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every literal occurrence, in either case, of a term in the chunks of its documents.

    ``chunks(doc_id, chunk_index, content)`` and ``wanted(term_id, form, doc_id)`` (a term's provenance
    documents) meet on the document; offsets come from cutting the text at the term.
    """
    both = chunks.join(wanted, "doc_id").select("term_id", "doc_id", "chunk_index", F.lower("form").alias("form"), F.lower("content").alias("low"))
    size = F.length("form")
    pieces = F.split(F.col("low"), F.concat(F.lit(r"\Q"), F.replace("form", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    # the end of each piece, by one running sum; the last piece ends the text
    ends = F.aggregate(
        F.transform(pieces, F.length), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, n: F.struct((a["at"] + n + size).alias("at"), F.concat(a["starts"], F.array(a["at"] + n)).alias("starts")), lambda a: a["starts"])
    cut = both.where("form <> '' AND contains(low, form)").select("term_id", "doc_id", "chunk_index", size.alias("size"), F.explode(F.slice(ends, 1, F.size(ends) - 1)).alias("start"))
    return cut.select("term_id", "doc_id", "chunk_index", "start", (F.col("start") + F.col("size")).alias("end"))


def evidence_summary(found: DataFrame) -> DataFrame:
    """Count, first evidence by (document, chunk, offset), and whether the term is active."""
    return found.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "chunk_index", "start")).alias("first"))


def mmr(base: list[float], relevance: list[float], near, n: int = 24, weight: float = 1.6, keep: float = 0.72, drop: float = 0.32) -> list[int]:
    """Maximal marginal relevance: places of the picks in order.

    The first has the greatest base + weight * relevance; each next the greatest keep * that minus
    drop * its greatest similarity (``near``, a matrix) to a pick, not below 0. Ties go to the smaller place.
    """
    import numpy as np

    combined = np.asarray(base, float) + weight * np.asarray(relevance, float)
    left, most, picks = np.ones(len(combined), bool), np.zeros(len(combined)), []
    while left.any() and len(picks) < n:
        value = keep * combined - drop * most if picks else combined
        best = int(np.flatnonzero(left)[np.argmax(value[left])])
        picks.append(best)
        left[best] = False
        most = np.maximum(most, near[best])
    return picks


def keyphrases(docs: DataFrame, n: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rank, phrase)``: up to ``n`` keyphrases of every document, ranked by MMR over hash embeddings.

    Candidates come from JVM expressions; phrases and whole text are embedded and ranked in one narrow
    pass. Each candidate has the score of a generic term; extractors that need language models are not there.
    """
    import re

    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.operators.search import hash_vector

        token = re.compile(T.TOKEN)
        for batch in batches:
            ids, ranks, picked = [], [], []
            for key, text, phrases in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not phrases:
                    continue
                v = np.stack([hash_vector([t.lower() for t in token.findall(x)]) for x in [text or "", *phrases]])
                near = v[1:] @ v[1:].T
                for rank, i in enumerate(mmr([GENERIC_SCORE] * len(phrases), np.maximum(0.0, v[1:] @ v[0]), np.maximum(0.0, near), n), 1):
                    ids.append(key)
                    ranks.append(rank)
                    picked.append(phrases[i])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranks, pa.int32()), pa.array(picked, pa.string())], names=["doc_id", "rank", "phrase"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), keyphrase_candidates(F.col(text_col)).alias("phrases"))
    return rows.mapInArrow(run, "doc_id long, rank int, phrase string")
