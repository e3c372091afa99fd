"""Audits of evaluation samples: whether what they refer to exists, and flags of samples that test little.

Flags are those of a published audit: A a query too generic or stripped of its source's terms, B weak overlap
with the expected chunks, C a comparison without a comparing chunk, D key points that rest on overlap text,
E too generic to tell rewriting from retrieval, F no differentiating term at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.phrases import OVERLAP_LABEL
from millrace.functions.text import let, single_spaced

# The term pattern, word lists, markers and floors of the audit.
TERM = r"@[A-Za-z][A-Za-z0-9_]+|[A-Za-z][A-Za-z0-9_.:/-]{2,}|[가-힣]{2,}"
EDGES = "`\"'()[]{}<>.,;:"
STOPWORDS = ("보통", "뭐임", "요약", "포인트", "어케", "언제", "어디", "정리", "가이드", "사용", "설정", "순서", "차이", "비교", "방법", "설명", "기본", "동작", "예시", "같이", "쓸때")
STRUCTURE = ("section", "path", "overlap", "context", "previous", "chunk")
GENERIC_TECH = ("spring", "security", "framework", "boot", "data", "jpa", "http", "https", "web", "mvc", "webflux", "aop", "oauth2", "repository", "environment", "kotlin", "java")
GENERIC_MARKERS = ("보통", "뭐임", "요약", "포인트", "어케", "언제", "어디", "정리", "가이드")
COMPARE_MARKERS = (" vs ", "차이", "뭐가 맞", "비교")
SOURCE_FLOOR, CHUNK_FLOOR, SUMMARY = 0.5, 0.34, "Section Summary"
#: Classes of broken references, the gravest first.
BROKEN = ("missing_document", "missing_chunk", "chunk_of_other_document", "evidence_not_in_text")


def terms(text: Column) -> Column:
    """Distinct terms of a text in order, the first spelling of each."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TERM})"), F.lit(1)), lambda t: F.btrim(t, F.lit(EDGES)))
    kept = F.filter(found, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*STOPWORDS, *STRUCTURE))
    return let(kept, lambda k: let(F.transform(k, F.lower), lambda low: F.filter(k, lambda _, i: F.array_position(low, F.get(low, i)) == i + 1)))


def specific(found: Column) -> Column:
    return F.filter(found, lambda t: ~F.lower(t).isin(*GENERIC_TECH))


def overlap(found: Column, text: Column) -> Column:
    """Share of the distinct terms that occur anywhere in a text; 0 without terms."""
    low = F.array_distinct(F.transform(found, F.lower))
    return let(F.lower(single_spaced(F.coalesce(text, F.lit("")))), lambda t: F.coalesce(F.try_divide(F.size(F.filter(low, lambda x: t.contains(x))), F.size(low)), F.lit(0.0)))


def _has(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.lower(single_spaced(F.coalesce(text, F.lit("")))).contains(m)
    return found


def flags(samples: DataFrame) -> DataFrame:
    """``samples(sample_id, query, source_query, source_type, chunk_text, section_path, key_points)`` with terms, overlaps and ``flags`` (array of A to F, in the order of the audit).

    Null texts count as empty; a sample without flags has an empty array.
    """
    cut = samples.withColumns({"_q": terms(F.col("query")), "_s": specific(terms(F.col("source_query")))})
    cut = cut.withColumn("_p", specific(F.col("_q")))
    seen = cut.withColumns({"chunk_overlap": overlap(F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.col("_q")), F.col("chunk_text")), "source_overlap": overlap(F.col("_s"), F.col("query"))})
    n, m, low = F.size("_p"), F.size("_s"), F.lower(F.coalesce("chunk_text", F.lit("")))
    dropped = (m >= 2) & (F.col("source_overlap") < SOURCE_FLOOR)
    leans = F.exists(F.coalesce("key_points", F.array().cast("array<string>")), lambda p: F.coalesce(p.startswith(OVERLAP_LABEL.rstrip(":")), F.lit(False)))
    comparing = (F.lower(F.coalesce("source_type", F.lit(""))) == "comparison") | low.contains("difference") | low.contains("versus")
    found = F.array_compact(F.array(
        F.when((_has(F.col("query"), GENERIC_MARKERS) & (n <= 1)) | dropped, "A"), F.when(leans, "D"), F.when(F.coalesce("section_path", F.lit("")).contains(SUMMARY) | (F.col("chunk_overlap") < CHUNK_FLOOR), "B"),
        F.when(_has(F.col("query"), COMPARE_MARKERS) & ~comparing, "C"), F.when(n == 0, "F"), F.when((n <= 1) & (m >= 1), "E")))
    return seen.select("sample_id", F.col("_q").alias("query_terms"), F.col("_p").alias("specific_terms"), "chunk_overlap", "source_overlap", found.alias("flags"))


def broken_references(samples: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(sample_id, broken)``: the gravest class of what is wrong with a sample's references, null if nothing is.

    ``samples(sample_id, doc_ids, chunk_ids, evidence)``, ``documents(doc_id)``, ``chunks(chunk_id, doc_id, text)``.
    A chunk belongs to one of the sample's documents, and its evidence stands in one of its chunks. Each kind
    is one join on ids; no sample is compared with a table.
    """
    of_docs = samples.select("sample_id", F.explode("doc_ids").alias("doc_id")).join(documents.select("doc_id", F.lit(True).alias("_d")), "doc_id", "left")
    docs = of_docs.groupBy("sample_id").agg(F.bool_or(F.col("_d").isNull()).alias("no_document"))
    named = samples.select("sample_id", "doc_ids", "evidence", F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", F.col("doc_id").alias("_of"), F.coalesce("text", F.lit("")).alias("_text")), "chunk_id", "left")
    there = F.col("_of").isNotNull()
    parts = named.groupBy("sample_id").agg(F.bool_or(~there).alias("no_chunk"), F.bool_or(there & ~F.array_contains("doc_ids", F.col("_of"))).alias("other_document"), F.bool_or(there & F.contains(F.col("_text"), F.coalesce("evidence", F.lit("")))).alias("shown"))
    every = samples.select("sample_id", "evidence").join(docs, "sample_id", "left").join(parts, "sample_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    unseen = (F.coalesce("evidence", F.lit("")) != "") & ~yes("shown")
    broken = F.when(yes("no_document"), BROKEN[0]).when(yes("no_chunk"), BROKEN[1]).when(yes("other_document"), BROKEN[2]).when(unseen, BROKEN[3])
    return every.select("sample_id", broken.alias("broken"))
