"""Anchor candidates and hints for rewriting: several ranked lists merged in order, the first of equal terms staying.

Memories of a query are an array in rank order of structs with ``memory_id``, ``query_text``, ``glossary``
(array of terms) and, for canonical hints, ``canonical`` (array of anchors). All functions are column
expressions over such rows; only the first five memories count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import phrases as P
from millrace.functions.text import let, unwrapped

MEMORIES = 5
#: Fixed limits: anchors in all, tokens taken of the query and of a memory's query, hints in all.
ANCHORS, OF_QUERY, OF_MEMORY = 8, 4, 3
HINTS, HINTS_OF_QUERY, HINTS_OF_MEMORY, MOST_HINTS = 12, 6, 4, 24
#: Forms of a canonical anchor in the order in which they are offered.
CANONICAL_FORMS = ("canonical_form", "display_alias", "normalized_alias", "canonical_normalized_form")


def tagged(terms: Column, source: str, memory_id: Column) -> Column:
    """Terms as structs that say where they come from."""
    return F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.struct(unwrapped(t).alias("term"), F.lit(source).alias("source"), memory_id.cast("string").alias("memory_id")))


def merged(lists: Column, keep, most: int) -> Column:
    """The structs of an array of arrays in order: those that ``keep`` accepts, the first of equal (folded) terms, at most ``most``."""
    usable = F.filter(F.flatten(lists), lambda x: (x["term"] != "") & keep(x["term"]))

    def first(rows: Column) -> Column:
        return let(F.transform(rows, lambda x: F.lower(x["term"])), lambda keys: F.filter(rows, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    return F.slice(let(usable, first), 1, most)


def _in_turn(raw: Column, memories: Column, language: Column, of_query: int, of_memory: int) -> Column:
    """The query's tokens, then for each memory its glossary and the tokens of its query."""
    own = tagged(P.anchor_tokens(raw, language, of_query), "raw_query", F.lit(None))
    of = F.transform(F.slice(memories, 1, MEMORIES), lambda m: F.concat(tagged(m["glossary"], "memory_glossary", m["memory_id"]), tagged(P.anchor_tokens(m["query_text"], language, of_memory), "memory_query", m["memory_id"])))
    return F.concat(F.array(own), of)


def anchor_candidates(raw: Column, memories: Column, language: Column, most: int = ANCHORS) -> Column:
    """``array<struct<term, source, memory_id>>``: anchors of the query and of its memories; glossary terms only if technical."""
    lists = F.transform(_in_turn(raw, memories, language, OF_QUERY, OF_MEMORY), lambda x: F.filter(x, lambda t: (t["source"] != "memory_glossary") | P.has_marker(t["term"])))
    return merged(lists, lambda t: P.is_valid_anchor(t, language), most)


def terminology_hints(raw: Column, memories: Column, language: Column, most: int = HINTS) -> Column:
    """``array<struct<term, source, memory_id>>``: technical terms alone, more of each list."""
    most = max(1, min(most, MOST_HINTS))
    lists = _in_turn(raw, memories, language, min(HINTS_OF_QUERY, most), HINTS_OF_MEMORY)
    return merged(lists, lambda t: P.has_marker(t) & P.is_valid_anchor(t, language), most)


def eligible(anchor: Column) -> Column:
    """Whether a canonical anchor may be given as a hint: resolved, reviewed, nothing pending."""
    status, review = F.lower(F.trim(F.coalesce(anchor["resolution_status"], F.lit("")))), F.lower(F.trim(F.coalesce(anchor["review_status"], F.lit(""))))
    reviewed = ((status == "mapped") & (review == "approved")) | ((status == "self_fallback") & review.isin("", "approved"))
    return F.coalesce(anchor["used_for_scoring"], F.lit(False)) & reviewed & ~F.coalesce(anchor["pending"], F.lit(False)) & (F.trim(F.coalesce(anchor["canonical_form"], F.lit(""))) != "")


def canonical_hints(memories: Column, language: Column, most: int = HINTS) -> Column:
    """``array<struct<term, source, memory_id>>`` of the eligible canonical anchors' forms; ``source`` is the canonical form."""
    most = max(1, min(most, MOST_HINTS))

    def forms(anchor: Column, memory: Column) -> Column:
        return F.array(*(F.struct(F.trim(F.coalesce(anchor[f], F.lit(""))).alias("term"), F.trim(anchor["canonical_form"]).alias("source"), memory["memory_id"].cast("string").alias("memory_id")) for f in CANONICAL_FORMS))

    lists = F.transform(F.slice(memories, 1, MEMORIES), lambda m: F.flatten(F.transform(F.filter(m["canonical"], eligible), lambda a: forms(a, m))))
    return merged(lists, lambda t: P.is_valid_anchor(t, language), most)
