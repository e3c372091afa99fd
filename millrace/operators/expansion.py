"""Canonical expansion: texts get the forms of every term group that they mention.

The variants of all groups are one index of literal patterns, matched in one pass over the texts; a text is
brought into the forms that variants are compared in (single-spaced, and without spaces) once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import HANGUL, spaced_form
from millrace.operators.search import literal_matches

#: Terms of a text at most, a fixed limit of the operator.
MOST = 64
#: Stands between the spaced and the compact form of a text; neither holds it.
MARK = "\x01"


def compact(spaced: Column) -> Column:
    return F.replace(spaced, F.lit(" "), F.lit(""))


def variants_of(anchors: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``(group, place, variant)``: the distinct filled forms of each group, in the order of its anchors and of the fields.

    ``anchors(group, at, used, *fields)``; anchors that are not used for scoring, or have no group, do not count.
    """
    forms = F.array(*(F.struct(F.lit(i).alias("i"), F.trim(F.coalesce(F.col(f), F.lit(""))).alias("v")) for i, f in enumerate(fields)))
    every = anchors.where("used AND group IS NOT NULL").select("group", "at", F.explode(forms).alias("x")).where("x.v <> ''")
    first = every.groupBy("group", F.lower("x.v").alias("k")).agg(F.min(F.struct("at", "x.i", "x.v")).alias("f"))
    order = Window.partitionBy("group").orderBy("f.at", "f.i", "k")
    return first.select("group", F.row_number().over(order).alias("place"), F.col("f.v").alias("variant"))


def mentioned(texts: DataFrame, variants: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(id, group)``: groups of which a text has a variant, as whole words, or (phrases, Hangul, annotations) with spaces ignored."""
    spaced = spaced_form(F.col("variant"))
    loose = spaced.contains(" ") | spaced.rlike(HANGUL) | spaced.startswith("@")
    patterns = F.array(F.concat(F.lit(" "), spaced, F.lit(" ")), F.when(loose, compact(spaced)))
    every = variants.where(spaced != "").select("group", F.explode(F.array_compact(patterns)).alias("pattern"))
    index = every.select("pattern").distinct().withColumn("pattern_id", F.xxhash64("pattern"))
    target = texts.select(F.col(id_col).alias("doc_id"), spaced_form(F.col(text_col)).alias("s")).select("doc_id", F.concat(F.lit(" "), "s", F.lit(" "), F.lit(MARK), compact(F.col("s"))).alias("text"))
    hits = literal_matches(target, index)
    return hits.join(every.withColumn("pattern_id", F.xxhash64("pattern")), "pattern_id").select(F.col("doc_id").alias(id_col), "group").distinct()


def expand(texts: DataFrame, variants: DataFrame, order: DataFrame | None = None, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, place, term)``: the variants of all groups that a text mentions, groups in their order, each term once, at most ``most``.

    ``order(group, at)`` says where a group stands; by default they stand in the order of their names.
    Texts that mention nothing have no rows.
    """
    found = mentioned(texts, variants, id_col, text_col)
    placed = found.join(variants, "group")
    placed = placed.join(order, "group") if order is not None else placed.withColumn("at", F.lit(0))
    first = placed.groupBy(id_col, F.lower("variant").alias("k")).agg(F.min(F.struct("at", "group", "place", "variant")).alias("f"))
    rank = Window.partitionBy(id_col).orderBy("f.at", "f.group", "f.place", "k")
    return first.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most).select(id_col, "place", F.col("f.variant").alias("term"))


def expanded_texts(texts: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with their terms on a line of their own behind them."""
    joined = terms.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("_terms"))
    return texts.join(joined, id_col, "left").withColumn(text_col, F.concat_ws("\n", F.coalesce(F.col(text_col), F.lit("")), "_terms")).drop("_terms")
