"""Anchor aliases: normal forms by language and term type."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import WRAPPERS, single_spaced


def _compatible_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def compatible_folded(text: Column) -> Column:
    """NFKC and case folding, which the JVM functions lack."""
    return F.pandas_udf(_compatible_folded, "string")(text)


def normal_alias(alias: Column, language: Column, term_type: Column) -> Column:
    """Lookup form of an alias: compatible characters, single spaces, no wrappers, folded case.

    Annotations (bare identifiers too) begin with @; hyphens and underscores of English concepts are
    spaces; Korean concepts have no space between Hangul. Configuration keys and artifacts keep their
    hyphens. A null alias is the empty text.
    """
    plain = F.btrim(single_spaced(compatible_folded(F.coalesce(alias, F.lit("")))), F.lit(WRAPPERS))
    concept = term_type == "concept"
    annotation = F.when(plain.rlike(r"^[A-Za-z_][\w.]*$"), F.concat(F.lit("@"), plain)).otherwise(plain)
    english = single_spaced(F.regexp_replace(plain, "[-_]+", " "))
    korean = F.regexp_replace(plain, "(?<=[가-힣]) (?=[가-힣])", "")
    return F.when(term_type == "annotation", annotation).when(concept & (language == "en"), english).when(concept & (language == "ko"), korean).otherwise(plain)
