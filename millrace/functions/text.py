"""Text functions as JVM column expressions: tokens, counts, ratios, sentences, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and tables, part of the results' definition.
TOKEN = "[A-Za-z0-9_./-]+|[가-힣]+"
LENGTH_TOKEN = r"[A-Za-z0-9_./:@$-]+|[^\p{L}\p{N}_\s]"
HANGUL = "[가-힣]"
SPECIAL = r"[^A-Za-z0-9가-힣\s]"
TRANSLATIONS = {
    "spring": "스프링", "security": "시큐리티", "framework": "프레임워크", "configuration": "설정", "bean": "빈", "context": "컨텍스트", "query": "질의",
    "document": "문서", "method": "방법", "how": "어떻게", "what": "무엇", "why": "왜", "error": "오류", "version": "버전",
}
WRAPPERS = ".,;:!?()[]{}<>\"'`"
#: UUID namespace for URLs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where ``body`` uses it within other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case search tokens in text order; empty for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def token_length(text: Column) -> Column:
    """Estimated model tokens: words with their inner punctuation, and each other sign."""
    return F.coalesce(F.regexp_count(text, F.lit(LENGTH_TOKEN)), F.lit(0)).cast("long")


def token_tail(text: Column, n: int) -> Column:
    """A text from its n-th last estimated token on, trimmed; the whole text if it has no more of them, or for no tokens."""
    whole = F.coalesce(text, F.lit(""))
    kept = whole
    if n > 0:
        marked = F.regexp_replace(F.translate(whole, "\x01", " "), f"({LENGTH_TOKEN})", "\x01$1")
        kept = F.when(token_length(whole) <= n, whole).otherwise(F.replace(F.substring_index(marked, "\x01", -n), F.lit("\x01"), F.lit("")))
    return F.regexp_replace(kept, r"^\s+|\s+$", "")


def _share(text: Column, pattern: str) -> Column:
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)), solid), F.lit(0.0))


def korean_ratio(text: Column) -> Column:
    """Hangul syllables per character that is not white space; 0 without any."""
    return _share(text, HANGUL)


def special_ratio(text: Column) -> Column:
    return _share(text, SPECIAL)


def sentences(text: Column) -> Column:
    """Trimmed sentences: cut at white space after . ! or ?; no empty ones."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(cut, lambda s: s != "")


def extractive_summary(text: Column, most: int = 2, fallback: int = 240) -> Column:
    found = sentences(text)
    plain = F.left(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), F.lit(fallback))
    return F.when(F.size(found) == 0, plain).otherwise(F.array_join(F.slice(found, 1, most), " "))


def translate_words(text: Column, table: dict[str, str] | None = None) -> Column:
    """Whole words replaced by the table, one after the other, in either case."""
    for source, target in (TRANSLATIONS if table is None else table).items():
        text = F.regexp_replace(text, rf"(?i)\b{source}\b", target)
    return text


def ngrams(array: Column, size: int) -> Column:
    """Space-joined runs of ``size`` elements."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda _: F.size(w) >= size)
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))

    return let(array, runs)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def copy_ratio(query: Column, reference: Column, size: int = 4) -> Column:
    """Share of the query's n-grams (repeats counted) also in the reference; 0 if either is too short."""

    def occurrences(array: Column, gram: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == gram))

    def shared(own: Column, other: Column) -> Column:
        both = F.aggregate(F.array_intersect(own, other), F.lit(0), lambda n, g: n + F.least(occurrences(own, g), occurrences(other, g)))
        return F.coalesce(F.try_divide(both, F.size(own)), F.lit(0.0))

    return let(ngrams(words(query), size), lambda own: let(ngrams(words(reference), size), lambda other: shared(own, other)))


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def term_key(text: Column) -> Column:
    return F.lower(single_spaced(text))


def content_id(text: Column, prefix: str) -> Column:
    """Content-addressed id: prefix and 16 hex digits of the SHA-1."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(text.cast("binary")), 1, 16))


def name_uuid(text: Column, namespace: str = URL_NAMESPACE) -> Column:
    """UUID version 5 of a text, by the bytes of its SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), text.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 64) + 128))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def unwrapped(text: Column) -> Column:
    """Without white space and quotes, brackets or stops around it."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), F.lit(WRAPPERS))


def guess_language(text: Column) -> Column:
    hangul, alpha = F.regexp_count(text, F.lit(HANGUL)), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(F.coalesce(hangul > alpha, F.lit(False)), "ko").otherwise("en")


def is_technical(token: Column) -> Column:
    """Annotation, separated, mixed alphanumeric or mixed-case tokens of three characters or more."""
    value = unwrapped(token)
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    cased = value.rlike(r"\p{Lu}") & value.rlike(r"\p{Ll}")
    return (F.length(value) >= 3) & (value.startswith("@") | value.rlike("[._/:-]") | mixed | cased)


def technical_tokens(all_tokens: Column) -> Column:
    """Distinct tokens with an ASCII letter or digit."""
    return F.filter(F.array_distinct(all_tokens), lambda t: t.rlike("[A-Za-z0-9]"))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Distinct tokens of ``left`` also in ``right``, per distinct token of ``left``."""
    return let(F.array_distinct(tokens(left)), lambda a: F.coalesce(F.try_divide(F.size(F.array_intersect(a, tokens(right))), F.size(a)), F.lit(0.0)))


def spaced_form(text: Column) -> Column:
    """Lower case, separators and other signs as single spaces (for matching variants)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[_-]", " "), "[^0-9a-z@가-힣]+", " "))


def variants_in_text(text: Column, variants: Column) -> Column:
    """Those of an array of variants that a text has: as whole words, or, for phrases, Hangul and annotations, with spaces ignored.

    The text is normalised once, whatever the number of variants.
    """
    blank, nothing = F.lit(" "), F.lit("")

    def found(spaced: Column, target: Column) -> Column:
        compact = F.replace(spaced, blank, nothing)
        loose = spaced.contains(" ") | compact.rlike(HANGUL) | compact.startswith("@")
        whole = target["whole"].contains(F.concat(blank, spaced, blank))
        return (compact != "") & (whole | (loose & target["compact"].contains(compact)))

    forms = let(spaced_form(text), lambda t: F.struct(F.concat(blank, t, blank).alias("whole"), F.replace(t, blank, nothing).alias("compact")))
    return let(forms, lambda target: F.filter(variants, lambda v: let(spaced_form(v), lambda s: found(s, target))))


def variant_in_text(text: Column, variant: Column) -> Column:
    """Whether a text has one variant, as :func:`variants_in_text` finds it."""
    return F.size(variants_in_text(text, F.array(variant))) > 0


def without_ascii_anchors(text: Column) -> Column:
    """ASCII tokens with their joints removed, white space single."""
    return single_spaced(F.regexp_replace(text, "[A-Za-z0-9_./:$#@-]+", " "))
