"""Anchor phrases, content tokens, hint tokens, short evaluation queries and rewrite templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import guess_language, let, single_spaced, unwrapped

# Token patterns, stop lists, endings and templates that results are defined by.
ANCHOR_TOKEN = r"[@A-Za-z0-9_./:$-]+"
CONTENT_TOKEN = r"[@A-Za-z0-9_./:$-]+|[가-힣]{2,}"
HINT_TOKEN = r"@[A-Za-z][A-Za-z0-9_]+|[A-Za-z][A-Za-z0-9_.:/+-]{2,}"
HANGUL_TOKEN = r"[가-힣]{2,}"
ANCHOR_STOPWORDS = ("spring", "security", "framework", "example", "examples", "config", "configuration")
KO_FUNCTIONAL = ("부탁드립니다", "제거되었습니다", "수 있습니다", "지원합니다", "됩니다")
EN_FUNCTIONAL = ("can be", "supported", "supports", "removed", "deprecated", "available")
KO_ENDINGS = ("합니다", "됩니다", "있습니다", "없습니다", "지원합니다", "제공합니다", "사용합니다", "가능합니다", "권장합니다", "제거되었습니다", "추가되었습니다", "변경되었습니다", "부탁드립니다")
GENERIC_CONTENT = (
    "spring", "boot", "security", "framework", "data", "java", "kotlin", "practical", "practice", "usage", "use", "overview", "summary", "point", "points", "difference", "differences", "guide", "latest", "stable", "version",
    "실행", "사용", "사용법", "요약", "포인트", "차이", "방법", "예시", "실무", "보통", "관련", "가이드", "정리", "핵심", "빠르게", "같이",
)
GENERIC_HINTS = ("spring", "security", "framework", "reference", "docs", "doc", "guide", "example", "examples", "setup", "config", "configuration", "usage", "role", "reason", "difference", "default", "basic")
GENERIC_TERMS_EN = (
    "spring", "security", "framework", "data", "boot", "class", "method", "object", "value", "values", "type", "types", "query", "queries", "request", "response",
    "application", "configuration", "config", "using", "usage", "example", "examples", "custom", "customize", "default",
)
GENERIC_TERMS_KO = ("방법", "설정", "사용", "차이", "이유", "정의", "개념", "예시", "클래스", "메서드", "어노테이션", "애플리케이션", "스프링", "어떻게", "무엇", "왜")
PRODUCT_SUFFIXES = ("-reference", "_reference", "-docs", "_docs", "-doc", "_doc")
SUFFIX_EN = {"definition": "what?", "procedure": "how?", "reason": "why?", "comparison": "difference?", "follow_up": "this?", "code_mixed": "usage?", "short_user": "?"}
SUFFIX_KO = {"definition": "뭐임?", "procedure": "방법?", "reason": "왜?", "comparison": "차이?", "follow_up": "이거?", "code_mixed": "사용?", "short_user": "?"}
OVERLAP_LABEL = "Overlap context from previous chunk:"


def _mixed_case(value: Column) -> Column:
    """A capital after the first character, and a small letter."""
    return F.substring(value, F.lit(2), F.length(value)).rlike(r"\p{Lu}") & value.rlike(r"\p{Ll}")


def has_marker(text: Column) -> Column:
    """Three characters or more with an annotation sign, a joint, letters beside digits, or inner capitals."""
    value = unwrapped(text)
    return (F.length(value) >= 3) & (value.startswith("@") | value.rlike("[._/:-]") | (value.rlike("[A-Za-z]") & value.rlike(r"\d")) | (value.rlike(r"\p{Lu}") & value.rlike(r"\p{Ll}")))


def is_functional(text: Column, language: Column | None = None) -> Column:
    """Whether a phrase only serves the sentence (or is empty)."""
    value = unwrapped(text)
    language = guess_language(value) if language is None else F.lower(language)
    ending = value.rlike(f"(?:{'|'.join(KO_ENDINGS)})$")
    korean = value.isin(*KO_FUNCTIONAL) | value.contains("수 있습니다") | (~has_marker(value) & ending)
    english = F.lower(value).isin(*EN_FUNCTIONAL) | (~has_marker(value) & F.lower(value).isin(*ANCHOR_STOPWORDS))
    return (value == "") | F.when(language == "ko", korean).otherwise(english)


def is_valid_anchor(text: Column, language: Column | None = None, least: int = 3, most: int = 120) -> Column:
    value = unwrapped(text)
    return (value != "") & F.length(value).between(least, most) & (F.regexp_count(value, F.lit(r"\.")) <= 6) & ~is_functional(value, language)


def _first_by_fold(values: Column) -> Column:
    """Values whose folded form did not occur before."""
    folded = F.transform(values, F.lower)
    return let(folded, lambda fs: F.filter(values, lambda _, i: F.array_position(fs, F.get(fs, i)) == i + 1))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def anchor_tokens(text: Column, language: Column | None = None, most: int = 8) -> Column:
    """Distinct technical tokens of a text in order, at most ``most``."""
    language = guess_language(text) if language is None else language
    tokens = F.transform(_found(text, ANCHOR_TOKEN), unwrapped)
    kept = F.filter(tokens, lambda t: (t != "") & ~F.lower(t).isin(*ANCHOR_STOPWORDS) & has_marker(t) & is_valid_anchor(t, language))
    return F.slice(_first_by_fold(kept), 1, most)


def content_tokens(text: Column, most: int = 24, generic: bool = False) -> Column:
    """The first ``most`` distinct content tokens in text order, folded."""
    tokens = F.transform(_found(text, CONTENT_TOKEN), unwrapped)
    kept = F.filter(tokens, lambda t: (t != "") & (F.lit(generic) | ~F.lower(t).isin(*GENERIC_CONTENT)) & ~t.rlike(r"^\d+$") & (F.length(t) >= 2) & ((F.length(t) >= 3) | has_marker(t)))
    return F.slice(F.array_distinct(F.transform(kept, F.lower)), 1, most)


def is_hint_anchor(token: Column) -> Column:
    """Whether a token of a memory may be given as a hint."""
    value = unwrapped(token)
    upper = value.rlike(r"[A-Za-z]") & ~value.rlike(r"\p{Ll}") & (F.length(value) >= 4)
    return (value != "") & ~F.lower(value).isin(*GENERIC_HINTS) & (value.startswith("@") | value.rlike("[._/:-]") | value.rlike(r"\d") | upper | _mixed_case(value))


def hint_tokens(text: Column, language: Column | None = None, most: int = 8) -> Column:
    """Distinct hint tokens: technical tokens first, then other names."""
    language = guess_language(text) if language is None else language
    every = F.concat(anchor_tokens(text, language, 2 * most), F.transform(_found(text, HINT_TOKEN), unwrapped))
    kept = F.filter(every, lambda t: is_hint_anchor(t) & is_valid_anchor(t, language))
    return F.slice(_first_by_fold(kept), 1, most)


def product_aliases(product: Column) -> Column:
    """A product key and what is left of it without a documentation suffix, sorted."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(product, F.lit("")))), "_", "-")
    suffixes = sorted({s.replace("_", "-") for s in PRODUCT_SUFFIXES})
    cut = F.array(*(F.when(key.endswith(s) & (F.length(key) > len(s)), F.substring(key, F.lit(1), F.length(key) - len(s))) for s in suffixes))
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(key), cut)))))


def overlap_of_chunk(text: Column) -> Column:
    """Struct ``(overlap_chars, content)``: a chunk's text without the overlap that its label announces."""
    cut = F.instr(text, "\n\n")
    head = F.substring(text, F.lit(1), cut - 1)
    line = F.instr(head, "\n")
    size = F.when(line > 0, F.length(head) - line).otherwise(0)
    whole = text.startswith(OVERLAP_LABEL) & (cut > 0)
    return F.struct(F.when(whole, size).otherwise(0).alias("overlap_chars"), F.when(whole, F.substring(text, cut + 2, F.length(text))).otherwise(text).alias("content"))


def encoder_text(text: Column, model: str, kind: str) -> Column:
    """The text as a model family with prefixes wants it (``kind`` is passage or query)."""
    return F.concat(F.lit(f"{kind}: "), text) if "e5" in model.lower() else text


def is_query_term(token: Column) -> Column:
    """A technical token by the stricter rule for short queries."""
    value = unwrapped(token)
    upper = value.rlike(r"[A-Za-z]") & ~value.rlike(r"\p{Ll}") & (F.length(value) >= 4)
    return (F.length(value) >= 3) & (value.startswith("@") | value.rlike("[._/:-]") | value.rlike(r"\d") | upper | _mixed_case(value))


def query_terms(text: Column, glossary: Column, language: str = "ko", most: int = 8) -> Column:
    """Terms of a short evaluation query: technical tokens, glossary terms, then (in Korean) Hangul words."""
    usable = lambda t: (t != "") & ~F.lower(t).isin(*GENERIC_TERMS_EN) & ~t.isin(*GENERIC_TERMS_KO)
    named = F.filter(F.transform(F.concat(_found(text, HINT_TOKEN), F.coalesce(glossary, F.array().cast("array<string>"))), unwrapped), lambda t: usable(t) & is_query_term(t))
    plain = F.filter(F.transform(_found(text, HANGUL_TOKEN), unwrapped), usable) if language == "ko" else F.array().cast("array<string>")
    return F.slice(_first_by_fold(F.concat(named, plain)), 1, most)


def short_query_variants(text: Column, glossary: Column, query_type: Column, language: str = "ko", most: int = 64) -> Column:
    """Short forms of a query, best first; the cut text is the last. A builder takes the first that is not used yet."""
    table = SUFFIX_EN if language == "en" else SUFFIX_KO
    kind = F.lower(F.trim(F.coalesce(query_type, F.lit(""))))
    suffix = F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[kind], F.lit("?"))
    plain = single_spaced(F.coalesce(text, F.lit("")))
    limit = 72 if language == "en" else 64

    def build(terms: Column) -> Column:
        one, two, three = (F.get(terms, F.lit(i)) for i in range(3))
        join = lambda *p: F.replace(F.concat_ws(" ", *p), F.lit(" ?"), F.lit("?"))
        named = F.array(F.when(F.size(terms) >= 1, join(one, suffix)), F.when(F.size(terms) >= 2, join(one, two, suffix)), F.when(F.size(terms) >= 3, F.concat(F.concat_ws(" ", one, two, three), F.lit("?"))))
        words = F.concat(F.rtrim(F.array_join(F.slice(F.split(plain, " "), 1, 3), " "), F.lit("?.!")), F.lit("?"))
        every = F.array_compact(F.concat(named, F.array(F.when((F.size(terms) == 0) & (plain != ""), words))))
        ended = F.transform(every, lambda v: F.replace(F.when(v.endswith("?"), v).otherwise(F.concat(v, F.lit("?"))), F.lit("??"), F.lit("?")))
        return F.filter(ended, lambda v: F.length(v).between(3, limit))

    cut = F.rtrim(F.substring(plain, 1, most))
    fallback = F.when(cut.endswith("?"), cut).otherwise(F.concat(cut, F.lit("?")))
    return F.concat(let(query_terms(text, glossary, language), build), F.array(fallback))


def template_rewrites(raw: Column, memory: Column, previous_question: Column, previous_summary: Column, most: int = 3) -> Column:
    """The three template rewrites: standalone, with the best memory, and for failures; array<struct<label, query>>."""
    before = F.trim(F.coalesce(previous_question, F.lit("")))
    entity = F.trim(F.coalesce(previous_summary, F.lit("")))
    alone = F.concat(raw, F.lit("를 스프링 기술 문서 기준으로 독립 질문 형태로 상세히 설명해 주세요."))
    follow = F.trim(F.concat(before, F.lit(" 이후 맥락에서 "), raw, F.lit("를 독립 질문으로 재작성해 주세요. "), entity))
    rows = [
        ("explicit_standalone", F.when((before != "") | (entity != ""), follow).otherwise(alone)), ("memory_anchored", F.concat(raw, F.lit(" 관련하여 "), F.coalesce(memory, raw))),
        ("task_or_error_focused", F.concat(raw, F.lit("가 실패하거나 오류가 날 때 점검 순서를 알려주세요."))),
    ]
    return F.slice(F.array(*(F.struct(F.lit(k).alias("label"), v.alias("query")) for k, v in rows)), 1, most)


def standalone_rewrites(raw: Column, guided: Column, memory_index: Column, previous_question: Column, previous_summary: Column, most: int = 2) -> Column:
    """The rewrites by context: the query with what went before it, and that with memory hints if it differs.

    ``guided`` is the standalone text with hints (null without memories); array<struct<label, query, source_memory_index, intent_risk>>.
    """
    joined = standalone_text(raw, previous_question, previous_summary)
    row = lambda label, text, index, risk: F.struct(F.lit(label).alias("label"), text.alias("query"), index.cast("int").alias("source_memory_index"), F.lit(risk).alias("intent_risk"))
    differs = (single_spaced(guided) != "") & (F.lower(single_spaced(guided)) != F.lower(single_spaced(joined)))
    expanded = F.when(F.coalesce(differs, F.lit(False)), row("expanded", guided, F.greatest(F.lit(1), F.coalesce(memory_index, F.lit(1))), "medium"))
    return F.slice(F.array_compact(F.array(row("standalone", joined, F.lit(0), "low"), expanded)), 1, most)


def standalone_text(raw: Column, previous_question: Column, previous_summary: Column) -> Column:
    parts = [F.nullif(F.trim(F.coalesce(p, F.lit(""))), F.lit("")) for p in (previous_question, previous_summary)]
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", parts[0], F.nullif(raw, F.lit("")), parts[1])), F.lit("")), raw)
