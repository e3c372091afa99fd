"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every document gets five ratios. Each ratio has ten cutoffs, from the most lenient (step 1) to the
strictest (step 10); step s of the rules rejects a document if any ratio exceeds its cutoff of step s.
A ratio only moves to a step at which it catches a labelled bad document that its earlier steps did
not, so steps that gain nothing reject nothing. That choice uses bad documents alone, so the good ones
still are a clean sample for the test of the rule.

Steps are nested, so for each stratum (language) those that catch a bad document anew are tested in
fixed sequence, lenient first: step s is certified if all steps before it are and the exact binomial tail P(Bin(n, alpha) <= k), where k of
the n labelled good documents of the stratum are rejected by the whole rule, is at most ``delta`` divided
by the number of strata (fixed-sequence testing needs no correction within a stratum, Bonferroni's holds
over the strata). So with probability 1 - ``delta`` the rules of every stratum together reject at most
``alpha`` of its good documents. The strictest certified step is taken; a stratum without one, as any
with too few labels, keeps all that pass the base rule. Strata come from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import WORD_BREAK, durable, whole_row

BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
#: Strata up to which the certified rules are broadcast; beyond, Spark chooses the join.
STRATA = 10_000
#: Labelled ids up to which they are broadcast to pick the texts that the rules are certified on.
LABELLED = 1_000_000
#: Cutoffs of each ratio, strictest first (a rule rejects above its cutoff).
GRID = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0),
    "duplicate_lines": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeated_words": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "long_words": (9.0, 10.0, 11.0, 12.0, 14.0, 17.0, 20.0, 25.0, 30.0, 50.0),
    "short_words": (-3.0, -2.75, -2.5, -2.25, -2.0, -1.75, -1.5, -1.35, -1.2, -1.1),
}
ALPHA, DELTA = 0.02, 0.1
STEPS = 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add the counts as columns ``_q_<name>`` (and ``_q_lines``) to the columns ``carry`` of ``df``.

    Repeats are found inside the row: three-word windows are hashed (XXH64 over the three words),
    and only where some are equal the hashes are sorted with their places. Nothing is shuffled.
    """
    kept = [F.col(c) for c in (df.columns if carry is None else carry)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    first = df.select(
        *kept,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK)).alias("_q_w"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("_q_l"),
        (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long").alias("_q_word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("_q_n_symbols"),
    )
    w = F.col("_q_w")
    windows = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    )
    hashed = first.select(
        *kept,
        F.size(w).cast("long").alias("_q_n_words"),
        "_q_word_chars",
        "_q_n_symbols",
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("_q_n_dup_lines"),
        F.size("_q_l").cast("long").alias("_q_lines"),
        windows.alias("_q_h"),
    )
    h = F.col("_q_h")
    ordered = hashed.select(
        *kept, "_q_n_words", "_q_word_chars", "_q_n_symbols", "_q_n_dup_lines", "_q_lines",
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_q_s"),
    )
    # starts of windows that occur twice or more, in text order; each adds its words not yet counted
    starts = F.expr("array_sort(transform(filter(_q_s, (e, k) -> e.h <=> get(_q_s, k - 1).h OR e.h <=> get(_q_s, k + 1).h), e -> e.i))")
    repeated = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    counted = ordered.select(
        *kept,
        # a one-row generator: later filters stay above it, so that they are not rewritten into copies of the expressions below
        F.explode(F.array(F.struct(
            "_q_n_words", "_q_word_chars", "_q_n_symbols", "_q_n_dup_lines", "_q_lines",
            F.when(F.col("_q_s").isNull(), F.lit(0).cast("long")).otherwise(repeated).alias("_q_n_repeat_words"),
        ))).alias("_q"),
    )
    return counted.select(*kept, "_q.*")


def base_failed() -> Column:
    return (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("_q_n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("_q_n_symbols") / words,
        "duplicate_lines": F.col("_q_n_dup_lines") / F.greatest(F.col("_q_lines"), F.lit(1)),
        "repeated_words": F.col("_q_n_repeat_words") / words,
        "long_words": F.col("_q_word_chars") / words,
        "short_words": -(F.col("_q_word_chars") / words),
    }


def stratum(lang_col: str) -> Column:
    """The language; the empty string where there is none."""
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def first_step(value: Column, cutoffs: tuple[float, ...]) -> Column:
    """The first step whose cutoff lies below ``value``; one more than the last where none does."""
    return F.lit(len(cutoffs) + 1) - F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: value > c))


def rejecting_step(steps: Column, gains: Column) -> Column:
    """The step of the rules that first rejects a document with ``steps`` by ratio, given the gaining steps by ratio; null if none does."""
    each = F.transform(steps, lambda s, i: F.array_min(F.filter(F.get(gains, i), lambda g: g >= s)))
    return F.array_min(F.filter(each, lambda s: s.isNotNull()))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly: the term at k from logarithms, the smaller terms by their ratios.

    1 where k is not below the mean (the tail is then about a half or more, never a certificate).
    """
    down = F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0)
    log_choose = F.aggregate(down, F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i))
    log_top = log_choose + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    odds = (1 - p) / p
    rest = F.aggregate(
        down,
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, j: F.struct((a["t"] * ((k - j + 1) / (n - k + j)) * odds).alias("t"), (a["s"] + a["t"] * ((k - j + 1) / (n - k + j)) * odds).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * rest)


def all_steps() -> Column:
    return F.array(*(first_step(v, GRID[name]) for name, v in ratios().items()))


def certify(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(_q_stratum, _q_gains, _q_step)`` of each stratum with a certified step; ``_q_gains`` are the gaining steps by ratio.

    ``measured`` needs ``_q_id``, ``_q_stratum`` and the counts; ``labels`` needs ``doc_id`` and
    ``quality`` (of several labels of one document the worst counts). Labelled rows are combined to
    counts by (stratum, step) before each shuffle, so no key gathers rows; the result has at most one
    row for each stratum with labels.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_q_id")).agg((F.min("quality") == 1).alias("_q_good"))
    rated = measured.where(~base_failed()).join(marks, "_q_id").groupBy("_q_stratum", "_q_good", all_steps().alias("steps")).agg(F.count(F.lit(1)).alias("n"))
    rated = durable(rated)
    caught = F.array(*(F.array_sort(F.collect_set(F.when(~F.col("_q_good") & (F.col("steps")[i] <= STEPS), F.col("steps")[i]))) for i in range(len(GRID))))
    gains = rated.groupBy("_q_stratum").agg(caught.alias("_q_gains"), F.sum(F.when(F.col("_q_good"), F.col("n"))).alias("good"))
    strata = gains.agg(F.count_if(F.col("good") > 0).alias("strata"))
    ruled = rated.join(gains, "_q_stratum").groupBy("_q_stratum", rejecting_step(F.col("steps"), F.col("_q_gains")).alias("step"))
    ruled = ruled.agg(F.sum(F.when(F.col("_q_good"), F.col("n")).otherwise(0)).alias("k"), F.count_if(~F.col("_q_good")).alias("bad"))
    by_step = ruled.groupBy("_q_stratum").agg(F.collect_list(F.struct("step", "k", "bad")).alias("ks"))
    rejected = lambda s: F.aggregate(F.filter(F.col("ks"), lambda x: x["step"] <= s), F.lit(0).cast("long"), lambda t, x: t + x["k"])
    tried = by_step.join(gains, "_q_stratum").crossJoin(F.broadcast(strata)).select(
        "_q_stratum", "_q_gains", "good", "strata", F.explode(F.filter("ks", lambda x: x["step"].isNotNull() & (x["bad"] > 0))["step"]).alias("step"), "ks")
    tested = tried.select("_q_stratum", "_q_gains", "step", (binomial_tail(rejected(F.col("step")), F.col("good"), alpha) <= delta / F.col("strata")).alias("ok"))
    return (
        tested.groupBy("_q_stratum").agg(F.first("_q_gains").alias("_q_gains"), F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"), F.collect_set("step").alias("steps"))
        .select("_q_stratum", "_q_gains", F.array_max(F.filter("steps", lambda s: F.col("stop").isNull() | (s < F.col("stop")))).alias("_q_step")).where("_q_step IS NOT NULL")
    )


def judged(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``_q_base_failed`` and ``_q_kept`` to measured rows by the (stored) certified rules."""
    few = rules.limit(STRATA + 1).count() <= STRATA
    joined = df.join(F.broadcast(rules) if few else rules, "_q_stratum", "left")
    bad = F.coalesce(rejecting_step(all_steps(), F.col("_q_gains")) <= F.col("_q_step"), F.lit(False))
    return joined.withColumn("_q_base_failed", base_failed()).withColumn("_q_kept", ~F.col("_q_base_failed") & ~bad)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and verdict of every document: id, the five counts, ``base_failed``, ``kept``, ``stratum``.

    A null text has no words and fails the base rule; a null language is a stratum of its own (the
    empty string); a null id is judged like any other but carries no label; repeated rows each get a row;
    empty tables give empty or uncertified (lenient) results. Other columns are not read. The
    narrow table of counts is checkpointed so that texts are measured once.
    """
    source = docs.select(F.col(id_col).alias("_q_id"), stratum(lang_col).alias("_q_stratum"), F.col(text_col).alias("_q_text"))
    counts = durable(measure(source, "_q_text", ["_q_id", "_q_stratum"]))
    out = judged(counts, durable(certify(counts, labels)))
    return out.select(F.col("_q_id").alias(id_col), *(F.col(f"_q_{c}").alias(c) for c in COUNTS), F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_stratum").alias("stratum"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with exactly its columns (whatever their names).

    Edge cases as in :func:`quality_report`. The rules come from a first pass over the texts; the
    second pass judges each row where it is read, so texts are not shuffled.
    """
    source = docs.select(F.col(id_col).alias("_q_id"), stratum(lang_col).alias("_q_stratum"), F.col(text_col).alias("_q_text"))
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("_q_id")).distinct()
    if named.limit(LABELLED + 1).count() <= LABELLED:  # only labelled texts need be measured for the rules
        source = source.join(F.broadcast(named), "_q_id", "left_semi")
    rules = durable(certify(measure(source, "_q_text", ["_q_id", "_q_stratum"]), labels))
    rows = docs.select(whole_row(docs).alias("_q_row"), F.col(id_col).alias("_q_id"), stratum(lang_col).alias("_q_stratum"), F.col(text_col).alias("_q_text"))
    measured = measure(rows, "_q_text", ["_q_row", "_q_id", "_q_stratum"])
    return judged(measured, rules).where("_q_kept").select("_q_row.*")
