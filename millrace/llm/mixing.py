"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

A source with n of N documents and target weight w gets the mean repetition rate epochs * w * N / n
(weights normalised over the sources present). Each document draws its number of copies from the
Poisson distribution with that mean by inverting its distribution function at a number hashed from
seed and document id. Means above ``PART`` are drawn as a sum of equal independent parts, so that
the inverted table stays short for any mean. Copies are then shuffled globally by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, whole_row

REST = "*"
PART = 32
#: Entries of the inverted table: beyond them a Poisson with mean PART has less than 2 ** -52 left.
TABLE = 150
#: Bound of the number of weighted sources, and so of the broadcast table of rates.
MAX_SOURCES = 10_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_group(source_col: str, weights: dict[str, float]) -> Column:
    """The source if it has a weight of its own, else the rest group."""
    named = [s for s in weights if s != REST]
    return F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(REST) if named else F.lit(REST)


def repetition_rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """``(_m_group, n, rate, parts, cdf)``, at most len(weights) + 1 rows; counts cover all documents.

    Sources without a weight share that of "*" (0 if none is given). Counting is combined before the
    shuffle, so a source may hold any part of the rows.
    """
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} weighted sources")
    if any(not math.isfinite(w) or w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights are finite, not negative and not all 0")
    counts = durable(docs.groupBy(source_group(source_col, weights).alias("_m_group")).agg(F.count(F.lit(1)).alias("n")))  # read once, used for each source and for all
    wanted = F.create_map(*(x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))))
    weighed = counts.select("_m_group", "n", F.coalesce(F.try_element_at(wanted, F.col("_m_group")), F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    rates = weighed.join(F.broadcast(total)).select("_m_group", "n", F.coalesce(F.try_divide(F.lit(float(epochs)) * F.col("w") / F.col("all_w") * F.col("all_n"), F.col("n")), F.lit(0.0)).alias("rate"))
    parted = rates.select("*", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int").alias("parts"))
    mean = F.col("rate") / F.col("parts")
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            (a["c"] + a["p"] * mean / k).alias("c"),
            F.concat(a["cdf"], F.array(a["c"] + a["p"] * mean / k)).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return parted.select("*", table.alias("cdf"))


def poisson_copies(seed: int, id_col: Column) -> Column:
    """How many copies: for each part, the entries of the distribution function not above its number."""
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(seed, id_col, part))
    return F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))


def mix(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", copy_col: str | None = None) -> DataFrame:
    """Each row of ``docs`` as often as its draw says, in a global random order; exactly its columns.

    ``copy_col`` adds the number of the copy, from 1. A null source belongs to the rest group; a
    null id draws like an empty id; rows repeated under one id draw alike; an empty table gives an
    empty one; texts are carried as they are, null or long. Columns may have any names. A document
    goes to a partition by the hash of id, copy and content, so sources, however large, are spread evenly.
    """
    rates = repetition_rates(docs, weights, epochs, source_col)
    rows = docs.select(whole_row(docs).alias("_m_row"), F.col(id_col).alias("_m_id"), source_group(source_col, weights).alias("_m_group"))
    drawn = rows.join(F.broadcast(rates.select("_m_group", "parts", "cdf")), "_m_group").select("_m_row", "_m_id", poisson_copies(seed, F.col("_m_id")).alias("_m_n"))
    content = [F.col("_m_row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]  # rows without an id, or of one id, are spread too
    copies = drawn.where("_m_n > 0").select("_m_row", F.explode(F.sequence(F.lit(1), F.col("_m_n"))).alias("_m_copy"), "_m_id")
    keyed = copies.select("_m_row", "_m_copy", F.xxhash64(F.lit(seed), F.col("_m_id"), F.col("_m_copy"), *content).alias("_m_key"))
    shuffled = keyed.repartition("_m_key").sortWithinPartitions("_m_key")
    return shuffled.select("_m_row.*", *([F.col("_m_copy").alias(copy_col)] if copy_col else []))
