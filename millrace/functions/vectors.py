"""Vector functions: feature-hash embeddings, cosine, trigram sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let

DIMENSION = 384


def hash_halves(token: Column) -> tuple[Column, Column]:
    """High and low 32 bits of the first 8 bytes of the SHA-1."""
    digest = F.sha1(token.cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def hash_slot(token: Column, dim: int = DIMENSION, signed: bool = False) -> Column:
    """Slot of a token: its 64-bit hash modulo ``dim``, as an unsigned (or signed) number."""
    high, low = hash_halves(token)
    high = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high) if signed else high
    return F.pmod(F.pmod(high, F.lit(dim)) * ((1 << 32) % dim) + low, F.lit(dim)).cast("int")


def hash_sign(token: Column) -> Column:
    """1 for an even hash, -1 for an odd one."""
    return 1 - 2 * (hash_halves(token)[1] % 2)


def hash_embedding(df: DataFrame, id_col: str, tokens: Column, dim: int = DIMENSION) -> DataFrame:
    """Sparse unit vectors ``(id, slot, value)``: signed counts by slot, combined before the shuffle."""
    exploded = df.select(id_col, F.explode(tokens).alias("_t"))
    slots = exploded.groupBy(id_col, "_t").agg(F.count(F.lit(1)).alias("_n"))
    summed = slots.groupBy(id_col, hash_slot(F.col("_t"), dim).alias("slot")).agg(F.sum(F.col("_n") * hash_sign(F.col("_t"))).alias("_v")).where("_v <> 0")
    norms = summed.groupBy(id_col).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    return summed.join(norms, id_col).select(id_col, "slot", (F.col("_v") / F.col("_norm")).alias("value"))


def dense_hash_embedding(tokens: Column, dim: int = DIMENSION) -> Column:
    """The same vector as a dense array, inside the row (for the few rows of a candidate pool)."""
    slots = F.transform(tokens, lambda t: F.struct(hash_slot(t, dim).alias("s"), hash_sign(t).alias("v")))

    def vector(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(found, lambda x: x["s"] == k), F.lit(0).cast("long"), lambda a, x: a + x["v"]))

    def unit(raw: Column) -> Column:
        return let(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return let(let(slots, vector), unit)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine in double precision; 0 for different lengths or a zero vector."""
    value = F.try_divide(dot(left, right), F.sqrt(dot(left, left) * dot(right, right)))
    return F.when(F.size(left) == F.size(right), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def fit_dimension(vector: Column, dim: int = DIMENSION) -> Column:
    """Cut or padded with zeros to ``dim``."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def trigrams(text: Column) -> Column:
    """Distinct three-letter parts of the lower-case words, each with two blanks before and one after."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    parts = F.transform(found, lambda w: let(F.concat(F.lit("  "), w, F.lit(" ")), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))))
    return F.array_distinct(F.flatten(parts))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared by all trigrams of two texts (left and right are trigram arrays)."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0))
