"""Relational patterns of the reports: pre-aggregated laterals, newest rows, top n, upserts, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.stored import durable


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def prefer(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each group, the first by ``order``."""
    return top_n(df, by, order, 1, "_rank").drop("_rank")


def with_stats(parent: DataFrame, child: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """A lateral aggregate: the child is aggregated by key first, then joined; parents without children stay."""
    return parent.join(child.groupBy(*keys).agg(*aggregates), keys, "left")


def latest(child: DataFrame, by: list[str], time: str, tie: str, *columns: str) -> DataFrame:
    """Columns of the newest child of each parent, without a sort."""
    return child.groupBy(*by).agg(*(F.max_by(c, F.struct(time, tie)).alias(c) for c in columns))


def recent_mean(df: DataFrame, by: list[str], time: str, tie: str, value: str, n: int = 20) -> DataFrame:
    """Mean of the n newest values of each group."""
    return top_n(df, by, [F.desc(time), F.desc(tie)], n).groupBy(*by).agg(F.avg(value).alias("recent_mean"), F.count(F.lit(1)).alias("n"))


def zero_filled(counts: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """All groups, those without rows with count 0."""
    return groups.join(counts, key, "left").withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("long")))


def upsert_actions(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, action)``: inserted, updated, skipped (equal, nulls too) or kept (only in ``old``)."""
    left = old.select(*keys, F.struct(*columns).alias("_old"), F.lit(True).alias("_in_old"))
    right = new.select(*keys, F.struct(*columns).alias("_new"), F.lit(True).alias("_in_new"))
    both = left.join(right, keys, "full_outer")
    action = F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "kept").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("updated")
    return both.select(*keys, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in it."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def neighbours(df: DataFrame, group: str, index: str, item: str, near: int = 2, far: int = 6) -> DataFrame:
    """Pairs at most ``far`` places apart within a group, by an equi-join on the shifted index."""
    shifts = F.array(*(F.lit(d) for d in range(-far, far + 1) if d))
    left = df.select(group, F.col(item).alias("source"), F.col(index).alias("_i"), F.explode(shifts).alias("_d")).withColumn("_j", F.col("_i") + F.col("_d"))
    right = df.select(group, F.col(item).alias("neighbour"), F.col(index).alias("_j"))
    joined = left.join(right, [group, "_j"])
    distance = F.abs("_d")
    return joined.select(group, "source", "neighbour", F.when(distance <= near, "near").otherwise("far").alias("kind"), distance.alias("distance"))


def linked(df: DataFrame, group: str, index: str | list[str], item: str) -> DataFrame:
    """Previous and next item within the group."""
    order = Window.partitionBy(group).orderBy(*([index] if isinstance(index, str) else index))
    return df.select("*", F.lag(item).over(order).alias("previous"), F.lead(item).over(order).alias("next"), (F.row_number().over(order) - 1).alias("place"))


def cooccurrence(df: DataFrame, unit: str, term: str, cap: float, base: float, step: float) -> DataFrame:
    """Directed relations of terms that share units, with a damped score and the number of shared units.

    Each unordered pair is made once per unit (a unit's terms are a set), counted with a combine
    before the shuffle, and turned round at the end.
    """
    terms = df.select(unit, term).distinct()
    left, right = terms.select(unit, F.col(term).alias("seed")), terms.select(unit, F.col(term).alias("related"))
    pairs = left.join(right, unit).where("seed < related").groupBy("seed", "related").agg(F.count(F.lit(1)).alias("shared"))
    scored = pairs.select("seed", "related", "shared", F.least(F.lit(cap), base + F.log1p("shared") * step).alias("score"))
    return both_ways(scored)


def running(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``place`` (from 0) and ``running`` sum of each row within its group, whatever part of the rows one group holds.

    Rows are dealt by range of group and order, and kept; a group that fills several ranges is summed up in each of
    them, and what its earlier ranges hold is added. Ties of the order keys have an arbitrary order.
    """
    dealt = durable(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))  # a row for each group and range
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    own = Window.partitionBy(group, "_part").orderBy(*order)
    placed = dealt.withColumns({"_k": F.row_number().over(own), "_v": F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    joined = placed.join(begins.withColumnsRenamed({group: "_g", "_part": "_p"}), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*rows.columns, (F.col("_n0") + F.col("_k") - 1).alias("place"), (F.col("_s0") + F.coalesce("_v", F.lit(0))).alias("running"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.withColumnsRenamed({"seed": "_s", "related": "seed"}).withColumnRenamed("_s", "related"))


def deleted(snapshot: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """What a cascading delete leaves."""
    return snapshot.join(doomed.select(*keys).distinct(), keys, "left_anti")


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; a parameter of None does not filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
