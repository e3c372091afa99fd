"""Sharding by minimax contiguous partition of atomic groups.

Rows of equal texts are one group and stay in one shard. Groups stand in the order of their texts'
MD5, so every shard is a mix, and a shard is a range of that order. The smallest capacity for which a
greedy pass needs no more than the given number of shards is found by binary search; a group larger than
the capacity has a shard of its own, so one huge group leaves the others near equal, and the largest shard
is as small as it can be.

The greedy pass needs the prefix sums of the group sizes. They stay in Spark: the driver sees a bounded
histogram of them, in which the pass is run once for the least and once for the most that each cut may
reach, and has only those buckets drawn finer in which a cut may fall, until every cut is one prefix sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, whole_row

LAW = "bytes"
#: Buckets of prefix sums that the driver sees at a time (16 bytes each, and a count).
BUCKETS = 1 << 16
#: First digits of the MD5 by which group sizes are summed up before they are added up: 4,096 runs.
RUN_DIGITS = 3


def text_key(text: Column) -> Column:
    """What the groups are ordered by; null and empty texts are equal."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def text_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none) and 1 for the row."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def group_ends(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(key, end, rows)``: each group with the sum of the sizes of all groups up to it, stored in the shared folder.

    Copies are summed up before the shuffle, so a group may hold any part of the rows.
    """
    groups = docs.groupBy(text_key(F.col(text_col)).alias("key")).agg(F.sum(text_size(F.col(text_col))).alias("size"), F.count(F.lit(1)).alias("rows"))
    groups = groups.select("key", F.left("key", F.lit(RUN_DIGITS)).alias("run"), "size", "rows")  # both uses read one shuffle
    runs = groups.groupBy("run").agg(F.sum("size").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))  # 16 ** RUN_DIGITS rows at most
    within = groups.withColumn("within", F.sum("size").over(Window.partitionBy("run").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    return durable(within.join(runs, "run").select("key", (F.coalesce("before", F.lit(0)) + F.col("within")).alias("end"), "rows"), few=True)


@dataclass(frozen=True)
class Ends:
    """Known prefix sums, sorted, with 0 at the front; ``open[i]``: others may lie between ``known[i]`` and the next."""

    known: np.ndarray
    open: np.ndarray

    @property
    def total(self) -> int:
        return int(self.known[-1])

    def reversed(self) -> Ends:
        return Ends(self.total - self.known[::-1], np.concatenate([self.open[:-1][::-1], [False]]))

    def gap(self, x: int) -> int:
        """The open gap that x is inside of, or -1."""
        i = int(np.searchsorted(self.known, x, "right")) - 1
        return i if self.open[i] and self.known[i] < x else -1

    def floor(self, x: int, most: bool) -> int:
        """The last prefix sum up to x; where it isn't known, the least or the most that it may be."""
        i = int(np.searchsorted(self.known, x, "right")) - 1
        return min(x, self.total) if most and self.gap(x) >= 0 else int(self.known[i])

    def jump(self, x: int, capacity: int, most: bool) -> int:
        """Where a shard that begins at x ends: as far as the capacity reaches, or behind one group larger than it."""
        if x >= self.total:
            return self.total
        end, i = self.floor(x + capacity, most), int(np.searchsorted(self.known, x, "right")) - 1
        if self.open[i]:  # groups that aren't known begin here; at most, one of them reaches to the next known end
            return max(end, int(self.known[i + 1])) if most else end
        return end if end > x else int(self.known[i + 1])

    def chain(self, capacity: int, shards: int, most: bool, start: int = 0) -> list[int]:
        """The ends of the greedy shards from ``start``."""
        at, out = start, []
        for _ in range(shards):
            at = self.jump(at, capacity, most)
            out.append(at)
        return out

    def least_capacity(self, shards: int, most: bool) -> int:
        """Binary search for the smallest capacity for which the greedy pass reaches the end."""
        low, high = 0, self.total
        while low < high:
            middle = (low + high) // 2
            if self.chain(middle, shards, most)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def runs_of_shards(ends: Ends, capacity: int, shards: int) -> list[tuple[int, int, int]]:
    """``(start, end, shards)`` of the runs between groups larger than the capacity, and of each of those (0 shards to cut).

    The greedy pass says how many shards a run needs; each one left goes where a shard would hold most.
    """
    at = start = number = 0
    runs: list[list[int]] = []
    while at < ends.total:
        end = ends.jump(at, capacity, most=False)
        if end - at > capacity:
            runs += [[start, at, number]] if number else []
            runs.append([at, end, 0])
            start, number = end, 0
        else:
            number += 1
        at = end
    runs += [[start, at, number]] if number else []
    for _ in range(shards - sum(max(1, n) for _, _, n in runs)):
        if cut := [r for r in runs if r[2]]:
            max(cut, key=lambda r: (r[1] - r[0]) / r[2])[2] += 1
    return [(a, b, n) for a, b, n in runs]


def even_cuts(ends: Ends, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Ends of the shards at that capacity: in each run as near an even share as the capacity and the shards behind allow.

    And the open gaps in which an end was looked up.
    """
    out, unsure = [], set()
    for start, stop, number in runs_of_shards(ends, capacity, shards):
        earliest = [ends.total - x for x in ends.reversed().chain(capacity, max(0, number - 1), most=False, start=ends.total - stop)][::-1]
        at = start
        for k in range(1, number):
            share = start + (stop - start) * k // number
            unsure |= {ends.gap(share), ends.gap(at + capacity)}
            below = ends.floor(share, most=False)
            above = int(ends.known[min(int(np.searchsorted(ends.known, share, "left")), len(ends.known) - 1)])
            near = below if share - below <= above - share else above
            at = min(stop, max(at, min(max(near, earliest[k - 1]), ends.jump(at, capacity, most=False))))
            out.append(at)
        out.append(stop)
    return [*out, *[ends.total] * (shards - len(out))], unsure - {-1}


def _wanted(ends: Ends, low: int, high: int, shards: int) -> set[int]:
    """Open gaps in which a cut of the greedy pass, from either end, may fall for a capacity from low to high."""
    spans = []
    for way, turned in ((ends, False), (ends.reversed(), True)):
        for a, b in zip(way.chain(low, shards, most=False), way.chain(high, shards, most=True), strict=True):
            spans.append((ends.total - b, ends.total - a) if turned else (a, b))
    found: set[int] = set()
    for a, b in spans:
        first, last = np.searchsorted(ends.known, [a, b], "right") - 1
        found |= {int(i) for i in range(int(first), int(last) + 1) if ends.open[i]}
    return found


def _drawn(rows: DataFrame, place: Column) -> list:
    """Least and greatest prefix sum, and their number, of each bucket."""
    return rows.groupBy(place.alias("p")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).collect()


def _merged(base: np.ndarray, buckets: list) -> Ends:
    """Known ends of before and of finer buckets; a bucket of more than two ends is open between its least and greatest."""
    low = np.array([r["a"] for r in buckets], np.int64)
    high = np.array([r["b"] for r in buckets], np.int64)
    more = np.array([r["n"] > 2 for r in buckets], bool)
    known = np.unique(np.concatenate([[0], base, low, high]))
    open_ = np.zeros(len(known), bool)
    open_[np.searchsorted(known, low[more])] = True
    return Ends(known, open_)


def find_cuts(groups: DataFrame, shards: int, buckets: int = BUCKETS) -> tuple[int, list[int]]:
    """The smallest capacity, and where the shards end, in prefix sums of ``groups(key, end)``.

    A round of work aggregates prefix sums to at most ``buckets`` rows; it takes as many as it needs digits
    of the total in that base, about four for 100 TB.
    """
    top = groups.agg(F.max("end")).first()[0]
    if not top:
        return 0, [0] * shards
    width = -(-top // buckets)
    bucket = F.expr(f"end div {width}")
    ends = _merged(np.zeros(0, np.int64), _drawn(groups, bucket))
    while True:
        low, high = ends.least_capacity(shards, most=True), ends.least_capacity(shards, most=False)
        wanted = _wanted(ends, low, high, shards)
        if not wanted:
            cuts, wanted = even_cuts(ends, high, shards)
        if not wanted:
            return high, cuts
        parts = max(2, buckets // len(wanted))
        spans = [(int(ends.known[i]), int(ends.known[i + 1])) for i in sorted(wanted)]
        finer = [(a // width, a, b, -(-(b - a) // parts)) for a, b in spans]
        frame = groups.sparkSession.createDataFrame(finer, "p long, lo long, hi long, w long")  # gaps of one bucket each, at most as many as there are buckets
        inside = groups.select("end", bucket.alias("p")).join(F.broadcast(frame), "p").where("end > lo AND end < hi")
        # gaps that were not asked for stay open; those drawn finer are open only within their new buckets
        stay = [{"a": int(ends.known[i]), "b": int(ends.known[i + 1]), "n": 3} for i in np.flatnonzero(ends.open) if int(i) not in wanted]
        ends = _merged(ends.known, [*stay, *_drawn(inside, F.expr("struct(lo, (end - lo) div w)"))])


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null under this law).

    The result has the columns of ``docs`` (those six names excepted, if it has them) and these. ``slot``
    numbers a shard's rows from 0 without gaps. Null and empty texts are equal and have size 1 and checksum
    0; all rows of equal texts, however many, are in one shard, and have slots spread by id; a null id is
    like any other; rows alike in id and text are interchangeable; an empty table gives an empty one. With
    fewer groups than shards some stay empty.

    Shuffled are one row for each task and distinct text, to sum up the groups, and then the rows once, to
    number them in as many runs as the root of their number, by id and text, so a group of copies that fills
    a shard is no hot key. Which shard a row is in follows from its own MD5 and the cuts: no text is joined.
    """
    groups = group_ends(docs, text_col)
    _, cuts = find_cuts(groups, shards, buckets)
    by_end = {r["end"]: r["key"] for r in groups.where(F.col("end").isin([int(x) for x in set(cuts)])).collect()}  # one for each shard at most
    last_keys = [by_end.get(x, "") for x in cuts[:-1]]  # no group: a shard that ends before the first
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    key = text_key(F.col(text_col))
    shard = F.lit(0)
    for last in last_keys:
        shard = shard + (F.col("_s_key") > F.lit(last)).cast("int")
    rows = docs.select(
        whole_row(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added))).alias("_s_row"), key.alias("_s_key"), text_size(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.col(id_col).alias("_s_id"),
    )
    runs = math.isqrt(groups.agg(F.sum("rows")).first()[0] or 0) + 1
    dealt = rows.select("*", shard.alias("shard"), F.pmod(F.xxhash64("_s_id", "_s_key"), F.lit(runs)).alias("_s_run"))
    before = dealt.groupBy("shard", "_s_run").agg(F.count(F.lit(1)).alias("n")).withColumn("_s_before", F.sum("n").over(Window.partitionBy("shard").orderBy("_s_run").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.row_number().over(Window.partitionBy("shard", "_s_run").orderBy("_s_id", "_s_key"))
    numbered = dealt.select("*", number.alias("_s_number")).join(before.select("shard", "_s_run", "_s_before"), ["shard", "_s_run"])
    return numbered.select(
        "_s_row.*", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.coalesce("_s_before", F.lit(0)) + F.col("_s_number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, folder: str, files_of_shard: int = 1) -> None:
    """A folder ``shard=k`` of Parquet files for each shard, rows in the order of their slots."""
    shards = sharded.agg(F.max("shard")).first()[0]
    ordered = sharded.repartitionByRange(max(1, ((shards or 0) + 1) * files_of_shard), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(folder)
