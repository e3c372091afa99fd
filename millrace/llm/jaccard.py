"""Near-duplicate texts at a similarity of word shingles (Jaccard, 0.8 or more), searched by SimHash.

Shingles are XXH64 (seed 42) of runs of ``width`` words. Texts of equal shingle sets are one node. A node
has a SimHash of 128 bits over its shingles (XXH64 and a mix of it) and lies below several upper nodes:

* two sets of similarity ``least`` or more share one of their first ``n - ceil(least * n) + 1`` shingles
  in any fixed order of all shingles, so each of these is an upper node. Shingles that are frequent in
  a sample go last; the sample decides the work, never the result.
* below an upper node the fingerprints are sorted by Gray rank and joined from the top of the hierarchy
  (:class:`millrace.llm.simhash.GrayIndex`); whole groups are pruned by their accumulated differences.
  ``RADIUS`` lies more than 5.5 standard deviations above what similarity 0.8 makes, so fewer than one
  pair in ten million at the threshold itself is lost; sets of less than ``SMALL_SET`` shingles, whose
  bits are not so regular, are not pruned.

What the search returns of an upper node is a spanning forest of its candidates, never the pairs. Its
components get the shingle sets of their members, each once, and all pairs of a component are
counted exactly by products of incidence blocks; only a forest of the links leaves the task. Components
larger than a block are first checked block by block with some common leaders; what that leaves
apart is searched again and checked in pairs of blocks, so that a large group costs a few checks a node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, durable, least_roots, map_rows, numeric_batches, starts_of, tidied, whole_groups
from millrace.llm.simhash import GrayIndex

WIDTH, LEAST = 5, 0.8
#: Differing bits of 128 up to which sets of ``SMALL_SET`` shingles or more are candidates.
RADIUS, SMALL_SET = 42, 32
#: Rows of the sample for the order of shingles, the count there from which one is frequent, and the frequent ones kept.
SAMPLE, OFTEN, FREQUENT = 8192, 6, 100_000
#: Upper nodes of so few members are compared pair by pair; in others each member is first compared with so many leaders.
PLAIN, LEADERS = 8, 4
#: Nodes and shingles of a block of one task, and the nodes that lead each block of a larger component.
BLOCK, BLOCK_SHINGLES, COMMON = 1024, 1 << 22, 32
#: Nodes of which an upper node has more are dealt out to pairs of parts.
PART = 1 << 15
#: Nodes up to which the wanted ones are broadcast.
FEW = 500_000
#: A shingle in more sets of a task than this is counted by a matrix product.
RARE = 6
EPS = 1e-9


def shingles(text: bytes, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Sorted distinct shingles of a UTF-8 text; a shorter text is one shingle, an empty one has none."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(seed)), np.uint64, len(words) - width + 1))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """128 bits as two unsigned words: a bit is 1 if set in over half of the shingles."""
    mixed = (found ^ found >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    out = []
    for h in (found, mixed ^ mixed >> np.uint64(32)):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            part = h[at : at + (1 << 14)]
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])
    return np.array(out, np.uint64)


def node_of(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), 42) if len(found) else 0


def nodes(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, least: float = LEAST, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``(id, fp, n, s0, s1, first)``: hash and size of the shingle set, its fingerprint, and (with ``frequent``) its upper nodes."""

    def make():
        def work(row_id, text):
            fp, sizes, prints, first = [], [], [], []
            for t in text.cast(pa.binary()).to_pylist():
                s = shingles(t or b"", width)
                fp.append(node_of(s))
                sizes.append(len(s))
                if frequent is None:
                    prints.append(np.zeros(2, np.uint64))
                    first.append(None)
                    continue
                prints.append(fingerprint(s))
                if len(frequent[0]) and len(s):
                    at = np.minimum(np.searchsorted(frequent[0], s), len(frequent[0]) - 1)
                    s = s[np.argsort(np.where(frequent[0][at] == s, frequent[1][at], 0), kind="stable")]
                first.append(s[: len(s) - math.ceil(least * len(s) - EPS) + 1].view(np.int64))
            sims = np.array(prints, np.uint64).reshape(len(fp), 2).view(np.int64)
            return [row_id, np.array(fp, np.uint64).view(np.int64), sizes, np.ascontiguousarray(sims[:, 0]), np.ascontiguousarray(sims[:, 1]), first]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, f"`{id_col}` {kind}, fp bigint, n int, s0 bigint, s1 bigint, first array<bigint>", make, [id_col, text_col])


def frequent_shingles(docs: DataFrame, text_col: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many texts of a sample share, and their counts (at most ``FREQUENT``)."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).select(F.xxhash64(text_col).alias("key"), text_col).dropDuplicates(["key"])
    make = lambda: lambda text: [[shingles(t or b"", width).view(np.int64) for t in text.cast(pa.binary()).to_pylist()]]
    counted = map_rows(some, "found array<bigint>", make, [text_col]).select(F.explode("found").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    found = counted.where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    h, c = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["c"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _shared(rows: DataFrame) -> DataFrame:
    """``(h, node, m)``: the ``m`` members of each upper node that has two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            h, node = (table.column(i).to_numpy() for i in range(2))
            cut = starts_of(h)
            m = np.repeat(np.diff(cut), np.diff(cut)).astype(np.int32)
            many = m > 1
            yield pa.RecordBatch.from_arrays([pa.array(h[many]), pa.array(node[many]), pa.array(m[many])], names=["h", "node", "m"])

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(tidied(run), "h bigint, node bigint, m int")


def _near(sim: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the pairs of places can have the similarity, by size and fingerprint."""
    low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    apart = np.bitwise_count(sim[x] ^ sim[y]).sum(axis=1, dtype=np.int64)
    return (low >= least * high - EPS) & ((apart <= RADIUS) | (low < SMALL_SET))


def candidate_roots(sim: np.ndarray, n: np.ndarray, component: np.ndarray, least: float) -> np.ndarray:
    """For each member of an upper node the least place that candidates of different components reach."""
    size = len(n)
    every = np.arange(size)

    def tried() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(min(LEADERS, size)):  # spread over the Gray order
            yield every, np.full(size, order[k * size // LEADERS])
        yield order[1:], order[:-1]

    def real(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, y in pairs:
            ok = component[x] != component[y]
            x, y = x[ok], y[ok]
            ok = _near(sim, n, x, y, least)
            yield x[ok], y[ok]

    index = GrayIndex(sim)
    order = index.order
    root = least_roots(size, real(tried()))
    if (root == root[0]).all():
        return root
    small = np.flatnonzero(n < SMALL_SET)
    beside = ((np.repeat(small[k : k + 64], size), np.tile(every, len(small[k : k + 64]))) for k in range(0, len(small), 64))
    return least_roots(size, real(pair for pairs in (index.links(RADIUS, root), beside) for pair in pairs), root)


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """Forest edges ``(a, b)`` of the candidates below each upper node, from ``rows(h, node, m, n, s0, s1, component)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            h, low, high, node, n, s0, s1, component = (table.column(i).to_numpy() for i in range(8))
            sim = np.stack([s0.view(np.uint64), s1.view(np.uint64)], axis=1)
            cut = starts_of(h, low, high)
            sizes = np.diff(cut)
            a, b = [], []
            for size in range(2, PLAIN + 1):
                own = cut[:-1][sizes == size]
                for i in range(size):
                    for j in range(i + 1, size):
                        x, y = own + i, own + j
                        ok = component[x] != component[y]
                        x, y = x[ok], y[ok]
                        ok = _near(sim, n, x, y, least)
                        a.append(node[x[ok]])
                        b.append(node[y[ok]])
            for s, e in zip(cut[:-1][sizes > PLAIN], cut[1:][sizes > PLAIN], strict=True):
                if (component[s:e] != component[s]).any():
                    root = candidate_roots(sim[s:e], n[s:e], component[s:e], least)
                    moved = root != np.arange(e - s)
                    a.append(node[s:e][moved])
                    b.append(node[s:e][root[moved]])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    parts = F.ceil(F.col("m") / PART).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.select("h", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "n", "s0", "s1", "component")
    return dealt.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high").mapInArrow(tidied(run), "a bigint, b bigint")


def linked_roots(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each shingle set the least place reachable by pairs of the similarity, all pairs counted exactly."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, count = owner[order], count
    begin = np.cumsum(count) - count
    both = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(2, RARE + 1):  # rare shingles pair by pair
        at = begin[count == c]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(both, (owner[at + i], owner[at + j]), 1)
    both += both.T
    often = np.flatnonzero(count > RARE)
    for k in range(0, len(often), 4096):
        part = often[k : k + 4096]
        block = np.zeros((len(sets), len(part)), np.float32)
        size = count[part]
        at = np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        block[owner[at], np.repeat(np.arange(len(part)), size)] = 1
        both += block @ block.T
    near = both >= least * (n[:, None] + n - both) - EPS
    return least_roots(len(sets), iter([np.nonzero(np.triu(near, 1))]))


def links(asked: DataFrame, least: float) -> DataFrame:
    """Forest edges ``(a, b)`` of the true links within each group of ``asked(component, low, high, node, set)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            component, low, high, node = (table.column(i).to_numpy() for i in range(4))
            held = table.column("set").combine_chunks()
            flat, ends = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy()
            a, b = [], []
            cut = starts_of(component, low, high)
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                own, at = np.unique(node[s:e], return_index=True)
                root = linked_roots([flat[ends[s + i] : ends[s + i + 1]] for i in at], least)
                moved = root != np.arange(len(own))
                a.append(own[moved])
                b.append(own[root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    return asked.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high").mapInArrow(tidied(run), "a bigint, b bigint")


def _with_sets(texts: DataFrame, places: DataFrame, distinct: DataFrame, width: int) -> DataFrame:
    """``places(node, ...)`` with the column ``set``; each node's set is made from one text (that of its least id)."""

    def make():
        def work(text):
            found = [shingles(t or b"", width) for t in text.cast(pa.binary()).to_pylist()]
            return [np.array([node_of(s) for s in found], np.uint64).view(np.int64), [s.view(np.int64) for s in found]]

        return work

    wanted = durable(places.select("node").distinct().join(distinct.select(F.col("fp").alias("node"), "least"), "node"), few=True)
    few = wanted.limit(FEW + 1).count() <= FEW
    small = lambda df: F.broadcast(df) if few else df
    rows = texts.join(small(wanted.where("least IS NOT NULL").select(F.col("least").alias("_s_id")).distinct()), "_s_id", "left_semi")
    if not wanted.where("least IS NULL").isEmpty():
        rows = rows.union(texts.where("_s_id IS NULL"))
    made = map_rows(rows, "node bigint, set array<bigint>", make, ["_s_text"])
    once = made.join(small(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"])
    return once.join(places, "node")


def _parted(members: DataFrame) -> DataFrame:
    """``(node, component, blocks, led)`` of ``members(node, n, component)``: the blocks of its component, and whether the node leads each of them."""
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    sized = sized.select("component", "size", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    drawn = F.pmod(F.xxhash64(F.lit("lead"), "node"), F.lit(1 << 30)) / float(1 << 30)
    return members.join(sized, "component").select("node", "component", "blocks", ((F.col("blocks") > 1) & (drawn < COMMON / F.col("size"))).alias("led"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``(id, component_id, group, fp)`` of every row: components of the pairs of similarity ``least`` or more.

    ``fp`` is the hash of the shingle set, ``group`` the least one of the component, ``component_id`` the
    least id (null if no row of the component has one). Null and empty texts are one node; ids are
    integers. Sets are made for candidates only, and shuffled once.
    """
    named = docs.select(F.col(id_col).cast("long").alias("_s_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_s_text"))
    own = durable(nodes(named, "_s_id", "_s_text", width, least, frequent_shingles(named, "_s_text", width)))
    alike = own.groupBy("fp").agg(F.min("_s_id").alias("least"), F.first("n").alias("n"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.first("first").alias("first"))
    distinct = durable(own.groupBy("fp").agg(F.min("_s_id").alias("least"), F.max(F.struct("n", "s0", "s1")).alias("x")).select("fp", "least", "x.*"), few=True)
    with numeric_batches(docs.sparkSession):
        shared = durable(_shared(alike.select(F.explode("first").alias("h"), F.col("fp").alias("node"))), few=True)
    known = distinct.select(F.col("fp").alias("node"), "n", "s0", "s1")

    rows = shared.join(known, "node").withColumn("component", F.col("node"))
    members = components(candidates(rows, least)).join(known.select("node", "n"), "node")
    parted = durable(_parted(members), few=True)
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    places = parted.select("node", "component", F.explode(F.when(F.col("led"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))).alias("low")).withColumn("high", F.col("low"))
    found = durable(links(_with_sets(named, places, distinct, width).select("component", "low", "high", "node", "set"), least), few=True)
    reached = components(found)

    large = parted.where("blocks > 1").select("node", F.col("component").alias("around"))
    if not large.isEmpty():  # pairs of different blocks that are not connected yet
        state = durable(large.join(reached, "node", "left").select("node", "around", F.coalesce("component", "node").alias("component")), few=True)
        open_ = state.groupBy("around").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("around")
        rest = state.join(open_, "around").select("node", "component")
        again = components(candidates(shared.join(known, "node").join(rest, "node"), least)).join(known.select("node", "n"), "node")
        pairs = _parted(again).withColumn("own", block).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("own <> other OR blocks = 1")
        pairs = pairs.select("node", "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        more = durable(links(_with_sets(named, durable(pairs, few=True), distinct, width).select("component", "low", "high", "node", "set"), least), few=True)
        reached = components(found.union(more))

    grouped = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    classes = grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "group", "component_id")
    return own.join(classes, "fp").select(F.col("_s_id").alias(id_col), "component_id", "group", "fp")
