"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 bits over XXH64 (seed 42) of word shingles. Equal fingerprints are reduced to one
before anything is searched. The index then has two storeys:

* upper nodes are masked bit patterns shared by their members. Cut into three pieces, two
  fingerprints at distance <= 2 agree on one; cut the rest into three again, and they agree on one of
  those. So each of nine masks (a piece and a piece of the rest, 35 or 36 bits) makes an upper node of
  the fingerprints that share its bits, and every link lies below one of them: the search is exact.
* below an upper node, fingerprints are sorted by Gray rank, and runs of 1, 2, 4, ... neighbours form
  a hierarchy whose nodes hold the bits all their members share. The node is joined with itself from
  the top; differences accumulate from level to level as more bits are shared, and a pair of nodes
  that has come to more than 2 is pruned with all below it.

Upper nodes are spread over tasks by their pattern, a hot one by pairs of its parts; within a node only
a spanning forest of the links is returned, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, durable, least_roots, map_rows, starts_of, tidied, whole_groups, whole_row

RADIUS = 2
#: The three pieces of a fingerprint as (first bit, bits).
PIECES = ((0, 22), (22, 21), (43, 21))
#: Pairs of index nodes looked at together; more are taken one lot after the other.
LOT = 1 << 15
#: Members of an upper node of which more are dealt out in parts, and hot nodes up to which they are broadcast.
PART, FEW = 1 << 18, 100_000


def masks() -> list[int]:
    """The nine masks of the upper nodes, as unsigned numbers."""
    found = []
    for first, size in PIECES:
        own = ((1 << size) - 1) << first
        rest = [b for b in range(64) if not own >> b & 1]
        step = -(-len(rest) // 3)
        found += [own | sum(1 << b for b in rest[k : k + step]) for k in range(0, len(rest), step)]
    return found


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingle_fingerprint(text: bytes, width: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """Fingerprint of a UTF-8 text, from whole-text shingles taken ``block`` at a time."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, block):
        part = words[at : at + block + width - 1]
        size = len(part) - width + 1
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp long)`` of every row, in one narrow stage; ``fp`` holds the 64 bits as a signed number."""

    def make():
        def work(row_id, text):
            raw = text.cast(pa.binary()).to_pylist()
            return [row_id, np.array([shingle_fingerprint(t or b"", width) for t in raw], np.uint64).view(np.int64)]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, f"`{id_col}` {kind}, fp bigint", make, [id_col, text_col])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence; codes of several words have the leading one first."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    if rank.ndim == 2:
        for w in range(1, rank.shape[1]):
            rank[:, w] ^= np.where(rank[:, w - 1] & np.uint64(1), ~np.uint64(0), np.uint64(0))
    return rank


class GrayIndex:
    """The hierarchy over the fingerprints below one upper node: (rows,) or (rows, words) of unsigned words.

    A node of the hierarchy stands for a run of neighbours in Gray order and holds the bits on which
    all of them agree. Two nodes joined at one level bring the differences found so far, and the
    bits these were found on; only bits that their agreement decides anew are added.
    """

    def __init__(self, codes: np.ndarray) -> None:
        codes = codes.reshape(len(codes), -1)
        rank = gray_rank(codes)
        self.order = np.lexsort(rank.T[::-1])
        low = high = codes[self.order]
        self.value, self.fixed = [low], [np.full_like(low, ~np.uint64(0))]
        while len(low) > 1:
            odd = len(low) % 2
            a, b = low[: len(low) - odd], high[: len(high) - odd]
            low = np.concatenate([a[::2] & a[1::2], low[len(low) - odd :]])
            high = np.concatenate([b[::2] | b[1::2], high[len(high) - odd :]])
            self.value.append(low)
            self.fixed.append(low | ~high)

    def links(self, radius: int = RADIUS, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (in the given order of codes) at distance <= ``radius``, lot by lot; pairs of one ``root`` are left out."""
        words = self.value[0].shape[1]
        lots = [(len(self.value) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, words), np.uint64))]
        while lots:
            level, x, y, apart, decided = lots.pop()
            value, fixed = self.value[level], self.fixed[level]
            both = fixed[x] & fixed[y]
            apart = apart + np.bitwise_count((value[x] ^ value[y]) & both & ~decided).sum(axis=1, dtype=np.int64)
            near = apart <= radius
            x, y, apart, decided = x[near], y[near], apart[near], both[near]
            if not len(x):
                continue
            if level == 0:
                x, y = self.order[x[x != y]], self.order[y[x != y]]
                if root is not None:
                    new = root[x] != root[y]
                    x, y = x[new], y[new]
                yield x, y
                continue
            below = len(self.value[level - 1])
            left = np.concatenate([2 * x, 2 * x, 2 * x + 1, 2 * x + 1])
            right = np.concatenate([2 * y, 2 * y + 1, 2 * y, 2 * y + 1])
            apart, decided = np.tile(apart, 4), np.tile(decided, (4, 1))
            real = (left <= right) & (right < below) & (left < below)
            left, right, apart, decided = left[real], right[real], apart[real], decided[real]
            lots += [(level - 1, left[k : k + LOT], right[k : k + LOT], apart[k : k + LOT], decided[k : k + LOT]) for k in range(0, len(left), LOT)]


def _node_edges(codes: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least linked node) among the members of one upper node."""
    if len(codes) == 2:  # a hierarchy of one level
        near = int(codes[0] ^ codes[1]).bit_count() <= RADIUS
        return (nodes[1:], nodes[:1]) if near else (nodes[:0], nodes[:0])
    root = least_roots(len(codes), GrayIndex(codes).links())
    moved = root != np.arange(len(codes))
    return nodes[moved], nodes[root[moved]]


def _dealt(rows: DataFrame) -> DataFrame:
    """``(mask, pattern, low, high, fp, node)``: members of upper nodes, those of hot ones in every pair of their parts.

    Upper nodes with more than ``PART`` members by a sample of every 16th fingerprint are hot; the
    sample decides how the work is dealt out, never the result.
    """
    counted = rows.where(F.pmod(F.xxhash64("fp"), F.lit(16)) == 0).groupBy("mask", "pattern").count().where(F.col("count") * 16 > PART)
    hot = durable(counted.select("mask", "pattern", F.ceil(F.col("count") * 16 / PART).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows.select("mask", "pattern", F.lit(0).alias("low"), F.lit(0).alias("high"), "fp", "node")
    few = hot.limit(FEW + 1).count() <= FEW
    joined = rows.join(F.broadcast(hot) if few else hot, ["mask", "pattern"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    joined = joined.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return joined.select("mask", "pattern", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "node")


def search(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` among the nodes of distinct ``(fp, node)``: a spanning forest below each upper node."""
    rows = distinct.select("fp", "node", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks()))).alias("mask", "pattern"))
    keys = ["mask", "pattern", "low", "high"]
    dealt = _dealt(rows).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 4):
            *key, fp, node = (table.column(i).to_numpy() for i in range(6))
            fp = fp.view(np.uint64)
            cut = starts_of(*key)
            many = np.diff(cut) > 1
            found = [_node_edges(fp[s:e], node[s:e]) for s, e in zip(cut[:-1][many], cut[1:][many], strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

    return dealt.select(*keys, "fp", "node").mapInArrow(tidied(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fingerprint, component_id, group, fp)`` of every row of ``docs``.

    ``fp`` is the fingerprint as a signed number, ``group`` the least fingerprint of the component.
    ``component_id`` is the least id reachable by links, the row's own included. Null and empty texts
    have fingerprint zero and are linked like any other; ids are integers; rows with a null id get
    the component of their fingerprint (null if no row of the component has an id); repeated rows
    each give a row; an empty table gives an empty one. Other columns are not read. Texts are read
    once; what is kept and shuffled afterwards is ids and fingerprints, equal fingerprints combined
    before the shuffle.
    """
    named = docs.select(F.col(id_col).cast("long").alias("_s_id"), F.col(text_col).alias("_s_text"))
    own = durable(fingerprints(named, "_s_id", "_s_text", width))
    distinct = durable(own.groupBy("fp").agg(F.min("_s_id").alias("least")))
    reached = components(search(distinct.select("fp", F.col("fp").alias("node"))))
    grouped = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    classes = grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "group", "component_id")
    out = own.join(classes, "fp")
    return out.select(F.col("_s_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group", "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, least: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component, with its columns: the row of the least id, then of the least node and text.

    With ``least`` the components are those of an exact Jaccard similarity of ``width``-word shingles of
    at least that (:mod:`millrace.llm.jaccard`), else of fingerprints within ``RADIUS``. Rows are told apart
    by component, id and text: unlike texts under one id all stay, and a component without any id keeps the
    row of its least node. Rows alike in id and text are told apart by the hash of their other columns.
    Edge cases otherwise as in :func:`near_duplicates`.

    Ids that name one row find it by the id alone. Only rows of repeated ids, or of none, are hashed again
    to find the one that stays.
    """
    from millrace.llm import jaccard

    near, prints = (near_duplicates, fingerprints) if least is None else (partial(jaccard.near_duplicates, least=least), jaccard.nodes)
    classes = durable(near(docs, id_col, text_col, width).select(F.col(id_col).alias("_s_id"), "group", "fp"), few=True)
    rows = docs.select(whole_row(docs).alias("_s_row"), F.col(id_col).cast("long").alias("_s_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_s_text"))
    chosen = classes.groupBy("group").agg(F.min(F.struct(F.col("_s_id").isNull().alias("nameless"), "_s_id", "fp")).alias("c")).select("c._s_id", "c.fp")
    counts = classes.where("_s_id IS NOT NULL").groupBy("_s_id").agg(F.count(F.lit(1)).alias("n"))
    marked = chosen.join(counts, "_s_id", "left")  # of ids alone: made again rather than kept
    firsts = rows.join(marked.where("n = 1").select("_s_id"), "_s_id").select("_s_row.*")
    odd = marked.where("n IS NULL OR n > 1").select(F.col("_s_id").alias("_s_odd"), F.col("fp").alias("_s_fp"))
    if odd.isEmpty():
        return firsts
    same = F.col("_s_id").eqNullSafe(F.col("_s_odd"))
    some = rows.join(odd.select("_s_odd").distinct(), same, "left_semi")
    texts = some.select("_s_id", "_s_text").distinct()
    nodes = prints(texts.select("_s_text", F.col("_s_text").alias("_s_t")).distinct(), "_s_text", "_s_t", width).select("_s_text", "fp")
    stay = texts.join(nodes, "_s_text").join(odd, same & (F.col("fp") == F.col("_s_fp"))).groupBy(F.col("_s_odd"), "fp").agg(F.min("_s_text").alias("_s_least"))
    kept = some.join(stay, same & (F.col("_s_text") == F.col("_s_least")), "left_semi")
    content = [F.col("_s_row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return firsts.union(kept.groupBy("_s_id", "_s_text").agg(F.min_by("_s_row", F.xxhash64(*content)).alias("_s_row")).select("_s_row.*"))
