"""Near-duplicate vectors by a random-projection tree forest.

Equal vectors of a label are reduced to one. Every tree splits space again and again along a random
direction (one for each level) at the median of a bounded sample, down to a depth at which leaves
have a fit size; a node that the sample hardly reaches is cut where its nearest well-filled ancestor
would be. A vector within a margin of a split goes to both sides (spill overlap): a pair at the wanted
cosine is parted at a split in about 0.5 % of cases, and several trees make that rarer still. The margin
is small, so that a level adds about an eighth to the rows. Within a leaf all vectors of one label are
compared exactly, in double precision and in blocks: a leaf too large for one task becomes tasks for
pairs of its blocks, and nothing is dropped. A pair that meets in several leaves counts in the least of
them. Tasks return counts and a spanning forest of the links; the forests are united into components.
Every dimension has a forest of its own; there is no size below which trees are not built.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, durable, least_roots, map_rows, tidy

THRESHOLD = 0.98
TREES = 3
#: Vectors of a dimension the splits are fitted on (bound of what reaches the driver), and how few leave a node to its ancestor.
SAMPLE, FEW = 8192, 16
#: Wanted rows of a leaf, the least and the greatest depth, and rows of a block of an oversize leaf.
LEAF_ROWS, MIN_DEPTH, MAX_DEPTH, BLOCK_ROWS = 1024, 3, 20, 4096
#: The margin in standard deviations of the projected difference of a pair at the threshold.
MARGIN = 0.75
PAIRS = 1 << 18


class Forest:
    """Directions by level and cuts by node of each tree over one dimension; codes of leaves are numbered over all trees."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, threshold: float, seed: int = 17) -> None:
        self.dim, self.depth, self.trees = sample.shape[1], depth, trees
        self.margin = MARGIN * math.sqrt(2 * (1 - threshold)) / math.sqrt(self.dim)
        self.directions: list[np.ndarray] = []
        self.cuts: list[list[np.ndarray]] = []
        for tree in range(trees):
            g = np.random.default_rng([seed, tree])
            direction = g.normal(size=(depth, self.dim))
            self.directions.append(direction / np.linalg.norm(direction, axis=1, keepdims=True))
            members = [np.arange(len(sample))]
            cuts = []
            for level in range(depth):
                side = sample @ self.directions[tree][level]
                cuts.append(np.array([np.median(side[m]) for m in members]))
                below = []
                for m, cut in zip(members, cuts[level], strict=True):
                    high = side[m] > cut
                    for part in (m[~high], m[high]):
                        below.append(part if len(part) >= FEW else m)
                members = below
            self.cuts.append(cuts)

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of every leaf of every row, sorted by row, then code."""
        rows, codes = [], []
        for tree in range(self.trees):
            row, place = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            sides = unit @ self.directions[tree].T
            for level, cut in enumerate(self.cuts[tree]):
                off = sides[row, level] - cut[place]
                left, right = off <= self.margin, off >= -self.margin
                row, place = np.concatenate([row[left], row[right]]), np.concatenate([2 * place[left], 2 * place[right] + 1])
            rows.append(row)
            codes.append(place + (tree << self.depth))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def unit_rows(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision, from single or double ones."""
    x = np.frombuffer(b"".join(raw), "<f4" if raw and len(raw[0]) == 4 * dim else "<f8").reshape(len(raw), dim).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepare(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(_e_id, _e_label, dim, digest, vec)``; digest and vec are null for vectors that cannot link.

    Vectors given in single precision are held so; all arithmetic is in double precision.
    """
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    named = vectors.select(F.col(id_col).cast("long").alias("_e_id"), F.col(label_col).alias("_e_label"), F.col(vec_col).cast("array<double>").alias("_e_vec"))

    def make():
        def work(row_id, label, vec):
            dims, digests, raws = [], [], []
            for i in range(len(vec)):
                value = vec[i]
                x = None
                if row_id[i].is_valid and label[i].is_valid and value.is_valid and value.values.null_count == 0:
                    x = np.asarray(value.values, dtype="<f8") + 0.0  # no negative zeros
                    if not len(x) or not np.isfinite(x).all() or not np.isfinite(norm := np.linalg.norm(x)) or norm == 0:
                        x = None
                raw = None if x is None else (x.astype("<f4") if single else x).tobytes()
                dims.append(None if x is None else len(x))
                digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
                raws.append(raw)
            return [row_id, label, dims, digests, raws]

        return work

    label_type = vectors.schema[label_col].dataType.simpleString()
    return map_rows(named, f"_e_id bigint, _e_label {label_type}, dim int, digest binary, vec binary", make, ["_e_id", "_e_label", "_e_vec"])


def _fit(distinct: DataFrame, trees: int, threshold: float) -> dict[int, Forest]:
    """A forest for each dimension, as deep as its largest label wants. Samples are drawn by hash, ``SAMPLE`` vectors or about so many."""
    sizes = distinct.groupBy("_e_label", "dim").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect()
    forests = {}
    rate = F.create_map(*(x for r in sizes for x in (F.lit(r["dim"]), F.lit(SAMPLE / r["n"])))) if sizes else None
    draw = F.pmod(F.xxhash64(F.lit("forest"), "digest"), F.lit(1 << 40)) / float(1 << 40)
    drawn: dict[int, list[bytes]] = {}
    for r in distinct.where(draw < rate[F.col("dim")]).select("dim", "vec").toLocalIterator() if sizes else ():
        drawn.setdefault(r["dim"], []).append(bytes(r["vec"]))
    for r in sizes:
        if r["dim"] in drawn:
            depth = min(MAX_DEPTH, max(MIN_DEPTH, math.ceil(math.log2(r["most"] / LEAF_ROWS))))
            forests[r["dim"]] = Forest(unit_rows(sorted(drawn[r["dim"]]), r["dim"]), depth, trees, threshold)
    return forests


def _route(distinct: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """``(_e_label, dim, code, codes, rep, n, vec)``: one row for each leaf of each vector."""
    sent = distinct.sparkSession.sparkContext.broadcast(forests)

    def make():
        def work(label, dim, rep, n, vec):
            dims = dim.to_numpy(zero_copy_only=False)
            picked, code, codes = [], [], []
            for d in np.unique(dims).tolist():
                fit = np.flatnonzero(dims == d)
                if d not in sent.value:  # no vector of it came into the sample: one leaf
                    row, leaf = np.arange(len(fit)), np.full(len(fit), -1)
                else:
                    row, leaf = sent.value[d].leaves(unit_rows([vec[int(i)].as_py() for i in fit], d))
                own = np.split(leaf, np.flatnonzero(np.diff(row)) + 1)
                picked += fit[row].tolist()
                code += leaf.tolist()
                codes += [own[r].tolist() for r in row]
            take = pa.array(picked, pa.int64())
            return [label.take(take), dim.take(take), code, codes, rep.take(take), n.take(take), vec.take(take)]

        return work

    label_type = distinct.schema["_e_label"].dataType.simpleString()
    return map_rows(distinct, f"_e_label {label_type}, dim int, code int, codes array<int>, rep bigint, n bigint, vec binary", make, ["_e_label", "dim", "rep", "n", "vec"])


def _met_before(x: np.ndarray, y: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the vectors of each pair of places share one of their (flat, by ``starts``) codes: sorted keys, no product of the lists."""
    if not len(x) or not len(codes):
        return np.zeros(len(x), bool)

    def keys(place: np.ndarray) -> np.ndarray:
        size = starts[place + 1] - starts[place]
        pair = np.repeat(np.arange(len(place)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[place], size)
        return pair * (1 << 32) + codes[at]

    both = np.intersect1d(keys(x), keys(y), assume_unique=True)
    met = np.zeros(len(x), bool)
    met[both >> 32] = True
    return met


def _compare(threshold: float):
    """Links of one task, (block i, block j) of one leaf: counts weighted by copies, and local roots."""

    def task(table: pa.Table) -> pa.Table:
        dim, code, low, high = (table.column(c)[0].as_py() for c in ("dim", "code", "low", "high"))
        rep, n, own = (table.column(c).to_numpy() for c in ("rep", "n", "own"))
        unit = unit_rows(table.column("vec").to_pylist(), dim)
        lists = [[c for c in x if c < code] for x in table.column("codes").to_pylist()]
        starts = np.cumsum([0, *map(len, lists)])
        earlier = np.array([c for x in lists for c in x], np.int64)
        left = np.flatnonzero(own == low)
        right = np.flatnonzero(own == high)
        count = np.zeros(len(rep), np.int64)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            lot = max(1, PAIRS // max(1, len(right)))
            for at in range(0, len(left), lot):
                part = left[at : at + lot]
                near = unit[part] @ unit[right].T >= threshold
                x, y = np.nonzero(near)
                x, y = part[x], right[y]
                keep = x < y if low == high else np.ones(len(x), bool)
                x, y = x[keep], y[keep]
                keep = ~_met_before(x, y, starts, earlier)
                x, y = x[keep], y[keep]
                np.add.at(count, x, n[y])
                np.add.at(count, y, n[x])
                yield x, y

        order = np.argsort(rep, kind="stable")  # places by id, so that the least place is the least id
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root = least_roots(len(rep), ((place[x], place[y]) for x, y in pairs()))
        roots = rep[order][root[place]]
        linked = count > 0
        tidy()
        return pa.table({"rep": rep[linked], "links": count[linked], "root": roots[linked]})

    return task


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row.

    Only vectors of one, non-null label link, by cosine >= ``threshold`` in double precision. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows
    without an id. Equal vectors link with each other. Ids are integers; rows repeated under one id
    count as vectors of their own. Vectors of different dimensions never link. Other columns are not read; an empty table gives an empty one.
    """
    rows = durable(_prepare(vectors, id_col, vec_col, label_col))
    able = rows.where("digest IS NOT NULL")
    distinct = durable(able.groupBy("_e_label", "dim", "digest").agg(F.min("_e_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")))
    routed = _route(distinct, _fit(distinct, trees, threshold))
    hot = routed.groupBy("_e_label", "dim", "code").count().where(F.col("count") > BLOCK_ROWS)
    hot = durable(hot.select("_e_label", "dim", "code", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")))
    sized = routed.withColumn("blocks", F.lit(1)) if hot.isEmpty() else routed.join(hot, ["_e_label", "dim", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    owned = sized.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = owned.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "_e_label", "dim", "code", "codes", "rep", "n", "vec", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    found = durable(dealt.groupBy("_e_label", "dim", "code", "low", "high").applyInArrow(_compare(threshold), "rep bigint, links bigint, root bigint"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    classes = distinct.select("_e_label", "dim", "digest", "rep", "n").join(counts, "rep", "left").join(parts, "rep", "left")
    classes = classes.select("_e_label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = able.join(classes, ["_e_label", "dim", "digest"]).select("_e_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select("_e_id", F.lit(0).cast("long").alias("n_links"), F.col("_e_id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("_e_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("_e_id"), F.lit(True)).alias("kept"))
