"""Anchor relations from several sources, kept in a versioned table: a build closes what it does not find again.

An edge is named by version, seed, related term, type and source. A build first closes the active edges of
its version and types, then writes the best edges of each seed over them, so that building twice from the
same rows changes nothing but the run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.stored import durable

KEY = ("version", "seed", "related", "kind", "source")
#: Cap, base and step of a damped count, fixed for each kind of co-occurrence.
BY_QUERY, BY_CHUNK = (0.95, 0.62, 0.07), (0.90, 0.55, 0.06)
FLOOR, PER_SEED = 0.55, 80
#: Terms of a unit that are sent in a row at most, terms of a block, links for each part in which a block is counted, and terms that are sent to every task at most.
HOT, BLOCK, PART_LINKS, FEW_TERMS = 1024, 1024, 1 << 20, 1 << 19
#: Links that a task groups at once (those of one unit at least), terms of units that it holds, and pairs that it counts at once (those of one term at least).
PIECE, ENTRIES, VISITS = 1 << 18, 1 << 25, 1 << 17
#: Stands for no method.
NONE = np.iinfo(np.int64).max
COLUMNS = (*KEY, "score", "evidence", "method", "run", "status")


@dataclass(frozen=True)
class Source:
    """Scored edges ``(seed, related, score, evidence, method)`` of one kind."""

    kind: str
    source: str
    edges: DataFrame


def active_terms(terms: DataFrame) -> DataFrame:
    return terms.where("active").select("term_id", "term_type")


def alias_edges(mappings: DataFrame, terms: DataFrame) -> DataFrame:
    """Both ways between a canonical term and its approved alias terms: the greatest confidence (1 if null), and how many mappings say so."""
    able = active_terms(terms).select("term_id")
    pairs = mappings.where("alias_term IS NOT NULL AND alias_term <> term").select("mapping_id", F.col("term").alias("seed"), F.col("alias_term").alias("related"), F.coalesce("confidence", F.lit(1.0)).alias("c"))
    pairs = pairs.join(able.select(F.col("term_id").alias("seed")), "seed", "left_semi").join(able.select(F.col("term_id").alias("related")), "related", "left_semi")
    one_way = pairs.groupBy("seed", "related").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("c"))).alias("score"), F.count_distinct("mapping_id").alias("evidence"))
    both = one_way.unionByName(one_way.withColumnsRenamed({"seed": "_s", "related": "seed"}).withColumnRenamed("_s", "related"))
    best = both.groupBy("seed", "related").agg(F.max(F.struct("score", "evidence")).alias("x"))  # a pair that is mapped both ways is one edge
    return best.select("seed", "related", F.round("x.score", 9).alias("score"), "x.evidence", F.lit(None).cast("string").alias("method"))


def _codes(links: DataFrame, terms: DataFrame) -> tuple[DataFrame, bool]:
    """``(term_id, code, parts)`` of the active terms that have links, and whether they are few. Codes follow the order of the terms, twice their place, odd for a concept (a
    term of which every active row is one). A block of ``BLOCK`` terms is counted in so many parts, one for each ``PART_LINKS`` of its links."""
    able = active_terms(terms).groupBy("term_id").agg(F.min((F.col("term_type") == "concept").cast("int")).alias("concept"))
    able = able.join(links.groupBy("term_id").agg(F.count(F.lit(1)).alias("n")), "term_id")
    ordered = durable(able.repartitionByRange("term_id").sortWithinPartitions("term_id").withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.select("*", F.expr("shiftrightunsigned(at, 33)").alias("_p"))
    before = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("before"))  # a row for each partition
    placed = ordered.join(F.broadcast(before), "_p").select("term_id", "n", (2 * (F.col("before") + F.expr(f"at & {(1 << 33) - 1}")) + F.coalesce("concept", F.lit(0))).cast("int").alias("code"))
    placed = placed.withColumn("block", F.expr(f"code div {2 * BLOCK}"))
    parts = placed.groupBy("block").agg(F.ceil(F.sum("n") / PART_LINKS).cast("int").alias("parts"))
    codes = durable(placed.join(parts, "block").select("term_id", "code", "parts"))
    return codes, codes.limit(FEW_TERMS + 1).count() <= FEW_TERMS


def shared_edges(links: DataFrame, terms: DataFrame, unit: str, shape: tuple[float, float, float], floor: float | None = None, most: int | None = None) -> DataFrame:
    """Terms that share units (queries or chunks): ``links(unit, term, method)``. Two concepts are never related, a null unit is none.

    The method is that of the shared units, "mixed" if they have several, null if they have none. With ``floor`` and ``most`` edges may be left
    out that :func:`best_of_each` would not keep by them. No pair is shuffled: the terms of a unit are sent once to each block of terms that it has some
    of, and a task counts the pairs of a block's terms, some of them at a time.
    """
    cap, base, step = shape
    h = F.xxhash64("method")
    names = links.where("method IS NOT NULL").select(h.alias("_h"), "method").distinct()  # methods are named by the build: a few
    typed = links.where(F.col(unit).isNotNull()).select(F.col(unit).alias("u"), F.col("term").alias("term_id"), F.when(F.col("method").isNotNull(), h).alias("_h"))
    codes, few = _codes(typed, terms)
    sent = F.broadcast(codes) if few else codes
    lines = typed.join(sent, "term_id").select("u", "code", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), "parts", "_h")
    rows = lines.repartition("u").sortWithinPartitions("u").mapInArrow(_units, "block int, part int, parts int, own binary, lo binary, hi binary, t binary")
    least = 1 if floor is None else max(1, math.ceil(math.exp(min(50.0, (floor - 1e-6 - base) / step)) - 1 - 1e-6))

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, key[2].as_py() == 1, least, most)

    counted = rows.groupBy("block", "part", "parts").applyInArrow(count, "a int, b int, evidence long, lo long, hi long")
    by = counted.groupBy("a", "b").agg(F.sum("evidence").alias("evidence"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    of = lambda name, code: sent.select(F.col("term_id").alias(name), F.col("code").alias(code))
    edges = by.join(of("seed", "a"), "a").join(of("related", "b"), "b").join(F.broadcast(names), F.col("lo") == F.col("_h"), "left")
    method = F.when(F.col("lo") != F.col("hi"), "mixed").otherwise(F.col("method"))
    return edges.select("seed", "related", F.round(F.least(F.lit(cap), base + F.log(F.col("evidence") + 1) * step), 9).alias("score"), "evidence", method.alias("method"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(u, code, part, parts, _h)`` in the order of units to rows ``(block, part, parts, own, lo, hi, t)``: a block's own terms in a unit with the least and
    greatest of their methods (null if none has one), and at most ``HOT`` of the unit's terms. All are numbers laid side by side."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < PIECE:
            continue
        piece = pa.Table.from_batches(held).combine_chunks()
        new = np.flatnonzero(_changes(piece["u"]))
        if len(new):  # the last unit may go on
            yield from _rows_of(piece.slice(0, int(new[-1]) + 1))
            piece = piece.slice(int(new[-1]) + 1)
        held, n = piece.to_batches(), 0
    if held:
        yield from _rows_of(pa.Table.from_batches(held).combine_chunks())


def _changes(x: pa.ChunkedArray) -> np.ndarray:
    """Whether the next value is another one, for all values but the last."""
    x = x.combine_chunks()
    return pc.not_equal(x.slice(1), x.slice(0, max(0, len(x) - 1))).to_numpy(zero_copy_only=False)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start``, ``start + 1``, ... of each span, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _binary(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes * x.itemsize)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _rows_of(links: pa.Table) -> Iterator[pa.RecordBatch]:
    if not links.num_rows:
        return
    unit = np.concatenate([[0], np.cumsum(_changes(links["u"]))])
    links = links.select(["code", "part", "parts", "_h"]).take(np.lexsort((links["code"].to_numpy(), unit)))
    code, part, parts = (links[c].to_numpy() for c in ("code", "part", "parts"))
    once = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (code[1:] != code[:-1])]))
    named = links["_h"].null_count < len(code)
    if named:
        lo, hi = np.minimum.reduceat(links["_h"].fill_null(NONE).to_numpy(), once), np.maximum.reduceat(links["_h"].fill_null(-NONE).to_numpy(), once)
    unit, code, part, parts = unit[once], code[once], part[once], parts[once]
    block = code // (2 * BLOCK)
    size = np.bincount(unit)
    start = np.cumsum(size) - size
    new = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (block[1:] != block[:-1])]))
    n_own = np.diff(np.append(new, len(code)))
    several = size[unit[new]] > 1
    new, n_own = new[several], n_own[several]
    cuts = (size[unit[new]] + HOT - 1) // HOT
    new, n_own, i = np.repeat(new, cuts), np.repeat(n_own, cuts), _spans(np.zeros(len(cuts), np.int64), cuts)
    first = start[unit[new]] + i * HOT
    n_all = np.minimum(HOT, size[unit[new]] - i * HOT)
    before = np.concatenate([[0], np.cumsum(n_own + n_all)])
    at = 0
    while at < len(new):
        end = max(at + 1, int(np.searchsorted(before, before[at] + 4 * PIECE, "right")) - 1)
        mine, every, o = _spans(new[at:end], n_own[at:end]), _spans(first[at:end], n_all[at:end]), n_own[at:end]
        methods = [_binary(x[mine], o) if named else pa.nulls(end - at, pa.binary()) for x in ((lo, hi) if named else (None, None))]
        numbers = [pa.array(x[new[at:end]], pa.int32()) for x in (block, part, parts)]
        yield pa.RecordBatch.from_arrays([*numbers, _binary(code[mine], o), *methods, _binary(code[every], n_all[at:end])], names=["block", "part", "parts", "own", "lo", "hi", "t"])
        at = end


def _laid(x: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of binaries one after the other, and how many there are of each row."""
    x = x.cast(pa.large_binary())
    ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(x.buffers()[2] or b"", kind, int(ends[-1] - ends[0]) // size, int(ends[0])).copy(), np.diff(ends) // size


def _counted(batches: Iterator[pa.RecordBatch], whole: bool, least: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows ``(own, lo, hi, t)`` of a block to ``(a, b, evidence, lo, hi)``. Where they are all rows of the block and fit together, only the best of each
    term; else what they add to each pair."""
    held, n, first = [], 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        (own, links), (t, sizes) = _laid(batch.column("own"), np.int32), _laid(batch.column("t"), np.int32)
        if n and n + len(t) > ENTRIES:
            yield from _edges(held, 1, None)
            held, n, first = [], 0, False
        named = np.repeat(batch.column("lo").is_valid().to_numpy(zero_copy_only=False), links)
        lo, hi = np.full(len(own), NONE), np.full(len(own), -NONE)
        lo[named], hi[named] = (_laid(batch.column(c).drop_null(), np.int64)[0] for c in ("lo", "hi"))
        held.append((own, links, lo, hi, t, sizes))
        n += len(t)
    if held:
        yield from _edges(held, *((least, most) if whole and first else (1, None)))


def _numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of ``x`` in order, and the place of each entry among them; without sorting where they lie close."""
    low, high = int(x.min()), int(x.max())
    if high - low > 4 * len(x) + (1 << 20):
        return np.unique(x, return_inverse=True)
    there = np.zeros(high - low + 1, bool)
    there[x - low] = True
    return (np.flatnonzero(there) + low).astype(x.dtype), (np.cumsum(there, dtype=np.int32) - 1)[x - low]


def _edges(held: list[tuple[np.ndarray, ...]], least: int, most: int | None) -> Iterator[pa.RecordBatch]:
    own, links, lo, hi, every, size = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    row, start = np.repeat(np.arange(len(links)), links), np.cumsum(size) - size
    seeds, seed = _numbers(own)
    los, his, kind = lo[:1], hi[:1], np.zeros(len(lo), np.int64)
    if (lo != lo[0]).any() or (hi != hi[0]).any():
        (los, lo), (his, hi) = np.unique(lo, return_inverse=True), np.unique(hi, return_inverse=True)
        kinds, kind = np.unique(lo * len(his) + hi, return_inverse=True)
        los, his = los[kinds // len(his)], his[kinds % len(his)]
    n_kinds = len(los)
    related, every = _numbers(every)
    wide = len(related)
    order = np.argsort(seed, kind="stable")
    seed, row, kind = seed[order], row[order], kind[order]
    pairs = np.concatenate([[0], np.cumsum(size[row])])  # before each link
    ends = np.searchsorted(seed, np.arange(len(seeds)), "right")
    at = 0  # link
    while at < len(seed):
        upto = int(np.searchsorted(pairs[ends], pairs[at] + VISITS, "right"))
        end = int(ends[max(upto - 1, seed[at])])  # whole seeds, one at least
        many = size[row[at:end]]
        place = _spans(start[row[at:end]], many)
        n_cells = (int(seed[end - 1]) - int(seed[at]) + 1) * wide * n_kinds
        cell = (np.repeat((seed[at:end] - seed[at]).astype(np.int64) * wide, many) + every[place]) * n_kinds
        if n_kinds > 1:
            cell += np.repeat(kind[at:end], many)
        if n_cells <= 4 * len(cell):
            n = np.bincount(cell, minlength=n_cells)
            cell = np.flatnonzero(n)
            n = n[cell]
        else:
            cell, n = np.unique(cell, return_counts=True)
        pair, k = cell // n_kinds, cell % n_kinds
        low, high = los[k], his[k]
        if n_kinds > 1:
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pair, n, low, high = pair[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        a, b = seeds[pair // wide + seed[at]], related[pair % wide]
        stays = (n >= least) & (a != b) & (a & b & 1 == 0)
        a, b, n, low, high = (x[stays] for x in (a, b, n, low, high))
        if most is not None and len(a):
            best = np.lexsort((b, -n, a))
            of = a[best]
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = best[np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of)))) < most]
            a, b, n, low, high = (x[best] for x in (a, b, n, low, high))
        none = low == NONE
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64)), pa.array(low, mask=none), pa.array(high, mask=none)], names=["a", "b", "evidence", "lo", "hi"])
        at = end


def best_of_each(source: Source, floor: float = FLOOR, most: int = PER_SEED) -> DataFrame:
    """The edges of a source that reach the floor, at most so many of a seed."""
    order = Window.partitionBy("seed").orderBy(F.desc("score"), F.desc("evidence"), "related")
    kept = source.edges.where(F.col("score") >= floor).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    return kept.select("seed", "related", F.lit(source.kind).alias("kind"), F.lit(source.source).alias("source"), "score", "evidence", "method")


def empty_table(df: DataFrame) -> DataFrame:
    """A relation table without rows, for terms of the type of ``df.seed``."""
    kind = df.schema["seed"].dataType.simpleString()
    return df.sparkSession.createDataFrame([], f"version string, seed {kind}, related {kind}, kind string, source string, score double, evidence long, method string, run string, status string")


def build(table: DataFrame | None, sources: list[Source], version: str, run: str, floor: float = FLOOR, most: int = PER_SEED) -> DataFrame:
    """The relation table after a build: ``(version, seed, related, kind, source, score, evidence, method, run, status)``.

    Edges of other versions or kinds stay as they are; of those built, edges not found again are
    "superseded" and keep their run, the others are "active" under this run.
    """
    new = reduce(DataFrame.unionByName, (best_of_each(s, floor, most) for s in sources))
    new = durable(new.select(F.lit(version).alias("version"), "*", F.lit(run).alias("run"), F.lit("active").alias("status")).select(*COLUMNS))  # read as rows and as keys
    old = empty_table(new) if table is None else table.select(*COLUMNS)
    closing = (F.col("version") == version) & F.col("kind").isin(*(s.kind for s in sources)) & (F.col("status") == "active")
    closed = old.join(new.select(*KEY), list(KEY), "left_anti").withColumn("status", F.when(closing, "superseded").otherwise(F.col("status")))
    return new.unionByName(closed.select(*COLUMNS))


def load(table: DataFrame, terms: DataFrame, version: str, kinds: tuple[str, ...], floor: float = 0.72) -> DataFrame:
    """The index that a run reads: active edges of a version, of allowed kinds and above a floor, to active terms, in each seed's order."""
    able = terms.where("active").select(F.col("term_id").alias("related"), "form", "term_type")
    kept = table.where((F.col("version") == version) & (F.col("status") == "active") & (F.col("score") >= floor) & F.col("kind").isin(*kinds)).join(able, "related")
    order = Window.partitionBy("seed").orderBy(F.desc("score"), F.desc("evidence"), "form", "related", "kind")
    return kept.withColumn("place", F.row_number().over(order)).select("seed", "place", "related", "form", "term_type", "kind", "score", "evidence", "method")


def lookup_keys(terms: DataFrame, aliases: DataFrame, mappings: DataFrame, normal) -> DataFrame:
    """``(key, term_id)``: every form under which an active term may be looked up: own forms, aliases and mapped aliases, by ``normal``."""
    able = terms.where("active").select("term_id")
    of = lambda df, term, *columns: [df.select(F.col(term).alias("term_id"), normal(F.col(c)).alias("key")) for c in columns]
    every = reduce(DataFrame.unionByName, [*of(terms, "term_id", "form"), *of(aliases, "term_id", "alias"), *of(mappings, "term", "alias")])
    return every.where("key IS NOT NULL AND key <> ''").join(able, "term_id", "left_semi").select("key", "term_id").distinct()


