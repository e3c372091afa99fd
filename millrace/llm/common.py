"""What the operators share: Arrow row mapping, checkpoints, and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import tables
from millrace.sources.stored import durable, shared_folder  # noqa: F401  (the operators take them from here)

#: ASCII white space of the word definition shared by the operators.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch; a batch holds whole texts.
BATCH_ROWS = 256


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tables.table(spark, sf_dir, table)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches of the session to ``rows``: whole texts go in them, on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, rows)


def tidy() -> None:
    """Give freed memory back to the system: Python workers stay between tasks and should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What an operator's module keeps in a Python worker between its tasks.
KEPT: dict[str, dict] = {}


def drop_kept(owner: str) -> None:
    """Let go of what other operators have kept in this worker: another stage has begun."""
    others = [held for name, held in KEPT.items() if name != owner and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
        tidy()


def tidied(run: Callable, owner: str | None = None) -> Callable:
    """``run`` over the batches of a task, tidying up at its end, and before it what other operators left."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        drop_kept(owner or getattr(run, "__module__", ""))
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


@contextmanager
def numeric_batches(spark: SparkSession, rows: int = 1 << 13) -> Iterator[None]:
    """Larger Arrow batches for what runs meanwhile: stages of numbers alone, for which batches of texts are too small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable], columns: list[str]) -> DataFrame:
    """Apply a Python function to Arrow columns, batch by batch, in one narrow stage.

    ``make()`` runs once in each task and returns ``f(*columns) -> list of columns`` for one batch,
    each a list or a pyarrow array in the order of ``schema``. An attribute ``close`` of ``f`` is called
    when the task ends, so that an idle Python worker holds little.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                out = work(*(part.column(i) for i in range(part.num_columns)))
                arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        if hasattr(work, "close"):
            work.close()

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(tidied(run, getattr(make, "__module__", "")), schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        inside = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
        whole = int(inside[-1]) + 1 if len(inside) else 0
        if not whole and held and all(held[-1].column(i)[-1].as_py() == c[-1] for i, c in enumerate(columns)):
            held.append(batch)
            continue
        if held or whole:
            yield pa.Table.from_batches([*held, batch.slice(0, whole)])
        held = [batch.slice(whole)]
    if held:
        yield pa.Table.from_batches(held)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where sorted groups begin, and the end."""
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]]) if len(columns[0]) else np.zeros(1, np.int64)


def least_roots(size: int, links: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """For each of ``size`` places the least place reachable by links (and what ``root`` has joined already)."""
    root = np.arange(size) if root is None else root.copy()
    for x, y in links:
        while True:
            a, b = root[x], root[y]
            differ = a != b
            if not differ.any():
                break
            x, y, a, b = x[differ], y[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


#: Edges that one task reduces to a forest at a time.
PART_EDGES = 1 << 20


def _local_forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges as star edges ``(a, b)``, b the least node its edges reach from a; at most ``PART_EDGES`` are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 0), np.int64)]

        def reduce() -> np.ndarray:
            edge = np.concatenate(held, axis=1)
            node, place = np.unique(edge, return_inverse=True)
            place = place.reshape(edge.shape)
            root = least_roots(len(node), iter([(place[0], place[1])]))
            moved = root != np.arange(len(node))
            return np.stack([node[moved], node[root[moved]]])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]))
            if sum(h.shape[1] for h in held) > PART_EDGES:
                done = reduce()
                held[:] = [done]
                if done.shape[1] > PART_EDGES // 2:  # a partition of too many nodes to be held
                    yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1])], names=["a", "b"])
                    held[:] = [done[:, :0]]
        done = reduce()
        yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(tidied(run), "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, component)``, component the least node.

    As many partitions as the edges need (``PART_EDGES`` each) are joined and reduced to a forest each: if
    that is one, its forest is the answer. Else large-star and
    small-star passes alternate: each is one minimum by node (combined before the shuffle) and one
    join, which AQE can split where a node is hot. Every pass is checkpointed, and only a count and a
    checksum reach the driver. Nodes without edges do not appear.
    """
    with numeric_batches(edges.sparkSession):
        return _components(edges, rounds)


def _components(edges: DataFrame, rounds: int) -> DataFrame:
    now = durable(edges.where("a <> b").select("a", "b"))
    state = None
    for _ in range(rounds):
        parts = -(-now.count() // PART_EDGES)
        now = durable(_local_forest(now.coalesce(max(1, parts))))
        if parts <= 1:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = durable(small.where("a <> b").distinct())
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (seen["n"], seen["x"]) == state:
            break
        state = (seen["n"], seen["x"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} passes")
    return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
