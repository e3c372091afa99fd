"""A stored vector index: coarse cells by k-means on a bounded sample, several cells probed, exact cosines within.

The folder has ``cells`` (centre, number of vectors and of blocks of each cell), ``blocks`` (at most about
``BLOCK`` vectors of one cell in a row, as unit vectors) and ``probes`` (how many cells a query has to look into for
the recall that was asked for, measured on the sample). Every vector with a direction is in one cell; a null
or zero vector, or one with a component that is null or not finite, has none and is never found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dense import QUERY_BLOCK, best_of_blocks, bounded_batches
from millrace.operators.retrieve import top_k

#: Vectors that the cells are fitted on, cells at most, rounds of k-means, vectors of a block, sampled queries that set the number of probes.
SAMPLE, MOST_CELLS, ROUNDS, BLOCK, TRIALS = 20_000, 4096, 12, 4096, 256
#: Recall at 10 that the number of probes is chosen for.
RECALL = 0.97


@dataclass(frozen=True)
class VectorIndex:
    centres: np.ndarray
    probes: int
    blocks: DataFrame


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector has a direction."""
    v = F.col(vec_col)
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vectors.where(F.coalesce(F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False)))


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Unit centres by spherical k-means; a cell that loses its last vector takes the one farthest from its centre."""
    points, g = unit_rows(sample), np.random.default_rng(seed)
    centres = points[np.sort(g.choice(len(points), cells, replace=False))]
    for _ in range(rounds):
        near = points @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, points)
        lost = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-12)
        sums[lost] = points[np.argsort(near.max(axis=1), kind="stable")[: len(lost)]]
        centres = unit_rows(sums)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL, k: int = 10, trials: int = TRIALS) -> int:
    """The fewest cells to look into so that of the k nearest in the sample the asked share is found."""
    points = unit_rows(sample)
    queries = points[:: max(1, len(points) // trials)]
    score = queries @ points.T
    score[np.isclose(score, 1.0)] = -2.0  # itself
    nearest = np.argsort(-score, axis=1, kind="stable")[:, :k]
    cell = (points @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[nearest], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _cells_of(centres: np.ndarray, n: int):
    """Batches ``(id, vector)`` to ``(cell, id, unit vector)`` for the n nearest cells of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(np.stack([np.asarray(x, float) for x in batch.column(1).to_pylist()]))
            near = np.argsort(-(units @ centres.T), axis=1, kind="stable")[:, :n]
            rows = np.repeat(np.arange(len(units)), near.shape[1])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * units.shape[1], pa.int32()), pa.array(units[rows].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(rows)), values], names=["cell", "id", "v"])

    return run


def build(vectors: DataFrame, folder: str, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> None:
    """Write the index. The sample are the vectors whose ids have the least hashes, so it is the same each time.

    By default there are as many cells as 4 roots of the number of vectors, at most ``MOST_CELLS`` and a
    sixteenth of the sample: the centres that every task gets are bounded. A cell of any size, copies included,
    is cut into blocks by the hash of the id.
    """
    spark = vectors.sparkSession
    held = usable(vectors, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    total = held.count()
    drawn = np.array([r["v"] for r in held.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], float)  # a bounded sample
    if not total:
        drawn = np.zeros((1, 1))
    number = cells or max(1, min(int(4 * total**0.5), MOST_CELLS, len(drawn) // 16))
    centres = fit_cells(drawn, min(number, len(drawn)))
    probes = probes_for(drawn, centres, recall) if total > 1 else 1
    meta = spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int")
    meta.coalesce(1).write.parquet(f"{folder}/cells")
    held.mapInArrow(_cells_of(centres, 1), "cell int, id bigint, v array<double>").write.parquet(f"{folder}/assigned")
    assigned = spark.read.parquet(f"{folder}/assigned")
    sizes = assigned.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))  # a row for each cell
    dealt = assigned.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("d"))
    dealt.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block").write.parquet(f"{folder}/blocks")


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # at most MOST_CELLS
    return VectorIndex(np.array([r["centre"] for r in cells]), cells[0]["probes"], spark.read.parquet(f"{folder}/blocks"))


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, exclude_self: bool = True, id_col: str = "query_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, doc_id, score, rank)``: top k by exact cosine among the vectors of each query's nearest cells.

    Queries are gathered by cell, in blocks, and meet the blocks of that cell alone; a task passes on k rows
    for each of its queries. Queries without a direction find nothing.
    """
    asked = usable(queries, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    placed = asked.mapInArrow(_cells_of(index.centres, min(probes or index.probes, len(index.centres))), "cell int, id bigint, v array<double>")
    sizes = asked.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / QUERY_BLOCK)).cast("int").alias("parts"))  # one row
    gathered = placed.crossJoin(F.broadcast(sizes)).groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
    pairs = gathered.join(index.blocks.select("cell", "d"), "cell").select("q", "d")
    return top_k(bounded_batches(pairs).mapInArrow(best_of_blocks(k, exclude_self), "query_id bigint, doc_id bigint, score double"), "score", k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, hits, expected)``: how many of the exact neighbours each query found."""
    kept = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return kept.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("expected"))
