"""Exact dense search: blocks of queries against blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.retrieve import top_k

#: Rows of a block on either side.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
#: Bytes of an Arrow batch of pairs of blocks.
PAIR_BYTES = 32 << 20


def _blocks(df: DataFrame, id_col: str, vec_col: str, rows: int, prefix: str) -> DataFrame:
    """Rows gathered into blocks of about ``rows`` by the hash of their id."""
    total = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("_b"))
    dealt = df.crossJoin(F.broadcast(total))
    return dealt.groupBy(F.pmod(F.xxhash64(id_col), F.col("_b")).alias(f"{prefix}_block")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))).alias(prefix))


def _matrix(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, from the Arrow buffers: no Python object for each number. Vectors of unlike lengths are refused."""
    vectors = block.field("v")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return block.field("id").to_numpy(zero_copy_only=False), flat.reshape(len(block), -1)


def bounded_batches(df: DataFrame) -> DataFrame:
    """A pair of blocks is a large row: Arrow batches are cut by bytes, not by thousands of rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PAIR_BYTES)
    return df


def best_of_blocks(k: int, exclude_self: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of pairs of blocks (queries, vectors) the k best vectors of each query of a pair, by cosine, ties by id."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_pair in range(batch.num_rows):
                (qid, q), (did, d) = (_matrix(batch.column(c).slice(k_pair, 1).flatten()) for c in (0, 1))
                norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)
                score = np.round(np.divide(q @ d.T, norms, out=np.zeros((len(q), len(d))), where=norms > 0), 9)
                if exclude_self:
                    score[qid[:, None] == did] = -2.0
                order = np.lexsort((np.broadcast_to(did, score.shape), -score), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(q)), order.shape[1])
                picked = score[rows, order.ravel()]
                ok = picked > -2.0
                yield pa.RecordBatch.from_arrays([pa.array(qid[rows][ok]), pa.array(did[order.ravel()][ok]), pa.array(picked[ok])], names=["query_id", "doc_id", "score"])

    return best


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: top k by cosine in double precision, ties by id.

    A task takes one block of each side, and passes on k rows for each of its queries.
    """
    pairs = _blocks(queries, "query_id", "embedding", QUERY_BLOCK, "q").crossJoin(_blocks(vectors, "doc_id", "embedding", VECTOR_BLOCK, "d"))
    return top_k(bounded_batches(pairs.select("q", "d")).mapInArrow(best_of_blocks(k, exclude_self), "query_id bigint, doc_id bigint, score double"), "score", k)
