"""Most similar chunks per query, given vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactlens import vocab

# Vectors in a block: of a thousand dimensions a pair of blocks is 32 MB, and its scores are 32 MB.
BLOCK_ROWS = 2048


def _blocks(rows: DataFrame, key: str, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    """The rows dealt into ``n_own`` blocks by their key, each sent to every block of the other side."""
    placed = rows.select(
        F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own), F.col(key).cast("bigint").alias("key"), F.col("vec").cast("array<double>").alias("vec")
    )
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = vocab.TOP_K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, chunk_id, score``: the k chunks of the highest cosine per query, ties by chunk id.

    ``chunks`` is ``chunk_id, vec``, ``queries`` is ``query_id, vec``; rows without a vector, or with a null or non-finite
    component in it, take no part.  ``knowledge`` retrieves by sparse vectors of texts, with an index.  Both sides are dealt into blocks of about ``block_rows`` vectors; a task multiplies one block
    with one block and keeps k candidates per query.  No pair of rows leaves it, nothing passes through the driver but
    the two row counts, and one path serves every size.
    """
    finite = F.forall("vec", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    chunks, queries = (df.where(F.coalesce(finite, F.lit(False))) for df in (chunks, queries))
    n_chunks, n_queries = (max(1, -(-df.count() // block_rows)) for df in (chunks, queries))
    ids = ["chunk_block", "query_block"]
    left = _blocks(chunks, "chunk_id", *ids, n_chunks, n_queries).groupBy(*ids)
    right = _blocks(queries, "query_id", *reversed(ids), n_queries, n_chunks).groupBy(*ids)
    found = left.cogroup(right).applyInArrow(lambda c, q: _best(c, q, k), "query_id BIGINT, chunk_id BIGINT, score DOUBLE")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "chunk_id", "score")
    )


def _best(chunks: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best chunks of one block for each query of another; queries go in steps, so a step's scores stay small."""
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
    if not chunks.num_rows or not queries.num_rows:
        return schema.empty_table()
    ids, vectors = _unit(chunks)
    return pa.concat_tables([_step(ids, vectors, *_unit(queries.slice(at, BLOCK_ROWS)), k, schema) for at in range(0, queries.num_rows, BLOCK_ROWS)])


def _step(ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, matrix: np.ndarray, k: int, schema: pa.Schema) -> pa.Table:
    scores = matrix @ vectors.T
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    values = np.repeat(names, order.shape[1]), ids[order].ravel(), np.take_along_axis(scores, order, 1).ravel()
    return pa.table([pa.array(v) for v in values], schema=schema)


def _unit(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of length one; a zero vector stays zero."""
    vectors = np.stack(rows["vec"].to_pylist()).astype(np.float64)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return rows["key"].to_numpy(), np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
