"""Exact top-k inner-product search: columnar branch and bound.

Vectors are cut into blocks that hold one row per dimension (vertical layout).
For a block of candidates and a block of queries, scores accumulate dimension
block by dimension block; the norms of the dimensions still to come bound what a
candidate can reach, and candidates whose bound stays under the k-th best lower
bound are compacted away. Scores are exact integers.

Blocks of queries meet blocks of candidates by an equi-join on the pair of block
numbers; each task holds one block of each, and per query and block k rows leave.

Rows: vectors that are null or hold null or non-finite components take no part;
missing trailing components count as 0; an id that is null takes no part; equal
ids are one vector each (a query leaves out all rows of its own id); equal
scores go to the smaller id; other columns are ignored. A component of an
integer vector must stay below ``2**63``, a score likewise, else the job fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanlake.llm.shared import stored

#: Vectors of a candidate block and of a query block.
BLOCK_ROWS = 8192
QUERY_ROWS = 512
#: Dimensions accumulated between two prunings.
DIMS = 16
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)

FOUND = "query_id long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * component) of each usable vector."""
    x = F.col("embedding")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    # the filter must see whole vectors before any component is cast
    return embeddings.select(F.col("vec_id").cast("long"), F.when(usable, v).alias("v")).filter("vec_id is not null and v is not null")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vertical layout: one row per dimension, zero-padded."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((dims, len(lengths)), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[dim, row] = flat
    return out


def best(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best columns of ``x`` for query ``q``, without ``query_id``.

    ``tails[j]`` holds every column's norm over the dimensions from j * DIMS on.
    """
    alive = np.flatnonzero(ids != query_id)
    score = np.zeros(len(alive))
    for j, lo in enumerate(range(0, len(q), DIMS)):
        part = slice(lo, lo + DIMS)
        block = x[part] if len(alive) == x.shape[1] else x[part][:, alive]
        score += q[part] @ block
        if len(alive) > k:
            rest = np.linalg.norm(q[lo + DIMS :]) * tails[j + 1][alive] * (1 + 1e-9)
            floor = np.partition(score - rest, len(alive) - k)[len(alive) - k]
            keep = score + rest >= floor - 1e-6
            alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][order], score[order]


def _search(data: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    columns = [t.column("v").combine_chunks() for t in (data, queries)]
    dims = max([1, *(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in columns)])
    x, qs = (_matrix(c, dims) for c in columns)
    ids, query_ids = (t.column("vec_id").to_numpy() for t in (data, queries))
    largest = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(qs.astype(float)).max(initial=0)) * dims
    out_q, out_v, out_s = [], [], []
    if largest < EXACT:
        x, qs = x.astype(np.float64), qs.astype(np.float64)
        squares = x * x
        starts = range(0, dims + DIMS, DIMS)
        tails = np.sqrt(np.array([squares[lo:].sum(axis=0) for lo in starts]))
        for i, query_id in enumerate(query_ids):
            v, s = best(ids, x, query_id, np.ascontiguousarray(qs[:, i]), k, tails)
            out_q += [query_id] * len(v)
            out_v += v.tolist()
            out_s += [int(y) for y in s]
    else:  # beyond double precision: whole numbers of any length
        exact = x.astype(object)
        for i, query_id in enumerate(query_ids):
            s = qs[:, i].astype(object) @ exact
            order = sorted((j for j in range(len(ids)) if ids[j] != query_id), key=lambda j: (-s[j], ids[j]))[:k]
            out_q += [query_id] * len(order)
            out_v += [int(ids[j]) for j in order]
            out_s += [int(s[j]) for j in order]
    return pa.table([pa.array(c, pa.int64()) for c in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best ``vectors`` for each of ``queries`` (both: vec_id, v): query_id, rank, vec_id, score."""
    n_data, n_queries = vectors.count(), queries.count()
    n_blocks, n_query_blocks = max(1, -(-n_data // block_rows)), max(1, -(-n_queries // query_rows))
    number = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = vectors.select("vec_id", "v", number(n_blocks).alias("block")).select("*", every(n_query_blocks).alias("query_block"))
    asked = queries.select("vec_id", "v", number(n_query_blocks).alias("query_block")).select("*", every(n_blocks).alias("block"))
    found = (
        data.groupBy("block", "query_block")
        .cogroup(asked.groupBy("block", "query_block"))
        .applyInArrow(lambda a, b: _search(a, b, k), FOUND)
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(embeddings: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """Top k of all vectors for the queries, the vectors whose id is divisible by ``every``."""
    vectors = stored(integer_vectors(embeddings, scale), "topk-vectors")
    return search(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
