"""Embedding near-duplicates: Euclidean p-stable hashing with exact cosine checks.

Vectors are scaled to length one, where a cosine of c is a distance of
sqrt(2 - 2c). A table's bucket is the hash of K quantised random projections
``floor((a.x + b) / w)``; with the collision probability of a projection known for
the threshold's distance and for unrelated vectors, K follows from the number of
vectors (so that unrelated vectors rarely meet) and the number of tables from the
recall asked for at the threshold itself. Pairs above the threshold meet more
surely than that.

Within a bucket all pairs are checked by exact cosine in double precision, as
blocks of a matrix product. A pair that meets in several tables is counted in the
first of them, so no list of pairs is ever made: groups emit, per vector, how many
vectors it links with and one vector of its own part. Equal vectors are one class
(named by a 64-bit hash) with a weight. A bucket of many vectors is cut into blocks that meet pair by pair.

Rows: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths never link; a null ``vec_id`` has
no link and a null component; rows that repeat a ``vec_id`` are vectors of their
own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.shared import components, mix, stored

COSINE = 0.95
#: Width of a projection's cells, for vectors of length one.
CELL = 2.0
#: Least chance that a pair exactly at the threshold meets in some table.
RECALL = 0.99
#: Unrelated vectors (at right angles) that a vector meets per table, on average.
STRAYS = 0.1
BLOCK = 512
SEED = 1234

SIGNED = "rep long, weight long, embedding array<double>, buckets array<int>"
LINKED = "rep long, links long, parent long"


def collision(distance: float, cell: float = CELL) -> float:
    """Chance that two points at ``distance`` share a cell of one projection."""
    if distance == 0:
        return 1.0
    c = cell / distance
    below = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def shape(n_vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections per table and number of tables."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n_vectors, 2) / STRAYS) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can't overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_hashes(x: np.ndarray, k: int, tables: int, cell: float = CELL) -> np.ndarray:
    """Bucket of each unit vector in each table, as 32-bit hashes."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    out = np.empty((len(x), tables), np.int32)
    for t in range(tables):
        a, b = rng.standard_normal((x.shape[1], k)), rng.uniform(0, cell, k)
        cells = np.floor((x @ a + b) / cell).astype(np.int64).view(np.uint64)
        h = np.full(len(x), x.shape[1], np.uint64)
        for j in range(k):
            h = mix(h + cells[:, j])
        out[:, t] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _sign(batches: Iterable[pa.RecordBatch], k: int, tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.diff(batch.column("embedding").offsets.to_numpy())
        for dims in np.unique(lengths):
            some = batch.take(pa.array(np.flatnonzero(lengths == dims)))
            x = unit(_matrix(some.column("embedding")))
            hashes = bucket_hashes(x, k, tables)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("weight"), lists(x), lists(hashes)], ["rep", "weight", "embedding", "buckets"])


def _smallest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable within the block from each row and each column."""
    none = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], none).min(axis=1, initial=none))
        nb = np.minimum(lb, np.where(linked, na[:, None], none).min(axis=0, initial=none))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def _check(batches: Iterable[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of each group (key, lo, hi): block ``lo`` against block ``hi``."""
    held = list(batches)
    if not sum(map(len, held)):
        return
    rows = pa.Table.from_batches(held)
    key, lo, hi, block, rep, weight = (rows.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "rep", "weight"))
    order = np.lexsort((rep, block, hi, lo, key))
    new = np.ones(len(order), bool)
    k, l, h = key[order], lo[order], hi[order]
    new[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1]) | (h[1:] != h[:-1])
    bounds = np.append(np.flatnonzero(new), len(order))
    vectors = rows.column("embedding").combine_chunks()
    at, flat = vectors.offsets.to_numpy().astype(np.int64), vectors.flatten().to_numpy()
    at = at - at[0]
    buckets = rows.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    reps, links, parents = [], [], []
    for x, y in zip(bounds[:-1], bounds[1:]):
        own = order[x:y]
        table = int(key[own[0]] >> 32)
        same = lo[own[0]] == hi[own[0]]
        a = own if same else own[block[own] == lo[own[0]]]
        b = own if same else own[block[own] == hi[own[0]]]
        size = at[own + 1] - at[own]
        if size.min() != size.max():  # a hash shared by vectors of different lengths: they never link
            continue
        if not len(a) or not len(b):
            continue
        dims = np.arange(size[0])
        linked = flat[at[a][:, None] + dims] @ flat[at[b][:, None] + dims].T >= cosine
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        la, lb = _smallest(linked, rep[a], rep[b])
        first = linked
        for t in range(table):
            first = first & (buckets[a, t][:, None] != buckets[b, t][None, :])
        reps += [rep[a]] if same else [rep[a], rep[b]]
        links += [first @ weight[b]] if same else [first @ weight[b], weight[a] @ first]
        parents += [la] if same else [la, lb]
    if reps:
        found = [np.concatenate(c) for c in (reps, links, parents)]
        some = (found[1] > 0) | (found[0] != found[2])
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in found], ["rep", "links", "parent"])


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    x = F.col("embedding")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))
    vectors = vectors.withColumn("rep", F.when(usable, F.xxhash64(F.size(x), x)))
    classes = vectors.filter("rep is not null").groupBy("rep")
    classes = stored(classes.agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")), "embedding-classes")
    k, tables = shape(classes.count(), cosine, recall)
    signed = stored(classes.select("rep", "weight", x.cast("array<double>").alias("embedding")).mapInArrow(lambda b: _sign(b, k, tables), SIGNED), "embedding-buckets")
    cells = signed.select("rep", F.posexplode("buckets").alias("table", "bucket"))
    cells = cells.select("rep", (F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(F.col("bucket").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("key"))
    shared = cells.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = cells.join(stored(shared, "embedding-shared"), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep")
    met = met.join(signed, "rep").repartition("key", "lo", "hi")
    found = stored(met.mapInArrow(lambda b: _check(b, cosine), LINKED), "embedding-links")
    links = found.select(F.col("rep").alias("a"), F.col("parent").alias("b")).filter("a != b")
    part = components(classes.select(F.col("rep").alias("id")), links, "embedding")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    part = stored(part.withColumnRenamed("id", "rep").join(classes.select("rep", "least", "weight"), "rep"), "embedding-parts")
    names = part.groupBy("component").agg(F.min("least").alias("component_id"))
    known = part.join(names, "component").join(counts, "rep", "left")
    known = stored(known.select("rep", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "embedding-result")
    component = F.coalesce("component_id", "vec_id")
    return vectors.join(known, "rep", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
