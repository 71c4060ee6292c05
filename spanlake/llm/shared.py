"""Helpers of this subpackage: intermediate tables, whitespace words, rolling hashes.

Word boundaries everywhere are the ASCII blanks ``\\x20 \\x09-\\x0D``; hashes are
64-bit and computed for a whole Arrow batch at once, so the cost per document
does not depend on how short it is.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: whatever executor is lost later, the rows come from files.
    """
    path = shared_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of text in a batch after it was unpacked.
EXPANDED_BYTES = 4 << 20


def _recoded(df: DataFrame, column: str, kind: T.DataType, recode) -> DataFrame:
    at = df.columns.index(column)
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([recode(c) if i == at else c for i, c in enumerate(part.columns)], names)
        trim()

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """What expands to more than ``EXPANDED_BYTES`` goes on in several batches."""
        start, size = 0, 0
        for i, x in enumerate(batch.column(at).to_pylist() if recode is _expand else []):
            more = 0 if x is None else zstandard.frame_content_size(x)
            if size and size + more > EXPANDED_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += more
        if start < len(batch):
            yield batch.slice(start)

    schema = T.StructType([T.StructField(f.name, kind if f.name == column else f.dataType) for f in df.schema])
    return df.mapInArrow(run, schema)


def _squeeze(texts: pa.Array) -> pa.Array:
    zip_ = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if t is None else zip_(t.encode()) for t in texts.to_pylist()], pa.binary())


def _expand(texts: pa.Array) -> pa.Array:
    unzip = zstandard.ZstdDecompressor().decompress
    return pa.array([None if t is None else unzip(t).decode() for t in texts.to_pylist()], pa.string())


def squeezed(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the texts compressed, for a shuffle that carries them."""
    return _recoded(df, column, T.BinaryType(), _squeeze)


def expanded(df: DataFrame, column: str = "text") -> DataFrame:
    """Undo ``squeezed``."""
    return _recoded(df, column, T.StringType(), _expand)


def trim() -> None:
    """Give freed memory back to the system at the end of a task: Python workers
    live on, and what they keep adds up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored.

    They go once the driver has collected the plans that refer to them, which a
    driver with little to do would put off until the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ordered(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) with ``oid``, unique and in the order of ``doc_id``:
    the id itself, or a number where ids repeat or are missing."""
    ids = documents.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if ids.isEmpty():
        return documents.withColumn("oid", F.col("doc_id").cast("long"))
    rows = documents.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return stored(rows.withColumn("oid", F.monotonically_increasing_id()), "ordered")


# ------------------------------------------------------------------ text as arrays

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_rng = np.random.default_rng(20240917)
#: A random odd 64-bit value for each byte.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(kind: str, n: int) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n, kept between calls."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, _BASE if kind == "up" else _BASE_INV, np.uint64)
        steps[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class Rolling:
    """Hashes of any byte ranges of one buffer: prefix sums of value * base**i."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.empty(n + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(BYTE_VALUES[data] * _powers("up", n), out=self.prefix[1:])
        self.down = _powers("down", n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; equal bytes give equal hashes."""
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hash of data[i:i+width] for every i."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.down[:n])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column (null: empty) and len+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Parts of a batch whose ``column`` holds at most ``most_bytes`` (a longer
    single value makes a part of its own), so that work arrays stay bounded."""
    lengths = np.diff(text_buffer(batch.column(column))[1])
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def gathered(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and put together so that ``column`` holds about ``most_bytes`` in each
    (a longer single value makes a batch of its own)."""
    held, size = [], 0
    for batch in batches:
        for some in slices(batch, column, most_bytes):
            more = int(text_buffer(some.column(column))[1][-1])
            if held and size + more > most_bytes:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(some)
            size += more
    if held:
        yield pa.concat_batches(held)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its first word per text (len+1)."""
    blank = BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    ends = ~blank
    ends[:-1] &= blank[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = ~blank[edge]
    ends[edge - 1] = ~blank[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_hashes(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles (lower-cased A-Z) of each text.

    Returns the flat hashes, in text order, and len+1 offsets. A text of fewer
    words has one shingle, its whole word sequence; one without words has none.
    """
    data, offsets = text_buffer(column)
    data = LOWER[data]
    start, end, first = words(data, offsets)
    word = Rolling(data).ranges(start, end)
    n_words = np.diff(first)
    count = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    salts = mix(np.arange(1, width + 1, dtype=np.uint64))
    rolled = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for j in range(width):
        rolled += mix(word[j : j + len(rolled)] ^ salts[j])
    # shingle i of a text starts at its i-th word
    at = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], count) + np.repeat(first[:-1], count)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    out = np.zeros(len(at), np.uint64)
    long_enough = np.repeat(n_words >= width, count)
    out[long_enough] = rolled[at[long_enough]]
    for i in short:
        h = np.zeros(1, np.uint64)
        for j, w in enumerate(word[first[i] : first[i + 1]]):
            h += mix(np.array([w], np.uint64) ^ salts[j])
        out[out_offsets[i]] = h[0] ^ _U64(int(n_words[i]))
    return mix(out), out_offsets


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64))


# ------------------------------------------------------------------ components


#: Links that one task contracts at a time.
LINKS_PER_TASK = 1 << 20


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's links, linked to the smallest id that they reach."""
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not rows:
        return
    nodes, index = np.unique(np.concatenate([np.concatenate(r) for r in zip(*rows)]), return_inverse=True)
    a, b = np.split(index, 2)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for side in (a, b):
            np.minimum.at(after, side, least)
            np.minimum.at(after, label[side], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    other = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["a", "b"])


def components(nodes: DataFrame, links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each node: columns ``id``, ``component``.

    ``links`` has columns ``a``, ``b``. Tasks first contract their own links, about
    ``LINKS_PER_TASK`` each, to one link per node. Unless that was one task,
    alternating large-star and small-star steps follow: a long chain halves with
    each pair of steps and every node's links to smaller ids shrink to one. Each
    step is one aggregation with map-side partial results and a join, written to
    the shared folder.
    """
    links = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b"), f"{name}-links")
    tasks = max(1, -(-links.count() // LINKS_PER_TASK))
    edges = stored(links.coalesce(tasks).mapInArrow(_contract, "a long, b long"), f"{name}-links")
    seen = None
    for _ in range(rounds if tasks > 1 else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node, linked to its smallest neighbour
        # (stored, so that Spark can split the join rows of a hub's many links)
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least")
        edges = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself, linked to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        stars = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        edges = stars.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(edges, f"{name}-links")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        if tasks > 1:
            raise RuntimeError(f"components of {name} did not settle in {rounds} rounds")
    return nodes.join(edges.select(F.col("a").alias("id"), "b"), "id", "left").select(
        "id", F.coalesce("b", "id").alias("component")
    )
