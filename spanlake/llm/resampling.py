"""Importance resampling towards a target: hashed n-gram buckets, log ratios, Gumbel draws.

A text's words, joined by one space, stand in one buffer, so every feature (a run of
1 to 2 words) is a span of it. The CRC-32 of a span is linear in its bytes: a table
holds what each byte adds at each distance from the span's end, ``bitwise_xor.reduceat``
folds the looked-up values span by span, and a constant for the span's length is the
CRC of as many zero bytes. Spans longer than the table are cut into blocks of its
size, counted from the end, and neighbouring blocks fold into one another, each time
shifted by twice the distance, until one value is left.

Bucket counts of the corpus and of the target are Spark aggregations (at most
``buckets`` rows, which is all that the driver and the workers get to hold). A
second pass gives each document the mean gain of its features; noise from a hash
of its id turns scores into draws without replacement, and the highest are ranked
by a range-partitioned sort.

Rows: a null or empty text, or one without words, has no features and weight 0; a
null ``doc_id`` draws no noise, so its score is null and it is never drawn, nor does
it count among the N documents; rows that share a ``doc_id`` share its noise and, with
equal scores, are ranked in any order; an empty table gives no rows; other columns
are ignored; long texts are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanlake.llm.shared import LOWER, slices, stored, text_buffer, trim

BUCKETS = 10_000
MOST_WORDS = 2
#: Documents with fewer words are not drawn.
MIN_WORDS = 20
PERCENT = 25
SEED = "7"
#: Distances from the end that the position table covers.
TABLE_BYTES = 32
SLICE_BYTES = 1 << 20

#: Bytes of a word: digits, letters and everything beyond ASCII.
WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


# ------------------------------------------------------------------ CRC-32


def _contributions(n: int) -> np.ndarray:
    """``[d, b]``: what byte b adds to the CRC of a span when d bytes follow it."""
    zeros = [zlib.crc32(bytes(d + 1)) for d in range(n)]
    return np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ zeros[d] for b in range(256)] for d in range(n)], np.uint32)


_TABLE = _contributions(TABLE_BYTES)
_FLAT = _TABLE.reshape(-1)
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(TABLE_BYTES + 1)], np.uint32)


def _shift(values: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``values`` with a number of zero bytes after them; ``matrix`` is that step, bit by bit."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= matrix[bit] * ((values >> np.uint32(bit)) & np.uint32(1))
    return out


#: One zero byte: the register moves down eight bits, its low byte comes back by the table.
_BITS = np.uint32(1) << np.arange(32, dtype=np.uint32)
_ONE_BYTE = (_BITS >> np.uint32(8)) ^ _TABLE[0][_BITS & np.uint32(255)]


def _block_step() -> np.ndarray:
    matrix = _BITS
    for _ in range(TABLE_BYTES):
        matrix = _shift(matrix, _ONE_BYTE)
    return matrix


_ONE_BLOCK = _block_step()


def _long_crc(span: np.ndarray) -> int:
    """CRC-32 of one span of any length, folded block by block."""
    n = -(-len(span) // TABLE_BYTES)
    count = 1 << (n - 1).bit_length()
    whole = np.zeros(count * TABLE_BYTES, np.uint8)  # zeros in front add nothing
    whole[len(whole) - len(span) :] = span
    at = np.arange(TABLE_BYTES - 1, -1, -1) * 256
    blocks = np.bitwise_xor.reduce(_FLAT[whole.reshape(count, TABLE_BYTES) + at], axis=1)
    step = _ONE_BLOCK
    while len(blocks) > 1:
        blocks = _shift(blocks[0::2], step) ^ blocks[1::2]
        step = _shift(step, step)
    return int(blocks[0]) ^ zlib.crc32(bytes(len(span)))


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for each pair."""
    length = end - start
    out = _ZEROS[np.minimum(length, TABLE_BYTES)].copy()
    short = np.flatnonzero((length > 0) & (length <= TABLE_BYTES))
    if len(short):
        size = length[short].astype(np.int32)
        first = np.cumsum(size, dtype=np.int64) - size
        total = int(first[-1]) + int(size[-1])
        # places of all spans' bytes, and each one's distance from its span's end
        place = np.arange(total, dtype=np.int32)
        distance = np.repeat((first + size - 1).astype(np.int32), size) - place
        place += np.repeat((start[short] - first).astype(np.int32), size)
        out[short] ^= np.bitwise_xor.reduceat(_FLAT[(distance << 8) + data[place]], first)
    for i in np.flatnonzero(length > TABLE_BYTES):
        out[i] = _long_crc(data[start[i] : end[i]])
    return out


# ------------------------------------------------------------------ features


def features(texts: pa.Array, most_words: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every feature, the text it belongs to, and each text's number of words."""
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    inside = WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[edge] = inside[edge]
    # the joined buffer: word bytes, and a space before each word but the first
    word = np.cumsum(begins, dtype=np.int32)[inside]
    n = int(word[-1]) if len(word) else 0
    joined = np.full(len(word) + max(n - 1, 0), 0x20, np.uint8)
    joined[np.arange(len(word)) + word - 1] = data[inside]
    size = np.bincount(word, minlength=n + 1)[1:]
    end = np.cumsum(size) + np.arange(n)
    start = end - size
    at = np.concatenate([[0], np.cumsum(begins)])[offsets]
    counts = np.diff(at)
    text = np.repeat(np.arange(len(counts)), counts)
    crcs, texts_of = [span_crcs(joined, start, end)], [text]
    for k in range(1, most_words):
        same = np.flatnonzero(text[k:] == text[:-k]) if n > k else np.zeros(0, np.int64)
        crcs.append(span_crcs(joined, start[same], end[same + k]))
        texts_of.append(text[same])
    return np.concatenate(crcs), np.concatenate(texts_of), counts


def _bucket_counts(batches: Iterable[pa.RecordBatch], buckets: int, most_words: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for some in slices(batch, "text", SLICE_BYTES):
            total += np.bincount(features(some.column("text"), most_words)[0] % np.uint32(buckets), minlength=buckets)
    seen = np.flatnonzero(total)
    trim()
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> DataFrame:
    """``bucket`` and ``n``: features of all rows' ``text`` by bucket."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _bucket_counts(b, buckets, most_words), "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket is worth: the floored log ratio of its smoothed
    shares in the target and in the corpus, in thousandths."""
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratio = lambda b: ((target.get(b, 0) + 1.0) * s_all) / ((corpus.get(b, 0) + 1.0) * t_all)
    return np.array([math.floor(1000.0 * math.log(ratio(b))) for b in range(buckets)], np.float64)


def _weights(batches: Iterable[pa.RecordBatch], gain: np.ndarray, most_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "text", SLICE_BYTES):
            crc, text, n_words = features(some.column("text"), most_words)
            n = np.bincount(text, minlength=len(some))
            # whole numbers below 2**53, so that sums in doubles are exact
            total = np.bincount(text, gain[crc % np.uint32(len(gain))], minlength=len(some)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), *map(pa.array, (n, n_words, weight))], ["doc_id", "n_features", "n_words", "weight"])
    trim()


def _weighed(documents: DataFrame, target: DataFrame, buckets: int, most_words: int) -> DataFrame:
    # at most ``buckets`` rows of each
    counts = lambda rows: {r["bucket"]: r["n"] for r in bucket_counts(rows, buckets, most_words).collect()}
    gain = gains(counts(documents), counts(target), buckets)
    held = documents.sparkSession.sparkContext.broadcast(gain)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda b: _weights(b, held.value, most_words), "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: str, seed: str = SEED) -> F.Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (doc_id, score, ...) with ``rank`` 1 to ``most`` in order; null beyond.

    Each task numbers its range of the order; the totals of the tasks before come from
    one row per task.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    # its upper bits are the task, the lower 33 the row's place within it
    placed = placed.withColumns({"task": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    placed = stored(placed, "resampling-order")
    tasks = placed.groupBy("task").agg(F.count("*").alias("n"))
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(tasks, "task").withColumn("rank", F.when(rank <= most, rank).cast("long")).drop("task", "place", "before")


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    buckets: int = BUCKETS,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``documents`` (doc_id, text) weighed against ``target`` (text): doc_id, n_features,
    n_words, weight, score, rank (null: not drawn)."""
    rows = _weighed(documents, target, buckets, most_words).withColumn("score", F.col("weight") + noise("doc_id", seed))
    rows = stored(rows, "resampling-scores")
    candidate = F.coalesce((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull(), F.lit(False))
    chosen = rows.where(candidate)
    drawn = _ranked(chosen, percent * chosen.count() // 100)
    rest = rows.where(~candidate).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "n_words", "weight", "score", "rank")
