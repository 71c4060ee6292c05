"""Phrases whose words belong together, by top-order marginalisation.

Only the longest windows are counted: for each word, itself and the next three words
of its piece as lead columns, padded with the empty string where the piece ends. A
phrase occurs wherever a window begins with it, so ``ROLLUP`` over language and the
four columns sums the windows to the counts of all shorter prefixes, and to the number
of words of each language, without an explosion per length.

Most windows of a corpus are rare, and a rare phrase matters only through its prefixes.
So windows travel as sorted, compressed blocks, and are cut back before the ROLLUP in
three steps: all windows that share their first three words meet, and a window that
is too rare loses its last word, as does a prefix of three words; the same for
prefixes of two words and of one. What a frequent prefix loses nowhere is its count:
a cut window still counts for every prefix it keeps. Each step spreads over buckets by
a hash of the shared words, about ``BUCKET_WINDOWS`` windows each, which a task takes
one by one; a word that a third of all windows begin with is spread by the words
after it, and by then only its remainders are left.

Rows: a null or empty text has no words; a null language is ``und``; rows that repeat
a ``doc_id`` (or have none) count like any others; an empty table gives no rows; other
columns are ignored. Long texts are cut at piece ends, which no window crosses.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanlake.llm.shared import LOWER, Rolling, gathered, mix, stored, text_buffer, trim

MOST_WORDS = 4
MIN_COUNT = 30
#: A longer phrase with this share of a phrase's occurrences replaces it.
ABSORB_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
NO_LANG = "und"

#: Bytes of text whose windows a task counts at a time.
SLICE_BYTES = 8 << 20
#: Windows that a bucket holds about.
BUCKET_WINDOWS = 1 << 20
#: Parts of a language's candidates that are ranked on their own first.
RANK_PARTS = 64

_BREAK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\v\f\r"])
_GAP = _BREAK | np.isin(np.arange(256), [0x20, 0x09])
WORDS = [f"w{i}" for i in range(1, MOST_WORDS + 1)]


# ------------------------------------------------------------------ windows


class Windows:
    """Counted windows: ``vocabulary`` (strings; 0 is the pad), ``langs``, and per
    window its language, its words (rows of ``codes``) and its count."""

    def __init__(self, vocabulary: pa.StringArray, langs: pa.StringArray, lang: np.ndarray, codes: np.ndarray, n: np.ndarray):
        self.vocabulary, self.langs, self.lang, self.codes, self.n = vocabulary, langs, lang, codes, n

    def __len__(self) -> int:
        return len(self.n)

    def take(self, rows) -> Windows:
        return Windows(self.vocabulary, self.langs, self.lang[rows], self.codes[:, rows], self.n[rows])

    def _order(self, first: np.ndarray | None = None) -> np.ndarray:
        size = max(1, len(self.vocabulary))
        pair = lambda i: self.codes[i].astype(np.int64) * size + self.codes[i + 1]
        keys = [pair(2), pair(0), self.lang]
        return np.lexsort(keys if first is None else [*keys, first])

    def same_as_before(self, length: int) -> np.ndarray:
        """Of sorted windows: which begin with the same ``length`` words as the one before."""
        same = np.zeros(len(self), bool)
        same[1:] = self.lang[1:] == self.lang[:-1]
        for c in self.codes[:length]:
            same[1:] &= c[1:] == c[:-1]
        return same

    def combined(self) -> Windows:
        """Sorted, equal windows as one."""
        if not len(self):
            return self
        out = self.take(self._order())
        first = np.flatnonzero(~out.same_as_before(MOST_WORDS))
        n = np.add.reduceat(out.n, first)
        out = out.take(first)
        out.n = n
        return out

    def cut_back(self, shared: int, least: int) -> Windows:
        """Windows whose prefix of more words than ``shared``, or of just as many, is
        rarer than ``least`` lose what comes after its last word but one. All windows
        with the same ``shared`` first words must be here."""
        if not len(self):
            return self
        out = self.take(self._order())
        for length in range(MOST_WORDS, shared - 1, -1):
            first = np.flatnonzero(~out.same_as_before(length))
            total = np.add.reduceat(out.n, first)
            rare = np.repeat(total < least, np.diff(np.append(first, len(out))))
            out.codes[length - 1 :, rare] = 0
        return out.combined()

    def buckets(self, shared: int, n: int) -> np.ndarray:
        """Bucket of each window by language and first words: the same in every task."""
        def hashes(strings: pa.StringArray) -> np.ndarray:
            data, offsets = text_buffer(strings)
            return Rolling(data).ranges(offsets[:-1], offsets[1:])

        words = hashes(self.vocabulary)
        h = hashes(self.langs)[self.lang]
        for c in self.codes[:shared]:
            h = mix(h * np.uint64(3) ^ words[c])
        return (h % np.uint64(n)).astype(np.int64)

    # -------------------------------------------------------------- blocks

    def blocks(self, shared: int, n: int) -> Iterator[tuple[int, bytes]]:
        """The windows of each bucket as a compressed block."""
        bucket = self.buckets(shared, n)
        order = self._order(bucket)
        rows, bucket = self.take(order), bucket[order]
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(bucket[lo]), rows.take(slice(lo, hi))._packed()

    def _packed(self) -> bytes:
        used, codes = np.unique(self.codes, return_inverse=True)
        codes = codes.reshape(self.codes.shape).astype(np.int32)
        langs, lang = np.unique(self.lang, return_inverse=True)
        parts = []
        for strings in (self.vocabulary.take(pa.array(used)), self.langs.take(pa.array(langs))):
            data, offsets = text_buffer(strings)
            parts += [np.diff(offsets).astype("<i4").tobytes(), data.tobytes()]
        # sorted columns: small steps
        codes[0] = np.diff(codes[0], prepend=0)
        parts += [np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), lang.astype("<i4").tobytes(), self.n.astype("<i8").tobytes()]
        head = struct.pack("<4q", len(used), len(langs), len(self), len(parts[1]))
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @staticmethod
    def unpacked(raw: bytes) -> Windows:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        n_words, n_langs, n, text = struct.unpack("<4q", raw[:32])
        at = 32

        def numbers(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        def strings(count: int) -> pa.StringArray:
            nonlocal at
            offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(numbers(count, "<i4"), dtype=np.int32)])
            out = pa.StringArray.from_buffers(count, pa.py_buffer(offsets), pa.py_buffer(raw[at : at + int(offsets[-1])]))
            at += int(offsets[-1])
            return out

        vocabulary, langs = strings(n_words), strings(n_langs)
        planes = numbers(4 * MOST_WORDS * n, "u1").reshape(4, MOST_WORDS * n)
        codes = np.ascontiguousarray(planes.T).view("<i4").reshape(MOST_WORDS, n).copy()
        codes[0] = np.cumsum(codes[0])
        return Windows(vocabulary, langs, numbers(n, "<i4"), codes, numbers(n, "<i8"))

    @staticmethod
    def together(parts: list[Windows]) -> Windows:
        """Windows of several blocks over one vocabulary."""
        def joined(arrays: list[pa.StringArray], codes: list[np.ndarray]) -> tuple[pa.StringArray, list[np.ndarray]]:
            coded = pa.concat_arrays([pa.array([""], pa.string()), *arrays]).dictionary_encode()
            index, at, out = coded.indices.to_numpy(), 1, []
            for a, c in zip(arrays, codes):
                out.append(index[at : at + len(a)][c])
                at += len(a)
            return coded.dictionary, out

        vocabulary, codes = joined([p.vocabulary for p in parts], [p.codes for p in parts])
        langs, lang = joined([p.langs for p in parts], [p.lang for p in parts])
        return Windows(vocabulary, langs, np.concatenate(lang), np.concatenate(codes, axis=1), np.concatenate([p.n for p in parts]))


def _text_parts(texts: pa.Array, most_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, text offsets and text numbers; a text above ``most_bytes`` is cut at piece ends."""
    data, offsets = text_buffer(texts)
    if len(data) <= most_bytes or len(offsets) > 2:
        yield data, offsets, np.arange(len(offsets) - 1)
        return
    ends = np.flatnonzero(_BREAK[data]) + 1
    lo = 0
    while lo < len(data):
        at = np.searchsorted(ends, lo + most_bytes, "right") - 1
        hi = int(ends[at]) if at >= 0 and ends[at] > lo else int(ends[at + 1]) if at + 1 < len(ends) else len(data)
        hi = len(data) if hi <= lo else hi
        yield data[lo:hi], np.array([0, hi - lo]), np.zeros(1, np.int64)
        lo = hi


def count_windows(data: np.ndarray, offsets: np.ndarray, langs: pa.StringArray) -> Windows:
    """The longest windows of some texts, counted."""
    data = LOWER[data]
    solid = ~_GAP[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[edge] = solid[edge]
    at = np.flatnonzero(begins)
    bounds = np.append(np.concatenate([[0], np.cumsum(solid)])[at], solid.sum()).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data[solid]))
    coded = strings.dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int32) + 1
    text = np.searchsorted(offsets, at, "right") - 1
    # pieces: the number of breaks before a word, and the text it is in
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[at]
    codes = np.zeros((MOST_WORDS, len(at)), np.int32)
    codes[0] = word
    for k in range(1, MOST_WORDS):
        same = (piece[k:] == piece[:-k]) & (text[k:] == text[:-k])
        codes[k, : len(same)] = np.where(same, word[k:], 0)
    lang = langs.dictionary_encode()
    return Windows(pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary]), lang.dictionary, lang.indices.to_numpy()[text], codes, np.ones(len(at), np.int64)).combined()


# ------------------------------------------------------------------ Spark: counting


def _emit(found: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += len(row[1])
        if size >= 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], ["bucket", "block"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], ["bucket", "block"])


def _first(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for some in gathered(batches, "text", SLICE_BYTES):
        texts, langs = some.column("text"), some.column("lang")
        for data, offsets, number in _text_parts(texts, SLICE_BYTES):
            yield from _emit(count_windows(data, offsets, langs.take(pa.array(number))).blocks(MOST_WORDS - 1, n))
    trim()


def _buckets(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[Windows]:
    """Windows bucket by bucket, from rows sorted by bucket; equal ones are put
    together whenever ``most`` rows have come."""
    current, held, size = None, [], 0
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
            if bucket != current and held:
                yield Windows.together(held).combined()
                held, size = [], 0
            elif size >= most:
                held = [Windows.together(held).combined()]
                size = 0
            current = bucket
            held.append(Windows.unpacked(block))
            size += len(held[-1])
    if held:
        yield Windows.together(held).combined()


def _collected(found: Iterable[Windows], most: int) -> Iterator[Windows]:
    """Small buckets put together, about ``most`` windows at a time."""
    held, size = [], 0
    for w in found:
        held.append(w)
        size += len(w)
        if size >= most:
            yield Windows.together(held).combined()
            held, size = [], 0
    if held:
        yield Windows.together(held).combined()


def _step(batches: Iterable[pa.RecordBatch], shared: int, least: int, n: int) -> Iterator[pa.RecordBatch]:
    cut = (w.cut_back(shared, least) for w in _buckets(batches, BUCKET_WINDOWS))
    yield from _emit(block for w in _collected(cut, BUCKET_WINDOWS) for block in w.blocks(shared - 1, n))
    trim()


def _last(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    cut = (w.cut_back(1, least) for w in _buckets(batches, BUCKET_WINDOWS))
    for w in _collected(cut, BUCKET_WINDOWS // 8):
        columns = [w.langs.take(pa.array(w.lang)), *(w.vocabulary.take(pa.array(c)) for c in w.codes), pa.array(w.n)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", *WORDS, "n"])
    trim()


def frequent_windows(documents: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """lang, w1 to w4, n: the longest windows, cut back to prefixes of at least ``least``."""
    docs = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + int(size) // (6 * BUCKET_WINDOWS)  # a word and its gap take about six bytes
    blocks = docs.mapInArrow(lambda b: _first(b, n), "bucket long, block binary")
    for shared in range(MOST_WORDS - 1, 0, -1):
        met = blocks.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
        if shared == 1:
            columns = ", ".join(f"{c} string" for c in ["lang", *WORDS])
            return met.mapInArrow(lambda b: _last(b, least), f"{columns}, n long")
        blocks = met.mapInArrow(lambda b, shared=shared: _step(b, shared, least, n), "bucket long, block binary")


def phrase_counts(documents: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """lang, words (array), f: every phrase of 1 to 4 words with ``least`` occurrences,
    and for each language a row without words: the number of all its words."""
    columns = ["lang", *WORDS]
    rolled = frequent_windows(documents, least).rollup(*columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    # the columns that are summed over are the last ones: 0, 1, 3, 7, 15
    length = F.lit(MOST_WORDS) - F.bit_count("gid")
    kept = rolled.withColumn("words", F.slice(F.array(*WORDS), F.lit(1), F.greatest(length, F.lit(0))))
    kept = kept.where((length >= 0) & ((length == 0) | ((F.col("f") >= least) & (F.try_element_at("words", F.lit(-1)) != ""))))
    return kept.select("lang", "words", "f")


# ------------------------------------------------------------------ Spark: scoring


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _scored(counts: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut."""
    phrase = counts.where(F.size("words") >= 2).withColumnRenamed("f", "a")
    cuts = phrase.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"left": F.expr("slice(words, 1, k)"), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    side = lambda name, f: counts.where(F.size("words") >= 1).select("lang", F.col("words").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"({SCALE} * cast(a as decimal(28,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "words", "a").agg(best).select("lang", "words", "a", "best.l", "best.r", "best.score")


def _not_absorbed(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one stands for."""
    longer = candidates.where(F.size("words") > 2).select("lang", "words", F.col("a").alias("longer"))
    lengths = F.sequence(F.lit(2), F.size("words") - 1)
    inner = longer.select("lang", "longer", "words", F.explode(lengths).alias("k"))
    inner = inner.select("lang", "longer", "words", "k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("i"))
    most = inner.groupBy("lang", F.expr("slice(words, i, k)").alias("words")).agg(F.max("longer").alias("longer"))
    rows = candidates.join(most, ["lang", "words"], "left")
    absorbed = F.coalesce(_big(F.col("longer")) * 100 >= _big(F.col("a")) * percent, F.lit(False))
    return rows.where(~absorbed).drop("longer")


def collocations(documents: DataFrame, least: int = MIN_COUNT, percent: int = ABSORB_PERCENT, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of ``documents`` (text, lang): lang, rank,
    phrase, a, l, r, n, score."""
    counts = stored(phrase_counts(documents, least), "collocations-counts")
    kept = _not_absorbed(stored(_scored(counts), "collocations-candidates"), percent).withColumn("phrase", F.array_join("words", " "))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    first = kept.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
