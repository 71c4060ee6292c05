"""Exact substring deduplication: sparse suffix buckets, refined by bucket pointers.

Every byte covered by a string of ``WIDTH`` bytes that also starts earlier (smaller
``doc_id``, or the same document and an earlier start) is removed. Suffixes are
sampled by content: a window of ``WIDTH`` bytes is anchored at its leftmost q-gram
of smallest hash, so equal windows have equal anchors at equal offsets, and a run
of windows with one anchor is one sampled suffix. Initial buckets are the anchors'
q-grams. Within a bucket, suffixes whose runs are equal throughout form a class;
all but a class's first occurrence are removed with one comparison. Where a bucket
holds several classes, the windows of their first occurrences are refined: sorted
on the bucket identifiers (q-gram hashes) at later offsets, one offset after the
other, and only windows that still share their bucket go on to the next.

Map tasks combine equal runs first, so a bucket brings a reducer at most one row
per class and map task. Reducers read their rows sorted by Spark, which spills, and hold
one bucket of at most ``LARGE_BUCKET`` classes; buckets with more are refined by a
grouped aggregation over window hashes instead of in one task.

Rows: a null text is empty; texts under ``WIDTH`` bytes lose nothing; where ids
repeat or are null, documents are ordered by id (nulls last) and text, and of equal
rows one comes first; an empty table gives no rows; other columns are kept by
``cut`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.shared import Rolling, expanded, mix, ordered, release, signed, squeezed, stored, text_buffer, trim

WIDTH = 100
#: Bytes of the q-grams that are initial buckets and bucket identifiers.
GRAM = 32
#: Bytes of text hashed in one go; longer texts are read in pieces that overlap.
PIECE_BYTES = 1 << 18
#: Sampled suffixes that a map task sorts together.
CHUNK = 1 << 19
#: Contexts that a task refines together.
REFINED = 1 << 11
#: Classes of a bucket beyond which its windows are grouped by Spark: what a task
#: would have to hold beyond ``REFINED``.
LARGE_BUCKET = REFINED

_U = np.uint64
_GRAMS = WIDTH - GRAM + 1  # grams of a window
_LOW = _U((1 << 24) - 1)

SAMPLED = "at long, c long, oid long, start long, span int"
FOUND = "g long, oid long, start long, span int, end long"
SPAN = "oid long, start long, end long"


def _rows(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


# ------------------------------------------------------------------ sampling


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, _U)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, over texts laid end to end (under 16 MB).

    Returns text index, first window's start in the buffer, number of windows,
    anchor's offset in the first window, anchor's hash and hash of the whole run.
    """
    n = len(data) - WIDTH + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty.view(_U), empty.view(_U)
    rolling = Rolling(data)
    grams = rolling.windows(GRAM)
    # hash and place in one number: the leftmost of equal hashes is the smallest
    low = _window_minima((grams & ~_LOW) | np.arange(len(grams), dtype=_U), _GRAMS)
    anchor = (low & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + WIDTH <= offsets[1:][text]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(begins)
    last = np.flatnonzero(valid & np.append(begins[1:] | ~valid[1:], True))
    count = last - start + 1
    offset = anchor[start] - start
    whole = rolling.ranges(start, last + WIDTH)
    return text[start], start, count, offset, grams[anchor[start]], mix(whole + offset.astype(_U))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffer, offsets, ids and first byte of texts or parts of long texts, about ``PIECE_BYTES`` at a time."""
    data, at = text_buffer(batch.column("text"))
    ids = batch.column("oid").to_numpy()
    parts, size = [], 0

    def out():
        buffer = np.concatenate([data[a:b] for _, a, b, _ in parts])
        offsets = np.concatenate([[0], np.cumsum([b - a for _, a, b, _ in parts])])
        return buffer, offsets, np.array([i for i, *_ in parts]), np.array([f for *_, f in parts])

    for i in range(len(ids)):
        lo, hi = int(at[i]), int(at[i + 1])
        if hi - lo < WIDTH:
            continue
        for a in range(lo, hi - WIDTH + 1, PIECE_BYTES):
            b = min(hi, a + PIECE_BYTES + WIDTH - 1)
            if size and size + b - a > PIECE_BYTES:
                yield out()
                parts, size = [], 0
            parts.append((ids[i], a, b, a - lo))
            size += b - a
    if parts:
        yield out()


def merged(oid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching byte ranges, per document."""
    if not len(oid):
        return oid, start, end
    order = np.lexsort((start, oid))
    oid, start, end = oid[order], start[order], end[order]
    new = np.ones(len(oid), bool)
    new[1:] = oid[1:] != oid[:-1]
    group = np.cumsum(new)
    # running maximum of the ends within a document: shifted apart by document
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return oid[first], start[first], np.maximum.reduceat(end, first)


def _sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    n_held = 0

    def flush():
        nonlocal held, n_held
        if held:
            oid, start, span, g, c = (np.concatenate(x) for x in zip(*held))
            held = []
            order = np.lexsort((start, oid, c, g))
            oid, start, span, g, c = oid[order], start[order], span[order], g[order], c[order]
            first = np.ones(len(g), bool)
            first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            yield _rows(SAMPLED, signed(g[first]), signed(c[first]), oid[first], start[first], span[first])
            rest = ~first
            # the chunk's own repetitions need no reducer
            o, s, e = merged(oid[rest], start[rest], start[rest] + (span[rest] >> 7) + WIDTH)
            yield _rows(SAMPLED, signed(mix(o.view(_U) + mix(s.view(_U)))), e, o, s, pa.nulls(len(o), pa.int32()))
        held, n_held = [], 0

    for batch in batches:
        for data, offsets, ids, begin in _pieces(batch):
            text, start, count, offset, g, c = sampled(data, offsets)
            own = start - offsets[text] + begin[text]
            held.append((ids[text], own, ((count - 1) << 7 | offset).astype(np.int32), g, c))
            n_held += len(own)
            if n_held >= CHUNK:
                yield from flush()
    yield from flush()
    trim()


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's classes the first occurrences, if there are several classes;
    ranges of all other occurrences. Rows come sorted by bucket, class and place; what is
    held is the first class of the bucket that is being read, and ranges to merge."""
    empty = np.empty(0, np.int64)
    g0, c0, only = empty, empty, [empty] * 4  # bucket and class read last; its row, while the bucket has one class
    ranges, n_ranges = [], 0

    def joined():
        o, s, e = merged(*(np.concatenate(x) for x in zip(*ranges)))
        return _rows(FOUND, pa.nulls(len(o), pa.int64()), o, s, pa.nulls(len(o), pa.int32()), e)

    for batch in batches:
        ready = batch.filter(batch.column("span").is_null())
        own = batch.filter(batch.column("span").is_valid())
        ranges.append([ready.column(x).to_numpy() for x in ("oid", "start", "c")])
        n_ranges += len(ready)
        if len(own):
            g, c, oid, start, span = (own.column(x).to_numpy() for x in ("at", "c", "oid", "start", "span"))
            before_g, before_c = np.concatenate([g0, g])[-len(g) - 1 : -1], np.concatenate([c0, c])[-len(g) - 1 : -1]
            bucket = np.ones(len(g), bool)
            bucket[len(g) - len(before_g) :] = g[len(g) - len(before_g) :] != before_g
            first = bucket.copy()
            first[len(g) - len(before_c) :] |= c[len(g) - len(before_c) :] != before_c
            g0, c0 = g[-1:], c[-1:]
            # classes, after the one that still waits for another in its bucket
            row = [np.concatenate([w, x[first]]) for w, x in zip(only, (g, oid, start, span))]
            alone = np.concatenate([np.ones(len(only[0]), bool), bucket[first]])
            several = ~alone
            several[:-1] |= several[1:]
            if len(alone):
                only = [x[-1:] if alone[-1] else empty for x in row]
            if several.any():
                yield _rows(FOUND, *(x[several].astype(np.int64) for x in row[:3]), row[3][several].astype(np.int32), pa.nulls(int(several.sum()), pa.int64()))
            rest = ~first
            ranges.append([oid[rest], start[rest], start[rest] + (span[rest] >> 7) + WIDTH])
            n_ranges += int(rest.sum())
        if n_ranges >= CHUNK // 4:
            yield joined()
            ranges, n_ranges = [], 0
    if ranges:
        yield joined()
    trim()


# ------------------------------------------------------------------ refinement

CONTEXT = "g long, oid long, start long, span int, context binary"


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run to refine, cut out of its text."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        runs = batch.column("runs")
        at = runs.offsets.to_numpy()
        at = at - at[0]
        flat = runs.flatten()
        g, start, span = (flat.field(i) for i in range(3))
        starts, spans = start.to_numpy(), span.to_numpy()
        ids = np.repeat(batch.column("oid").to_numpy(), np.diff(at))
        cut: list[bytes] = []
        begin = 0

        def out(end: int) -> pa.RecordBatch:
            return _rows(CONTEXT, *(x[begin:end] for x in (g, ids, start, span)), pa.array(cut, pa.binary()))

        for i, text in enumerate(batch.column("text")):
            raw = expand.decompress(text.as_py())
            for k in range(at[i], at[i + 1]):
                cut.append(raw[starts[k] : starts[k] + (spans[k] >> 7) + WIDTH])
                if len(cut) == REFINED:
                    yield out(k + 1)
                    begin, cut = k + 1, []
        if cut:
            yield out(begin + len(cut))
    trim()


def _windows(table: pa.Table) -> tuple[np.ndarray, ...]:
    """All windows of runs: initial bucket (anchor and offset), place in the buffer,
    document, start; and the bucket identifiers of the buffer's positions."""
    data, at = text_buffer(table.column("context"))
    span = table.column("span").to_numpy().astype(np.int64)
    count, offset = (span >> 7) + 1, span & 127
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    bucket = mix(table.column("g").to_numpy().view(_U)[row] + mix((offset[row] - k + WIDTH).astype(_U)))
    return bucket, at[:-1][row] + k, table.column("oid").to_numpy()[row], table.column("start").to_numpy()[row] + k, Rolling(data).windows(GRAM)


#: Later offsets whose bucket identifiers, with the window's first, span a window.
LATER = (0, WIDTH - GRAM, *range(GRAM, WIDTH - GRAM, GRAM))


def refine(bucket: np.ndarray, place: np.ndarray, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that share all their bytes with another, and their final bucket.

    Each step sorts what is left on the bucket identifiers at one later offset; a
    window that is alone in its bucket is settled and not looked at again.
    """
    left = np.arange(len(bucket))
    for off in LATER:
        bucket = mix(bucket + pointers[place[left] + off])
        order = np.argsort(bucket)
        s = bucket[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        keep = order[same[1:] | same[:-1]]
        left, bucket = left[keep], bucket[keep]
    return left, bucket


def _whole_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``g`` in tables of whole buckets, about ``REFINED`` rows each."""
    held, n = [], 0
    for batch in batches:
        for a in range(0, len(batch), REFINED):
            held.append(batch.slice(a, REFINED))
            n += len(held[-1])
            if n < REFINED:
                continue
            rows = pa.Table.from_batches(held)
            g = rows.column("g").to_numpy()
            end = int(np.argmax(g == g[-1]))  # the last bucket may go on
            if end:
                yield rows.slice(0, end)
            held = rows.slice(end).to_batches()
            n -= end
    if n:
        yield pa.Table.from_batches(held)


def _refine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows; rows come sorted by bucket."""
    for rows in _whole_buckets(batches):
        bucket, place, oid, start, pointers = _windows(rows.combine_chunks())
        left, bucket = refine(bucket, place, pointers)
        oid, start = oid[left], start[left]
        order = np.lexsort((start, oid, bucket))
        oid, start, bucket = oid[order], start[order], bucket[order]
        again = np.zeros(len(bucket), bool)
        again[1:] = bucket[1:] == bucket[:-1]
        yield _rows(SPAN, *merged(oid[again], start[again], start[again] + WIDTH))
    trim()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final bucket, document and start of every window."""
    for batch in batches:
        for a in range(0, len(batch), REFINED):
            bucket, place, oid, start, pointers = _windows(pa.Table.from_batches([batch.slice(a, REFINED)]).combine_chunks())
            for off in LATER:
                bucket = mix(bucket + pointers[place + off])
            yield _rows("bucket long, oid long, start long", signed(bucket), oid, start)
    trim()


# ------------------------------------------------------------------ Spark


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        texts = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("oid"), pa.array(texts, pa.binary())], ["oid", "text"])
    trim()


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For ``docs`` (oid, text): spans per document (oid, spans), the compressed texts
    of these documents (oid, text), and ``oid, n_bytes, sha, copy`` of all documents,
    where ``copy`` marks whole copies of an earlier text (not among the spans)."""
    docs = docs.select("oid", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    facts = stored(docs.select("oid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "substring-facts")
    originals = facts.filter(F.col("n_bytes") >= WIDTH).groupBy("sha").agg(F.min("oid").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    facts = facts.join(stored(originals, "substring-originals"), "sha", "left")
    facts = stored(facts.select("oid", "n_bytes", "sha", F.coalesce(F.col("oid") > F.col("original"), F.lit(False)).alias("copy")), "substring-facts")
    copies = facts.filter("copy").select("oid")

    found = docs.mapInArrow(_sample, SAMPLED).repartition("at").sortWithinPartitions("at", "c", "oid", "start").mapInArrow(_classes, FOUND)
    found = stored(found, "substring-found").join(copies, "oid", "left_anti")
    found = stored(found, "substring-found")
    release(docs.sparkSession)
    several = found.filter("g is not null").select("g", "oid", "start", "span")
    known = found.filter("g is null").select("oid", "start", "end")
    texts = docs.mapInArrow(_packed, "oid long, text binary")
    texts = stored(texts.join(found.select("oid").distinct().hint("merge"), "oid", "left_semi"), "substring-texts")
    release(docs.sparkSession)
    runs = several.groupBy("oid").agg(F.collect_list(F.struct("g", "start", "span")).alias("runs"))
    contexts = runs.join(texts, "oid").select("oid", "runs", "text").mapInArrow(_contexts, CONTEXT)
    large = stored(several.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE_BUCKET).select("g"), "substring-large")
    if large.isEmpty():
        refined = contexts.repartition("g").sortWithinPartitions("g").mapInArrow(_refine, SPAN)
    else:
        contexts = stored(contexts, "substring-contexts")
        refined = contexts.join(large, "g", "left_anti").select(*[x.split()[0] for x in CONTEXT.split(", ")]).repartition("g").sortWithinPartitions("g").mapInArrow(_refine, SPAN)
        windows = contexts.join(large, "g", "left_semi").select(*[x.split()[0] for x in CONTEXT.split(", ")]).mapInArrow(_hashed, "bucket long, oid long, start long")
        windows = stored(windows, "substring-windows")
        first = windows.groupBy("bucket").agg(F.min(F.struct("oid", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        again = windows.join(stored(first.drop("n"), "substring-first"), "bucket").filter(F.struct("oid", "start") > F.col("first"))
        refined = refined.unionByName(again.select("oid", "start", (F.col("start") + WIDTH).alias("end")))
    spans = known.unionByName(stored(refined, "substring-refined"))
    spans = spans.groupBy("oid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return stored(spans, "substring-spans"), texts, facts


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    o, s, e = merged(*(np.array([0 if k is None else x[k] for x in spans], np.int64) for k in (None, "start", "end")))
    return list(zip(s.tolist(), e.tolist()))


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for oid, spans, text in zip(*(batch.column(c).to_pylist() for c in ("oid", "spans", "text"))):
            spans, raw = _union(spans), expand.decompress(text)
            rows.append((oid, sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(raw, spans)).hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        yield _rows(DIGEST, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))))


DIGEST = "oid long, removed long, pieces long, kept string"


def digests(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = ordered(documents.select("doc_id", "text"))
    spans, texts, facts = repeated_spans(docs)
    cut = spans.join(texts, "oid").select("oid", "spans", "text").mapInArrow(_digest, DIGEST)
    rows = docs.select("doc_id", "oid").join(facts, "oid").join(stored(cut, "substring-digests"), "oid", "left")
    empty = hashlib.sha256(b"").hexdigest()
    whole = F.when(F.col("copy"), F.col("n_bytes"))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.coalesce(whole, "removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.when(F.col("copy"), 1), "pieces", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.when(F.col("copy"), empty), "kept", "sha").alias("kept_sha256"),
    )


def cut(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated passages cut out of ``text``. A character of which
    any byte goes, goes whole. Null texts stay null."""
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text")).alias("row")
    docs = ordered(documents.select("doc_id", "text", row))
    spans, _, facts = repeated_spans(docs)
    release(documents.sparkSession)
    whole = facts.filter("copy").select("oid", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"))
    rows = squeezed(docs.select("oid", "row", "text")).join(spans.unionByName(whole).hint("merge"), "oid", "left")
    rows = expanded(rows.select("row", "text", "spans"))
    names = documents.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = [
                t if not s else without(t.encode(), _union(s)).decode(errors="ignore")
                for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in names], names)

    return rows.mapInArrow(run, documents.schema)
