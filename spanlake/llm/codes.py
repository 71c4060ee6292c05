"""Token files of directly addressable codes: any id of a corpus without decoding a block.

An id is split into chunks of bits, the lowest first. Level 0 holds the first chunk
of every id, level 1 the second chunk of those ids that need one, and so on. A
level's continuation bitmap says which of its ids go on, and their places in the
next level are ranks in that bitmap, read off a directory of running counts for
every ``RANK_BITS`` bits. So one id takes a few short reads, a range of ids is a
range on every level, and nothing before it is decoded. Chunk widths are chosen
file by file: of all splits, the one whose levels and bitmaps take the fewest bits.

File: magic, sizes and widths, places of the sections; document ids, which of them
are null, and each document's first id; then per level its chunks (bit-packed,
highest bit first), bitmap and directory. Little-endian throughout.

Documents are sorted by ``doc_id``, a task encodes its range of them, and a file
closes after the document that fills it. Files have names of their own; those of
successful attempts are in the manifest, which Spark commits, with the number of ids
before each. Running totals over tasks come from one row per task.

Rows: a null or empty text is its end id alone; a null ``doc_id`` stays null and
comes last; rows that share a ``doc_id`` are in order of their texts' hashes, then
their texts; an empty table gives an empty manifest; other columns are ignored; a
text of any length lies in one file whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanlake.llm.packing import WordTokens
from spanlake.llm.shared import gathered, shared_path, stored, trim

END_ID = 1
#: A file closes once it holds so many ids.
FILE_IDS = 1 << 22
#: Bits of a continuation bitmap for each entry of its rank directory.
RANK_BITS = 512
#: Ids that are packed or unpacked at a time.
BLOCK = 1 << 18
SLICE_BYTES = 4 << 20

MAGIC = b"SPANDAC1"
MANIFEST = "path string, part long, nth long, n_docs long, n_ids long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ------------------------------------------------------------------ bits


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after another."""
    out = []
    for i in range(0, len(values), BLOCK):
        raw = values[i : i + BLOCK].astype(">u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(raw, axis=1)[:, 32 - width :].reshape(-1)).tobytes())
    return b"".join(out)


def unpack_bits(raw: bytes, first_bit: int, n: int, width: int) -> np.ndarray:
    """``n`` values of ``width`` bits from ``first_bit`` of ``raw`` on."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))[first_bit : first_bit + n * width].reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide, axis=1).reshape(-1).view(">u4").astype(np.uint32)


def chunk_widths(ids: np.ndarray) -> list[int]:
    """Widths of the levels, lowest bits first, that take the fewest bits for ``ids``."""
    most = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    # longer[b]: ids that need more than b bits
    longer = [len(ids), *(int(np.count_nonzero(ids >> np.uint32(b))) for b in range(1, most))]
    best: list[tuple[int, list[int]]] = [(0, [])] * most + [(0, [])]
    for b in range(most - 1, -1, -1):
        splits = []
        for w in range(1, most - b + 1):
            rest, widths = best[b + w]
            splits.append((longer[b] * (w + (b + w < most)) + rest, [w, *widths]))
        best[b] = min(splits)
    return best[0][1]


# ------------------------------------------------------------------ one file


def encode_file(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """A file of ``ids`` (uint32); document i begins at ``starts[i]``."""
    sections = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes(),
        np.asarray(starts, "<i8").tobytes(),
    ]
    widths, counts, rest = chunk_widths(ids), [], ids
    for at, width in enumerate(widths):
        counts.append(len(rest))
        more = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        goes_on = more > 0
        sections.append(pack_bits(rest, width))
        if at + 1 < len(widths):
            blocks = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.int64) if len(rest) else np.zeros(0, np.int64)
            sections += [np.packbits(goes_on).tobytes(), (np.cumsum(blocks) - blocks).astype("<i8").tobytes()]
            rest = more[goes_on]
    head = struct.pack("<8sqqq", MAGIC, len(ids), len(doc_ids), len(widths))
    head += np.array([*widths, *counts], "<i8").tobytes()
    place, places = len(head) + 8 * len(sections), []
    for s in sections:
        places.append(place)
        place += len(s)
    return b"".join([head, np.array(places, "<i8").tobytes(), *sections])


class TokenFile:
    """Reads a file through ``read(offset, n_bytes)``, only what it is asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, self.n_ids, self.n_docs, levels = struct.unpack("<8sqqq", read(0, 32))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {magic!r}")
        numbers = np.frombuffer(read(32, 8 * (2 * levels + 3 + 3 * levels - 2)), "<i8").tolist()
        self.widths, self.counts, places = numbers[:levels], numbers[levels : 2 * levels], numbers[2 * levels :]
        self.documents, self.places = places[:3], places[3:]

    def directory(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids and where each document begins, with the end of the last."""
        ids, nulls, starts = self.documents
        found = np.frombuffer(self.read(ids, 8 * self.n_docs), "<i8").tolist()
        missing = np.unpackbits(np.frombuffer(self.read(nulls, -(-self.n_docs // 8)), np.uint8))[: self.n_docs]
        begins = np.frombuffer(self.read(starts, 8 * self.n_docs), "<i8")
        return [None if m else d for d, m in zip(found, missing)], np.append(begins, self.n_ids)

    def _rank(self, level: int, i: int) -> int:
        """Ids before ``i`` on a level that go on to the next."""
        _, bitmap, directory = self.places[3 * level : 3 * level + 3]
        block = min(i, self.counts[level] - 1) // RANK_BITS
        before = struct.unpack("<q", self.read(directory + 8 * block, 8))[0]
        inside = i - block * RANK_BITS
        bits = np.unpackbits(np.frombuffer(self.read(bitmap + block * RANK_BITS // 8, -(-inside // 8)), np.uint8))
        return before + int(bits[:inside].sum())

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids from ``lo`` to before ``hi``."""
        out, shift, where = np.zeros(hi - lo, np.uint32), 0, None
        for level, width in enumerate(self.widths):
            n = hi - lo
            if not n:
                break
            at, bit = divmod(lo * width, 8)
            raw = self.read(self.places[3 * level] + at, -(-(bit + n * width) // 8))
            chunks = unpack_bits(raw, bit, n, width) << np.uint32(shift)
            if where is None:
                out |= chunks
                where = np.arange(n)
            else:
                out[where] |= chunks
            if level + 1 == len(self.widths):
                break
            at, bit = divmod(lo, 8)
            bits = np.unpackbits(np.frombuffer(self.read(self.places[3 * level + 1] + at, -(-(bit + n) // 8)), np.uint8))
            where = where[bits[bit : bit + n] > 0]
            lo = self._rank(level, lo)
            hi = lo + len(where)
            shift += width
        return out

    def id_at(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])


# ------------------------------------------------------------------ Spark: writing


def _write(batches: Iterable[pa.RecordBatch], path: str, folder: str, end_id: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    tokens, part, rows = WordTokens(path), TaskContext.get().partitionId(), []
    ids: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    docs: list[int | None] = []
    held = 0

    def close() -> None:
        nonlocal held
        uri = f"{folder}/{uuid.uuid4().hex}.dac"
        size = np.concatenate(lengths)
        raw = encode_file(np.concatenate(ids), np.cumsum(size) - size, docs)
        fs, place = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(place, compression=None) as out:
            out.write(raw)
        rows.append((uri, part, len(rows), len(docs), held, len(raw)))
        ids.clear(), lengths.clear(), docs.clear()
        held = 0

    for some in gathered(batches, "text", SLICE_BYTES):
        flat, offsets = tokens.encode(some.column("text"), end_id)
        doc_ids, lo = some.column("doc_id").to_pylist(), 0
        while lo < len(doc_ids):
            # up to the document that fills the file
            hi = min(int(np.searchsorted(offsets, offsets[lo] + file_ids - held)), len(doc_ids))
            ids.append(flat[offsets[lo] : offsets[hi]])
            lengths.append(np.diff(offsets[lo : hi + 1]))
            docs += doc_ids[lo:hi]
            held += len(ids[-1])
            lo = hi
            if held >= file_ids:
                close()
    if held:
        close()
    tokens.clear()
    trim()
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows) if rows else [[]] * 6)], names)


def write_files(documents: DataFrame, path: str, folder: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of ``documents`` (doc_id, text) below ``folder``; the stored manifest,
    with ``base``, the number of ids in all files before."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    last = F.col("doc_id").asc_nulls_last()
    docs = docs.repartitionByRange(last, "h").sortWithinPartitions(last, "h", "text").drop("h")
    files = stored(docs.mapInArrow(lambda b: _write(b, path, folder, end_id, file_ids), MANIFEST), "codes-files")
    # a total per task, running totals over the tasks, then within each task
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    before = lambda value, w: F.coalesce(F.sum(value).over(earlier(w)), F.lit(0).cast("long"))
    tasks = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before("n", W.orderBy("part")).alias("task_base"))
    files = files.join(tasks, "part").withColumn("base", F.col("task_base") + before("n_ids", W.partitionBy("part").orderBy("nth")))
    return stored(files.drop("task_base"), "codes-manifest")


# ------------------------------------------------------------------ Spark: reading


def _opened(uri: str):
    fs, place = pa.fs.FileSystem.from_uri(uri)
    source = fs.open_input_file(place)

    def read(offset: int, n: int) -> bytes:
        source.seek(offset)
        raw = source.read(n)
        if len(raw) != n:
            raise ValueError(f"{uri} ends at byte {offset + len(raw)}")
        return raw

    return source, TokenFile(read)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DOCUMENTS.split(", ")]
    for batch in batches:
        for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            source, file = _opened(uri)
            with source:
                doc_ids, starts = file.directory()
                crc = np.zeros(len(doc_ids), np.int64)
                # documents in blocks of ids; one that goes beyond a block is carried on
                for lo in range(0, file.n_ids, BLOCK):
                    hi = min(lo + BLOCK, file.n_ids)
                    raw = memoryview(file.ids(lo, hi).astype("<u4")).cast("B")
                    for d in range(int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi, "left"))):
                        a, b = max(int(starts[d]), lo), min(int(starts[d + 1]), hi)
                        crc[d] = zlib.crc32(raw[4 * (a - lo) : 4 * (b - lo)], int(crc[d]))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc)], names)
    trim()


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    n_files = max(1, manifest.count())
    return manifest.select("path", "base").repartition(n_files).mapInArrow(_documents, DOCUMENTS)


def _lookup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    source = file = uri = None
    for batch in batches:
        found = []
        for path, position, base in zip(*(batch.column(c).to_pylist() for c in ("path", "position", "base"))):
            if path != uri:
                if source is not None:
                    source.close()
                (source, file), uri = _opened(path), path
            found.append(file.id_at(position - base))
        yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(found, pa.int64())], ["position", "id"])
    if source is not None:
        source.close()


def lookup(manifest: DataFrame, positions: DataFrame, span: int = FILE_IDS) -> DataFrame:
    """``position`` and ``id`` for each row of ``positions`` (position: ids before it in
    the corpus) that lies in the corpus. Files and positions meet by their multiples of
    ``span``; each position then takes a few short reads."""
    first, last = F.floor(F.col("base") / span), F.floor((F.col("base") + F.col("n_ids") - 1) / span)
    files = manifest.select("path", "base", "n_ids", F.explode(F.sequence(first, last)).alias("key"))
    wanted = positions.select(F.col("position").cast("long").alias("position")).withColumn("key", F.floor(F.col("position") / span))
    hits = wanted.join(files, "key").where((F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("n_ids")))
    return hits.select("path", "position", "base").sortWithinPartitions("path", "position").mapInArrow(_lookup, "position long, id long")


def round_trip(spark: SparkSession, documents: DataFrame, path: str) -> DataFrame:
    """Write the files below the shared folder and read every document back from them."""
    return read_documents(write_files(documents, path, shared_path(spark, "codes")))
