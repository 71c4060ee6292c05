"""Packing token sequences by minimum bin slack.

Documents are tokenised once and cut at multiples of the window; what packing has
to place is the last piece of each document. Pieces of one length are alike, so
the plan is made on the counts per length: seed a window with the largest length
that is left, find by a bitset subset-sum over the other lengths the multiset that
fills the window closest to its capacity, trace it back into counts per length,
and use the same pattern as often as the counts allow. The plan's size depends on
the window, not on the corpus: it is the only thing the driver holds, and it is
broadcast (at most a few patterns per length, each of at most ``capacity`` lengths).

A window that cannot be filled is left at the largest power of two that some
multiset reaches exactly, if there is one, since such a sequence needs no padding.

Pieces are numbered by length within their map task; running totals over the
tasks' counts turn that into a rank among all pieces of the length, and a rank
into a window of the plan.

Rows: a null or empty text is its end token alone; rows that repeat a ``doc_id``
(or have none) are packed like any others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanlake.llm.shared import BLANK, LOWER, slices, stored, text_buffer, trim

CAPACITY = 4096
END_ID = 2
SLICE_BYTES = 1 << 20
#: Distinct words whose ids a worker keeps before it starts anew.
CACHED_WORDS = 1 << 18

_MARK = np.isin(np.arange(256), [ord(c) for c in ".,!?;:"])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])

#: Byte-level signs: a printable Latin-1 byte is its own sign, the others follow from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"


# ------------------------------------------------------------------ tokens


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer of a file, once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokens:
    """Ids of whole texts by way of their distinct words.

    The tokenizer lower-cases, drops white space and never merges across it or
    between a letter and a punctuation mark, so a text's ids are those of its words
    one after another, and each distinct word is encoded once. Words are cut at
    ASCII blanks and after a letter before ``.,!?;:``; any other white space or
    mark stays inside a word and is left to the tokenizer. A word of Latin-1 letters
    alone goes to the tokenizer's model directly: what comes before the model only
    lower-cases it and writes its bytes as signs.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.clear()

    def clear(self) -> None:
        # word 0 stands for the end token
        self.known = pa.array([""], pa.string())
        self.ids, self.starts, self.lengths = np.zeros(1, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int32)

    def _learn(self, words: list[str]) -> None:
        found: list = [None] * len(words)
        tokenize = self.tokenizer.model.tokenize
        plain = [i for i, w in enumerate(words) if w.isascii() and w.isalpha()]
        for i, w in zip(plain, "\n".join([words[i] for i in plain]).lower().split("\n")):
            found[i] = [t.id for t in tokenize(w)]
        other = [i for i, x in enumerate(found) if x is None]
        latin = [i for i in other if words[i].isalpha() and max(words[i]) <= "\xff"]
        # (put together with a mark that is its own sign)
        signs = "!".join([words[i] for i in latin]).lower().encode().decode("latin-1").translate(_BYTE_SIGNS)
        for i, w in zip(latin, signs.split("!")):
            found[i] = [t.id for t in tokenize(w)]
        other = [i for i in other if found[i] is None]
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                found[i] = x.ids
        self.known = pa.concat_arrays([self.known, pa.array(words, pa.string())])
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, each text's followed by ``end_id``, and len+1 offsets."""
        if len(self.known) > CACHED_WORDS:
            self.clear()
        data, offsets = text_buffer(texts)
        if b"<|" not in data.tobytes():  # else a special token might be spelt
            data = LOWER[data]
        solid = ~BLANK[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | (_MARK[data[1:]] & _LETTER[data[:-1]])
        edge = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[edge] = solid[edge]
        first = np.flatnonzero(begins)
        at = np.searchsorted(first, offsets)
        letters = data[solid]
        bounds = np.append(np.cumsum(solid, dtype=np.int32)[first] - 1, len(letters)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
        number = pc.index_in(coded.dictionary, value_set=self.known)
        if number.null_count:
            new = pc.is_null(number)
            before = len(self.known)
            self._learn(coded.dictionary.filter(new).to_pylist())
            number = pc.if_else(new, pa.array(before - 1 + np.cumsum(new.to_numpy(zero_copy_only=False)), pa.int32()), number)
        word = np.insert(number.to_numpy()[coded.indices.to_numpy()], at[1:], 0)
        length = self.lengths[word]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(length, dtype=np.int64)])
        flat = np.repeat((self.starts[word] - before[:-1]).astype(np.int32), length)
        flat += np.arange(before[-1], dtype=np.int32)
        out = self.ids[flat]
        ends = before[at[1:] + np.arange(1, len(texts) + 1)]
        out[ends - 1] = end_id
        return out, np.concatenate([np.zeros(1, np.int64), ends])


def _pieces(batches: Iterable[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens, part, used = WordTokens(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for some in slices(batch, "text", SLICE_BYTES):
            ids, offsets = tokens.encode(some.column("text"), end_id)
            size = np.diff(offsets)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, size[row] - start)
            little = ids.astype("<u4")
            lo = offsets[row] + start
            crc = [zlib.crc32(little[a:b]) for a, b in zip(lo.tolist(), (lo + length).tolist())]
            order = np.argsort(length, kind="stable")
            first = np.ones(len(order), bool)
            first[1:] = length[order][1:] != length[order][:-1]
            run = np.flatnonzero(first)
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - run[np.cumsum(first) - 1] + used[length[order]]
            np.add.at(used, length, 1)
            columns = [some.column("doc_id").take(pa.array(row)), start, length, np.array(crc, np.int64), size[row], np.full(len(row), part), nth]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
    tokens.clear()
    trim()


def tokenized_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids (rows of ``PIECES``, with ``ids`` if asked for)."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.mapInArrow(lambda b: _pieces(b, path, capacity, end_id, keep_ids), schema)


# ------------------------------------------------------------------ plan


def fill(count: dict[int, int], room: int, lengths: list[int], targets: list[int] | None = None) -> dict[int, int]:
    """Counts per length of a multiset that fits ``room`` and fills it best.

    ``lengths`` are tried in order. With ``targets``, the multiset meets the first
    of them that can be met exactly, and is empty if none can.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    goal = (targets or [room])[0]
    for length in lengths:
        left, k = count.get(length, 0), 1
        while left and k * length <= room:
            k = min(k, left)
            after = (reach | reach << (k * length)) & mask
            if after != reach:
                steps.append((k, length, reach))
                reach = after
            left -= k
            k *= 2
        if reach >> goal & 1:
            break
    if targets is None:
        at = reach.bit_length() - 1
    else:
        at = next((t for t in targets if reach >> t & 1), 0)
    used: dict[int, int] = {}
    for k, length, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return used


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, counts per length) that place every piece once."""
    count = {k: v for k, v in count.items() if v}
    powers = [1 << i for i in range(capacity.bit_length() - 1, -1, -1)]
    out = []
    lengths = sorted(count, reverse=True)
    while lengths:
        seed = lengths[0]
        room = capacity - seed
        count[seed] -= 1
        others = [x for x in lengths if x <= room]
        pattern = fill(count, room, others)
        total = seed + sum(k * v for k, v in pattern.items())
        if total < capacity and total & (total - 1):
            targets = [p - seed for p in powers if seed < p <= total]
            pattern = (fill(count, room, others, targets) if targets and seed & (seed - 1) else {}) or ({} if not seed & (seed - 1) else pattern)
        count[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(count[k] // v for k, v in pattern.items())
        for k, v in pattern.items():
            count[k] -= times * v
        out.append((times, pattern))
        lengths = [x for x in lengths if count[x]]
    return out


PLAN = "length long, lo long, hi long, first_sequence long, per_window long, first_offset long"


def plan_rows(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple]:
    """Ranks [lo, hi) of a length go to windows from ``first_sequence`` on, ``per_window`` to each."""
    rows, used, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n, lo = pattern[length], used.get(length, 0)
            rows.append((length, lo, lo + n * times, sequence, n, offset))
            used[length] = lo + n * times
            offset += n * length
        sequence += times
    return rows


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = documents.sparkSession
    pieces = stored(tokenized_pieces(documents, path, capacity, end_id, keep_ids), "packing-pieces")
    sums = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))
    # one row per length: at most ``capacity``
    count = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(plan_rows(plan(count, capacity)), PLAN)
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    own = places.withColumnRenamed("length", "own_length")
    placed = ranked.join(F.broadcast(own), (F.col("length") == F.col("own_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    columns = [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("per_window"))).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_window") * F.col("length")).alias("offset"),
    ]
    return placed.select(*columns, *(["ids"] if keep_ids else []))
