"""N-gram Jaccard join by parity sketches: exact near-duplicate components.

A document is the set of hashes of its word shingles. Its *parity sketch* cuts
the hash space into ``k`` blocks and keeps the XOR of the hashes in each block; a
shingle that two documents do not share changes one block, so the number of
differing blocks (the Hamming distance over blocks) is at most the symmetric
difference of the sets. Linked sets of sizes n and m have a symmetric difference
of at most (n + m)(1 - t)/(1 + t) and, seen from either side, of at most
d = n(1 - t)/t. So (pigeonhole) among any d + 1 non-empty blocks that both
documents pick by the same order, one is equal. Documents emit those blocks as
join keys, per band of sizes; a document with too few non-empty blocks emits all
its blocks, the empty ones as well. A second sketch, one bit of XOR per hash,
drops candidates whose bit distance is already too large. What is left is
verified on the whole sets.

Work stays linear in groups of copies. Equal sets are one class. The documents of
a key are compared with its smallest id (first within a map task, so one key
never brings more rows to a reducer than there are map tasks); components of the
verified links follow. Only keys whose documents then lie in several components
get the other pairs, between different components; a key of very many documents
is cut into blocks that meet pair by pair.

Rows: a null, empty or blank text has no shingle, size 0 and no link; fewer words
than the shingle width make one shingle; rows sharing a ``doc_id`` are one node
that has the links of each; a null ``doc_id`` has no link and a null component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.shared import components, expanded, mix, ordered, release, shingle_hashes, signed, slices, squeezed, stored, text_buffer, trim

#: Words of a shingle, and the least Jaccard similarity as a fraction (over one half).
WIDTH = 5
THRESHOLD = (3, 4)
#: Text bytes handled in one go, and keys that a map task sorts together.
SLICE_BYTES = 1 << 19
#: Unpacked bytes of the texts that are verified together.
PLAIN_BYTES = 1 << 20
#: Rows with sketches that a task compares, about.
ROWS_PER_TASK = 1 << 15
CHUNK_KEYS = 1 << 18
#: Bytes of whole groups that are compared in one go.
GROUP_BYTES = 4 << 20
#: Blocks of a size band [2**i, 2**(i+1)): 2**i of them, twice as many in small bands.
SMALL_BAND = 64
LEAST_BLOCKS = 16
#: Bits of the second sketch: the power of two for this many bits per hash, within these.
BITS_PER_HASH = 4
SKETCH_BITS = (64, 1 << 16)
#: Documents of a key that are compared in one group; larger keys are cut into
#: blocks, and each pair of blocks is a group of its own.
BLOCK_DOCS = 2048

_U = np.uint64


def unique_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and len+1 offsets."""
    flat, offsets = shingle_hashes(column, width)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        flat[lo:hi].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[offsets[:-1][offsets[:-1] < len(flat)]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, _U), np.cumsum(values)])[offsets])


def _set_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, independent of order."""
    return _sums(mix(flat ^ _U(0x5851F42D4C957F2D)), offsets), _sums(mix(flat + _U(0x14057B7EF767814F)), offsets)


def _bit_sketch(s: np.ndarray) -> np.ndarray:
    bits = min(max(SKETCH_BITS[0], 1 << (BITS_PER_HASH * len(s) - 1).bit_length()), SKETCH_BITS[1])
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


FEATURES = "doc_id long, n long, h1 long, h2 long, sketch array<long>"


def _features(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            flat, offsets = unique_sets(part.column("text"), width)
            h1, h2 = _set_hashes(flat, offsets)
            sketches = [_bit_sketch(flat[a:b]) if b > a else np.empty(0, np.int64) for a, b in zip(offsets[:-1], offsets[1:])]
            at = np.concatenate([[0], np.cumsum([len(x) for x in sketches])])
            words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*sketches, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), signed(h1), signed(h2), words], ["doc_id", "n", "h1", "h2", "sketch"]
            )
    trim()


# ------------------------------------------------------------------ keys


def block_keys(flat: np.ndarray, offsets: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of each set and the index of the set they belong to.

    Two linked sets have a key in common. Blocks with more hashes come first in
    the common order: they are the least likely to be equal by a shared passage.
    """
    num, den = threshold
    n = np.diff(offsets)
    index = np.flatnonzero(n > 0)
    band = np.array([int(x).bit_length() - 1 for x in n[index]], np.int64)
    upper = den * n[index] >= num * (np.int64(2) << band)  # partners in the next band
    keys, owners = [], []
    for layout, sets in ((band, index), (band[upper] + 1, index[upper])):
        if not len(sets):
            continue
        k = np.maximum(LEAST_BLOCKS, np.where((1 << layout) < SMALL_BAND, 2 << layout, 1 << layout))
        size = n[sets]
        row = np.repeat(np.arange(len(sets)), size)
        h = flat[np.repeat(offsets[sets] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        block = ((h >> _U(32)) * k[row].astype(_U)) >> _U(32)  # rises with the hash: sets are sorted by block
        first = np.ones(len(h), bool)
        first[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(first)
        count = np.diff(np.append(starts, len(h)))
        owner = row[starts]
        place = mix(block[starts] + (layout[owner].astype(_U) << _U(40)))
        key = mix(np.bitwise_xor.reduceat(h, starts) + place)
        order = (_U(3) - np.minimum(count, 3).astype(_U)) << _U(62) | key >> _U(2)
        need = size * (den - num) // num + 1
        bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            mine = key[lo:hi]
            if need[i] < hi - lo:
                mine = mine[np.argpartition(order[lo:hi], need[i] - 1)[: need[i]]]
            elif need[i] > hi - lo:
                rest = np.setdiff1d(np.arange(k[i]), block[starts[lo:hi]].astype(np.int64)).astype(_U)
                mine = np.concatenate([mine, mix(mix(rest + (_U(int(layout[i])) << _U(40))))])
            keys.append(mine)
            owners.append(np.full(len(mine), sets[i]))
    if not keys:
        return np.empty(0, _U), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


MAPPED = "at long, key long, leader long, member long"
STARS = "key long, member long, leader long"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _grouped(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and document: keys, documents, where a key begins, its first document for each row."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return key, doc, first, doc[first][np.cumsum(first) - 1] if len(doc) else doc


def _map_keys(batches: Iterable[pa.RecordBatch], width: int, threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """A row per key with its first document (dealt by key), and rows for its other
    documents within this chunk (dealt at random: they need no reducer)."""
    keys, docs, seen, held = [], [], set(), 0

    def flush():
        nonlocal keys, docs, seen, held
        if held:
            key, doc, first, leader = _grouped(np.concatenate(keys), np.concatenate(docs))
            key = key.view(np.int64)
            yield _batch(MAPPED, key[first], pa.nulls(int(first.sum()), pa.int64()), doc[first], pa.nulls(int(first.sum()), pa.int64()))
            rest = ~first & (doc != leader)
            at = mix(doc[rest].view(_U) + mix(key[rest].view(_U)))
            yield _batch(MAPPED, signed(at), key[rest], leader[rest], doc[rest])
        keys, docs, seen, held = [], [], set(), 0

    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            flat, offsets = unique_sets(part.column("text"), width)
            sums = list(zip(*(x.tolist() for x in _set_hashes(flat, offsets))))
            fresh = []  # equal sets within a chunk: one of them is enough
            for i, x in enumerate(sums):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            key, owner = block_keys(flat, offsets, threshold)
            keep = np.isin(owner, fresh)
            keys.append(key[keep])
            docs.append(ids[owner[keep]])
            held += int(keep.sum())
            if held >= CHUNK_KEYS:
                yield from flush()
    yield from flush()
    trim()


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, docs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        whole = batch.column("member").is_null()
        own = batch.filter(whole)
        keys.append(own.column("at").to_numpy())
        docs.append(own.column("leader").to_numpy())
        rest = batch.filter(pc.invert(whole))
        yield _batch(STARS, rest.column("key"), rest.column("member"), rest.column("leader"))
    key, doc, _, leader = _grouped(np.concatenate(keys), np.concatenate(docs))
    other = doc != leader
    yield _batch(STARS, key[other], doc[other], leader[other])
    del key, doc, leader, other, keys, docs
    trim()


#: Smallest keys that a document carries, to see where else a pair meets.
LOW_KEYS = 6


GROUP = ("key", "lo", "hi")


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``GROUP`` in tables of about ``GROUP_BYTES`` that end where a group does."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < GROUP_BYTES:
            continue
        rows = pa.Table.from_batches(held)
        last = np.logical_and.reduce([(x := rows.column(c).to_numpy()) == x[-1] for c in GROUP])
        if (begin := len(last) - int(last.sum())) > 0:
            yield rows.slice(0, begin)
            held = rows.slice(begin).to_batches()
            size = sum(x.nbytes for x in held)
        del rows
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _cross(batches: Iterable[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs between components of a partition's groups; its rows come sorted by ``GROUP``."""
    for rows in _whole_groups(batches):
        yield _compared(rows, threshold)
    trim()


def _compared(rows: pa.Table, threshold: tuple[int, int]) -> pa.RecordBatch:
    """Pairs of a group (key, lo, hi) that lie in different components and that sizes
    and bit sketches allow. Rows at distance 1, 2, ... within their group are
    compared together for all groups of the table. A pair that also meets at a
    smaller key, as far as both rows' smallest keys tell, is left to that one."""
    num, den = threshold
    column = lambda c: rows.column(c).to_numpy()
    group = (column("key"), column("lo"), column("hi"))
    order = np.lexsort(group)
    key, lo, hi = (g[order] for g in group)
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    run = np.cumsum(new)
    block, doc, comp, n = (column(c)[order] for c in ("block", "a", "component", "n"))
    lowest = rows.column("low").combine_chunks()
    low = np.full((len(order), LOW_KEYS), np.iinfo(np.int64).max)
    many = np.diff(lowest.offsets.to_numpy())
    low[np.arange(LOW_KEYS)[None, :] < many[:, None]] = lowest.flatten().to_numpy()
    low = low[order]
    words = rows.column("sketch").combine_chunks()
    flat, at = words.flatten().to_numpy().view(_U), words.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    size, at = np.diff(at)[order], at[:-1][order]

    # for a first look, each sketch folded to a quarter
    short_size = np.maximum(size // 4, 1)
    short_at = np.cumsum(short_size) - short_size
    short = np.zeros(int(short_size.sum()), _U)
    for w in np.unique(size):
        own = np.flatnonzero(size == w)
        for part in np.array_split(own, 1 + len(own) * int(w) // (1 << 20)):
            long = flat[at[part][:, None] + np.arange(w)].reshape(len(part), -1, max(w // 4, 1))
            short[short_at[part][:, None] + np.arange(long.shape[2])] = np.bitwise_xor.reduce(long, axis=1)

    def apart_by(i: np.ndarray, j: np.ndarray, words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bits in which two sketches differ; one that is twice as long is folded."""
        out = np.empty(len(i), np.int64)
        width = np.minimum(length[i], length[j])
        for w in np.unique(width):
            some = np.flatnonzero(width == w)
            for part in np.array_split(some, 1 + len(some) * int(w) // (1 << 20)):
                sides = []
                for index in (i[part], j[part]):
                    side = words[begin[index][:, None] + np.arange(w)]
                    twice = length[index] > w
                    side[twice] ^= words[begin[index[twice]][:, None] + w + np.arange(w)]
                    sides.append(side)
                out[part] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
        return out

    found, active, apart = [], np.arange(len(order)), 0
    while len(active):
        apart += 1
        active = active[active + apart < len(order)]
        active = active[run[active] == run[active + apart]]
        i, j = active, active + apart
        near = (comp[i] != comp[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
        near &= (lo[i] == hi[i]) | (block[i] != block[j])  # pairs within a block belong to its own group
        i, j = i[near], j[near]
        near = apart_by(i, j, short, short_at, short_size) * (den + num) <= (n[i] + n[j]) * (den - num)
        i, j = i[near], j[near]
        elsewhere = np.zeros(len(i), bool)
        for x in range(LOW_KEYS):
            mine = low[i, x]
            elsewhere |= (mine < key[i]) & (low[j] == mine[:, None]).any(axis=1)
        i, j = i[~elsewhere], j[~elsewhere]
        near = apart_by(i, j, flat, at, size) * (den + num) <= (n[i] + n[j]) * (den - num)
        i, j = i[near], j[near]
        found.append(np.column_stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])]))
    pairs = np.unique(np.concatenate([*found, np.empty((0, 2), np.int64)]), axis=0)
    return _batch("a long, b long", pairs[:, 0].copy(), pairs[:, 1].copy())


# ------------------------------------------------------------------ verification


def sets_linked(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and threshold[1] * common >= threshold[0] * (len(a) + len(b) - common)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        texts = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])


def _plain_slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts, each counted once, take at most ``most_bytes`` unpacked."""
    sides = [batch.column(f"text_{s}").dictionary_encode() for s in "ab"]
    sizes = [[zstandard.frame_content_size(x) for x in side.dictionary.to_pylist()] for side in sides]
    start, size, seen = 0, 0, set()
    for i, row in enumerate(zip(*(side.indices.to_pylist() for side in sides))):
        new = [(s, t) for s, t in enumerate(row) if (s, t) not in seen]
        more = sum(sizes[s][t] for s, t in new)
        if i > start and size + more > most_bytes:
            yield batch.slice(start, i - start)
            start, size, seen = i, 0, set()
            new = list(enumerate(row))
            more = sum(sizes[s][t] for s, t in new)
        size += more
        seen.update(new)
    yield batch.slice(start)


def _verify(batches: Iterable[pa.RecordBatch], width: int, threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in _plain_slices(batch, PLAIN_BYTES):
            sides = []
            for side in "ab":
                text = part.column(f"text_{side}").dictionary_encode()
                plain = pa.array([expand.decompress(x) for x in text.dictionary.to_pylist()], pa.large_binary())
                flat, offsets = unique_sets(plain, width)
                sides.append([flat[offsets[i] : offsets[i + 1]] for i in text.indices.to_numpy()])
            ok = np.array([sets_linked(x, y, threshold) for x, y in zip(*sides)], bool)
            yield part.select(["a", "b"]).filter(pa.array(ok))
    trim()


def _half(sketch: Column) -> Column:
    """A bit sketch folded onto half its length."""
    n = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), n), F.slice(sketch, n + 1, n), lambda x, y: x.bitwiseXOR(y))


def _near(n: Column, m: Column, sketch_n: Column, sketch_m: Column, threshold: tuple[int, int]) -> Column:
    """Sizes and bit sketches allow a link."""
    num, den = threshold
    fold = lambda s, t: F.when(F.size(s) > F.size(t), _half(s)).otherwise(s)
    apart = F.aggregate(F.zip_with(fold(sketch_n, sketch_m), fold(sketch_m, sketch_n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.least(n, m) * den >= F.greatest(n, m) * num
    return F.when(sizes, apart * (den + num) <= (n + m) * (den - num)).otherwise(False)


def link_components(documents: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    features = stored(docs.mapInArrow(lambda b: _features(b, width), FEATURES), "jaccard-features")
    known = docs.filter("doc_id is not null")

    # equal sets: one class, named by its smallest id
    classes = features.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n")
    classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "jaccard-classes")
    member = features.join(classes, ["h1", "h2", "n"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    member = stored(member.select("doc_id", "n", "rep"), "jaccard-members")
    named = member.select("doc_id", F.col("rep").alias("of"))
    copies = stored(named.join(named.filter("doc_id != of").select("doc_id").distinct(), "doc_id", "left_semi").distinct(), "jaccard-copies")
    # an id whose rows lie in several classes joins them
    one_id = copies.join(copies.groupBy("doc_id").agg(F.min("of").alias("b")), "doc_id").filter("of != b").select(F.col("of").alias("a"), "b")
    long_reps = features.filter("doc_id is not null and n > 0").select(F.col("doc_id").alias("id"), "n", "sketch")

    def to_reps(rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = rows.join(copies.select(F.col("doc_id").alias(c), "of"), c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
        return rows

    def allowed(pairs: DataFrame) -> DataFrame:
        quarter = F.when(F.size("sketch") >= 4, _half(_half(F.col("sketch")))).otherwise(F.col("sketch"))
        reps = long_reps.withColumn("sketch", quarter)
        a = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        near = _near(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), threshold)
        return stored(pairs.join(a, "a").join(b, "b").filter(near).select("a", "b").distinct(), "jaccard-candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        packed = known.mapInArrow(_packed, "doc_id long, text binary")
        # (the same plan at every size)
        texts = stored(packed.join(ids.hint("merge"), "doc_id", "left_semi"), "jaccard-texts")
        rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        rows = rows.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return stored(rows.mapInArrow(lambda x: _verify(x, width, threshold), "a long, b long"), "jaccard-links")

    # each document of a key against the key's smallest
    mapped = known.mapInArrow(lambda b: _map_keys(b, width, threshold), MAPPED)
    stars = stored(mapped.repartition("at").mapInArrow(_stars, STARS), "jaccard-stars")
    release(documents.sparkSession)
    spokes = stored(stars.select("member", "leader").distinct(), "jaccard-spokes")
    spoke_reps = to_reps(spokes.withColumns({"a": F.col("member"), "b": F.col("leader")}), "a", "b").filter("a != b")
    spoke_reps = stored(spoke_reps, "jaccard-spoke-reps")
    first = allowed(spoke_reps.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = verified(first).unionByName(one_id)
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = stored(components(nodes, links, "jaccard"), "jaccard-components")

    def with_component(rows: DataFrame, c: str) -> DataFrame:
        part = found.select(F.col("id").alias(c), F.col("component").alias("of"))
        return rows.join(part, c, "left").withColumn(f"{c}_in", F.coalesce("of", c)).drop("of")

    release(documents.sparkSession)
    # keys whose documents lie in several components: the other pairs between components
    open_spokes = with_component(with_component(spoke_reps, "a"), "b").filter("a_in != b_in").select("member", "leader")
    open_keys = stars.join(open_spokes, ["member", "leader"], "left_semi").select("key").distinct()
    open_keys = stored(open_keys, "jaccard-open-keys")
    held = stars.join(open_keys, "key", "left_semi").select("key", F.explode(F.array("member", "leader")).alias("a")).distinct()
    held = with_component(to_reps(held, "a").distinct(), "a")
    held = stored(held.select("key", "a", F.col("a_in").alias("component")), "jaccard-held")
    blocks = stored(held.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks")).filter("blocks > 1"), "jaccard-large-keys")
    tasks = 1 + held.count() // ROWS_PER_TASK
    low = held.groupBy("a").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOW_KEYS).alias("low"))
    about = long_reps.withColumnRenamed("id", "a").join(low, "a")
    held = held.join(about, "a").join(blocks, "key", "left")
    held = held.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "a", "component", "n", "low", "sketch")
    pairs = held.repartition(tasks, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(lambda x: _cross(x, threshold), "a long, b long")
    pairs = stored(pairs.distinct(), "jaccard-pairs")
    release(documents.sparkSession)
    more = verified(pairs.join(first, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        # components of components
        between = with_component(with_component(more, "a"), "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct()
        between = stored(between, "jaccard-between")
        nodes = found.select("component").union(between.select(F.explode(F.array("a", "b")))).distinct().select(F.col("component").alias("id"))
        joined = stored(components(nodes, between, "jaccard"), "jaccard-joined")
        single = nodes.select("id", F.col("id").alias("component")).join(found.select("id"), "id", "left_anti")
        found = found.unionByName(single).withColumnRenamed("component", "part")
        found = stored(found.join(joined.withColumnRenamed("id", "part"), "part").select("id", "component"), "jaccard-components")
    out = member.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def representatives(documents: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``documents`` without near copies: of each component the row of its smallest
    ``doc_id`` stays (of rows that share it, the one with the smallest text); rows
    without ``doc_id`` stay."""
    spark = documents.sparkSession
    found = stored(link_components(documents, width, threshold), "jaccard-result")
    release(spark)
    gone = found.filter("component_id != doc_id").select("doc_id").distinct()
    twice = found.filter("component_id = doc_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    rows = squeezed(documents).join(gone.hint("merge"), "doc_id", "left_anti").select(*documents.columns)
    rows = expanded(rows)
    if twice.isEmpty():
        return rows
    twice = stored(twice, "jaccard-twice")
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    one = rows.join(twice, "doc_id").groupBy("doc_id").agg(F.min_by(row, "text").alias("row"))
    return rows.join(twice, "doc_id", "left_anti").select(*documents.columns).unionByName(one.select("row.*"))


def one_of_each(documents: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``documents`` without near copies, decided row by row: of rows linked by their
    texts the one with the smallest ``doc_id`` stays (a missing id comes last, then the
    smaller text decides). Rows that share an id but not their text are apart."""
    spark = documents.sparkSession
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text")).alias("row")
    docs = ordered(documents.select("doc_id", "text", row))
    found = stored(link_components(docs.select(F.col("oid").alias("doc_id"), "text"), width, threshold), "jaccard-result")
    release(spark)
    gone = found.filter("component_id != doc_id").select(F.col("doc_id").alias("oid"))
    kept = expanded(squeezed(docs.select("oid", "row", "text")).join(gone.hint("merge"), "oid", "left_anti").select("row", "text"))
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns))
