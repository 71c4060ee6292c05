"""Language identification: averaged hashed subword embeddings, linear softmax.

The features of a text are all its byte n-grams (two to four bytes, lower case,
everything that is not a letter a blank), hashed into buckets. A text is the mean
of its buckets' embeddings; a linear softmax on the mean gives the language. Both
are trained by stochastic gradient descent in numpy on a bounded sample of
labelled texts. Since the model is linear after the lookup, embedding times output
matrix is folded into one score per bucket and language, and a text costs one
table lookup per n-gram, whole texts included.

A part of the sample is kept from training to calibrate: a temperature makes the
probabilities honest. Probabilities only compare the learned languages with each
other, so rejection goes by another measure that can fail: how familiar a text's
n-grams are in the language it is given, as the mean logarithm of their rate in that
language's texts against a uniform one. Pieces of the sampled texts, each measured
against the counts of all other texts, give by language and length the bar that all
but ``REJECTED_SHARE`` of them reach.

Rows: a null text, or one without a letter, is ``und`` with score 0 and rejected;
null languages are never learned; a null ``doc_id`` counts as the empty text for
the fold; with no labelled rows every text is ``und``; with one language every
accepted text is of it, with score 1; a language of fewer than ``FEWEST_TEXTS``
sampled texts has no bar; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import slices, text_buffer, trim

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 8
RATE = 8.0
#: Labelled texts per language in the training sample, and in all; with so many
#: languages that these are fewer for each, still ``LEAST_PER_LANGUAGE``.
SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS, LEAST_PER_LANGUAGE = 500, 128_000, 10
CALIBRATION_SHARE = 0.2
REJECTED_SHARE = 0.001
#: Pieces of about 2**k bytes are measured, ``PIECES`` of a text at most for each k, in
#: an excerpt of ``EXCERPT`` characters; longer texts are held to the last bar.
BANDS, PIECES, EXCERPT = range(1, 11), 4, 1500
#: Sampled texts that a language needs for bars of its own.
FEWEST_TEXTS = 10
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

_FACTORS = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LETTER[_LETTER == 0] = 32


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 letters; other ASCII becomes a blank."""
    out = _LETTER[data]
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


def bucket_runs(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram size, the bucket at every position of the buffer."""
    wide = folded(data).astype(np.uint32)
    gram = wide
    for n in range(2, max(SIZES) + 1):
        gram = gram[:-1] | wide[n - 1 :] << np.uint32(8 * (n - 1)) if len(gram) > 1 else gram[:0]
        if n in SIZES:
            yield n, (gram * _FACTORS[n]) >> np.uint32(32 - (BUCKETS.bit_length() - 1))


#: The bucket of blanks alone, for each n-gram size.
_BLANKS = {n: int(b[0]) for n, b in bucket_runs(np.full(max(SIZES), 32, np.uint8))}


def band(grams: np.ndarray) -> np.ndarray:
    """Place in ``BANDS`` of texts with so many n-grams that hold a letter."""
    k = np.floor(np.log2(np.asarray(grams) / len(SIZES) + 2)).astype(int)
    return np.clip(k, BANDS[0], BANDS[-1]) - BANDS[0]


def _spans(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's n-grams of size n begin and end in the buffer."""
    return offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    familiar: np.ndarray | None = None  # bucket x language
    bars: np.ndarray | None = None  # language x band

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        count = np.zeros(len(offsets) - 1)
        for n, bucket in bucket_runs(data):
            lo, hi = _spans(offsets, n)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            # pairs (begin, end): every second sum is a text's
            edges = np.minimum(np.column_stack([lo[some], hi[some]]).ravel(), len(bucket))
            tail = edges[:-1] if edges[-1] == len(bucket) else edges
            for c in range(len(self.languages)):
                total[some, c] += np.add.reduceat(self.table[:, c][bucket], tail, dtype=np.float64)[::2]
            count += hi - lo
        return total / np.maximum(count, 1)[:, None] + self.bias

    def unfamiliar(self, data: np.ndarray, offsets: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Texts whose n-grams are less familiar in ``language`` than the bar."""
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        column = np.repeat(language.astype(np.int32), np.diff(offsets))
        for n, bucket in bucket_runs(data):
            lo, hi = _spans(offsets, n)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            letters = bucket != _BLANKS[n]
            value = self.familiar[bucket, column[: len(bucket)]]
            value[~letters] = 0
            edges = np.minimum(np.column_stack([lo[some], hi[some]]).ravel(), len(bucket))
            tail = edges[:-1] if edges[-1] == len(bucket) else edges
            total[some] += np.add.reduceat(value, tail, dtype=np.float64)[::2]
            count[some] += np.add.reduceat(letters, tail, dtype=np.int64)[::2]
        return total / np.maximum(count, 1) < self.bars[language, band(count)]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


# ------------------------------------------------------------------ training


def text_counts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    data, offsets = text_buffer(column)
    runs = [(n, b) for n, b in bucket_runs(data)]
    out = []
    for i in range(len(offsets) - 1):
        own = [b[max(0, offsets[i]) : max(offsets[i], offsets[i + 1] - n + 1)] for n, b in runs]
        bucket, count = np.unique(np.concatenate(own), return_counts=True)
        out.append((bucket.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
    return out


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    n_held = int(len(y) * CALIBRATION_SHARE) if len(y) >= 20 else 0
    held, used = order[:n_held], order[n_held:]
    emb = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    out, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    total, step = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            bucket, share = samples[i]
            if len(bucket):
                rate = RATE * (1 - step / total)
                v = share @ emb[bucket]
                z = v @ out + bias
                g = np.exp(z - z.max())
                g /= g.sum()
                g[y[i]] -= 1
                emb[bucket] -= rate * share[:, None] * (out @ g)
                out -= min(rate, 1.0) * np.outer(v, g)
                bias -= 0.01 * rate * g
            step += 1
    model = Model(languages, np.ascontiguousarray(emb @ out).astype(np.float32), bias)
    if n_held:
        calibrate(model, [samples[i] for i in held], y[held])
    return model


def calibrate(model: Model, samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
    """Temperature with the least log loss."""
    z = np.array([share @ model.table[bucket] + model.bias for bucket, share in samples])

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(np.maximum(model.probabilities(z)[np.arange(len(y)), y], 1e-12)).mean())

    model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)


def set_bars(model: Model, samples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], excerpts: list[str]) -> None:
    """Familiarity of every bucket in each language, and the bars that nearly all pieces reach.

    A piece is measured with its own text left out of the counts.
    """
    blanks = list(_BLANKS.values())
    model.familiar = np.empty((BUCKETS, len(model.languages)), np.float32)
    model.bars = np.full((len(model.languages), len(BANDS)), -np.inf)
    own = np.zeros(BUCKETS)
    for k, language in enumerate(model.languages):
        mine = [i for i, x in enumerate(labels) if x == language]
        shares = []
        seen = np.zeros(BUCKETS)
        for i in mine:
            bucket, share = samples[i]
            share = np.where(np.isin(bucket, blanks), 0, share).astype(np.float64)
            shares.append(share / max(share.sum(), 1e-9))
            seen[bucket] += shares[-1]
        model.familiar[:, k] = np.log((seen * BUCKETS + 1) / (len(mine) + 1))
        if len(mine) < FEWEST_TEXTS:
            continue
        measured: list[list[np.ndarray]] = [[] for _ in BANDS]
        for i, share in zip(mine, shares):
            bucket = samples[i][0]
            own[bucket] = share
            total, count = _pieces(excerpts[i], lambda b: np.log((np.maximum(seen[b] - own[b], 0) * BUCKETS + 1) / len(mine)))
            own[bucket] = 0
            at = band(count)
            for a in set(at[count > 0].tolist()):
                measured[a].append((total / np.maximum(count, 1))[(at == a) & (count > 0)])
        bar = -np.inf
        for a, found in enumerate(measured):
            if found:
                value = np.sort(np.concatenate(found))
                bar = value[int(len(value) * REJECTED_SHARE)]
            model.bars[k, a] = bar - 1e-6  # without pieces of this length: the bar of shorter ones


def _pieces(excerpt: str, measure: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``measure`` and number of n-grams with a letter, for pieces of all lengths."""
    data = np.frombuffer(excerpt.encode(), np.uint8)
    solid = folded(data) != 32
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(data) else np.empty(0, int)
    lo, hi = [], []
    for k in BANDS:
        size = (1 << k) + (1 << k) // 8 + 1
        fit = begins[begins + size <= len(data)]
        fit = fit[np.unique(np.linspace(0, len(fit) - 1, PIECES).astype(int))] if len(fit) else fit
        lo += fit.tolist()
        hi += (fit + size).tolist()
    if len(begins):  # and the whole
        lo, hi = [*lo, 0], [*hi, len(data)]
    lo, hi = np.array(lo, int), np.array(hi, int)
    total, count = np.zeros(len(lo)), np.zeros(len(lo))
    for n, bucket in bucket_runs(data):
        letters = bucket != _BLANKS[n]
        end = np.maximum(lo, hi - n + 1)
        for out, x in ((total, np.where(letters, measure(bucket), 0.0)), (count, letters)):
            sums = np.concatenate([[0.0], np.cumsum(x)])
            out += np.where(end > lo, sums[np.minimum(end, len(x))] - sums[np.minimum(lo, len(x))], 0)
    return total, count


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def excerpt(text: str) -> str:
    """At most ``EXCERPT`` characters from a place that depends on the text."""
    at = zlib.crc32(text[: 2 * EXCERPT].encode()) % max(1, len(text) - EXCERPT + 1)
    return text[at : at + EXCERPT]


def labelled_sample(documents: DataFrame, per_language: int) -> list[tuple[str, bytes, bytes, str]]:
    """At most about ``per_language`` labelled texts of each language, as bucket counts and an excerpt.

    Texts are picked by a hash of id and text, at a rate known from the counts per
    language; what reaches the driver is bounded by the sample.
    """
    counts = documents.filter("lang is not null").groupBy("lang").count().collect()
    if not counts:
        return []
    per_language = min(per_language, max(LEAST_PER_LANGUAGE, SAMPLE_TEXTS // len(counts)))
    rates = documents.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
    # one row per language
    picked = documents.join(F.broadcast(rates), "lang").filter(draw < F.col("rate"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = text_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()), pa.array([excerpt(t) for t in part.column("text").to_pylist()], pa.string())],
                    ["lang", "bucket", "share", "excerpt"],
                )

    rows = picked.select("lang", "text").mapInArrow(count, "lang string, bucket binary, share binary, excerpt string").collect()
    # a few more than asked for can pass the draw; the order makes training repeatable
    kept: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["lang"], bytes(r["bucket"]), bytes(r["share"]), r["excerpt"])):
        kept[r["lang"]] = kept.get(r["lang"], 0) + 1
        if kept[r["lang"]] <= 2 * per_language:
            out.append((r["lang"], bytes(r["bucket"]), bytes(r["share"]), r["excerpt"]))
    return out


def fit(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Model from labelled ``documents`` (doc_id, text, lang); null if none has a language."""
    rows = labelled_sample(documents.select("doc_id", F.col("text").cast("string"), "lang").filter("text is not null"), per_language)
    samples = [(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for _, b, s, _ in rows]
    labels = [r[0] for r in rows]
    model = train(samples, labels)
    if model is not None:
        set_bars(model, samples, labels, [r[3] for r in rows])
    return model


def judged(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    buffer = text_buffer(texts)
    p = model.probabilities(model.logits(*buffer))
    best = p.argmax(axis=1)
    has = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
    score = np.where(has, p[np.arange(len(best)), best], 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)], score, ~has | model.unfamiliar(*buffer, best)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` (with ``text``), then lang_pred, score and rejected, which
    replace columns of these names."""
    added = ("lang_pred", "score", "rejected")
    documents = documents.select(*(f"`{c}`" for c in documents.columns if c.lower() not in added))
    if model is None:
        return documents.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lang, score, rejected = judged(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, *added])
        trim()

    schema = T.StructType([*documents.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return documents.mapInArrow(run, schema)


def accepted(documents: DataFrame, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """The rows of ``documents`` whose text the model does not reject; a null ``lang``
    becomes the predicted one. Learns as ``identify`` does."""
    model = fit(documents.filter(fold(F.col("doc_id"), folds) != held_out_fold))
    if model is None:
        return documents.limit(0)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lang, _, rejected = judged(part.column("text"), shared.value)
                known = pc.coalesce(part.column("lang"), pa.array(lang, part.column("lang").type))
                kept = [known if c == "lang" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(kept, names).filter(pa.array(~rejected))
        trim()

    return documents.mapInArrow(run, documents.schema)


def identify(documents: DataFrame, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all: adds
    held_out, lang_pred, score and rejected to ``documents``."""
    held = fold(F.col("doc_id"), folds) == held_out_fold
    model = fit(documents.filter(~held))
    return predict(documents.withColumn("held_out", held), model)
