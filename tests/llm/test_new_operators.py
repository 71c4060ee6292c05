"""Token files, collocations and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.llm import codes, collocations, resampling
from spanlake.llm.oracle import ORACLE
from spanlake.llm.queries import QUERIES, packing_tokenizer
from spanlake.llm.shared import shared_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
#: Null, empty, blank and marks-only texts, repeated rows and ids, missing ids and languages.
ODD = [
    (900, None, "en"), (901, "", "en"), (902, " \n\t", None), (903, ".,;!", "fr"), (904, "A b", "und"), (904, "A b", "und"),
    (904, "other words", None), (None, "a b", "en"), (None, None, None), (905, "\x1c odd\x1cword \xa0x", "en"), (-7, "x", ""),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for c in ("h", "part", "task", "n", "w1", "phrase", "score", "rank", "weight", "bucket", "block", "path", "base", "place"):
        df = df.withColumn(c, F.lit("clash"))
    return df.withColumn("a.b", F.lit(1))


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------------ op11


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 9000])
@pytest.mark.parametrize("most", [1, 300, 49_408, 2**32 - 1])
def test_codes_any_range_of_a_file(n, most):
    rng = np.random.default_rng(n + most)
    ids = np.minimum(rng.pareto(0.5, n) * most / 50, most).astype(np.uint32)
    starts = np.sort(rng.integers(0, n + 1, 4))
    raw = codes.encode_file(ids, starts, [3, None, -5, 7])
    asked = []

    def read(offset, size):
        asked.append(size)
        return raw[offset : offset + size]

    file = codes.TokenFile(read)
    assert file.directory()[0] == [3, None, -5, 7] and file.directory()[1].tolist() == [*starts, n]
    assert (file.ids(0, n) == ids).all()
    for _ in range(30 if n else 0):
        lo = int(rng.integers(0, n))
        hi = int(rng.integers(lo, n + 1))
        assert (file.ids(lo, hi) == ids[lo:hi]).all()
        asked.clear()
        assert file.id_at(lo) == ids[lo]
        # no block is decoded: a few bytes of chunks, one directory entry and its bits
        assert sum(asked) <= len(file.widths) * (8 + 1 + 8 + codes.RANK_BITS // 8)


def test_codes_widths_take_the_fewest_bits():
    rng = random.Random(5)
    ids = np.array([rng.choice([1, 3, 9, 100, 4000]) for _ in range(300)], np.uint32)

    def cost(widths):
        total, rest = 0, [int(x) for x in ids]
        for i, w in enumerate(widths):
            total += len(rest) * (w + (i + 1 < len(widths)))
            rest = [x >> w for x in rest if x >> w]
        return total if not rest else math.inf

    def splits(n):
        yield from [[n]] if n else [[]]
        for w in range(1, n):
            yield from ([w, *s] for s in splits(n - w))

    assert cost(codes.chunk_widths(ids)) == min(cost(s) for s in splits(12))


def test_codes_damaged_file():
    with pytest.raises(ValueError):
        codes.TokenFile(lambda o, n: b"\0" * n)


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing_tokenizer())
    return [[*x.ids, codes.END_ID] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want, at = [], 0
    for (i, _), ids in zip(docs, brute_ids([t for _, t in docs])):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = QUERIES["op11_token_files"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_codes_files_rows_and_lookup(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["token", "Größe", "x9", "<|endoftext|>", "!"]) for _ in range(60_000))
    rows = [*ODD, *[(rng.randrange(60), "some words " * rng.randrange(40), "en") for _ in range(90)], (30, long, "en")]
    manifest = codes.write_files(frame(spark, rows).repartition(5), packing_tokenizer(), shared_path(spark, "codes"), file_ids=700)
    assert manifest.count() > 5
    got = sorted((tuple(r) for r in codes.read_documents(manifest).collect()), key=lambda r: r[1])
    # gapless, ids ascending with nulls last, and every text once
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert [r[0] is None for r in got] == sorted(r[0] is None for r in got)
    given = [r[0] for r in got if r[0] is not None]
    assert given == sorted(given)
    ids = brute_ids([r[1] for r in rows])
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), len(x), crc(x)) for r, x in zip(rows, ids))
    # the corpus by random access: the ids at any position
    by_sum = {(str(r[0]), len(x), crc(x)): x for r, x in zip(rows, ids)}
    whole = [x for r in got for x in by_sum[(str(r[0]), r[2], r[3])]]
    wanted = [0, len(whole) - 1, len(whole), -1, *rng.sample(range(len(whole)), 200)]
    found = codes.lookup(manifest, spark.createDataFrame([(p,) for p in wanted], "position long"), span=700)
    assert tuples(found) == sorted([(p, whole[p]) for p in wanted if 0 <= p < len(whole)], key=str)


def test_codes_empty_table(spark):
    manifest = codes.write_files(frame(spark, []), packing_tokenizer(), shared_path(spark, "codes"))
    assert manifest.collect() == [] and codes.read_documents(manifest).collect() == []


# ------------------------------------------------------------------ op12


def brute_collocations(rows, least, percent=80, top=2000):
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        around = (b for (m, q), b in candidates.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if any(100 * b >= percent * a for b in around):
            continue
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = collections.Counter()
    for i, r in enumerate(out):
        ranks[r[0]] += 1
        out[i] = (r[0], ranks[r[0]], *r[1:])
    return [r for r in out if r[1] <= top]


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "sea", "été", "x", "-", "a\x0bb", "of the", "big red dog,", "one. two"]
    weights = [9, 3, 7, 2, 2, 4, 1, 1, 5, 4, 2]
    return [(i, rng.choice([" ", "\t", "  "]).join(rng.choices(words, weights, k=rng.randrange(30))), rng.choice(["en", "en", "fr", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("least", [1, 4, 30])
def test_collocations_brute_force(spark, least, monkeypatch):
    rows = [*some_texts(least, 150), *ODD, *[(5000 + i, "hot words here " * 7, "en") for i in range(60)]]
    # many buckets, several blocks for each, and parts put together in between
    monkeypatch.setattr(collocations, "BUCKET_WINDOWS", 150)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 2000)
    got = collocations.collocations(frame(spark, rows).repartition(7), least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_collocations(rows, least))


def test_collocations_top_and_absorption(spark):
    rows = some_texts(77, 200)
    for percent, top in ((50, 3), (100, 10), (101, 2000)):
        got = collocations.collocations(frame(spark, rows), least=5, percent=percent, top=top)
        assert sorted(tuple(r) for r in got.collect()) == sorted(brute_collocations(rows, 5, percent, top))


def test_collocations_counts_beyond_64_bits(spark):
    big = 5 * 10**12
    counts = spark.createDataFrame(
        [("en", ["a", "b"], big), ("en", ["a"], 3 * big), ("en", ["b"], 2 * big), ("en", [], 9 * big)], "lang string, words array<string>, f long"
    )
    assert [tuple(r) for r in collocations._scored(counts).collect()] == [("en", ["a", "b"], big, 3 * big, 2 * big, 400_000)]


def test_collocations_windows_survive_packing():
    text = pa.array(["a b a b. c\nb a", "", "b ñ b ñ"])
    data, offsets = collocations.text_buffer(text)
    found = collocations.count_windows(data, offsets, pa.array(["en", "fr", "en"]))
    again = collocations.Windows.together([collocations.Windows.unpacked(b) for _, b in found.blocks(3, 4)]).combined()

    def shown(w):
        v, m = w.vocabulary.to_pylist(), w.langs.to_pylist()
        return sorted((m[a], *(v[c] for c in cs), n) for a, cs, n in zip(w.lang, w.codes.T, w.n))

    assert shown(found) == shown(again)
    assert ("en", "a", "b", "", "", 1) in shown(found) and ("en", "b", "ñ", "b", "ñ", 1) in shown(found)


@pytest.mark.parametrize("text", ["word " * 50 + "end. " + "next one, " * 40, "." * 90, "nogapatall" * 30, "a b " * 60 + "\n" + "z" * 200])
def test_collocations_long_texts_are_cut_at_piece_ends(text):
    data, offsets = collocations.text_buffer(pa.array([text]))
    parts = list(collocations._text_parts(pa.array([text]), 64))
    assert b"".join(p[0].tobytes() for p in parts) == text.encode()
    whole = collocations.count_windows(data, offsets, pa.array(["en"]))
    cut = collocations.Windows.together([collocations.count_windows(d, o, pa.array(["en"])) for d, o, _ in parts]).combined()
    assert whole.n.sum() == cut.n.sum() and len(whole) == len(cut)


def test_collocations_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, ODD)).collect() == []


# ------------------------------------------------------------------ op13


def test_crc_of_spans():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 50_000).astype(np.uint8)
    sizes = np.array([*range(140), 1000, 4095, 4096, 4097, 33_333])
    start = rng.integers(0, 50_000 - sizes)
    got = resampling.span_crcs(data, start, start + sizes)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, sizes)]


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_resample(rows, target, percent=25, min_words=20, buckets=10_000):
    def spots(text):
        w = brute_words(text)
        return [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = collections.Counter(), collections.Counter()
    for _, text, *_ in rows:
        s.update(spots(text))
    for text in target:
        t.update(spots(text))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (ss + buckets)) / ((s[b] + 1.0) * (tt + buckets))))
    out = []
    for i, text, *_ in rows:
        found = spots(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(brute_words(text))])
    chosen = sorted((r for r in out if r[0] is not None and r[5] >= min_words), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(chosen[: percent * len(chosen) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def test_resampling_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["the", "Größe", "42", "x-y", "naïve", "q" * 70, "of", "sea.side", "ÀB"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60))), "en") for i in range(300)]
    rows += [r for r in ODD if r[0] != 904] + [(904, "A b", "und"), (9000, "the sea " * 30_000, "en"), (9001, "w" * 100_000, "en")]
    target = ["the sea side", None, "", "of the sea 42 42"]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = resampling.resample(frame(spark, rows).repartition(6), aim).select("doc_id", "n_features", "weight", "score", "rank")
    assert tuples(got) == sorted(brute_resample(rows, target), key=str)


def test_resampling_draw_sizes_and_ties(spark):
    rows = [(i, "same words " * 12, "en") for i in range(41)] + [(7, "same words " * 12, "en")]
    for percent in (0, 10, 100):
        got = resampling.resample(frame(spark, rows), frame(spark, rows), percent=percent).collect()
        drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in drawn] == list(range(1, percent * len(rows) // 100 + 1))
        assert [(-r["score"], r["doc_id"]) for r in drawn] == sorted((-r["score"], r["doc_id"]) for r in drawn)


def test_resampling_empty_tables(spark):
    assert resampling.resample(frame(spark, []), frame(spark, [])).collect() == []
    got = resampling.resample(frame(spark, [(1, "a b", "en")]), frame(spark, []), min_words=1, percent=100).first()
    assert (got["n_features"], got["rank"]) == (3, 1)


# ------------------------------------------------------------------ SQL


@pytest.mark.parametrize("name", ["op12_collocations", "op13_importance_resampling"])
def test_new_queries_match_sql(spark, name):
    from oracle_check import compare, duck

    ok, message = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert ok, message


# ------------------------------------------------------------------ pipeline rows


def test_near_copies_are_decided_by_row(spark):
    """Unlike texts that share an id stay; missing ids, repeated rows, columns with odd
    names and texts that pack to almost nothing."""
    from spanlake.llm import jaccard

    text = lambda *words: " ".join(f"{w}{i}" for i in range(12) for w in words)
    long = "again and again " * 100_000
    rows = [
        (4, text("a", "b"), "en"), (4, text("x", "y"), "en"), (9, text("a", "b") + " more", "en"), (None, text("x", "y"), "en"), (None, text("q"), "en"),
        (5, None, "en"), (5, None, "en"), (6, "", "en"), (7, long, "en"), (8, long.upper(), "en"), (4, text("a", "b"), "fr"),
    ]
    df = frame(spark, rows).withColumn("oid", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(((r["doc_id"], (r["text"] or "")[:4], r["oid"], r["a.b"]) for r in got.collect()), key=str)
    want = [(4, "a0 b", "clash", 1), (4, "x0 y", "clash", 1), (None, "q0 q", "clash", 1), (5, "", "clash", 1), (5, "", "clash", 1), (6, "", "clash", 1), (7, "agai", "clash", 1)]
    assert kept == sorted(want, key=str)
    assert jaccard.one_of_each(frame(spark, [])).collect() == []


def test_unpacked_texts_come_in_bounded_batches():
    from spanlake.llm import jaccard
    from spanlake.llm.shared import _squeeze

    texts = _squeeze(pa.array(["ab " * 200_000, "cd " * 200_000, "ab " * 200_000, "x"]))
    batch = pa.RecordBatch.from_arrays([texts, texts.take(pa.array([1, 1, 0, 3]))], ["text_a", "text_b"])
    parts = list(jaccard._plain_slices(batch, 1_300_000))
    assert [len(p) for p in parts] == [1, 1, 2] and pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch)
