"""Jaccard join, substring deduplication, language, toxicity and packing against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.llm import jaccard, langid, packing, substrings, toxicity
from spanlake.llm.queries import packing_tokenizer
from spanlake.llm.shared import shingle_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
#: Null, empty, blank, short, cased and repeated texts; columns with names used inside.
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "A b"), (904, "a  B"), (905, "x"), (None, "a b"), (None, None)]


def odd_frame(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for c in ("oid", "row", "spans", "rep", "key", "component", "score", "held_out", "source_size"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------------ op2


def word_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    return out


def brute_components(rows):
    sets = word_sets(rows)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                holders[x].append(k)
    common = collections.Counter(p for v in holders.values() for p in itertools.combinations(v, 2))
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a][1]) + len(sets[b][1]) - c):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=str)


def mutated(rnd, n, vocabulary, sizes, edits):
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice(sizes))] for _ in range(n // 8)]
    for i in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice(edits)):
            j, kind = rnd.randrange(len(t)), rnd.random()
            if kind < 0.5:
                t[j] = rnd.choice(vocabulary)
            elif kind < 0.75:
                t.insert(j, rnd.choice(vocabulary))
            elif len(t) > 1:
                del t[j]
        yield i, " ".join(t)


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_KEYS", chunk)
    rnd = random.Random(5)
    rows = list(mutated(rnd, 500, [f"w{i}" for i in range(60)], [1, 2, 3, 4, 5, 6, 8, 12, 20, 60, 150], [0, 0, 1, 1, 2, 4]))
    df = odd_frame(spark, rows + ODD).repartition(4)
    assert rows_of(jaccard.link_components(df)) == brute_components(rows + ODD)


def test_jaccard_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, long), (5, other), (3, long), (4, other + " more"), (7, "alone in the world it is")]
    got = rows_of(jaccard.link_components(spark.createDataFrame(rows, DOCS)))
    assert {(i, c) for i, _, c in got} == {(5, 3), (3, 3), (4, 3), (7, 7)}
    assert rows_of(jaccard.representatives(spark.createDataFrame(rows + rows, DOCS))) == [(3, long), (7, "alone in the world it is")]


@pytest.mark.parametrize("most, batch_rows", [(1, 1), (1, 7), (2000, 5), (1 << 30, 1000)])
def test_jaccard_groups_are_compared_whole(monkeypatch, most, batch_rows):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", most)
    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 60, 40).tolist()) for _ in range(12)]
    rows = []
    for doc in range(150):
        own = np.array(sorted(sets[doc % 12] - set(rng.integers(0, 60, 3).tolist())), np.uint64)
        own = jaccard.mix(own)
        for key in rng.choice(25, 3, replace=False).tolist():
            rows.append((key, 0, 0, 0, doc, doc % 50, len(own), [key], jaccard._bit_sketch(own).tolist()))
    rows.sort(key=lambda r: r[:3])
    table = pa.Table.from_pylist([dict(zip(("key", "lo", "hi", "block", "a", "component", "n", "low", "sketch"), r)) for r in rows])
    allowed = set()
    for r in rows:
        for q in rows:
            if r[0] == q[0] and r[4] < q[4] and r[5] != q[5] and 4 * min(r[6], q[6]) >= 3 * max(r[6], q[6]):
                x, y = (np.array(v[8], np.int64).view(np.uint64) for v in (r, q))
                if len(x) == len(y) and int(np.bitwise_count(x ^ y).sum()) * 7 <= r[6] + q[6]:
                    allowed.add((r[4], q[4]))
    got = [p for b in jaccard._cross(iter(table.to_batches(batch_rows)), jaccard.THRESHOLD) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert allowed and allowed <= set(got)
    whole = [p for b in [jaccard._compared(table, jaccard.THRESHOLD)] for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert set(got) == set(whole)
    assert list(jaccard._cross(iter([]), jaccard.THRESHOLD)) == []


def test_jaccard_empty_table(spark):
    assert jaccard.link_components(spark.createDataFrame([], DOCS)).count() == 0


def test_linked_sets_share_a_block_key():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(1, 120))
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = a[: max(1, -(-3 * len(a) // 4))]
        if not jaccard.sets_linked(a, keep):
            continue
        flat, offsets = np.concatenate([a, keep]), np.array([0, len(a), len(a) + len(keep)])
        key, owner = jaccard.block_keys(flat, offsets)
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_shingles_of_a_batch_do_not_cross_texts():
    texts = ["a b c d e f", None, "", "A  B\tc d e f", "a b", "é ü a b c d"]
    flat, at = shingle_hashes(pa.array(texts))
    parts = [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    assert parts[0] == parts[3] and [len(p) for p in parts] == [2, 0, 0, 2, 1, 2]
    alone = [shingle_hashes(pa.array([t]))[0].tolist() for t in texts]
    assert parts == alone


# ------------------------------------------------------------------ op6


def brute_substrings(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] or ""))
    seen, out = set(), []
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out.append((rows[k][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("large,chunk", [(50_000, 1 << 19), (3, 400)])
def test_substrings_equal_brute_force(spark, monkeypatch, large, chunk):
    monkeypatch.setattr(substrings, "LARGE_BUCKET", large)
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["é", "ßü", "漢字"]
    passage = [" ".join(rnd.choice(words) for _ in range(rnd.choice([15, 25, 40, 80]))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 2, 5, 30])))]
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            parts += [rnd.choice(passage)[rnd.randrange(30) :], " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 2, 5])))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(10)] + [(1100 + i, "X" + rows[i][1][1:]) for i in range(10)]
    rows += [(2002, "a" * 99), (2003, "a" * 100), (2004, "a" * 350), (2005, "ab" * 200), (2007, ("x" * 77 + "y" * 5) * 30)]
    df = odd_frame(spark, rows + ODD[:6]).repartition(4)
    got = rows_of(substrings.digests(df))
    assert got == brute_substrings(rows + ODD[:6])
    cut = {r.doc_id: r for r in substrings.cut(df).collect()}
    kept = {r[0]: r[4] for r in got}
    for i, _ in rows[:60]:
        if all(ord(c) < 128 for c in dict(rows)[i]):
            assert hashlib.sha256(cut[i].text.encode()).hexdigest() == kept[i]
    assert cut[900].text is None and cut[901].row == "clash" and cut[901].oid == "clash"


@pytest.mark.parametrize("seed", range(20))
def test_substring_reducers_hold_at_any_cut_of_their_rows(monkeypatch, seed):
    monkeypatch.setattr(substrings, "CHUNK", 40)
    monkeypatch.setattr(substrings, "REFINED", 5)
    rnd = random.Random(seed)
    wide = lambda ranges: {(o, x) for o, s, e in ranges for x in range(s, e)}

    def batches(rows, schema, types):
        at = 0
        while at < len(rows):
            n = rnd.randrange(1, 7)
            columns = zip(*rows[at : at + n])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in schema.split(", ")])
            at += n

    # classes: bucket, class, document, start, one window each; null: a range that is ready
    rows = sorted((rnd.randrange(8), rnd.randrange(3), rnd.randrange(5), 100 * k, 0) for k in range(rnd.randrange(60)))
    ready = [(rnd.randrange(8), 500_000 + k, 9, 400_000 + k, None) for k in range(10)]
    types = (pa.int64(),) * 4 + (pa.int32(),)
    given = sorted(rows + ready, key=lambda r: r[:4])
    found = [r for b in substrings._classes(batches(given, substrings.SAMPLED, types)) for r in b.to_pylist()]
    firsts = {}
    for g, c, oid, start, _ in rows:
        firsts.setdefault(g, {}).setdefault(c, (oid, start))
    several = sorted((g, *x) for g, classes in firsts.items() if len(classes) > 1 for x in classes.values())
    assert sorted((r["g"], r["oid"], r["start"]) for r in found if r["g"] is not None) == several
    first = {x for classes in firsts.values() for x in classes.values()}
    expected = [(o, s, s + 100) for _, _, o, s, _ in rows if (o, s) not in first] + [(o, s, c) for _, c, o, s, _ in ready]
    assert wide((r["oid"], r["start"], r["end"]) for r in found if r["g"] is None) == wide(expected)

    # contexts of one window: within a bucket all but the first of equal bytes go
    text = [bytes(rnd.randrange(256) for _ in range(100)) for _ in range(4)]
    rows = sorted((rnd.randrange(6), rnd.randrange(5), 100 * k, 0, rnd.choice(text)) for k in range(rnd.randrange(1, 50)))
    types = (pa.int64(),) * 3 + (pa.int32(), pa.binary())
    got = [tuple(r.values()) for b in substrings._refine(batches(rows, substrings.CONTEXT, types)) for r in b.to_pylist()]
    seen, expected = set(), []
    for g, oid, start, _, raw in sorted(rows):
        if (g, raw) in seen:
            expected.append((oid, start, start + 100))
        seen.add((g, raw))
    assert wide(got) == wide(expected)


def test_substrings_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE_BYTES", 300)
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(2000))
    rows = [(1, text), (2, text[150:1700] + "!" + text[:120]), (3, text[::-1])]
    assert rows_of(substrings.digests(spark.createDataFrame(rows, DOCS))) == brute_substrings(rows)


def test_substrings_with_repeated_and_missing_ids(spark):
    rows = [(1, "q" * 150), (1, "q" * 150), (None, "z" * 120), (None, "z" * 120), (2, None), (1, "abc" * 60)]
    assert rows_of(substrings.digests(spark.createDataFrame(rows, DOCS))) == brute_substrings(rows)
    assert substrings.digests(spark.createDataFrame([], DOCS)).count() == 0


# ------------------------------------------------------------------ op10


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).select("held_out", "lang", "lang_pred", "score").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    train = [(i, "the cat and the dog " * 3, "en") for i in range(40)] + [(100 + i, "der hund und die katze " * 3, "de") for i in range(40)]
    odd = [(900, None, "en"), (901, "", None), (902, "12 34 !", "de"), (903, "Der Hund", None), (None, "the dog", None), (904, "é" * 50_000, None)]
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(train + odd, schema).withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[900].rejected and out[901].score == 0
    assert out[903].lang_pred == "de" and out[None].lang_pred == "en" and out[904].lang_pred in ("en", "de")
    kept = {r.doc_id: r for r in langid.accepted(df).collect()}
    assert set(kept) >= set(range(40)) and not set(kept) & {900, 901, 902} and kept[903].lang == "de" and kept[903].score == "clash"
    none = spark.createDataFrame([(1, "words", None)], schema)
    assert [r.lang_pred for r in langid.identify(none).collect()] == ["und"]
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("languages", [("en",), ("en", "de")])
def test_language_rejects_letter_junk_and_unlearned_languages(spark, languages):
    words = {
        "en": "the and of to in that with house water people many other which their time write about these would make like into look more day could come number sound most".split(),
        "de": "der die und das nicht mit haus wasser leute viele andere welche ihre zeit schreiben davon diese würden machen wie hinein sehen mehr tag konnte kommen zahl klang".split(),
        "fi": "talo vesi ihmiset monta muita jotka heidän aika kirjoittaa tästä nämä tekisi kuin sisään katso enemmän päivä voisi tulla numero ääni eniten yksi kaksi kolme".split(),
    }
    rnd = random.Random(9)
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    junk = lambda n: " ".join("".join(rnd.choice("bcdfgjkqxzvwp") for _ in range(rnd.randrange(3, 10))) for _ in range(n))
    train = [(i, text(lang, rnd.choice([20, 60, 200])), lang) for lang in languages for i in range(1000 * languages.index(lang), 1000 * languages.index(lang) + 120)]
    clean = [(5000 + i, text(languages[i % len(languages)], rnd.choice([3, 6, 40])), None) for i in range(60)]
    bad = [(6000 + i, junk(rnd.choice([20, 80])), None) for i in range(30)] + [(7000 + i, text("fi", rnd.choice([20, 80])), None) for i in range(30)]
    kept = {r.doc_id for r in langid.accepted(spark.createDataFrame(train + clean + bad, "doc_id long, text string, lang string")).collect()}
    assert not kept & {i for i, _, _ in bad}
    assert len(kept & {i for i, _, _ in clean}) >= 58 and len(kept) >= 0.98 * (len(train) + len(clean))


def test_every_language_is_learned(spark):
    rnd = random.Random(14)
    rows = []
    for k in range(300):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)]
        rows += [(1000 * k + i, " ".join(rnd.choices(words, k=12)), f"l{k}") for i in range(2 + (k < 290))]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == sorted({r[2] for r in rows})


# ------------------------------------------------------------------ op3


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [toxicity.Term(t, False, 1.0) for t in ("idiot", "scum", "worthless", "disgusting")] + [toxicity.Term("lostrag", True, 1.0)]
    automaton = toxicity.Automaton(terms)
    rnd = random.Random(2)
    words = ["idiot", "scum", "lostragen", "x"]
    for t in terms:
        for _ in range(300):
            w = list(t.text)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                j = rnd.randrange(len(w))
                rnd.choice([lambda: w.insert(j, rnd.choice("abst")), lambda: w.pop(j) if len(w) > 1 else None, lambda: w.__setitem__(j, rnd.choice("abst"))])()
            words.append("".join(w) + (rnd.choice(["", "en", "ung"]) if t.stem else ""))
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    signs = toxicity.word_bytes(data)
    start, end, _ = toxicity.split_words(signs, np.array([0, len(data)]))
    index, _, errors = automaton.read(signs, start, end)
    got = dict(zip(index.tolist(), errors.tolist()))
    for k, w in enumerate(words):
        best = min((min(edit_distance(w[:n], t.text) for n in range(len(w) + 1)) if t.stem else edit_distance(w, t.text), t.edits) for t in terms) if w else None
        want = [d for t in terms for d in [min(edit_distance(w[:n], t.text) for n in range(len(w) + 1)) if t.stem else edit_distance(w, t.text)] if d <= t.edits]
        assert got.get(k) == (min(want) if want else None), (w, best)


def toxic_corpus(n=400):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.choice([8, 40, 120]))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            text.insert(rnd.randrange(len(text)), rnd.choice(["idiot", "scumbag", "worthless"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_finds_misspelt_terms_and_lets_quotations_pass(spark):
    docs, labels = toxic_corpus()
    plain = "the tall ship sails into port at noon with all hands on deck "
    docs += [(900, None), (901, ""), (902, plain + "you idoit you w0rthless scumbg " + plain), (903, "You are an IDIOT, a worthless scumbag"), (None, plain)]
    docs += [(904, plain + 'he wrote "idiot" once ' + plain), (905, plain * 4000)]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(df, lab)
    got = {r.doc_id: r for r in out.collect()}
    truth = dict(labels)
    held = [r for i, r in got.items() if i in truth and r.held_out]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert got[903].predicted == 1 and got[902].score > got[904].score
    assert got[904].predicted == 0 and got[905].predicted == 0 and got[900].score == got[901].score and got[None].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_learns_many_rare_terms(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    terms = sorted({"".join(rnd.choice("bcdfgjkpqvwxz") for _ in range(4)) for _ in range(720)})
    plain = lambda n: [rnd.choice(words) for _ in range(n)]
    held = [t for t in terms for _ in range(10)]
    rnd.shuffle(held)
    toxic = [plain(4) + held[i : i + 1] + plain(4) + held[i + 1 : i + 2] + plain(4) for i in range(0, len(held), 2)]
    docs = [(i, " ".join(t)) for i, t in enumerate([*toxic, *(plain(14) for _ in range(11_000))])]
    labels = [(i, int(i < len(toxic))) for i, _ in docs]
    model = toxicity.learn(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    probes = [(i, " ".join([*plain(6), t, *plain(6)])) for i, t in enumerate(terms)] + [(-1, " ".join(plain(13)))]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(probes, DOCS), model).collect()}
    assert sum(got[i] > got[-1] for i in range(len(terms))) >= 0.99 * len(terms)
    # copies of one text are not evidence
    copies = [(50_000 + i, " ".join(plain(5)) * (i == 0) or "tal mor zzyzxa nel rum sol ") for i in range(40)]
    more = labels + [(i, 1) for i, _ in copies]
    again = toxicity.learn(spark.createDataFrame(docs + copies, DOCS), spark.createDataFrame(more, "doc_id long, toxic int"))
    assert not any("zzy" in t.text for t in again.automaton.terms)


def test_lexicon_over_several_automata_reads_like_one(monkeypatch):
    terms = [toxicity.Term(t, False, w) for t, w in (("idiot", 1.0), ("idiom", 2.0), ("scum", 1.0), ("worthless", 3.0), ("worthness", 1.0))]
    data = np.frombuffer(b"idiot idio scum worthles worthnes wrthless none", np.uint8)
    signs = toxicity.word_bytes(data)
    start, end, _ = toxicity.split_words(signs, np.array([0, len(data)]))
    results = []
    for n in (300, 2, 1):
        monkeypatch.setattr(toxicity, "TERMS_PER_AUTOMATON", n)
        lexicon = toxicity.Lexicon(terms)
        results.append([(w, lexicon.terms[t].text, e) for w, t, e in zip(*(x.tolist() for x in lexicon.read(signs, start, end)))])
    assert results[0] == results[1] == results[2] and len(results[0]) == 6


def test_quotation_marks():
    assert toxicity.quoted('he said "you ', ' there" and left') and not toxicity.quoted("you ", " there")
    assert toxicity.quoted("er sagte „du ", "“ und ” ging") and toxicity.quoted("dit « ", " » et") and not toxicity.quoted('"so" you ', ' "and"  x')


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}


# ------------------------------------------------------------------ op5

TEXTS = [
    "Hello, World!! it's I'm", "“quoted” don't  x\u00a0y\u2003z\x1cq\x85r", "a...b ,,c .d", None, "", "  ", "İstanbul ΣΑΣ café CAFÉ cafe\u0301.",
    "日本語 テスト123 12a3 <|endoftext|> A<|ENDOFTEXT|>b", "éa,b;c:d!e?f.g", "ﬁ ½ ß ẞ K Ⅷ ²", "\n\tx\x0by\x0cz\r", "a'll.'s 're-'ve", "x" * 5000, "ªº µ ÀÖØö÷øÿ× Þß",
]


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer

    whole, parts = Tokenizer.from_file(packing_tokenizer()), packing.WordTokens(packing_tokenizer())
    for batch in (TEXTS, *([t] for t in TEXTS)):
        ids, at = parts.encode(pa.array(batch, pa.string()), 2)
        for i, t in enumerate(batch):
            assert ids[at[i] : at[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids + [2]


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(10_000, TEXTS[0]), (None, "no id"), (10_099, "word " * 20_000)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5), packing_tokenizer(), keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing_tokenizer())
    want = collections.Counter()
    for i, t in rows:
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    pieces = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append(r)
    for (i, ids), n in want.items():
        mine = [r for r in pieces[i] if r.doc_tokens == len(ids) and r.ids == list(ids[r.start : r.start + r.length])]
        assert sum(r.length for r in mine) == n * len(ids)
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 4096 + 0.01 * sum(r.length for r in got)


def test_plan_uses_every_piece_and_fills_windows():
    rnd = random.Random(1)
    for n in (0, 1, 5, 300, 20_000):
        count = collections.Counter(min(4096, max(1, int(rnd.lognormvariate(6.5, 1.2)))) for _ in range(n))
        patterns = packing.plan(dict(count))
        used = collections.Counter()
        for times, pattern in patterns:
            assert sum(k * v for k, v in pattern.items()) <= 4096
            for k, v in pattern.items():
                used[k] += times * v
        assert used == count
    total = sum(k * v for k, v in count.items())
    fills = [(t, sum(k * v for k, v in p.items())) for t, p in patterns]
    assert sum(t * (4096 - f) for t, f in fills if f & (f - 1)) <= 0.0005 * total


def test_fill_is_the_best_subset_sum():
    rnd = random.Random(6)
    for _ in range(60):
        items = [rnd.randrange(1, 60) for _ in range(10)]
        room = rnd.randrange(1, 150)
        best = max(s for m in range(1 << 10) for s in [sum(x for k, x in enumerate(items) if m >> k & 1)] if s <= room)
        count = collections.Counter(items)
        found = packing.fill(dict(count), room, sorted(count, reverse=True))
        assert sum(k * v for k, v in found.items()) == best and all(v <= count[k] for k, v in found.items())


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), packing_tokenizer()).count() == 0
