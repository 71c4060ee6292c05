"""WARC, vectors, URLs, mixing, the pipeline, and the queries with SQL."""

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from oracle_check import compare, duck
from spanlake.llm import embeddings, langid, mixing, shared, topk, urls, warc
from spanlake.llm.oracle import ORACLE
from spanlake.llm.queries import QUERIES
from spanlake.llm.shared import components, table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    ok, said = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert ok, said


def test_eleven_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11)) and "pipeline" in entry.queries()


# ------------------------------------------------------------------ op1

PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "ü" * 800
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "b", "x" * 999), (4, "b", "x" * 999), (5, "c", None), (6, "c", ""), (None, "d", big), (2, "e", big), (9, "f", "y" * 300_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit(0)).repartition(3)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        keeper = 2 if h == big else None
        again = keeper is not None and i != keeper
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keeper if again else None))
    manifest = warc.write_archives(df, warc.shared_path(spark, "t"), archive_bytes=1 << 10)
    assert manifest.count() > 2
    got = warc.read_archives(manifest)
    assert rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sorted(want, key=str)
    texts = {(r.page_id, r.payload.decode()) for r in got.collect() if r.record_type == "response"}
    assert (9, "y" * 300_000) in texts and (5, "") in texts
    assert {r.url for r in got.collect()} == {"http://a/%0D%0AX: y", None, "b", "c", "d", "e", "f"}
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_warc_reader_rejects_damage():
    record = warc.page_record(7, "u", b"payload " * 1000, None)
    assert next(warc.read_records(io.BytesIO(warc.warcinfo_record() + record)))[:3] == (7, "u", 8000)
    for bad in (record[:-9], record[: len(record) // 2], b"no gzip" + record):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
    plain = zlib.decompress(record, 31)
    squeeze = lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()
    for a, b in ((b"payload p", b"pbyload p"), (b"Content-Length: 80", b"Content-Length: 81"), (b"WARC/1.1", b"WURC/1.1")):
        assert a in plain
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(squeeze(plain.replace(a, b, 1)))))


def test_warc_headers_of_any_length(spark):
    urls_ = ["http://a/" + "x" * (3 << 20), "http://b/" + "y" * ((1 << 16) - 150), "c"]
    records = [warc.page_record(i, u, b"p" * 10, None) for i, u in enumerate(urls_)]
    assert [r[:2] for r in warc.read_records(io.BytesIO(b"".join(records)))] == list(enumerate(urls_))
    # a header's end may lie across two chunks, wherever they are cut
    for cut in range(1, 9):
        block = warc.Block(iter([b"ab\r\n\r\ncd"[:cut], b"ab\r\n\r\ncd"[cut:]]))
        assert block.until(b"\r\n\r\n") == b"ab" and b"".join(block.exactly(2)) == b"cd"
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls_)], PAGES)
    got = warc.read_archives(warc.write_archives(df, warc.shared_path(spark, "long")))
    assert {r.page_id: r.url for r in got.collect()} == dict(enumerate(urls_))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.encode_record([("WARC-Type", "response")], b"no end" * 10))))


# ------------------------------------------------------------------ op4, op7

VECTORS = "vec_id long, embedding array<float>"


def vectors():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 8))
    rows = [(i, [float(x) for x in (base[i % 30] + (0 if i % 7 == 0 else rng.standard_normal(8) * 0.12))]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None]), (304, [float("nan"), 1.0]), (305, [1.0, 2.0]), (306, [2.0, 4.0])]
    return rows + [(307, [float("inf"), 1.0]), (None, [1.0, 2.0]), (305, [1.0, 2.0]), (308, [-1.0, 2.0]), (309, [1e-30, 2e-30]), (310, [1e30, 2e30])]


def brute_links(rows):
    n = len(rows)
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, group = [0] * n, list(range(n))
    for i in good:
        for j in good:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(np.array(rows[k][1], np.float32), float) for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                    links[i] += 1
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    least = collections.defaultdict(list)
    for g, (k, _) in zip(group, rows):
        least[g].append(k)
    return sorted(((k, m, None if k is None else min(least[g]), k is not None and k == min(least[g])) for (k, _), m, g in zip(rows, links, group)), key=str)


@pytest.mark.parametrize("block", [512, 4])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    df = spark.createDataFrame(vectors(), VECTORS).withColumn("rep", F.lit("clash")).withColumn("weight", F.lit(0)).repartition(3)
    assert rows_of(embeddings.near_duplicates(df)) == brute_links(vectors())
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_hashing_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = embeddings.unit(rng.standard_normal((4000, 64)))
    side = rng.standard_normal((4000, 64))
    side = embeddings.unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    k, tables = embeddings.shape(50_000)
    met = (embeddings.bucket_hashes(a, k, tables) == embeddings.bucket_hashes(b, k, tables)).any(axis=1)
    assert met.mean() >= 0.97


@pytest.mark.parametrize("block,queries", [(8192, 512), (40, 7)])
def test_top_k_equals_brute_force(spark, block, queries):
    rows = [(k, v) for k, v in vectors() if k != 310]
    df = spark.createDataFrame(rows, VECTORS).withColumn("block", F.lit("clash"))
    x = topk.integer_vectors(df)
    got = topk.search(x, x.filter("vec_id % 50 = 0"), 5, block, queries)
    good = [(k, np.floor(np.array(np.array(v, np.float32), float) * 256)) for k, v in rows if k is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, qv in good:
        if q % 50 == 0:
            scores = []
            for k, v in good:
                m = min(len(v), len(qv))
                scores.append((-int(v[:m] @ qv[:m]), k)) if k != q else None
            want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scores)[:5])]
    assert rows_of(got) == sorted(want, key=str)
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_top_k_beyond_double_precision(spark):
    rows = [(0, [3e6, 1.0]), (50, [3e6, 1.00390625]), (51, [3e6, 1.0078125]), (52, [3e6, 1.01171875])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2)
    best = [(r["query_id"], r["vec_id"], r["score"]) for r in got.collect() if r["rank"] == 1]
    x = {k: [int(np.floor(c * 256)) for c in v] for k, v in rows}
    assert sorted(best) == [(0, 52, sum(a * b for a, b in zip(x[0], x[52]))), (50, 52, sum(a * b for a, b in zip(x[50], x[52])))]


# ------------------------------------------------------------------ op8


def test_urls_rules_and_odd_urls(spark):
    rows = [(1, None), (2, "nothing"), (3, "HTTP://WWW.Example.ORG/en/12?x=1#f"), (4, "http://example.org/es"), (5, "http://a.org"), (6, "x://b.com/de/1?q"), (7, "x://b.com/fr/")]
    rows += [(7, "x://b.com/fr/"), (8, "://"), (None, "http://xorg/"), (9, ""), (10, "http://com?/de/"), (11, "http://q.com/\n/de/"), (12, "http://x.net/" + "a/" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("label", F.lit("clash"))
    got = collections.Counter((r.page_id, r.host, r.path[:8], r.rule) for r in urls.judge(df).collect())
    assert got == collections.Counter([
        (1, "", "", None), (2, "", "", None), (3, "www.example.org", "/en/12", "example.org/en/1"), (4, "example.org", "/es", "org/"), (5, "a.org", "", None),
        (6, "b.com", "/de/1", "com/de/"), (7, "b.com", "/fr/", "com/fr/"), (7, "b.com", "/fr/", "com/fr/"), (8, "", "", None), (None, "xorg", "/", None), (9, "", "", None),
        (10, "com", "", None), (11, "q.com", "/\n/de/", None), (12, "x.net", "/a/a/a/a", None),
    ])
    assert {r.verdict for r in urls.judge(df).collect()} <= {"allow", "block"}
    assert urls.judge(df.limit(0)).count() == 0
    alike = urls.judge(spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], "page_id long, url string"))
    assert [r.verdict for r in alike.collect()] == ["allow", "allow"]


def test_trees_learn_from_the_rules(spark):
    """URLs like the blocked ones, which no rule fits, are blocked; no Python runs."""
    rows = [(i, f"http://h{i % 40}.com/{'de' if i % 2 else 'fr'}/{i}{'?a=1&b=2&c=3&d=4' if i % 2 else ''}") for i in range(600)]
    rows += [(1000 + i, f"http://h{i}.net/xx/{i}{'?a=1&b=2&c=3&d=4' if i % 2 else ''}") for i in range(40)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"))
    got = {r.page_id: r.verdict for r in out.collect()}
    assert sum(got[1000 + i] == ("block" if i % 2 else "allow") for i in range(40)) >= 36
    assert not re.search("Python|Arrow", out._jdf.queryExecution().toString())


# ------------------------------------------------------------------ op9

DOCS = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1), passes=3):
    """Share by weight, cut at the cap, give the excess back, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(passes * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        share = {s: passes * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        above = {s for s in names if s not in full and share[s] > passes * sizes[s]}
        if not above:
            return share
        full |= above


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{int(rng.integers(0, 12)) ** 2 // 30}") for i in range(1500)]
    rows += [(2000, None, "s0"), (2001, "a b", None), (2001, "a b", None), (None, "c", "tiny"), (2002, "x " * 9000, "b")]
    df = spark.createDataFrame(rows, DOCS).withColumn("sid", F.lit("clash")).withColumn("start", F.lit("clash"))
    plan = mixing.mix(df)
    got = mixing.words_taken(plan).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 + 0.01 * t
    again = mixing.words_taken(mixing.mix(df.repartition(7)))
    assert sorted((r.doc_id, r.source, r["size"], r.taken) for r in got if r.doc_id) == sorted((r.doc_id, r.source, r["size"], r.taken) for r in again.collect() if r.doc_id)
    # as documents: the same words, and passes follow each other
    mixed = mixing.mixed(df).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(taken.values()) and {r.sid for r in mixed} == {"clash"}
    slots = plan.schedule.orderBy("slot").collect()
    share = collections.Counter(r.sid for r in slots[: len(slots) // 4])
    quota = {r.sid: r.quota for r in plan.sources.collect()}
    for sid, q in quota.items():
        assert abs(share[sid] - q / 4) <= 6 + 0.02 * q
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_points_are_exact_at_any_slot(spark):
    first = 10**13
    got = spark.range(first, first + 2000).select("id", mixing.point("id").alias("u")).collect()
    assert all(r.u == (r.id + 1) * mixing.PHI % mixing.UNIT for r in got) and len({r.u for r in got}) == 2000


def test_mix_meets_quotas_of_very_unlike_sources(spark):
    quotas = [1, 150_000, 2, 0, 40_000, 3]
    rows = [(i, f"s{i}", q, 1, float(q), max(1, q // 2), q) for i, q in enumerate(quotas)]
    sources = spark.createDataFrame(rows, "sid int, source string, source_size long, weight int, target double, n_blocks long, quota long")
    got = mixing.slot_sequence(sources)
    ranks = {r.sid: (r.n, r.lo, r.hi) for r in got.groupBy("sid").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect()}
    assert ranks == {i: (q, 0, q - 1) for i, q in enumerate(quotas) if q}
    assert got.select("slot").distinct().count() == sum(quotas)


@pytest.mark.parametrize("range_rows", [1, 1 << 16])
def test_mix_places_documents_alike_whatever_the_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(mixing, "LEAST_KEY_DIGITS", 1)
    df = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 2}") for i in range(600)], DOCS)
    for sid in (1, 2):
        at = sorted((r.start, r["size"]) for r in mixing.mix(df).documents.filter(F.col("sid") == sid).collect() if r["size"])
        assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0


# ------------------------------------------------------------------ components


@pytest.mark.parametrize("per_task", [1 << 20, 40])
def test_components_of_chains_and_stars(spark, monkeypatch, per_task):
    monkeypatch.setattr(shared, "LINKS_PER_TASK", per_task)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(139, 200), (300, 300)]
    nodes = spark.range(0, 320).select(F.col("id"))
    got = dict(components(nodes, spark.createDataFrame(links, "a long, b long").repartition(4), "t").collect())
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[139] == 100 and got[300] == 300 and got[310] == 310


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on what its predecessor kept."""
    from test_text_operators import brute_components, brute_substrings

    docs = table(spark, SF, "documents")
    columns = docs.columns
    one = corpus_pipeline.language_id(spark, docs, SF)
    judged = langid.predict(docs, langid.fit(docs.filter(langid.fold(F.col("doc_id"), 4) != 2)))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in judged.filter("not rejected").collect()}
    one = one.cache()
    two = corpus_pipeline.near_duplicates(spark, one, SF).cache()
    keep = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in one.collect()]) if i == c}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == keep
    three = corpus_pipeline.substring_dedup(spark, two, SF).cache()
    gone = {i: n for i, _, n, _, _ in brute_substrings([(r.doc_id, r.text) for r in two.collect()])}
    before = {r.doc_id: len(r.text.encode()) for r in two.collect()}
    assert three.columns == columns
    for r in three.collect():
        assert 0 <= before[r.doc_id] - gone[r.doc_id] - len(r.text.encode()) <= 6 * (gone[r.doc_id] > 0) * 20 and r.n_chars == len(r.text)
    four = corpus_pipeline.source_mix(spark, three, SF).cache()
    sizes, words = collections.Counter(), collections.Counter()
    for r in three.collect():
        sizes[r.source] += len(r.text.split())
    for r in four.collect():
        words[r.source] += len(r.text.split())
    assert four.columns == columns
    for s, t in targets(sizes).items():
        assert abs(words[s] - t) <= 2 + 0.01 * t
    five = corpus_pipeline.pack(spark, four, SF)
    full = [r for r in five.collect() if r.start == 0]
    assert len(full) == four.count()


def test_pipeline_result_holds_the_token_ids(spark):
    docs = table(spark, SF, "documents").limit(20)
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_pipeline_runs_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


