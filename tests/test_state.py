"""Mergeable state, parts and their compaction, membership filters, publishing."""

import json
import math
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from spanlake.operators import fold, partial, raw
from spanlake.plans.state import build_state
from spanlake.streaming import store as store_module
from spanlake.streaming.store import ConcurrentCommit, StateStore
from spanlake.streaming.sync import append_events, commit

FOLDS = {"traces": fold.fold_traces, "observations": fold.fold_observations, "scores": fold.fold_scores}


def written(spark, df, scratch, name):
    path = os.path.join(scratch, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def random_events(seed, n):
    """Events of a few keys: late ones, equal and missing times, nested metadata that
    turns from objects into scalars and back, empty objects."""
    rng = random.Random(seed)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.6:
            return {rng.choice("abc"): value(depth - 1) for _ in range(rng.randrange(3))}
        return rng.choice([1, 2.5, "x", None, True, [1, {"a": 2}], {}])

    out = []
    for i in range(n):
        kind = rng.choice(["trace-create", "span-create", "span-update", "generation-update", "score-create"])
        body = {"id": f"{kind[0]}{rng.randrange(6)}"}
        for k, v in {
            "name": rng.choice(["n1", "n2", None, "{}"]), "userId": "u", "sessionId": f"s{i}", "traceId": f"t{rng.randrange(3)}", "metadata": value(3),
            "input": rng.choice([{"q": i}, {}, None]), "value": rng.choice([1, "2", True, None]), "comment": rng.choice(["c", None]), "source": "EVAL",
            "costDetails": {"total": rng.randrange(9)}, "usageDetails": rng.choice([{}, {"input": i}]), "startTime": "2024-01-01T00:00:00Z",
        }.items():
            if rng.random() < 0.6:
                body[k] = v
        time = None if rng.random() < 0.1 else f"2024-01-01T00:00:{rng.randrange(12):02d}Z"
        out.append((f"e{i:04d}", time, kind, json.dumps(body)))
    return out


def log_of(spark, events):
    return raw.raw_rows(spark.createDataFrame(events, "id string, timestamp string, type string, body string"), "p")


@pytest.mark.parametrize("seed", [1])
def test_batches_merge_to_the_full_fold(spark, scratch, seed):
    """Any split into batches, in any order and grouping, gives the fold of all events."""
    events = random_events(seed, 260)
    log = written(spark, log_of(spark, events), scratch, "log")
    rng = random.Random(seed)
    for name, full in FOLDS.items():
        want = sorted(map(str, full(log).collect()))
        batch_of = {e[0]: rng.randrange(4) for e in events}
        batches = []
        for b in range(4):
            mine = [e for e, x in batch_of.items() if x == b]
            batches.append(written(spark, partial.state_of(log.where(F.col("event_id").isin(mine)), name), scratch, f"{name}{b}"))
        rng.shuffle(batches)
        pair = written(spark, partial.merge(batches[0].unionByName(batches[1]), name), scratch, f"{name}-pair")
        rest = written(spark, partial.merge(batches[2].unionByName(batches[3]), name), scratch, f"{name}-rest")
        merged = written(spark, partial.merge(pair.unionByName(rest), name), scratch, f"{name}-all")
        assert sorted(map(str, partial.finish(merged, name).collect())) == want
        assert merged.count() == merged.select(*partial.KEY).distinct().count()


def test_empty_state(spark, scratch):
    st = StateStore(spark, os.path.join(scratch, "state"))
    assert append_events(st, spark.createDataFrame([], "id string, timestamp string, type string, body string"), "p") == {"processed": 0, "skipped": 0}
    assert [st.read(t).count() for t in FOLDS] == [0, 0, 0] and st.get("traces", "p", "x").count() == 0


def reads_of(st):
    return {t: sorted(map(str, st.read(t).collect())) for t in FOLDS}


def test_many_commits_stay_a_few_parts(spark, scratch, monkeypatch):
    """Commits in random order, late events among them: the state equals one fold, the
    parts grow with the logarithm of the commits, and what no record names is deleted."""
    monkeypatch.setattr(store_module, "FANOUT", 2)
    monkeypatch.setattr(store_module, "LEAST_BYTES", 20_000)
    monkeypatch.setattr(store_module, "KEEP_RECORDS", 2)
    events = random_events(7, 120)
    random.Random(3).shuffle(events)
    st = StateStore(spark, os.path.join(scratch, "state"))
    n = 10
    for i in range(n):
        commit(st, log_of(spark, events[i::n]), "direct")
        parts = st.record()["parts"]
        assert max(len(p) for p in parts.values()) <= 2 + 2 * math.log2(i + 2)
    full = build_state(written(spark, log_of(spark, events), scratch, "log"))
    assert reads_of(st) == {t: sorted(map(str, getattr(full, t).collect())) for t in FOLDS}
    assert st.read_raw().count() == len(events) == st.record()["counters"]["events"]
    # a get reads one bucket of each part and gives the row
    row = st.read("observations").first()
    assert st.get("observations", "p", row["id"]).collect() == [row]
    st.vacuum(keep=1)
    named = {p["id"] for parts in st.record()["parts"].values() for p in parts}
    for table in store_module.TABLES:
        folder = os.path.join(scratch, "state", table)
        assert set(os.listdir(folder) if os.path.isdir(folder) else []) <= named
    assert len([x for x in os.listdir(os.path.join(scratch, "state", "_commits")) if x.endswith(".json")]) == 1


def test_reader_of_an_older_record_is_not_disturbed(spark, scratch, monkeypatch):
    monkeypatch.setattr(store_module, "FANOUT", 2)
    monkeypatch.setattr(store_module, "LEAST_BYTES", 1 << 30)
    st = StateStore(spark, os.path.join(scratch, "state"))
    events = random_events(9, 40)
    commit(st, log_of(spark, events[:20]))
    before, want = st.read("observations"), sorted(map(str, st.read("observations").collect()))
    commit(st, log_of(spark, events[20:]))
    assert len(st.record()["parts"]["observations"]) == 1 and st.record()["n"] == 3  # two commits, one compaction
    assert sorted(map(str, before.collect())) == want


def test_buckets_follow_the_bytes(spark, scratch):
    st = StateStore(spark, os.path.join(scratch, "state"), bucket_bytes=2000)
    rows = spark.range(3000).select(F.lit("p").alias("project_id"), F.format_string("event-%05d", "id").alias("event_id"))
    small, large = st.put("ids", rows.limit(10), 300), st.put("ids", rows, 60_000)
    assert small["buckets"] == 1 and large["buckets"] == 32 and large["words"] == 750
    # a bucket of the small part splits into buckets of the large one
    assert st.part("ids", large, list(range(32))).count() == 3000
    assert 0 < st.part("ids", large, [5]).count() < 300


def test_membership_reads_only_what_passes_the_filters(spark, scratch):
    st = StateStore(spark, os.path.join(scratch, "state"), bucket_bytes=4000)
    ids = lambda lo, hi: spark.range(lo, hi).select(F.lit("p").alias("project_id"), F.concat(F.lit("e"), "id").alias("event_id"))
    record = st.record()
    record["parts"]["ids"] = [st.put("ids", ids(0, 4000), 40_000), st.put("ids", ids(4000, 5000), 9000)]
    keep = lambda df, name: written(spark, df, scratch, f"{name}-{random.random()}")
    read, part = [], StateStore.part

    def counting(self, name, entry, buckets=None):
        read.append((entry["id"], buckets))
        return part(self, name, entry, buckets)

    st.part = counting.__get__(st)
    got = st.known("ids", ids(3990, 4010).unionByName(ids(9000, 9020)), record, keep)
    assert sorted(r["event_id"] for r in got.collect()) == [f"e{i}" for i in range(3990, 4010)]
    # new ids read no id file but for false positives
    read.clear()
    st.known("ids", ids(20_000, 20_200), record, keep)
    assert sum(len(b) for _, b in read) <= 8
    other = ids(0, 50).withColumn("project_id", F.lit("q"))
    none = st.known("ids", other, record, keep)
    assert none is None or none.count() == 0


def test_of_racing_writers_one_wins(spark, scratch):
    st = StateStore(spark, os.path.join(scratch, "state"))
    record, outcome, start = st.record(), [], threading.Barrier(6)

    def write(i):
        start.wait()
        try:
            st.publish(record | {"counters": {"writer": i}}, 0)
            outcome.append(i)
        except ConcurrentCommit:
            outcome.append(None)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [x for x in outcome if x is not None]
    assert len(outcome) == 6 and len(won) == 1
    assert st.record()["counters"]["writer"] == won[0] and st.record()["n"] == 1
    assert [x for x in os.listdir(os.path.join(scratch, "state", "_commits")) if x.endswith(".json")] == ["000000000001.json"]
