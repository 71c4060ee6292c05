"""Incremental sync over stored objects: first run, no-op rerun, later objects,
and incremental state == full rebuild."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanlake.operators import otlp, raw, store
from spanlake.plans.state import build_state
from spanlake.sources import files, overlays
from spanlake.streaming.sync import SyncJob

COLS_T = ["id", "name", "user_id", "session_id", "start_time", "end_time", "total_cost"]
COLS_O = ["id", "trace_id", "parent_observation_id", "type", "name", "start_time", "end_time", "total_cost", "usage_details_json"]


def _write_objects_as_files(objects, root):
    """Test fixture: one JSON file per object under otel/demo/<hour>/."""
    for r in objects.select("object_key", F.to_json("resource_spans").alias("j")).collect():
        path = os.path.join(root, "otel", "demo", "2024", "01", "01", "00", os.path.basename(r.object_key))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(r.j)


def _full(spark, objects, scratch, name):
    ev = otlp.otlp_events(objects.withColumn("object_key", F.concat(F.lit("otel/demo/2024/01/01/00/"), F.regexp_extract("object_key", r"([^/]+)$", 1))))
    entity = F.coalesce(F.get_json_object(F.col("body"), "$.id"), F.col("object_key"))
    path = os.path.join(scratch, name)
    raw.dedupe_skip(raw.raw_rows(ev, "demo", entity_id=entity)).write.parquet(path)
    return build_state(spark.read.parquet(path))


def _rows(df, cols):
    """Rows as sorted tuples; doubles rounded (cost sums depend on order)."""
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())


def test_sync_first_noop_incremental(spark, scratch):
    objects = overlays.f4_objects(spark, SF_SMALL)
    keys = sorted(r.object_key for r in objects.select("object_key").collect())[:20]
    objects = objects.where(F.col("object_key").isin(keys)).cache()
    half = keys[:10]
    first = objects.where(F.col("object_key").isin(half))
    store_root = os.path.join(scratch, "store")
    _write_objects_as_files(first, store_root)
    job = SyncJob(spark, store_root, "demo", os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"))
    res = job.run()
    assert sum(r["events"] for r in res) > 0
    want = _full(spark, first, scratch, "full1")
    assert _rows(job.state.read("traces"), COLS_T) == _rows(want.traces, COLS_T)
    assert _rows(job.state.read("observations"), COLS_O) == _rows(want.observations, COLS_O)

    # second run over the same objects reads nothing (ledger = checkpoint)
    job2 = SyncJob(spark, store_root, "demo", os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"))
    assert sum(r["events"] for r in job2.run()) == 0

    # later objects: incremental state equals a full rebuild of everything
    _write_objects_as_files(objects, store_root)
    job3 = SyncJob(spark, store_root, "demo", os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"))
    assert sum(r["events"] for r in job3.run()) > 0
    want = _full(spark, objects, scratch, "full2")
    assert _rows(job3.state.read("traces"), COLS_T) == _rows(want.traces, COLS_T)
    assert _rows(job3.state.read("observations"), COLS_O) == _rows(want.observations, COLS_O)


def test_replay_of_committed_batch_is_harmless(spark, scratch):
    """Re-committing the same raw rows (a retried micro-batch) changes nothing."""
    from spanlake.streaming.store import StateStore
    from spanlake.streaming.sync import commit

    objects = overlays.f4_objects(spark, SF_SMALL)
    ev = otlp.otlp_events(objects)
    rows = raw.raw_rows(ev, "demo", entity_id=F.coalesce(F.get_json_object(F.col("body"), "$.id"), F.col("object_key")))
    st = StateStore(spark, os.path.join(scratch, "state"))
    a = commit(st, rows, "otel")
    traces_once = _rows(st.read("traces"), COLS_T)
    b = commit(st, rows, "otel")
    assert a["events"] > 0 and b["events"] == 0
    assert _rows(st.read("traces"), COLS_T) == traces_once
    assert st.read_raw().count() == a["events"]


def test_line_layout_keeps_objects_apart_and_prunes_by_time(spark, scratch):
    objects = overlays.f4_objects(spark, SF_SMALL).limit(6).cache()
    n_spans = sum(r.n for r in otlp.flatten_spans(objects).groupBy("object_key").agg(F.count("*").alias("n")).collect())
    store.write_otlp_objects(objects, scratch, "demo", F.lit("2024-01-01 10:17:00").cast("timestamp"))
    store.write_otlp_objects(objects, scratch, "demo", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    base = os.path.join(scratch, "otel", "demo", "year=2024", "month=01", "day=01", "hour=10", "minute=17")
    assert os.path.isdir(base)
    docs = files.read_documents(spark, base, scratch, lines=True)
    back = files.otlp_lines(docs)
    assert sorted(r.object_key for r in back.collect()) == sorted(r.object_key for r in objects.collect())
    ids = otlp.otlp_events(back).where(F.col("type") != "trace-create").select("id").distinct().count()
    assert ids == n_spans
    window = files.otlp_window(spark, scratch, "demo", "2024-01-01T10:00:00Z", "2024-01-01T11:00:00Z")
    assert window.count() == 6
    assert "PartitionFilters: [" in window._jdf.queryExecution().toString() and window.inputFiles()
    # the same objects written again are the same objects: the ledger has them
    job = SyncJob(spark, scratch, "demo", os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"), lines=True)
    job.run()
    assert job.state.read("observations").count() == n_spans
    assert job.state.ledger().count() == 6


ODD_KEYS = ["plain", "t 1", "t%201", "t[1]", "a+b", "x{y}*?"]


def _event(i, **body):
    return {"id": f"e{i}", "timestamp": f"2024-01-01T00:00:{i:02d}.000Z", "type": "trace-create", "body": body}


def _put(root, key, value):
    path = os.path.join(root, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


def _manifest(root, name, keys):
    objects = [{"key": f"demo/trace/{k}/o.json", "entityType": "trace", "entityId": k, "eventIds": [], "minTimestamp": "", "maxTimestamp": "", "sha256": ""} for k in keys]
    _put(root, f"demo/manifests/2024/02/01/00/00/{name}.json", {"batchId": name, "projectId": "demo", "createdAt": "2024-02-01T00:00:00Z", "objects": objects})


def _job(spark, scratch, **more):
    return SyncJob(spark, os.path.join(scratch, "store"), "demo", os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"), **more)


def test_object_keys_are_taken_literally_and_ledgers_count(spark, scratch):
    root = os.path.join(scratch, "store")
    for i, k in enumerate(ODD_KEYS):
        _put(root, f"demo/trace/{k}/o.json", [_event(i, id=k, name=k)])
    _manifest(root, "b1", ODD_KEYS)
    _manifest(root, "b2", ODD_KEYS[:2])
    job = _job(spark, scratch)
    job.run()
    assert sorted(r.id for r in job.state.read("traces").collect()) == sorted(ODD_KEYS)
    record = job.state.record()
    assert record["counters"]["events"] == len(ODD_KEYS) and record["counters"]["manifests"] == 2
    assert record["counters"]["objects"] == len(ODD_KEYS) and record["watermark"]["manifests"]
    # the checkpoint lost: everything is listed again, and the ledger has it all
    again = SyncJob(spark, root, "demo", os.path.join(scratch, "state"), os.path.join(scratch, "ckpt2"))
    stats = again.run()[-1]
    assert stats["events"] == 0 and stats["manifests"] == 0 and stats["manifests_skipped"] == 2


@pytest.mark.parametrize("content", ['[{"id": "e1", "type":', '{"not": "an array"}', None])
def test_unreadable_or_missing_object_fails_and_commits_nothing(spark, scratch, content):
    root = os.path.join(scratch, "store")
    _put(root, "demo/trace/good/o.json", [_event(1, id="good")])
    if content is not None:
        _put(root, "demo/trace/bad/o.json", content)
    _manifest(root, "b1", ["good", "bad"])
    job = _job(spark, scratch)
    with pytest.raises(Exception):
        job.run()
    assert job.state.record()["n"] == 0 and job.state.read("traces").count() == 0
    _put(root, "demo/trace/bad/o.json", [_event(2, id="bad")])
    assert sum(r["events"] for r in _job(spark, scratch).run()) == 2


def test_repeated_json_key_keeps_the_last(spark, scratch):
    _put(scratch, "in/a.json", '[{"scopeSpans": [], "scopeSpans": [{"spans": [{"traceId": "ab", "spanId": "cd"}]}]}]')
    objects = files.otlp_objects(files.read_documents(spark, os.path.join(scratch, "in")))
    assert otlp.flatten_spans(objects).count() == 1


def _events(spark, rows):
    return spark.createDataFrame([(e["id"], e["timestamp"], e["type"], json.dumps(e["body"])) for e in rows], "id string, timestamp string, type string, body string")


FIRST = [
    {"id": "a", "timestamp": "2024-01-01T00:00:00Z", "type": "trace-create", "body": {"id": "t1", "name": "one"}},
    {"id": "b", "timestamp": "2024-01-01T00:00:01Z", "type": "span-create", "body": {"id": "o1", "traceId": "t1", "totalCost": 2}},
    {"id": "c", "timestamp": "2024-01-01T00:00:02Z", "type": "score-create", "body": {"id": "s1", "traceId": "t1", "name": "n", "value": 1}},
]
SECOND = [
    {"id": "d", "timestamp": "2024-01-01T00:00:03Z", "type": "trace-create", "body": {"id": "t2", "name": "two"}},
    {"id": "e", "timestamp": "2024-01-01T00:00:04Z", "type": "span-update", "body": {"id": "o1", "traceId": "t2"}},
    {"id": "f", "timestamp": "2024-01-01T00:00:05Z", "type": "span-create", "body": {"id": "o2", "traceId": "t2", "totalCost": 3}},
]


def _state(st):
    return {t: sorted(map(str, st.read(t).collect())) for t in ("traces", "observations", "scores")} | {"raw": st.read_raw().count()}


def test_commit_fails_at_any_write_and_is_retried(spark, scratch, monkeypatch):
    """Whichever write fails, readers see the last commit, and a retry gives what a
    full rebuild gives."""
    from pyspark.sql import DataFrameWriter
    from spanlake.streaming.store import StateStore
    from spanlake.streaming.sync import append_events, commit

    whole = StateStore(spark, os.path.join(scratch, "whole"), buckets=2)
    append_events(whole, _events(spark, FIRST + SECOND), "p")
    want = _state(whole)
    st = StateStore(spark, os.path.join(scratch, "state"), buckets=2)
    assert append_events(st, _events(spark, FIRST), "p") == {"processed": 3, "skipped": 0}
    before, rows = _state(st), raw.raw_rows(_events(spark, SECOND), "p")
    write, writes = DataFrameWriter.parquet, []

    def counting(self, path, *a, **b):
        writes.append(path)
        if len(writes) == fail_at:
            raise OSError("disk gone")
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", counting)
    # the same commit elsewhere tells how many writes there are; each of them fails in turn
    fail_at, other = 0, StateStore(spark, os.path.join(scratch, "other"), buckets=2)
    append_events(other, _events(spark, FIRST), "p")
    writes.clear()
    commit(other, rows)
    for fail_at in range(1, len(writes) + 1):
        writes.clear()
        with pytest.raises(OSError):
            commit(st, rows)
        assert _state(st) == before
    monkeypatch.setattr(StateStore, "publish", lambda *a: (_ for _ in ()).throw(OSError("no rename")))
    fail_at = 0
    with pytest.raises(OSError):
        commit(st, rows)
    monkeypatch.undo()
    assert _state(st) == before
    commit(st, rows)
    assert _state(st) == want
    assert {r.id: r.total_cost for r in st.read("traces").collect()} == {"t1": None, "t2": 5.0}


def test_projects_do_not_share_ids(spark, scratch):
    from spanlake.plans import reads
    from spanlake.streaming.store import StateStore
    from spanlake.streaming.sync import append_events

    st = StateStore(spark, os.path.join(scratch, "state"), buckets=2)
    append_events(st, _events(spark, FIRST), "p")
    other = [{**e, "body": {**e["body"], "name": "other", **({"value": 0.1} if e["type"] == "score-create" else {})}} for e in FIRST]
    assert append_events(st, _events(spark, other), "q") == {"processed": 3, "skipped": 0}
    assert reads.trace_get(st.read("traces"), "q", "t1").first().name == "other"
    assert reads.observations_list(st.read("observations"), "p", "t1").count() == 1
    low = reads.low_score_traces(st.read("traces"), st.read("scores")).collect()
    assert [(r.project_id, r.name) for r in low] == [("q", "other")]


def test_two_writers_cannot_publish_the_same_commit(spark, scratch):
    from spanlake.streaming.store import ConcurrentCommit, StateStore

    st = StateStore(spark, os.path.join(scratch, "state"))
    record = st.record()
    st.publish(record, 0)
    with pytest.raises(ConcurrentCommit):
        st.publish(record, 0)


def test_requests_and_batches(spark, scratch):
    req = os.path.join(scratch, "req")
    os.makedirs(req)
    with open(os.path.join(req, "a.json"), "w") as f:
        json.dump({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "ab", "spanId": "cd", "name": "x"}]}]}]}, f)
    with open(os.path.join(req, "b.json"), "w") as f:
        json.dump({"resourceSpans": []}, f)
    objs = files.otlp_requests(files.read_documents(spark, req))
    assert objs.count() == 1
    bat = os.path.join(scratch, "bat")
    os.makedirs(bat)
    with open(os.path.join(bat, "b.json"), "w") as f:
        json.dump({"batch": [{"id": "e1"}, 5, "x"], "metadata": {"sdk": "t"}}, f)
    assert files.event_batches(files.read_documents(spark, bat)).count() == 3


def _write_entity_objects_and_manifests(spark, events, root):
    """Entity objects (K2) and one manifest per batch (K3) as JSON files."""
    from spanlake.operators import store as st_

    objs = st_.entity_objects(events, "demo").cache()
    assert st_.write_objects(objs, root, sha256="sha256").count() == objs.count()
    man = st_.batch_manifests(objs, "demo", F.lit("2024-02-01T00:00:00.000Z"))
    for r in man.select("batch", F.to_json(F.struct(F.col("batch").cast("string").alias("batchId"), "projectId", "createdAt", "objects")).alias("j")).collect():
        path = os.path.join(root, "demo", "manifests", "2024", "02", "01", "00", "00", f"b{r.batch}.json")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(r.j)


def test_manifest_sync_equals_batch_fold(spark, scratch):
    """Accepted events → entity objects + manifests → sync; the state equals a
    fold of the same accepted events (S2, S3, K2, K3)."""
    from spanlake.plans import state as stp

    acc = stp.f1_accepted(spark, SF_SMALL).where(F.col("batch") < 3).where(F.col("copy") == 0)
    acc = acc.withColumn("pos", F.col("eid") * 4 + F.when(F.col("kind") == "trace", 1).otherwise(0))
    store_root = os.path.join(scratch, "store")
    _write_entity_objects_and_manifests(spark, acc, store_root)
    job = SyncJob(spark, store_root, "demo", os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"))
    res = job.run()
    assert sum(r["events"] for r in res) == acc.count()
    want = build_state(raw.raw_rows(acc, "demo"))
    cols_o = ["id", "trace_id", "type", "name", "start_time", "total_cost", "metadata_json"]
    assert _rows(job.state.read("observations"), cols_o) == _rows(want.observations, cols_o)
    got_t, want_t = _rows(job.state.read("traces"), COLS_T), _rows(want.traces, COLS_T)
    assert got_t == want_t, [(a, b) for a, b in zip(got_t, want_t) if a != b][:3]
    raw_log = job.state.read_raw()
    assert raw_log.where(F.col("manifest_key").isNull()).count() == 0


def test_gzip_objects_are_read(spark, scratch):
    import gzip

    d = os.path.join(scratch, "gz")
    os.makedirs(d)
    with gzip.open(os.path.join(d, "a.json.gz"), "wt") as f:
        json.dump([{"scopeSpans": [{"spans": [{"traceId": "ab", "spanId": "cd"}]}]}], f)
    objs = files.otlp_objects(files.read_documents(spark, d))
    assert objs.count() == 1


def test_strict_duplicates_fail_the_batch(spark, scratch):
    """Strict policy: re-sending stored event ids fails the commit and writes
    nothing; the skip policy just skips them (I6)."""
    from spanlake.streaming.store import StateStore
    from spanlake.streaming.sync import commit

    objects = overlays.f4_objects(spark, SF_SMALL).limit(3)
    ev = otlp.otlp_events(objects)
    rows = raw.raw_rows(ev, "demo", entity_id=F.coalesce(F.get_json_object(F.col("body"), "$.id"), F.col("object_key")))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    st = StateStore(spark, os.path.join(scratch, "state"))
    first = commit(st, rows, "otel", duplicates="strict")
    n = st.read_raw().count()
    assert first["events"] == n > 0
    with pytest.raises(Exception):
        commit(st, rows, "otel", duplicates="strict")
    assert st.read_raw().count() == n
    assert commit(st, rows, "otel", duplicates="skip")["events"] == 0
