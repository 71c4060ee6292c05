"""Validation and cleaning rules at their edges, and OTLP decoding edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanlake.functions.json import lenient_number
from spanlake.functions.time import lenient_timestamp, strict_iso_ok
from spanlake.operators import otlp, raw, store, validate
from spanlake.sources import files

WHEN = "2025-03-04T05:06:07.008Z"


def event(kind, body, **envelope):
    return {"id": "x", "timestamp": WHEN, "type": kind, "body": body} | envelope


def checked(spark, events):
    """Validated rows in the order of ``events``."""
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(events)], "i int, j string")
    return validate.validate(df.select("i", F.parse_json("j").alias("event"))).orderBy("i").collect()


def cleaned(spark, *bodies, kind="generation-create"):
    return [json.loads(r.body) for r in checked(spark, [event(kind, b) for b in bodies])]


def test_usage_details_keep_nonnegative_integers(spark):
    got = cleaned(
        spark,
        {"usageDetails": {"zero": 0, "minus": -3, "half": 1.5, "text": "12 tokens", "minus text": "-4", "word": "many", "none": None}},
        {"usageDetails": {"huge": "99999999999999999999", "long": "123456789012345678901234567890123456789012"}},
        {"usageDetails": {"only": -1}},
    )
    assert got[0]["usageDetails"] == {"zero": 0, "text": 12}
    assert got[1]["usageDetails"]["huge"] == 1e20
    assert "usageDetails" not in got[2]


def test_cost_details_keep_nonnegative_numbers_only(spark):
    got = cleaned(spark, {"costDetails": {"a": 0, "b": 0.5, "c": -0.5, "d": "0.5", "e": [1]}})
    assert got[0]["costDetails"] == {"a": 0, "b": 0.5}


def test_legacy_usage_is_renamed_and_empty_usage_dropped(spark):
    got = cleaned(spark, {"usage": {"promptTokens": 7}}, {"usage": {"input": None}}, {"name": "no usage"})
    assert got[0]["usage"] == {"input": 7, "unit": "TOKENS"} and "usage" not in got[1] and got[2]["usage"] is None


def test_score_source_and_environment_defaults(spark):
    score, = cleaned(spark, {"name": "s", "value": 0, "environment": "langfuse_QA"}, kind="score-create")
    assert score["source"] == "API" and score["environment"] == "qa"


REJECTS = [
    event("span-create", {}, timestamp="2025-03-04"),
    event("span-create", {}, timestamp="2025-03-04T05:06:07+00"),
    event("span-create", {}, timestamp="2025-03-04T05:06:07+0000"),
    event("span-create", {}, timestamp=5),
    event("no-such-type", {}),
    event("span-create", {}, id="a\rb"),
    event("span-create", {}, id=""),
    event("span-create", [1]),
    event("span-create", {}, metadata="text"),
    event("score-create", {"name": "", "value": 1}),
    event("score-create", {"name": "s", "value": {"x": 1}}),
    17,
    None,
    ["x"],
]


@pytest.mark.parametrize("position", [0, 7])
def test_rejects_do_not_disturb_their_neighbours(spark, position):
    good = event("span-create", {"id": "ok"}, id="good", timestamp="2025-03-04T05:06Z")
    events = REJECTS[:position] + [good] + REJECTS[position:]
    rows = checked(spark, events)
    assert [not r.errors for r in rows] == [e is good for e in events]
    df = spark.createDataFrame([(json.dumps(e),) for e in events], "j string").select(F.parse_json("j").alias("event"))
    rejected = validate.rejected(validate.validate(df)).collect()
    assert {r.status for r in rejected} == {400} and sum(r.reject_id == "unknown" for r in rejected) >= 3


def test_timestamps_need_seconds_or_minutes_and_a_full_offset(spark):
    cases = {"2024-01-01T00:00Z": True, "2024-01-01T00:00+05:30": True, "2024-01-01T00:00:00.123456Z": True, "2024-01-01T00:00": False, "2024-01-01T00:00:00+00": False, "2024-02-30T00:00:00Z": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: (r.ok, r.ms) for r in df.select("t", strict_iso_ok(F.col("t")).alias("ok"), lenient_timestamp(F.col("t")).cast("long").alias("ms")).collect()}
    assert {t: ok for t, (ok, _) in got.items()} == cases
    assert got["2024-01-01T00:00Z"][1] == 1704067200 and got["2024-01-01T00:00+05:30"][1] == 1704067200 - 19800


def test_numbers_of_any_length(spark):
    cases = {"0xff": 255.0, "0xFFFFFFFFFFFFFFFFFF": float(0xFFFFFFFFFFFFFFFFFF), "0x" + "f" * 400: None, "": 0.0, " 12 ": 12.0, "1d": None, "9" * 400: None, "1e3": 1000.0, "0x": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.n for r in df.select("t", lenient_number(F.col("t")).alias("n")).collect()}
    assert got == cases


def test_environment_rules(spark):
    df = spark.createDataFrame([("LANGFUSE_dev",), ("Langfuse-Prod",), ("Bad Env!",), ("x" * 50,), (None,)], "e string")
    got = [r.n for r in df.select(validate.normalize_environment(F.col("e")).alias("n")).collect()]
    assert got == ["dev", "prod", "default", "x" * 40, "default"]


def test_otlp_id_and_time_encodings(spark):
    span = {
        "traceId": {"type": "Buffer", "data": [1, 2, 255]},
        "spanId": {"0": 10, "1": 11},
        "parentSpanId": "",
        "startTimeUnixNano": {"low": 1345250816, "high": 397048614},
        "attributes": [
            {"key": "a", "value": {"intValue": "12"}},
            {"key": "a", "value": {"stringValue": "last"}},
            {"key": "arr", "value": {"arrayValue": {"values": [{"stringValue": "x"}, {"boolValue": True}]}}},
            {"key": 5, "value": {"stringValue": "skipped"}},
        ],
    }
    objs = spark.createDataFrame([("k", json.dumps([{"scopeSpans": [{"spans": [span]}]}]))], "object_key string, j string")
    objs = objs.select("object_key", F.parse_json("j").alias("resource_spans"))
    d = otlp.decode_spans(otlp.flatten_spans(objs)).first()
    assert d.trace_id == "0102ff" and d.span_id == "0a0b" and d.parent_span_id is None
    assert d.start_time is not None and d.start_time.year >= 2024
    attrs = {k: json.loads(v.toJson()) for k, v in d.attributes.items()}
    assert attrs == {"a": "last", "arr": ["x", True]}


def _attribute(spark, value):
    objects = spark.createDataFrame([("k", json.dumps([{"scopeSpans": [{"spans": [{"traceId": "ab", "attributes": [{"key": "a", "value": value}]}]}]}]))], "object_key string, j string")
    row = otlp.decode_spans(otlp.flatten_spans(objects.select("object_key", F.parse_json("j").alias("resource_spans")))).first()
    return json.loads(row.attributes["a"].toJson())


def test_nested_attribute_arrays(spark):
    value, want = {"stringValue": "deep"}, "deep"
    for _ in range(9):
        value, want = {"arrayValue": {"values": [value, {"intValue": "1"}]}}, [want, "1"]
    assert _attribute(spark, value) == want
    for _ in range(9):
        value = {"arrayValue": {"values": [value]}}
    with pytest.raises(Exception, match="nested"):
        _attribute(spark, value)


def test_manual_traces_keep_value_types(spark):
    rows = spark.createDataFrame([("t1", "n", None, None, "5", "plain text", '{"n": [1, 2], "b": true, "o": {"k": 1}, "s": "x"}')], "id string, name string, user_id string, session_id string, input string, output string, metadata string")
    objects = store.trace_rows_to_objects(rows.withColumn("timestamp", F.lit(WHEN).cast("timestamp")))
    span = json.loads(objects.first().resource_spans.toJson())[0]["scopeSpans"][0]["spans"][0]
    got = {a["key"]: a["value"] for a in span["attributes"]}
    assert got["langfuse.trace.input"] == {"doubleValue": 5} and got["langfuse.trace.output"] == {"stringValue": "plain text"}
    assert got["langfuse.trace.metadata.n"] == {"arrayValue": {"values": [{"stringValue": "1"}, {"stringValue": "2"}]}}
    assert got["langfuse.trace.metadata.b"] == {"boolValue": True} and got["langfuse.trace.metadata.o"] == {"stringValue": '{"k":1}'}


def test_entity_objects_keep_the_envelope_metadata(spark):
    rows = checked(spark, [event("trace-create", {"id": "t"}, metadata={"sdk": "v1"})])
    df = spark.createDataFrame([(0, 0, r.id, r.timestamp, r.type, r.body, r.metadata) for r in rows], "batch int, pos int, id string, timestamp string, type string, body string, metadata string")
    content = json.loads(store.entity_objects(df, "p").first().content)
    assert content[0]["metadata"] == {"sdk": "v1"}


def test_events_of_two_projects_with_one_id_are_two_events(spark):
    df = spark.createDataFrame([("e", WHEN, "trace-create", '{"id":"t"}')], "id string, timestamp string, type string, body string")
    both = raw.raw_rows(df, "p").unionByName(raw.raw_rows(df, "q"))
    assert raw.dedupe_skip(both).count() == 2 and raw.duplicate_event_ids(both).count() == 0
    assert raw.dedupe_skip(both, raw.raw_rows(df, "p")).first().project_id == "q"


@pytest.mark.parametrize("content", ['{"batch": [{"id": "e1"}, {"id"', '{"batch": {"id": "e1"}}', '{"events": []}', "[]", ""])
def test_unreadable_event_batch_is_an_error(spark, content):
    docs = spark.createDataFrame([("good.json", '{"batch": [{"id": "e1"}]}', None), ("bad.json", content, None)], "object_key string, content string, modified timestamp")
    with pytest.raises(Exception, match="unreadable event batch: bad.json"):
        files.event_batches(docs).collect()
    assert files.event_batches(docs.where("object_key = 'good.json'")).count() == 1


def _object(rng, key):
    spans = []
    for i in range(rng.randrange(1, 12)):
        attributes = rng.choice([[], [{"key": "user.id", "value": {"stringValue": "u"}}], [{"key": "langfuse.trace.name", "value": {"stringValue": "n"}}]])
        span = {"traceId": rng.choice(["a1", "b2", "c3"]), "spanId": f"{i:02x}", "name": rng.choice(["s", ""]), "startTimeUnixNano": str(10**18 + i), "attributes": attributes}
        if rng.random() < 0.8:
            span["parentSpanId"] = "ff"
        spans.append(span)
    cut = rng.randrange(len(spans) + 1)
    return key, json.dumps([{"scopeSpans": [{"spans": spans[:cut]}]}, {"scopeSpans": [{"spans": spans[cut:]}]}])


def test_otlp_events_in_one_pass(spark):
    """Each object's first-seen and shallow rules, wherever its rows are cut into
    batches; the same events as by windows, without window and shuffle."""
    rng = random.Random(4)
    rows = [_object(rng, f"k{i:03d}") for i in range(120)] + [("empty", "[]")]
    objects = spark.createDataFrame(rows, "object_key string, j string").select("object_key", F.parse_json("j").alias("resource_spans")).repartition(3)
    when = F.lit("2024-01-01").cast("timestamp")
    mapped = otlp.map_spans(otlp.decode_spans(otlp.flatten_spans(objects), when))
    cols = ["object_key", "id", "timestamp", "type", "metadata", "body"]
    want = sorted(map(str, otlp.observation_events(mapped).select(*cols).unionByName(otlp.trace_events(mapped).select(*cols)).collect()))
    for most in ("10000", "1", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            assert sorted(map(str, otlp.otlp_events(objects, fallback_time=when).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = otlp.otlp_events(objects.coalesce(2), fallback_time=when)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1 and plan.lower().count("generate posexplode") == 3
