"""Work is dealt out by rows, and what several steps read is written once."""

import json
import re

from conftest import SF_SMALL
from pyspark.sql import functions as F

from spanlake.operators import fold, otlp
from spanlake.plans import catalog, state
from spanlake.sources import overlays
from spanlake.sources.tables import spread


def test_rows_of_one_row_group_are_dealt_out(spark, scratch):
    spark.range(20_000).coalesce(1).write.parquet(f"{scratch}/t")
    small = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = spark.read.parquet(f"{scratch}/t")
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores  # many splits, but one row group
        sizes = spread(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and sum(n > 0 for n in sizes) >= cores and max(sizes) < 20_000 / cores * 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_existing_keys_come_from_written_state(spark):
    assert "parse_json" not in _plan(catalog.existing_keys(spark, SF_SMALL))
    assert _plan(catalog.replay_history(spark, SF_SMALL)).count("Aggregate") == 0


def test_costs_are_summed_from_the_written_observations(spark, scratch, monkeypatch):
    calls = []
    folded = fold.fold_observations
    monkeypatch.setattr(fold, "fold_observations", lambda log: calls.append(log) or folded(log))
    s = state.stored_state(spark, "f1_counted", f"{scratch}/x", lambda: state.f1_raw(spark, SF_SMALL))
    assert len(calls) == 1 and s.traces.where("total_cost is not null").count() > 0


def test_metadata_is_merged_in_one_reading(spark):
    log = state.f1_raw(spark, SF_SMALL)
    for folded in (fold.fold_observations(log), fold.fold_traces(log)):
        # the fold, the keys with several values, and their values
        assert _plan(folded).count("Relation [") <= 3


def test_flat_and_nested_metadata_merge_alike(spark):
    from pyspark.sql import functions as F

    from spanlake.operators import metadata

    texts = [
        '{"a":1,"b":"x, y"}', '{"b":"}{:","é":null}', '{"a":{"x":1}}', '{"a":2.50,"c":-0}', '{"q\\"":true}', '{"a":1,"a":7}',
        '{"a":{"y":[1,{"z":2,"b":3}]}}', '{"":false}', '{ "a" : 3 }', '"text"', "{}", "7", '{"a":"' + "l" * 3000 + '"}', '{"b":"u\\u00e9"}', '{"n":1e3,"m":12345678901234567890}',
    ]
    rows = [(k, i, texts[(k * 7 + i * (k % 4 + 1)) % len(texts)]) for k in range(60) for i in range(k % 5 + 1)]

    def merged(values):
        # objects merge, other values replace; what is no object counts until one has come
        out, scalar, last = {}, None, values[-1]

        def into(a, b):
            for k, v in b.items():
                both = isinstance(v, dict) and isinstance(a.get(k), dict)
                a[k] = into(a[k], v) if both else into({}, v) if isinstance(v, dict) else v
            return a

        for t in values:
            v = metadata.json.loads(t, parse_int=metadata._Number, parse_float=metadata._Number)
            if isinstance(v, dict):
                into(out, v)
            else:
                scalar = t
        return metadata._dump(out) if out else scalar or last

    want = {k: merged([t for key, _, t in sorted(rows) if key == k]) for k in range(60)}
    df = spark.createDataFrame(rows, "k int, i int, text string").repartition(4)
    got = {r.k: r.metadata_json for r in metadata.merge_metadata(df, ["k"], "text", F.col("i")).collect()}
    assert got == want


def _objects(spark, *resource_spans):
    df = spark.createDataFrame([(f"k{i}", json.dumps(r)) for i, r in enumerate(resource_spans)], "object_key string, j string")
    return df.select("object_key", F.parse_json("j").alias("resource_spans"))


def test_objects_are_built_and_taken_apart_in_one_go(spark):
    # every further step copies all spans of an object once more
    built = overlays.f4_objects(spark, SF_SMALL)
    assert _plan(built.select("resource_spans")).split("Aggregate")[0].count("to_variant_object(") <= 2
    assert _plan(otlp.flatten_spans(_objects(spark, []))).count("variant_get(") == 1


def test_levels_that_do_not_fit_are_passed_over(spark):
    odd = [None, 1, "x", {}, [], {"scopeSpans": 5}, {"scopeSpans": [7, {"spans": {}}]}]
    new = {"scopeSpans": [None, {"spans": [{"a": 1}, None, "s"]}], "instrumentationLibrarySpans": [{"spans": [2]}]}
    old = {"scopeSpans": None, "instrumentationLibrarySpans": [{"spans": [3]}]}
    rows = otlp.flatten_spans(_objects(spark, *odd, [*odd, new, old])).select("object_key", "rs_pos", "ss_pos", "span_pos", F.to_json("span")).collect()
    n = len(odd)
    assert sorted(tuple(r) for r in rows) == [(f"k{n}", n, 1, 0, '{"a":1}'), (f"k{n}", n, 1, 1, "null"), (f"k{n}", n, 1, 2, '"s"'), (f"k{n}", n + 1, 0, 0, "3")]


def test_a_span_is_read_in_one_go(spark):
    spans = otlp.flatten_spans(_objects(spark, []))
    plan = _plan(otlp.decode_spans(spans).drop("span"))
    assert len(re.findall(r"variant_get\(span#", plan)) == 1
    # metadata, identity and the update flag are worked out once, not for each bundle that has them
    assert _plan(otlp.map_spans(otlp.decode_spans(spans))).count("map_filter(") == 1


def test_members_of_spans_and_attribute_values(spark):
    values = [
        {"stringValue": None, "intValue": 3}, {"doubleValue": 1.5}, {"bytesValue": [1]}, {}, None, "plain", {"kvlistValue": 1},
        {"arrayValue": [{"boolValue": True}, 7]}, {"arrayValue": {"values": [{"arrayValue": {"values": [{"intValue": "1"}, {}]}}, None]}}, {"arrayValue": {"values": 1}},
    ]
    attributes = [{"key": f"a{i}", "value": v} for i, v in enumerate(values)] + [{"key": "none"}, {"key": 5, "value": 1}, 6, {"value": 2}, {"key": "a1", "value": 8}]
    spans = [
        {"traceId": "t", "spanId": [1, 255], "parentSpanId": "", "name": {"low": 1, "high": 0}, "attributes": attributes},
        {"traceId": {"low": 5, "high": 0}, "spanId": {"type": "Buffer", "data": [16]}, "name": 7, "attributes": {}},
        "no span",
    ]
    decoded = otlp.decode_spans(otlp.flatten_spans(_objects(spark, [{"scopeSpans": [{"spans": spans}]}])), F.lit("2024-01-01").cast("timestamp"))
    a, b, c = decoded.select("trace_id", "span_id", "parent_span_id", "span_name", F.to_json(F.to_variant_object("attributes")).alias("attributes")).orderBy("span_pos").collect()
    assert (a.trace_id, a.span_id, a.parent_span_id, a.span_name) == ("t", "01ff", None, "otel-span")
    want = [None, 8, [1], {}, None, "plain", {"kvlistValue": 1}, [True, 7], [["1", {}], None], {"arrayValue": {"values": 1}}]
    assert json.loads(a.attributes) == {f"a{i}": v for i, v in enumerate(want)} | {"none": None}
    assert (b.trace_id, b.span_id, b.span_name, b.attributes) == ("5", "10", "7", "{}")
    assert (len(c.trace_id), len(c.span_id), c.span_name, c.attributes) == (32, 16, "otel-span", "{}")
