"""Golden cases for the fold (order, partial updates, metadata merge, scores,
trace start, empty-object guard), re-typed from the event model's rules."""

import json

import pytest
from pyspark.sql import functions as F

from spanlake.operators import fold, raw


def _raw(spark, events):
    rows = [(e["id"], e.get("timestamp"), e["type"], json.dumps(e["body"])) for e in events]
    df = spark.createDataFrame(rows, "id string, timestamp string, type string, body string")
    return raw.raw_rows(df, "p", object_key="k")


def obs(spark, events, oid="o1"):
    return fold.fold_observations(_raw(spark, events)).where(F.col("id") == oid).first()


def test_latest_timestamp_wins_regardless_of_arrival(spark):
    ev = [
        {"id": "b", "timestamp": "2024-01-01T00:00:02.000Z", "type": "span-update", "body": {"id": "o1", "name": "new"}},
        {"id": "a", "timestamp": "2024-01-01T00:00:01.000Z", "type": "span-create", "body": {"id": "o1", "name": "old", "traceId": "t"}},
    ]
    r = obs(spark, ev)
    assert r.name == "new" and r.trace_id == "t" and r.type == "span-update"


def test_ties_break_on_event_id_and_missing_time_sorts_first(spark):
    ev = [
        {"id": "z", "timestamp": "2024-01-01T00:00:01.000Z", "type": "span-create", "body": {"id": "o1", "name": "z"}},
        {"id": "a", "timestamp": "2024-01-01T00:00:01.000Z", "type": "span-create", "body": {"id": "o1", "name": "a"}},
        {"id": "m", "timestamp": None, "type": "span-create", "body": {"id": "o1", "name": "missing", "version": "v"}},
    ]
    r = obs(spark, ev)
    assert r.name == "z"


def test_null_does_not_clear_and_update_moves_start(spark):
    ev = [
        {"id": "a", "timestamp": "2024-01-01T00:00:01.000Z", "type": "generation-create",
         "body": {"id": "o1", "name": "g", "startTime": "2024-01-01T00:00:00.500Z", "input": {"q": 1}}},
        {"id": "b", "timestamp": "2024-01-01T00:00:05.000Z", "type": "generation-update", "body": {"id": "o1", "name": None, "input": None}},
    ]
    r = obs(spark, ev)
    assert r.name == "g" and json.loads(r.input_json) == {"q": 1}
    # an update without startTime moves start_time to its own event time
    assert str(r.start_time).startswith("2024-01-01 00:00:05")
    assert r.type == "generation-update"


def test_empty_object_guard(spark):
    ev = [
        {"id": "a", "timestamp": "2024-01-01T00:00:01.000Z", "type": "generation-create",
         "body": {"id": "o1", "usageDetails": {"input": 3}, "output": {"a": 1}}},
        {"id": "b", "timestamp": "2024-01-01T00:00:02.000Z", "type": "generation-update",
         "body": {"id": "o1", "usageDetails": {}, "output": {}}},
    ]
    r = obs(spark, ev)
    assert json.loads(r.usage_details_json) == {"input": 3}
    assert json.loads(r.output_json) == {}


def test_observation_cost(spark):
    ev = [
        {"id": "a", "timestamp": "2024-01-01T00:00:01.000Z", "type": "generation-create",
         "body": {"id": "o1", "costDetails": {"input": 0.5, "output": "0.25", "bad": "x"}}},
        {"id": "c", "timestamp": "2024-01-01T00:00:01.000Z", "type": "generation-create",
         "body": {"id": "o2", "totalCost": "2", "costDetails": {"total": 9}}},
        {"id": "d", "timestamp": "2024-01-01T00:00:01.000Z", "type": "generation-create",
         "body": {"id": "o3", "costDetails": {"total": 1.5, "input": 7}}},
    ]
    assert obs(spark, ev, "o1").total_cost == pytest.approx(0.75)
    assert obs(spark, ev, "o2").total_cost == pytest.approx(2.0)
    assert obs(spark, ev, "o3").total_cost == pytest.approx(1.5)


def plain_merge(left, right):
    """The merge rule, two values at a time."""
    if right is None or right == {}:
        return left
    if left is None or left == {} or not isinstance(left, dict):
        return right
    if not isinstance(right, dict):
        return left

    def deep(a, b):
        out = dict(a)
        for k, v in b.items():
            out[k] = deep(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
        return out

    return deep(left, right)


def _random_value(rnd, depth):
    kind = rnd.random()
    if depth and kind < 0.6:
        return {rnd.choice("abc"): _random_value(rnd, depth - 1) for _ in range(rnd.randrange(3))}
    return rnd.choice([1, "x", None, [1, {"a": 2}], True, {}, -0.5])


def _deep(n, leaf):
    return leaf if not n else {"l": _deep(n - 1, leaf)}


def test_metadata_merge_equals_plain_merge(spark):
    """Any nesting, scalars over objects and back, spread over hours, in any order of arrival."""
    import functools
    import random

    rnd = random.Random(11)
    ev, want = [], {}
    for k in range(120):
        values = [_random_value(rnd, rnd.choice([1, 2, 4])) for _ in range(rnd.randrange(2, 9))]
        if k == 0:
            values = [{"n": {"x": 1}}, {"n": 5}, {"n": {"y": 3}}]
        if k == 1:
            values = [_deep(14, {"p": 1}), _deep(14, {"q": 2}), {"top": 1}]
        for i, v in enumerate(values):
            stamp = f"2024-01-01T{i * 5 // 2:02d}:30:00.000Z"
            ev.append({"id": f"e{k}-{i}", "timestamp": stamp, "type": "span-create", "body": {"id": f"o{k}", "metadata": v}})
        want[f"o{k}"] = functools.reduce(plain_merge, values, None)
    rnd.shuffle(ev)
    got = {r.id: r.metadata_json for r in fold.fold_observations(_raw(spark, ev)).collect()}
    for k, w in want.items():
        g = None if got[k] is None else json.loads(got[k])
        assert g == w or (w == {} and g is None), k


def test_first_score_event_is_the_base(spark):
    ev = [
        {"id": "a", "timestamp": "2024-01-01T00:00:00Z", "type": "score-create", "body": {"id": "s1", "name": "n", "metadata": {}}},
        {"id": "b", "timestamp": "2024-01-01T00:00:01Z", "type": "score-create", "body": {"id": "s1", "value": 1}},
        {"id": "c", "timestamp": "2024-01-01T00:00:01Z", "type": "score-create", "body": {"id": "s2", "metadata": {}}},
        {"id": "d", "timestamp": "2024-01-01T00:00:02Z", "type": "score-create", "body": {"id": "s2", "metadata": {"k": 2}}},
    ]
    got = {r.id: r.metadata_json for r in fold.fold_scores(_raw(spark, ev)).collect()}
    assert got["s1"] == "{}" and json.loads(got["s2"]) == {"k": 2}


def test_trace_start_is_minimum_in_any_arrival_order(spark):
    ev = [
        {"id": "b", "timestamp": "2024-01-01T00:00:05.000Z", "type": "trace-create", "body": {"id": "t1", "timestamp": "2024-01-01T00:00:00.000Z"}},
        {"id": "a", "timestamp": "2024-01-01T00:00:01.000Z", "type": "trace-create", "body": {"id": "t1", "name": "n"}},
    ]
    for order in (ev, ev[::-1]):
        t = fold.fold_traces(_raw(spark, order)).first()
        assert str(t.start_time).startswith("2024-01-01 00:00:00") and t.name == "n"


def test_scores_pair_and_partial_update(spark):
    ev = [
        {"id": "e1", "timestamp": "2024-01-01T00:00:01.000Z", "type": "score-create",
         "body": {"id": "s1", "name": "q", "value": 0.9, "traceId": "t"}},
        {"id": "e2", "timestamp": "2024-01-01T00:00:02.000Z", "type": "score-create", "body": {"id": "s1", "comment": "c"}},
        {"id": "e3", "timestamp": "2024-01-01T00:00:01.000Z", "type": "score-create",
         "body": {"id": "s2", "name": "b", "value": True, "metadata": {"source": "EVAL"}}},
        {"id": "e4", "timestamp": "2024-01-01T00:00:02.000Z", "type": "score-create",
         "body": {"id": "s2", "value": "x"}},
        {"id": "e5", "timestamp": "2024-01-01T00:00:01.000Z", "type": "score-create",
         "body": {"id": "s3", "name": "n", "value": "0.5", "dataType": "NUMERIC"}},
    ]
    s = {r.id: r for r in fold.fold_scores(_raw(spark, ev)).collect()}
    assert s["s1"].value == 0.9 and s["s1"].string_value is None and s["s1"].comment == "c"
    assert s["s1"].data_type == "NUMERIC" and s["s1"].source == "API"
    assert str(s["s1"].timestamp).startswith("2024-01-01 00:00:01")
    # a later text value replaces the boolean pair as a whole
    assert s["s2"].value is None and s["s2"].string_value == "x" and s["s2"].data_type == "CATEGORICAL"
    assert s["s2"].source == "EVAL"
    assert s["s3"].value == 0.5 and s["s3"].string_value == "0.5" and s["s3"].data_type == "NUMERIC"


def test_arrival_order_invariance(spark):
    from conftest import SF_SMALL
    from spanlake.plans import state as st

    r = st.f1_raw(spark, SF_SMALL)
    a = fold.fold_observations(r).select("id", "name", "type", "total_cost", "metadata_json")
    b = fold.fold_observations(r.repartition(7).orderBy(F.rand(3))).select("id", "name", "type", "total_cost", "metadata_json")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_metadata_merge_across_time_buckets(spark):
    """Values spread over several hour buckets (and one without a timestamp)
    merge in event order through the bucket hierarchy."""
    ev = [
        {"id": "e3", "timestamp": "2024-01-01T02:10:00.000Z", "type": "span-update", "body": {"id": "o1", "metadata": {"a": 3, "n": {"y": 3}}}},
        {"id": "e1", "timestamp": "2024-01-01T00:30:00.000Z", "type": "span-create", "body": {"id": "o1", "metadata": {"a": 1, "n": {"x": 1}}}},
        {"id": "e0", "timestamp": None, "type": "span-create", "body": {"id": "o1", "metadata": {"z": 0, "a": 0}}},
        {"id": "e2b", "timestamp": "2024-01-01T01:20:00.000Z", "type": "span-update", "body": {"id": "o1", "metadata": {"n": 5}}},
        {"id": "e2a", "timestamp": "2024-01-01T01:10:00.000Z", "type": "span-update", "body": {"id": "o1", "metadata": {"b": 2, "n": {"w": 1}}}},
    ]
    r = obs(spark, ev)
    assert json.loads(r.metadata_json) == {"z": 0, "a": 3, "b": 2, "n": {"y": 3}}
