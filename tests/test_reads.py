"""Read helpers: percentile index rule and list limits."""

import pytest

from spanlake.plans import reads


def test_percentiles_use_lower_index(spark):
    # floor((n-1)*p): n=2, p=.95 -> first value (percentile_disc would pick the second)
    sizes = spark.createDataFrame([("a", 10), ("b", 20)], "trace_id string, bytes long")
    r = reads.trace_bytes_stats(sizes).first()
    assert (r.min_bytes, r.p50_bytes, r.p95_bytes, r.max_bytes, r.traces, r.trace_bytes) == (10, 10, 10, 20, 2, 30)
    sizes = spark.createDataFrame([(str(i), v) for i, v in enumerate([5, 1, 9, 9, 3])], "trace_id string, bytes long")
    r = reads.trace_bytes_stats(sizes).first()
    assert (r.min_bytes, r.p50_bytes, r.p95_bytes, r.max_bytes) == (1, 5, 9, 9)


@pytest.mark.parametrize("bad", [0, 10001, -1])
def test_list_limit_bounds(bad):
    with pytest.raises(ValueError):
        reads.check_limit(bad)


def test_scores_list_needs_a_filter(spark):
    df = spark.createDataFrame([], "id string, trace_id string, observation_id string, timestamp timestamp")
    with pytest.raises(ValueError):
        reads.scores_list(df, "p")


def test_storage_stats(spark):
    import json

    from pyspark.sql import functions as F

    spans = [{"traceId": "a", "spanId": "1"}, {"traceId": "a", "spanId": "22"}, {"traceId": "b", "spanId": "3", "name": "n"}, {"spanId": "4"}]
    objects = [[{"scopeSpans": [{"spans": spans[:3]}]}], [{"scopeSpans": [{"spans": spans[3:]}]}]]
    df = spark.createDataFrame([(str(i), json.dumps(o)) for i, o in enumerate(objects)], "object_key string, j string")
    df = df.select("object_key", F.parse_json("j").alias("resource_spans"))
    r = reads.storage_stats(df, spark.range(3)).first()
    size = lambda v: len(json.dumps(v, separators=(",", ":")))
    per_trace = sorted([size(spans[0]) + size(spans[1]), size(spans[2])])
    total = sum(map(size, objects))
    assert (r.object_count, r.manifest_count, r.total_bytes) == (2, 3, total)
    assert (r.mean_bytes_per_trace, r.min_bytes, r.p50_bytes, r.max_bytes) == (round(total / 2), per_trace[0], per_trace[0], per_trace[1])


def test_storage_stats_is_registered_over_whole_objects(spark):
    import __spark_entry__ as entry
    from conftest import SF_SMALL

    r = entry.queries()["storage_stats"](spark, SF_SMALL).first()
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    # 8 spans to an object, each of more than 200 bytes
    assert r.object_count >= events // 8 and r.manifest_count > 0 and r.total_bytes > 200 * events
