"""Read queries over the five relations (list / get / report).

Lists are top-k reports: ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject,
one bounded heap per task and a k-row merge, never a global sort. Null order is
always stated and ties break on ``id`` so results are deterministic. Point reads
filter on the key and push the predicate into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LIMIT = 100
MAX_LIMIT = 10_000


def check_limit(limit: int) -> int:
    """Every list takes 1..10000 rows (default 100)."""
    if not isinstance(limit, int) or limit < 1 or limit > MAX_LIMIT:
        raise ValueError(f"limit must be an integer between 1 and {MAX_LIMIT}")
    return limit


def traces_list(traces: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest traces first (Q1)."""
    return traces.orderBy(F.col("start_time").desc_nulls_last(), F.col("id").asc()).limit(check_limit(limit))


def trace_get(traces: DataFrame, project_id: str, trace_id: str) -> DataFrame:
    """One trace of a project by id (Q2)."""
    return traces.where((F.col("project_id") == project_id) & (F.col("id") == trace_id)).limit(1)


def observations_list(observations: DataFrame, project_id: str, trace_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Observations of a trace in chronological order, id tie-break (Q3)."""
    return (
        observations.where((F.col("project_id") == project_id) & (F.col("trace_id") == trace_id))
        .orderBy(F.col("start_time").asc_nulls_last(), F.col("id").asc())
        .limit(check_limit(limit))
    )


def sessions_list(sessions: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Most recently active sessions first (Q4)."""
    return sessions.orderBy(F.col("last_seen_at").desc_nulls_last(), F.col("id").asc()).limit(check_limit(limit))


def session_get(sessions: DataFrame, project_id: str, session_id: str) -> DataFrame:
    """One session of a project by id (Q5)."""
    return sessions.where((F.col("project_id") == project_id) & (F.col("id") == session_id)).limit(1)


def scores_list(
    scores: DataFrame,
    project_id: str,
    trace_id: str | None = None,
    observation_id: str | None = None,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Scores of a trace and/or observation, newest first (Q6). At least one
    filter is required; both combine with AND."""
    if trace_id is None and observation_id is None:
        raise ValueError("scores list requires trace_id or observation_id")
    out = scores.where(F.col("project_id") == project_id)
    if trace_id is not None:
        out = out.where(F.col("trace_id") == trace_id)
    if observation_id is not None:
        out = out.where(F.col("observation_id") == observation_id)
    return out.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").asc()).limit(check_limit(limit))


def adhoc_sql(spark: SparkSession, query: str) -> DataFrame:
    """Ad-hoc SQL over the registered views (Q7); see ``State.register``."""
    return spark.sql(query)


def high_cost_traces(traces: DataFrame, limit: int = 20) -> DataFrame:
    """Most expensive traces (Q8)."""
    return (
        traces.select("id", "name", "user_id", "session_id", "start_time", "total_cost")
        .orderBy(F.col("total_cost").desc_nulls_last(), F.col("id").asc())
        .limit(check_limit(limit))
    )


def low_score_traces(traces: DataFrame, scores: DataFrame, threshold: float = 0.5, limit: int = 50) -> DataFrame:
    """Traces joined to their scores below a threshold, newest first (Q9).

    The score filter is applied below the join, so only low scores shuffle.
    """
    low = scores.where(F.col("value") < threshold).select(
        "project_id", F.col("trace_id").alias("id"), F.col("name").alias("score_name"), "value", F.col("id").alias("score_id")
    )
    return (
        traces.select("id", "name", "start_time", "project_id")
        .join(low, ["project_id", "id"], "inner")
        .orderBy(F.col("start_time").desc_nulls_last(), F.col("id").asc(), F.col("score_id").asc())
        .limit(check_limit(limit))
    )


def score_agreement(traces: DataFrame, scores: DataFrame, score_name: str, output_path: str) -> DataFrame:
    """Model score inside the trace output vs the expected score attached to the
    trace (Q15): one row per (trace, score) with the absolute difference."""
    expected = scores.where(F.col("name") == score_name).select(
        "project_id", F.col("trace_id").alias("id"), F.col("value").alias("expected_score")
    )
    model = F.get_json_object(F.col("output_json"), output_path).try_cast("double")
    return (
        traces.select("project_id", "id", model.alias("model_score"))
        .join(expected, ["project_id", "id"], "inner")
        .select("id", "model_score", "expected_score", F.round(F.abs(F.col("model_score") - F.col("expected_score")), 6).alias("abs_diff"))
    )


def busy_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    """Sessions with the most traces (Q10)."""
    return sessions.orderBy(F.col("trace_count").desc(), F.col("id").asc()).limit(check_limit(limit))


def repeated_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions holding more than one trace (Q10)."""
    return sessions.where(F.col("trace_count") > 1)


def entity_history(events_raw: DataFrame, project_id: str, entity_id: str) -> DataFrame:
    """Raw events of one entity of a project in time order (Q11)."""
    return (
        events_raw.where((F.col("project_id") == project_id) & (F.col("entity_id") == entity_id))
        .select("event_id", "event_type", "event_timestamp", "entity_id", "trace_id", "observation_id")
        .orderBy(F.col("event_timestamp").asc_nulls_last(), F.col("event_id").asc())
    )


def usage_by_model(events_raw: DataFrame) -> DataFrame:
    """Events, observations and total tokens per model, read from raw bodies (Q12).

    model lives only in ``body_json``; the JSON path is evaluated in the scan stage
    and the aggregate is partial + final.
    """
    b = F.col("body_json")
    model = F.get_json_object(b, "$.model")
    total = F.get_json_object(b, "$.usageDetails.total").try_cast("double")
    return (
        events_raw.where(model.isNotNull())
        .groupBy(model.alias("model"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.countDistinct("observation_id").alias("observations"),
            F.sum(total).alias("total_tokens"),
        )
    )


def trace_count(traces: DataFrame) -> DataFrame:
    """Number of traces (Q14)."""
    return traces.agg(F.count(F.lit(1)).alias("trace_count"))


def trace_bytes_stats(sizes: DataFrame) -> DataFrame:
    """Storage footprint from per-trace byte sizes (Q13).

    ``sizes``: (trace_id, bytes). Percentile p is the value at 0-based index
    floor((n-1)·p) of the ascending sizes. Rows are first counted per distinct
    size (map-side combined). The running count that locates the indexes is taken
    within ranges of sizes (one per bit length), and over the 64 ranges' totals.
    """
    from pyspark.sql import Window

    hist = sizes.groupBy("bytes").agg(F.count(F.lit(1)).alias("c"))
    hist = hist.withColumn("range", F.length(F.bin("bytes")))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy("range").agg(F.sum("c").alias("r"))
    totals = totals.select("range", F.coalesce(F.sum("r").over(upto), F.lit(0)).alias("before"), F.sum("r").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("range").orderBy("bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("inside", F.sum("c").over(inside)).join(totals, "range")
    cum = cum.select("bytes", "c", "n", (F.col("before") + F.col("inside")).alias("cum"))

    def at(p: float) -> F.Column:
        rank = F.floor((F.col("n") - 1) * F.lit(p)) + 1
        return F.min(F.when(F.col("cum") >= rank, F.col("bytes")))

    return cum.agg(
        F.max("n").alias("traces"),
        F.sum(F.col("bytes") * F.col("c")).alias("trace_bytes"),
        at(0.0).alias("min_bytes"),
        at(0.5).alias("p50_bytes"),
        at(0.95).alias("p95_bytes"),
        at(1.0).alias("max_bytes"),
    )


def storage_stats(objects: DataFrame, manifests: DataFrame) -> DataFrame:
    """Storage statistics of stored OTLP objects (object_key, resource_spans) and
    manifests (Q13): counts, stored bytes as JSON text, mean per trace, and the
    spread of span bytes over traces."""
    from spanlake.operators import otlp

    stored = objects.agg(F.count(F.lit(1)).alias("object_count"), F.coalesce(F.sum(F.octet_length(F.to_json("resource_spans"))), F.lit(0)).alias("total_bytes"))
    spans = otlp.flatten_spans(objects).select(F.try_variant_get("span", "$.traceId", "string").alias("trace_id"), F.octet_length(F.to_json("span")).alias("bytes"))
    per_trace = spans.where(F.coalesce("trace_id", F.lit("")) != "").groupBy("trace_id").agg(F.sum("bytes").alias("bytes"))
    named = manifests.agg(F.count(F.lit(1)).alias("manifest_count"))
    # three one-row reports side by side
    out = stored.join(named, F.lit(True)).join(trace_bytes_stats(per_trace), F.lit(True))
    mean = F.coalesce(F.round(F.col("total_bytes") / F.nullif(F.col("traces"), F.lit(0))), F.lit(0)).cast("long")
    return out.select("object_count", "manifest_count", "total_bytes", mean.alias("mean_bytes_per_trace"), "min_bytes", "p50_bytes", "p95_bytes", "max_bytes")
