"""Event log → current state.

Each relation is one ``groupBy`` on its entity key. Events are totally ordered by
``(event_timestamp, event_id)`` with a missing timestamp first; every column is
"last defined value wins", written as ``max_by(value, ord)`` where the order key
is NULL for events that do not define the value (``max_by`` skips those). The
aggregate has partial and final phases, so a hot key is pre-combined map-side.
Only metadata needs a deep merge, and only for keys that carry more than one
non-empty metadata value (``operators.metadata``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.cache import per_context
from spanlake.functions.json import (
    is_bool,
    is_defined,
    is_number,
    is_object,
    is_string,
    js_number,
    js_string,
    json_text,
    lenient_number,
    object_text,
    vget,
)
from spanlake.functions.time import lenient_timestamp
from spanlake.operators.metadata import merged_objects
from spanlake.operators.raw import first_present
from spanlake.schema import OBSERVATIONS, SCORE_CREATE, SCORES, SESSIONS, TRACE_CREATE, TRACES

# Fixed values of the event model: the score sources and their default.
SCORE_SOURCES = ["API", "EVAL", "ANNOTATION"]
DEFAULT_SCORE_SOURCE = "API"


def order_key() -> Column:
    """Total order of events for one entity: timestamp (missing first), then id."""
    return F.struct(F.col("event_timestamp").alias("t"), F.col("event_id").alias("i"))


def last_defined(value: Column, ord: Column, guard_empty: bool = True) -> Column:
    """Value of the latest event that defines ``value``.

    ``guard_empty``: a literal ``{}`` does not count as defined (it never
    overwrites anything except input/output).
    """
    cond = value.isNotNull()
    if guard_empty:
        cond = cond & (value != "{}")
    return F.max_by(value, F.when(cond, ord))


def last_defined_over_first(value: Column, ord: Column) -> Column:
    """As ``last_defined``, but the first event's value stands, even ``{}``, until
    another one is defined."""
    return F.coalesce(last_defined(value, ord), F.min_by(value, ord))


def _ts_value(v: Column) -> Column:
    return lenient_timestamp(js_string(v))


# ------------------------------------------------------------ per-event fields


def body_fields(raw: DataFrame) -> DataFrame:
    """Per-event values every relation folds (narrow: runs in the scan stage)."""
    return raw.select(*_body_field_columns())


@per_context
def _body_field_columns() -> list[Column]:
    b = F.parse_json(F.col("body_json"))
    start_src = first_present(vget(b, "$.startTime"), vget(b, "$.createdAt"))
    start_time = F.when(is_defined(start_src), _ts_value(start_src)).otherwise(F.col("event_timestamp"))
    return [
        F.col("event_id"),
        F.col("project_id"),
        F.col("event_type"),
        F.col("event_timestamp"),
        F.col("trace_id"),
        F.col("observation_id"),
        F.col("score_id"),
        b.alias("_b"),
        js_string(vget(b, "$.name")).alias("f_name"),
        start_time.alias("f_start"),
        _ts_value(vget(b, "$.endTime")).alias("f_end"),
        json_text(vget(b, "$.metadata")).alias("f_metadata"),
        json_text(vget(b, "$.input")).alias("f_input"),
        json_text(vget(b, "$.output")).alias("f_output"),
    ]


def _nonempty(md: Column) -> Column:
    return md.isNotNull() & (md != "{}")


def _metadata_aggs() -> list[Column]:
    """Count of non-empty metadata values, the latest one and the latest that is no
    object (JSON text is one if it begins like one): most keys have at most one, and
    need no merge at all."""
    md = F.col("f_metadata")
    return [
        F.count_if(_nonempty(md)).alias("_md_n"),
        F.max_by(md, F.when(_nonempty(md), order_key())).alias("_md_last"),
        F.max_by(md, F.when(_nonempty(md) & ~md.startswith("{"), order_key())).alias("_md_scalar"),
    ]


def _with_metadata(agg: DataFrame, ev: DataFrame, keys: list[str]) -> DataFrame:
    """Attach metadata: the single value as is, the path-wise merge only for keys
    with several values."""
    multi = agg.where(F.col("_md_n") > 1).select(*keys)
    values = ev.select(*keys, F.col("f_metadata").alias("_text"), order_key().alias("_ord")).where(_nonempty(F.col("_text")))
    merged = merged_objects(values.join(multi, keys, "left_semi"), keys, "_text", "_ord")
    # values that are no objects count only while no non-empty object has come
    metadata = F.coalesce(F.col("_merged"), F.col("_md_scalar"), F.col("_md_last")).alias("metadata_json")
    return agg.join(merged, keys, "left").select("*", metadata).drop("_merged", "_md_n", "_md_last", "_md_scalar")


# --------------------------------------------------------------------- traces


def trace_fields(raw: DataFrame) -> DataFrame:
    """Per-event trace values."""
    ev = body_fields(
        raw.where((F.col("event_type") == TRACE_CREATE) & F.col("trace_id").isNotNull() & (F.col("trace_id") != ""))
    )
    return ev.select("*", *_trace_extra_columns()).drop("_b")


def fold_traces(raw: DataFrame) -> DataFrame:
    """trace-create events → ``traces`` (without cost; see ``rollup_trace_costs``)."""
    ev = trace_fields(raw)
    out = ev.groupBy("project_id", "trace_id").agg(*_trace_aggs())
    out = _with_metadata(out, ev, ["project_id", "trace_id"]).withColumnRenamed("trace_id", "id")
    return out.select(*[F.lit(None).cast("double").alias(c) if c == "total_cost" else F.col(c) for c in TRACES.names])


@per_context
def _trace_extra_columns() -> list[Column]:
    b = F.col("_b")
    return [
        js_string(vget(b, "$.userId")).alias("f_user"),
        js_string(vget(b, "$.sessionId")).alias("f_session"),
        F.coalesce(_ts_value(vget(b, "$.timestamp")), F.col("f_start")).alias("f_trace_start"),
    ]


@per_context
def _trace_aggs() -> list[Column]:
    ord = order_key()
    return [
        last_defined(F.col("f_name"), ord).alias("name"),
        last_defined(F.col("f_user"), ord).alias("user_id"),
        last_defined(F.col("f_session"), ord).alias("session_id"),
        F.min("f_trace_start").alias("start_time"),
        last_defined(F.col("f_end"), ord, guard_empty=False).alias("end_time"),
        last_defined(F.col("f_input"), ord, guard_empty=False).alias("input_json"),
        last_defined(F.col("f_output"), ord, guard_empty=False).alias("output_json"),
        last_defined(F.col("event_timestamp"), ord, guard_empty=False).alias("updated_at"),
        *_metadata_aggs(),
    ]


# --------------------------------------------------------------- observations


def cost_details_total(cost: Column) -> Column:
    """Explicit ``total`` if numeric, else the sum of the other numeric entries."""
    entries = F.map_entries(cost.cast("map<string,variant>"))
    others = F.filter(
        F.transform(F.filter(entries, lambda e: e["key"] != "total"), lambda e: js_number(e["value"])),
        lambda x: x.isNotNull(),
    )
    summed = F.when(F.size(others) > 0, F.aggregate(others, F.lit(0.0), lambda acc, x: acc + x))
    return F.when(is_object(cost), F.coalesce(js_number(vget(cost, "$.total")), summed))


def observation_fields(raw: DataFrame) -> DataFrame:
    """Per-event observation values."""
    is_obs = (F.col("event_type") != TRACE_CREATE) & (F.col("event_type") != SCORE_CREATE)
    ev = body_fields(raw.where(is_obs & F.col("observation_id").isNotNull() & (F.col("observation_id") != "")))
    return ev.select("*", *_observation_extra_columns()).drop("_b")


@per_context
def _observation_extra_columns() -> list[Column]:
    b = F.col("_b")
    cost = vget(b, "$.costDetails")
    return [
        js_string(vget(b, "$.parentObservationId")).alias("f_parent"),
        json_text(vget(b, "$.usageDetails")).alias("f_usage"),
        object_text(cost).alias("f_cost_details"),
        F.coalesce(js_number(vget(b, "$.totalCost")), cost_details_total(cost)).alias("f_total_cost"),
    ]


def fold_observations(raw: DataFrame) -> DataFrame:
    """Observation events → ``observations``. ``type`` and ``start_time`` come from
    the latest event, as in the event model (an update moves them)."""
    ev = observation_fields(raw)
    out = ev.groupBy("project_id", "observation_id").agg(*_observation_aggs())
    out = _with_metadata(out, ev, ["project_id", "observation_id"]).withColumnRenamed("observation_id", "id")
    return out.select(*OBSERVATIONS.names)


@per_context
def _observation_aggs() -> list[Column]:
    ord = order_key()
    return [
        last_defined(F.col("trace_id"), ord).alias("trace_id"),
        last_defined(F.col("f_parent"), ord).alias("parent_observation_id"),
        last_defined(F.col("event_type"), ord).alias("type"),
        last_defined(F.col("f_name"), ord).alias("name"),
        last_defined(F.col("f_start"), ord, guard_empty=False).alias("start_time"),
        last_defined(F.col("f_end"), ord, guard_empty=False).alias("end_time"),
        last_defined(F.col("f_input"), ord, guard_empty=False).alias("input_json"),
        last_defined(F.col("f_output"), ord, guard_empty=False).alias("output_json"),
        *_metadata_aggs(),
        last_defined(F.col("f_usage"), ord).alias("usage_details_json"),
        last_defined(F.col("f_cost_details"), ord).alias("cost_details_json"),
        last_defined(F.col("f_total_cost"), ord, guard_empty=False).alias("total_cost"),
        last_defined(F.col("event_timestamp"), ord, guard_empty=False).alias("updated_at"),
    ]


# --------------------------------------------------------------------- scores


def score_value(v: Column, declared: Column) -> tuple[Column, Column, Column, Column]:
    """(value, string_value, data_type, value_defined) for one score event.

    value and string_value move as a pair: they are defined exactly when the
    body carries a non-null value.
    """
    defined = is_defined(v)
    s = F.try_variant_get(v, "$", "string")
    num_text = lenient_number(s)
    numeric_decl = F.coalesce(declared, F.lit("")) == "NUMERIC"
    value = (
        F.when(is_number(v), F.try_variant_get(v, "$", "double"))
        .when(is_bool(v), F.when(F.try_variant_get(v, "$", "boolean"), 1.0).otherwise(0.0))
        .when(is_string(v) & numeric_decl, num_text)
    )
    string_value = F.when(is_bool(v) | is_string(v), s)
    data_type = (
        F.when(~defined, declared)
        .when(is_number(v), F.coalesce(declared, F.lit("NUMERIC")))
        .when(is_bool(v), F.coalesce(declared, F.lit("BOOLEAN")))
        .when(is_string(v) & numeric_decl & num_text.isNotNull(), F.lit("NUMERIC"))
        .when(is_string(v), F.coalesce(declared, F.lit("CATEGORICAL")))
        .otherwise(F.coalesce(declared, F.lit("NUMERIC")))
    )
    return value, string_value, data_type, defined


def score_source(b: Column) -> Column:
    """body.source, else metadata.source, each only when a known source."""
    explicit = js_string(vget(b, "$.source"))
    md = vget(b, "$.metadata")
    from_md = F.when(is_object(md), js_string(vget(md, "$.source")))
    return F.when(explicit.isin(*SCORE_SOURCES), explicit).when(from_md.isin(*SCORE_SOURCES), from_md)


def score_fields(raw: DataFrame) -> DataFrame:
    ev = raw.where((F.col("event_type") == SCORE_CREATE) & F.col("score_id").isNotNull() & (F.col("score_id") != ""))
    return ev.select(*_score_field_columns())


@per_context
def _score_field_columns() -> list[Column]:
    b = F.parse_json(F.col("body_json"))
    value, string_value, data_type, value_defined = score_value(
        vget(b, "$.value"), js_string(vget(b, "$.dataType"))
    )
    created = first_present(vget(b, "$.createdAt"))
    ts = F.when(is_defined(created), _ts_value(created)).otherwise(F.col("event_timestamp"))
    return [
        F.col("event_id"),
        F.col("project_id"),
        F.col("event_timestamp"),
        F.col("score_id"),
        js_string(vget(b, "$.traceId")).alias("f_trace"),
        js_string(vget(b, "$.observationId")).alias("f_observation"),
        js_string(vget(b, "$.sessionId")).alias("f_session"),
        js_string(vget(b, "$.name")).alias("f_name"),
        F.struct(value.alias("value"), string_value.alias("string_value")).alias("f_value_pair"),
        value_defined.alias("f_value_defined"),
        data_type.alias("f_data_type"),
        score_source(b).alias("f_source"),
        js_string(vget(b, "$.comment")).alias("f_comment"),
        json_text(vget(b, "$.metadata")).alias("f_metadata"),
        ts.alias("f_timestamp"),
    ]


def fold_scores(raw: DataFrame) -> DataFrame:
    """score-create events → ``scores``: the first event fixes ``timestamp``;
    every other field is last-defined; source defaults to API."""
    ev = score_fields(raw)
    out = ev.groupBy("project_id", "score_id").agg(*_score_aggs())
    out = (
        _with_metadata(out, ev, ["project_id", "score_id"])
        .withColumn("metadata_json", F.coalesce("metadata_json", "_md_first"))
        .withColumn("value", F.col("_pair.value"))
        .withColumn("string_value", F.col("_pair.string_value"))
        .withColumn("source", F.coalesce(F.col("source"), F.lit(DEFAULT_SCORE_SOURCE)))
        .withColumnRenamed("score_id", "id")
    )
    return out.select(*SCORES.names)


@per_context
def _score_aggs() -> list[Column]:
    ord = order_key()
    return [
        last_defined_over_first(F.col("f_trace"), ord).alias("trace_id"),
        last_defined_over_first(F.col("f_observation"), ord).alias("observation_id"),
        last_defined_over_first(F.col("f_session"), ord).alias("session_id"),
        last_defined_over_first(F.col("f_name"), ord).alias("name"),
        F.max_by(F.col("f_value_pair"), F.when(F.col("f_value_defined"), ord)).alias("_pair"),
        last_defined_over_first(F.col("f_data_type"), ord).alias("data_type"),
        last_defined_over_first(F.col("f_source"), ord).alias("source"),
        last_defined_over_first(F.col("f_comment"), ord).alias("comment"),
        *_metadata_aggs(),
        F.min_by(F.col("f_metadata"), ord).alias("_md_first"),
        F.min_by(F.col("f_timestamp"), ord).alias("timestamp"),
        last_defined(F.col("event_timestamp"), ord, guard_empty=False).alias("updated_at"),
    ]


# ------------------------------------------------------------ rollups & views


def observation_costs(observations: DataFrame) -> DataFrame:
    """Sum of non-null observation costs per (project, trace)."""
    return (
        observations.where(F.col("total_cost").isNotNull() & F.col("trace_id").isNotNull())
        .groupBy("project_id", "trace_id")
        .agg(F.sum("total_cost").alias("_cost"))
    )


def rollup_trace_costs(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """traces.total_cost = sum of its observations' costs, NULL when none.

    Both inputs are hash-partitioned on (project_id, trace id) by their own
    aggregations, so the left join adds no exchange.
    """
    costs = observation_costs(observations).withColumnRenamed("trace_id", "id")
    out = traces.drop("total_cost").join(costs, ["project_id", "id"], "left")
    return out.withColumn("total_cost", F.col("_cost")).select(*TRACES.names)


def sessions_view(traces: DataFrame) -> DataFrame:
    """Sessions derived from traces (P20)."""
    return (
        traces.where(F.col("session_id").isNotNull() & (F.col("session_id") != ""))
        .groupBy(F.col("session_id").alias("id"), "project_id")
        .agg(
            F.min("start_time").alias("first_seen_at"),
            F.max(F.coalesce(F.col("end_time"), F.col("start_time"))).alias("last_seen_at"),
            F.count(F.lit(1)).alias("trace_count"),
        )
        .select(*SESSIONS.names)
    )
