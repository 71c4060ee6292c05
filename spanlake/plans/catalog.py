"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables through an overlay (see
``spanlake.sources.overlays``) and runs over the whole table. Computed columns
are aliased to the names the DuckDB oracle uses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import fold, raw, validate
from spanlake.plans import reads
from spanlake.plans import state as st
from spanlake.sources import overlays

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fixed ids the point reads look up; they exist at every scale factor.
F1_TRACE = "t1"
F1_SESSION = "s1"
F1_ENTITY = "o1"


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _r6(c) -> F.Column:
    return F.round(c, 6)


def _md_k(col: str = "metadata_json") -> F.Column:
    return F.get_json_object(F.col(col), "$.k").cast("long")


def _md_keys(col: str = "metadata_json") -> F.Column:
    return F.size(F.json_object_keys(F.col(col))).cast("long")


# ------------------------------------------------------------ validation (F1)


@query("accepted_events")
def accepted_events(spark: SparkSession, sf: str) -> DataFrame:
    acc = st.f1_accepted(spark, sf)
    return acc.select("id", "type", "timestamp").orderBy("timestamp", "id")


@query("rejected_events")
def rejected_events(spark: SparkSession, sf: str) -> DataFrame:
    rej = validate.rejected(st.f1_validated(spark, sf))
    return rej.select(F.col("reject_id").alias("id"), "status", "message", "error")


@query("batch_result")
def batch_result(spark: SparkSession, sf: str) -> DataFrame:
    v = st.f1_validated(spark, sf)
    ok = F.size("errors") == 0
    return v.groupBy("batch").agg(
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
        F.lit(validate.ACCEPT_STATUS).alias("accept_status"),
    )


@query("entity_type")
def entity_type_q(spark: SparkSession, sf: str) -> DataFrame:
    acc = st.f1_accepted(spark, sf)
    return acc.select("id", validate.entity_type(F.col("type")).alias("entity_type"), validate.body_id(F.col("body")).alias("body_id"))


# ---------------------------------------------------------------- raw log (F1)


@query("raw_log")
def raw_log(spark: SparkSession, sf: str) -> DataFrame:
    r = st.f1_raw(spark, sf)
    return r.select(
        "event_id", "project_id", "object_key", "event_type", "event_timestamp", "entity_id", "trace_id", "observation_id", "score_id"
    )


@query("project_scope")
def project_scope(spark: SparkSession, sf: str) -> DataFrame:
    r = st.f1_raw(spark, sf).where(F.col("project_id") == overlays.PROJECT)
    return r.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("entity_id").alias("entities")
    )


@query("dedupe_strict")
def dedupe_strict(spark: SparkSession, sf: str) -> DataFrame:
    return raw.duplicate_event_ids(st.f1_raw_batch(spark, sf)).select("event_id", "copies")


def _f1_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(stored log of batch 1, incoming batch 2 with its duplicates)."""
    batch = st.f1_raw_batch(spark, sf)
    second = F.col("event_timestamp") >= F.lit(overlays.F1_SECOND_BATCH_FROM).cast("timestamp")
    stored = st.materialize(spark, "f1_stored_raw", sf, lambda: raw.dedupe_skip(batch.where(~second)))
    return stored, batch.where(second)


def _f1_existing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(stored log of batch 1, keys of batch 2 that its written state has)."""
    from spanlake.operators import incremental

    stored, new = _f1_split(spark, sf)
    state = st.stored_state(spark, "f1_stored", sf, lambda: stored)
    keys = st.materialize(spark, "f1_affected_keys", sf, lambda: incremental.affected_keys(new))
    existing = lambda: incremental.existing_keys(keys, state.traces, state.observations, state.scores)
    return stored, st.materialize(spark, "f1_existing_keys", sf, existing)


@query("dedupe_skip")
def dedupe_skip(spark: SparkSession, sf: str) -> DataFrame:
    stored, _ = _f1_split(spark, sf)
    incoming = st.f1_raw_batch(spark, sf)  # the whole batch re-sent: stored ids are skipped
    out = raw.dedupe_skip(incoming, stored)
    return out.select("event_id", "event_type", "entity_id")


@query("affected_keys")
def affected_keys(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import incremental

    _, new = _f1_split(spark, sf)
    return incremental.affected_keys(new)


@query("existing_keys")
def existing_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _f1_existing(spark, sf)[1]


@query("replay_history")
def replay_history(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import incremental

    stored, keys = _f1_existing(spark, sf)
    return incremental.replay_history(stored, keys).select("kind", "key", "event_id")


# ------------------------------------------------------------------- folds (F1)


def _obs_out(o: DataFrame) -> DataFrame:
    return o.select(
        "id",
        "project_id",
        "trace_id",
        "parent_observation_id",
        "type",
        "name",
        "start_time",
        "end_time",
        _r6(F.col("total_cost")).alias("total_cost"),
        "updated_at",
        _md_k().alias("md_k"),
        _md_keys().alias("md_keys"),
        _md_k("output_json").alias("output_k"),
    )


@query("merge_observations")
def merge_observations(spark: SparkSession, sf: str) -> DataFrame:
    return _obs_out(fold.fold_observations(st.f1_raw(spark, sf)))


@query("observation_cost")
def observation_cost(spark: SparkSession, sf: str) -> DataFrame:
    ev = fold.observation_fields(st.f1_raw(spark, sf))
    return ev.select("event_id", "observation_id", _r6(F.col("f_total_cost")).alias("total_cost"))


@query("merge_traces")
def merge_traces(spark: SparkSession, sf: str) -> DataFrame:
    t = fold.fold_traces(st.f1_raw(spark, sf))
    return t.select(
        "id", "project_id", "name", "user_id", "session_id", "start_time", "end_time", "updated_at",
        _md_k().alias("md_k"), _md_keys().alias("md_keys"),
    )


@query("trace_cost_rollup")
def trace_cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = st.f1_state(spark, sf)
    return s.traces.select("id", _r6(F.col("total_cost")).alias("total_cost"))


@query("sessions")
def sessions_q(spark: SparkSession, sf: str) -> DataFrame:
    return st.f1_state(spark, sf).sessions


# -------------------------------------------------------------- reads (F1)

_TRACE_COLS = ["id", "name", "user_id", "session_id", "start_time", "total_cost"]


def _trace_out(t: DataFrame) -> DataFrame:
    return t.select(*[_r6(F.col(c)).alias(c) if c == "total_cost" else F.col(c) for c in _TRACE_COLS])


@query("traces_list")
def traces_list(spark: SparkSession, sf: str) -> DataFrame:
    return _trace_out(reads.traces_list(st.f1_state(spark, sf).traces, 100))


@query("trace_get")
def trace_get(spark: SparkSession, sf: str) -> DataFrame:
    return _trace_out(reads.trace_get(st.f1_state(spark, sf).traces, overlays.PROJECT, F1_TRACE))


@query("observations_list")
def observations_list(spark: SparkSession, sf: str) -> DataFrame:
    o = reads.observations_list(st.f1_state(spark, sf).observations, overlays.PROJECT, F1_TRACE, 100)
    return _obs_out(o)


@query("sessions_list")
def sessions_list(spark: SparkSession, sf: str) -> DataFrame:
    return reads.sessions_list(st.f1_state(spark, sf).sessions, 100)


@query("session_get")
def session_get(spark: SparkSession, sf: str) -> DataFrame:
    return reads.session_get(st.f1_state(spark, sf).sessions, overlays.PROJECT, F1_SESSION)


@query("high_cost_traces")
def high_cost_traces(spark: SparkSession, sf: str) -> DataFrame:
    return _trace_out(reads.high_cost_traces(st.f1_state(spark, sf).traces, 20))


@query("busy_sessions")
def busy_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return reads.busy_sessions(st.f1_state(spark, sf).sessions, 20)


@query("repeated_sessions")
def repeated_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return reads.repeated_sessions(st.f1_state(spark, sf).sessions)


@query("entity_history")
def entity_history(spark: SparkSession, sf: str) -> DataFrame:
    return reads.entity_history(st.f1_raw(spark, sf), overlays.PROJECT, F1_ENTITY)


@query("trace_count")
def trace_count(spark: SparkSession, sf: str) -> DataFrame:
    return reads.trace_count(st.f1_state(spark, sf).traces)


@query("trace_bytes_stats")
def trace_bytes_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Footprint of the raw log's key columns per trace (F1)."""
    r = st.f1_raw(spark, sf).where(F.col("trace_id").isNotNull())
    size = (
        F.octet_length("event_id") + F.octet_length("entity_id") + F.octet_length("event_type") + F.octet_length("trace_id")
    )
    sizes = r.groupBy(F.col("trace_id")).agg(F.sum(size).alias("bytes"))
    return reads.trace_bytes_stats(sizes)


@query("adhoc_sql")
def adhoc_sql(spark: SparkSession, sf: str) -> DataFrame:
    s = st.f1_state(spark, sf)
    s.register()
    return reads.adhoc_sql(
        spark,
        "SELECT type, count(*) AS n, round(sum(total_cost), 6) AS cost, count(DISTINCT trace_id) AS traces "
        "FROM observations GROUP BY type",
    )


# ----------------------------------------------------------------- scores

F3_TRACE = "d1"
_SCORE_COLS = ["id", "trace_id", "observation_id", "name", "value", "string_value", "data_type", "source", "comment", "timestamp", "updated_at"]


@query("merge_scores")
def merge_scores(spark: SparkSession, sf: str) -> DataFrame:
    return st.f3_state(spark, sf).scores.select(*_SCORE_COLS)


@query("score_typing")
def score_typing(spark: SparkSession, sf: str) -> DataFrame:
    ev = fold.score_fields(st.f3_raw(spark, sf))
    return ev.select(
        "event_id",
        F.col("f_value_pair.value").alias("value"),
        F.col("f_value_pair.string_value").alias("string_value"),
        F.col("f_data_type").alias("data_type"),
    )


@query("score_source")
def score_source(spark: SparkSession, sf: str) -> DataFrame:
    ev = fold.score_fields(st.f3_raw(spark, sf))
    return ev.select("event_id", F.col("f_source").alias("source"))


@query("scores_list")
def scores_list(spark: SparkSession, sf: str) -> DataFrame:
    return reads.scores_list(st.f3_state(spark, sf).scores, overlays.PROJECT, trace_id=F3_TRACE).select(*_SCORE_COLS)


@query("low_score_traces")
def low_score_traces(spark: SparkSession, sf: str) -> DataFrame:
    s = st.f3_state(spark, sf)
    return reads.low_score_traces(s.traces, s.scores, 0.5, 50)


@query("score_agreement")
def score_agreement(spark: SparkSession, sf: str) -> DataFrame:
    s = st.f3_state(spark, sf)
    return reads.score_agreement(s.traces, s.scores, "quality", "$.compliance_score")


@query("direct_append")
def direct_append(spark: SparkSession, sf: str) -> DataFrame:
    """Direct append (K7): the trace events are stored first, then the whole F3
    stream is appended; already stored ids are skipped."""
    stored = raw.raw_rows(overlays.f3_trace_events(spark, sf), overlays.PROJECT)
    incoming = st.f3_raw(spark, sf)
    appended = raw.dedupe_skip(incoming, stored)
    return appended.groupBy("event_type").agg(F.count(F.lit(1)).alias("processed")).join(
        incoming.join(stored.select(*raw.EVENT_KEY), raw.EVENT_KEY, "left_semi")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("skipped")),
        "event_type",
        "full",
    ).select("event_type", F.coalesce("processed", F.lit(0)).alias("processed"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


# --------------------------------------------------------------- OTLP


def _vs(c: str) -> F.Column:
    """VARIANT text field → string."""
    return F.try_variant_get(F.col(c), "$", "string")


@query("otlp_spans")
def otlp_spans(spark: SparkSession, sf: str) -> DataFrame:
    m = st.f4_mapped(spark, sf)
    return m.select("object_key", "rs_pos", "ss_pos", "span_pos", "trace_id", "span_id", "parent_span_id")


@query("otlp_timestamps")
def otlp_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return st.f4_mapped(spark, sf).select("span_id", "start_time", "end_time")


@query("otlp_attributes")
def otlp_attributes(spark: SparkSession, sf: str) -> DataFrame:
    m = st.f4_mapped(spark, sf)
    a = F.col("attributes")
    return m.select(
        "span_id",
        F.size(a).cast("long").alias("n_attributes"),
        F.try_variant_get(F.try_element_at(a, F.lit("dup.key")), "$", "string").alias("dup_key"),
        F.schema_of_variant(F.try_element_at(a, F.lit("gen_ai.usage.input_tokens"))).alias("input_tokens_type"),
    )


@query("classify_spans")
def classify_spans(spark: SparkSession, sf: str) -> DataFrame:
    return st.f4_mapped(spark, sf).select("span_id", "observation_type")


@query("normalize_fields")
def normalize_fields(spark: SparkSession, sf: str) -> DataFrame:
    return st.f4_mapped(spark, sf).select(
        "span_id", F.col("o_model_p").alias("model_present"), F.when(F.col("o_model_p"), _vs("o_model")).alias("model")
    )


@query("genai_usage")
def genai_usage(spark: SparkSession, sf: str) -> DataFrame:
    m = st.f4_mapped(spark, sf)
    u = F.when(F.col("o_usageDetails_p"), F.col("o_usageDetails"))
    return m.select(
        "span_id",
        F.try_variant_get(u, "$.input", "double").alias("usage_input"),
        F.try_variant_get(u, "$.output", "double").alias("usage_output"),
        F.try_variant_get(u, "$.total", "double").alias("usage_total"),
        F.when(F.col("o_model_p"), _vs("o_model")).alias("model"),
    )


@query("identity_resolution")
def identity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return st.f4_mapped(spark, sf).select(
        "span_id",
        F.when(F.col("r_userId_p"), _vs("r_userId")).alias("user_id"),
        F.when(F.col("r_sessionId_p"), _vs("r_sessionId")).alias("session_id"),
    )


@query("trace_tags")
def trace_tags(spark: SparkSession, sf: str) -> DataFrame:
    m = st.f4_mapped(spark, sf).where(F.col("r_tags_p"))
    return m.select("span_id", F.array_join(F.col("r_tags").try_cast("array<string>"), ",").alias("tags"))


@query("has_trace_update")
def has_trace_update(spark: SparkSession, sf: str) -> DataFrame:
    return st.f4_mapped(spark, sf).select("span_id", "has_update")


@query("root_spans")
def root_spans(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import otlp

    m = st.f4_mapped(spark, sf)
    return m.select("span_id", otlp.is_root_span(F.col("parent_span_id"), F.col("attributes")).alias("is_root"))


@query("root_trace_fields")
def root_trace_fields(spark: SparkSession, sf: str) -> DataFrame:
    m = st.f4_mapped(spark, sf)
    return m.select("span_id", F.coalesce(F.when(F.col("r_name_p"), _vs("r_name")), F.col("span_name")).alias("name"))


@query("otlp_trace_events")
def otlp_trace_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = st.f4_trace_events(spark, sf)
    b = F.col("body")
    return ev.select(
        "object_key",
        "span_id",
        "trace_id",
        F.col("trace_event_kind").alias("kind"),
        F.get_json_object(b, "$.name").alias("name"),
        F.get_json_object(b, "$.userId").alias("user_id"),
        F.get_json_object(b, "$.sessionId").alias("session_id"),
    )


@query("otlp_events")
def otlp_events(spark: SparkSession, sf: str) -> DataFrame:
    """All events of the stored objects, in one pass over each object's spans."""
    from spanlake.operators import otlp

    ev = otlp.otlp_events(overlays.f4_objects(spark, sf))
    b = F.col("body")
    return ev.select("type", F.get_json_object(b, "$.id").alias("id"), F.get_json_object(b, "$.name").alias("name"), "timestamp")


@query("otlp_observation_events")
def otlp_observation_events(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import otlp

    ev = otlp.observation_events(st.f4_mapped(spark, sf))
    b = F.col("body")
    return ev.select(
        F.get_json_object(b, "$.id").alias("span_id"),
        F.get_json_object(b, "$.traceId").alias("trace_id"),
        F.get_json_object(b, "$.parentObservationId").alias("parent_span_id"),
        "type",
        F.get_json_object(b, "$.name").alias("name"),
        F.get_json_object(b, "$.environment").alias("environment"),
        "timestamp",
    )


@query("span_count")
def span_count(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import otlp
    from spanlake.sources import overlays as ov

    return otlp.count_spans(ov.f4_objects(spark, sf))


@query("otlp_traces")
def otlp_traces(spark: SparkSession, sf: str) -> DataFrame:
    return st.f4_state(spark, sf).traces.select("id", "name", "user_id", "session_id", "start_time")


# ------------------------------------------------- cleaning, conversations (F2)

F2_TRACE = "c1"


def _f2_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return validate.accepted(st.f2_validated(spark, sf))


def _j(path: str, cast: str | None = None) -> F.Column:
    c = F.get_json_object(F.col("body"), path)
    return c.cast(cast) if cast else c


@query("normalize_environment")
def normalize_environment(spark: SparkSession, sf: str) -> DataFrame:
    return _f2_accepted(spark, sf).select("id", _j("$.environment").alias("environment"))


@query("normalize_usage")
def normalize_usage(spark: SparkSession, sf: str) -> DataFrame:
    a = _f2_accepted(spark, sf).where(F.col("type") == "generation-create")
    u = F.try_variant_get(F.parse_json(F.col("body")), "$.usage", "variant")
    return a.select(
        "id",
        _j("$.usage.input", "long").alias("usage_input"),
        _j("$.usage.output", "long").alias("usage_output"),
        _j("$.usage.total", "long").alias("usage_total"),
        _j("$.usage.unit").alias("usage_unit"),
        F.coalesce(F.is_variant_null(u), F.lit(False)).alias("usage_null"),
    )


@query("clean_usage_details")
def clean_usage_details(spark: SparkSession, sf: str) -> DataFrame:
    a = _f2_accepted(spark, sf).where(F.col("type") == "generation-create")
    return a.select(
        "id",
        _j("$.usageDetails.input", "long").alias("ud_input"),
        _j("$.usageDetails.output", "long").alias("ud_output"),
        _j("$.usageDetails.total", "long").alias("ud_total"),
        F.size(F.json_object_keys(_j("$.usageDetails"))).cast("long").alias("ud_keys"),
    )


@query("clean_cost_details")
def clean_cost_details(spark: SparkSession, sf: str) -> DataFrame:
    a = _f2_accepted(spark, sf).where(F.col("type") == "generation-create")
    return a.select(
        "id",
        F.round(_j("$.costDetails.total", "double"), 6).alias("cost_total"),
        F.size(F.json_object_keys(_j("$.costDetails"))).cast("long").alias("cost_keys"),
    )


def _conv_obs(o: DataFrame) -> DataFrame:
    return o.select(
        "id", "trace_id", "parent_observation_id", "type", "name", "start_time", "end_time",
        F.get_json_object("usage_details_json", "$.total").cast("long").alias("usage_total"),
        F.round("total_cost", 6).alias("total_cost"),
    )


@query("conversation_observations")
def conversation_observations(spark: SparkSession, sf: str) -> DataFrame:
    return _conv_obs(st.f2_state(spark, sf).observations)


@query("conversation_timeline")
def conversation_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return _conv_obs(reads.observations_list(st.f2_state(spark, sf).observations, overlays.PROJECT, F2_TRACE, 100))


@query("conversation_costs")
def conversation_costs(spark: SparkSession, sf: str) -> DataFrame:
    t = st.f2_state(spark, sf).traces
    return t.select("id", "name", "user_id", "session_id", "start_time", F.round("total_cost", 6).alias("total_cost"))


@query("usage_by_model")
def usage_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return reads.usage_by_model(st.f2_raw(spark, sf))


@query("accepted_scores")
def accepted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """F3 score events through validation: comment-only updates lack name and
    value and are rejected; accepted ones get source API by default (V9)."""
    ev = overlays.f3_score_events(spark, sf).select(F.to_variant_object(F.struct("id", "timestamp", "type", F.parse_json("body").alias("body"))).alias("event"))
    v = validate.validate(ev)
    return v.select(
        "id",
        (F.size("errors") == 0).alias("accepted"),
        F.get_json_object(F.col("body"), "$.source").alias("source"),
        F.array_join("errors", "; ").alias("error"),
    )


# ------------------------------------------------------------------- sinks


@query("otlp_sink_layout")
def otlp_sink_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Key of each F4 export object under the UTC-minute layout; the write time
    is the object's earliest span start (K1)."""
    from spanlake.operators import store

    m = st.f4_mapped(spark, sf)
    first = m.groupBy("object_key").agg(F.min("start_time").alias("write_time"))
    batch = F.regexp_extract(F.col("object_key"), r"([^/]+)\.json$", 1)
    return first.select("object_key", store.otlp_object_key(overlays.PROJECT, F.col("write_time"), batch).alias("path"))


def _f1_positioned(spark: SparkSession, sf: str) -> DataFrame:
    acc = st.f1_accepted(spark, sf)
    pos = F.col("eid") * 4 + F.when(F.col("kind") == "trace", 1).otherwise(0) + F.col("copy") * 2
    return acc.withColumn("pos", pos)


@query("entity_objects")
def entity_objects(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import store

    objs = store.entity_objects(_f1_positioned(spark, sf), overlays.PROJECT)
    return objs.select(
        "batch", "key", "entity_type", "entity_id", F.size("event_ids").cast("long").alias("n_events"),
        "min_timestamp", "max_timestamp", F.col("event_ids")[0].alias("first_event_id"),
    )


@query("batch_manifest")
def batch_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import store

    objs = store.entity_objects(_f1_positioned(spark, sf), overlays.PROJECT)
    m = store.batch_manifests(objs, overlays.PROJECT, F.lit("2024-02-01T00:00:00.000Z"))
    return m.select("batch", "projectId", "n_objects", "n_events")


@query("storage_stats")
def storage_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Footprint of all stored F4 objects and F1 manifests, whole spans by trace (Q13)."""
    from spanlake.operators import store

    objs = store.entity_objects(_f1_positioned(spark, sf), overlays.PROJECT)
    manifests = store.batch_manifests(objs, overlays.PROJECT, F.lit("2024-02-01T00:00:00.000Z"))
    return reads.storage_stats(overlays.f4_objects(spark, sf), manifests)


def _manual_trace_rows(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.sources.tables import table

    d = table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    return d.select(
        F.lpad(F.lower(F.hex(F.col("doc_id") + 1000)), 32, "0").alias("id"),
        F.col("source").alias("name"),
        F.concat(F.lit("mu"), (F.col("doc_id") % 10).cast("string")).alias("user_id"),
        F.col("lang").alias("session_id"),
        F.to_json(F.struct(F.col("n_chars").alias("n_chars"))).alias("input"),
        F.lit(None).cast("string").alias("output"),
        F.to_json(F.struct(F.col("lang").alias("lang"))).alias("metadata"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00")) + F.col("doc_id")).alias("timestamp"),
    )


@query("trace_rows_to_events")
def trace_rows_to_events(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import otlp, store

    objs = store.trace_rows_to_objects(_manual_trace_rows(spark, sf))
    mapped = otlp.map_spans(otlp.decode_spans(otlp.flatten_spans(objs)))
    ev = otlp.trace_events(mapped)
    b = F.col("body")
    return ev.select(
        F.get_json_object(b, "$.id").alias("trace_id"),
        F.get_json_object(b, "$.name").alias("name"),
        F.get_json_object(b, "$.userId").alias("user_id"),
        F.get_json_object(b, "$.sessionId").alias("session_id"),
        F.get_json_object(b, "$.metadata.lang").alias("md_lang"),
        F.get_json_object(b, "$.input.n_chars").cast("long").alias("input_n_chars"),
        F.get_json_object(b, "$.environment").alias("environment"),
    )


@query("score_rows_to_events")
def score_rows_to_events(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import store
    from spanlake.sources.tables import table

    lab = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    d = F.col("doc_id")
    rows = lab.select(
        F.concat(F.lit("a"), d.cast("string")).alias("id"),
        F.concat(F.lit("d"), d.cast("string")).alias("trace_id"),
        F.lit(None).cast("string").alias("observation_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.lit("review").alias("name"),
        F.when(d % 3 == 0, F.col("quality").cast("string"))
        .when(d % 3 == 1, F.when(F.col("toxic") == 1, "true").otherwise("false"))
        .otherwise(F.when(F.col("quality") == 1, "ok").otherwise("bad"))
        .alias("value"),
        F.lit(None).cast("string").alias("data_type"),
        F.when(d % 4 == 0, "EVAL").when(d % 4 == 1, "ANNOTATION").alias("source"),
        F.lit(None).cast("string").alias("comment"),
        F.concat(F.lit("ae"), d.cast("string")).alias("event_id"),
    )
    ev = store.score_rows_to_events(rows, F.lit("2024-04-01 00:00:00").cast("timestamp"))
    b = F.col("body")
    return ev.select(
        "id", "status",
        F.get_json_object(b, "$.id").alias("score_id"),
        F.get_json_object(b, "$.source").alias("source"),
        F.to_json(F.try_variant_get(F.parse_json(b), "$.value", "variant")).alias("value_json"),
        F.get_json_object(b, "$.createdAt").alias("created_at"),
    )


# ------------------------------------------------- merge, views, upserts


@query("merge_metadata")
def merge_metadata_q(spark: SparkSession, sf: str) -> DataFrame:
    """Nested values, scalars over objects and back, and twelve levels, per user of
    the event stream (P16)."""
    from spanlake.operators.metadata import merge_metadata
    from spanlake.sources.tables import table

    i = F.col("event_id").cast("string")
    deep = "".join(f'{{"l{n}":' for n in range(11))
    text = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"a":{"x":'), i, F.lit("}}")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"a":{"y":'), i, F.lit("}}")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"a":'), i, F.lit("}")))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"deep":' + deep), i, F.lit("}" * 12)))
        .otherwise(F.concat(F.lit('{"a":{"x":{"z":'), i, F.lit('}},"k":'), i, F.lit("}")))
    )
    ev = table(spark, sf, "events", "event_id", "ts", "user_id").withColumn("text", text)
    out = merge_metadata(ev, ["user_id"], "text", F.struct("ts", "event_id"))

    def at(path: str) -> F.Column:
        return F.get_json_object("metadata_json", path).try_cast("long")

    levels = ".".join(f"l{n}" for n in range(11))
    return out.select(
        "user_id", at("$.a").alias("a"), at("$.a.x").alias("x"), at("$.a.x.z").alias("z"), at("$.a.y").alias("y"),
        at(f"$.deep.{levels}").alias("deep"), at("$.k").alias("k"),
    )


@query("events_raw_view")
def events_raw_view_q(spark: SparkSession, sf: str) -> DataFrame:
    """The raw log with its computed ``event_json``."""
    v = raw.events_raw_view(st.f1_raw(spark, sf))
    j = F.col("event_json")
    return v.select(
        "event_id", F.get_json_object(j, "$.id").alias("json_id"), F.get_json_object(j, "$.type").alias("json_type"), F.get_json_object(j, "$.timestamp").alias("json_timestamp")
    )


_SYNCED: dict[tuple[str, str, str], object] = {}


def _committed(spark: SparkSession, name: str, sf: str, first: DataFrame, second: DataFrame):
    """State after two commits: a first part of a raw log, then the rest (with what
    it repeats of the first)."""
    from spanlake.session import checkpoint_dir
    from spanlake.streaming.store import StateStore
    from spanlake.streaming.sync import commit

    memo = (spark.sparkContext.applicationId, name, sf)
    if memo not in _SYNCED:
        state = StateStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", buckets=8)
        commit(state, first)
        commit(state, second)
        _SYNCED[memo] = state
    return _SYNCED[memo]


def _f1_committed(spark: SparkSession, sf: str):
    batch = st.f1_raw_batch(spark, sf)
    second = F.col("event_timestamp") >= F.lit(overlays.F1_SECOND_BATCH_FROM).cast("timestamp")
    return _committed(spark, "f1_committed", sf, batch.where(~second), batch)


@query("upsert_observations")
def upsert_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations after two commits equal one fold (K5)."""
    return _obs_out(_f1_committed(spark, sf).read("observations"))


@query("upsert_traces")
def upsert_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Trace costs after two commits equal one fold and rollup (K5)."""
    return _f1_committed(spark, sf).read("traces").select("id", _r6(F.col("total_cost")).alias("total_cost"))


@query("upsert_scores")
def upsert_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores after two commits equal one fold (K5)."""
    log = st.f3_raw(spark, sf)
    early = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    return _committed(spark, "f3_committed", sf, log.where(early), log).read("scores").select(*_SCORE_COLS)


@query("ledger")
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events that the commits' records count, against those in the raw log (K6)."""
    state = _f1_committed(spark, sf)
    log = state.read_raw().agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("event_id").alias("distinct_ids"))
    return log.select(F.lit(state.record()["counters"]["events"]).cast("long").alias("counted"), "stored", "distinct_ids")
