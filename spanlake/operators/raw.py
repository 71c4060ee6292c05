"""Raw event log: envelope → 11-column log rows, entity keys, event_json view,
and the two duplicate policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.json import is_defined, js_string, vget
from spanlake.functions.time import iso_ms, lenient_timestamp
from spanlake.schema import EVENTS_RAW, SCORE_CREATE, TRACE_CREATE

RAW_COLUMNS = [f.name for f in EVENTS_RAW.fields]
#: What names an event: ids are only unique within a project.
EVENT_KEY = ["project_id", "event_id"]


def first_present(*values: Column) -> Column:
    """JavaScript ``a ?? b ?? c`` over VARIANT values (presence, not validity)."""
    out = values[-1]
    for v in reversed(values[:-1]):
        out = F.when(is_defined(v), v).otherwise(out)
    return out


def entity_keys(event_type: Column, event_id: Column, body: Column) -> tuple[Column, Column, Column]:
    """(trace_id, observation_id, score_id) an event projects to."""
    body_id = js_string(vget(body, "$.id"))
    ref_trace = js_string(vget(body, "$.traceId"))
    is_trace = event_type == TRACE_CREATE
    is_score = event_type == SCORE_CREATE
    trace_id = F.when(is_trace, js_string(first_present(vget(body, "$.id"), vget(body, "$.traceId")))).otherwise(
        ref_trace
    )
    observation_id = (
        F.when(is_trace, F.lit(None).cast("string"))
        .when(is_score, js_string(vget(body, "$.observationId")))
        .otherwise(F.coalesce(body_id, event_id))
    )
    score_id = F.when(is_score, F.coalesce(body_id, event_id))
    return trace_id, observation_id, score_id


def raw_rows(
    events: DataFrame,
    project_id: Column | str,
    object_key: Column | str | None = None,
    manifest_key: Column | str | None = None,
    entity_id: Column | None = None,
) -> DataFrame:
    """Envelope rows (id, timestamp, type, body[, metadata]) → the raw-log shape.

    ``object_key`` / ``manifest_key`` / ``entity_id`` default to columns of the
    same name on ``events`` when present.
    """

    def _col(v, name):
        if isinstance(v, Column):
            return v
        if v is None:
            return F.col(name) if name in events.columns else F.lit(None).cast("string")
        return F.lit(v)

    body = F.parse_json(F.col("body"))
    event_id = F.col("id")
    event_type = F.col("type")
    trace_id, observation_id, score_id = entity_keys(event_type, event_id, body)
    default_entity = F.coalesce(js_string(vget(body, "$.id")), event_id)
    return events.select(
        event_id.alias("event_id"),
        _col(project_id, "project_id").alias("project_id"),
        _col(manifest_key, "manifest_key").alias("manifest_key"),
        _col(object_key, "object_key").alias("object_key"),
        event_type.alias("event_type"),
        lenient_timestamp(F.col("timestamp")).alias("event_timestamp"),
        (entity_id if entity_id is not None else (F.col("entity_id") if "entity_id" in events.columns else default_entity)).alias(
            "entity_id"
        ),
        F.col("body").alias("body_json"),
        trace_id.alias("trace_id"),
        observation_id.alias("observation_id"),
        score_id.alias("score_id"),
    )


def events_raw_view(raw: DataFrame) -> DataFrame:
    """The raw log plus the computed ``event_json`` column.

    Column pruning drops the expression whenever ``event_json`` is not read.
    """
    event_json = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            iso_ms(F.col("event_timestamp")).alias("timestamp"),
            F.col("event_type").alias("type"),
            F.parse_json(F.col("body_json")).alias("body"),
        )
    )
    return raw.select(*RAW_COLUMNS[:8], event_json.alias("event_json"), *RAW_COLUMNS[8:])


def dedupe_skip(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Direct-append policy: keep one row per project and event id and skip those
    already stored."""
    out = batch.dropDuplicates(EVENT_KEY)
    if stored is not None:
        out = out.join(stored.select(*EVENT_KEY), EVENT_KEY, "left_anti")
    return out


def duplicate_event_ids(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Strict (sync) policy helper: event ids of a project that occur more than
    once, or that are already stored. A non-empty result means the batch must not commit."""
    ids = batch.select(*EVENT_KEY)
    if stored is not None:
        ids = ids.unionByName(stored.select(*EVENT_KEY))
    return ids.groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


class DuplicateEventError(ValueError):
    """An event id occurs more than once (strict policy)."""


def check_no_duplicates(batch: DataFrame, stored: DataFrame | None = None) -> None:
    """Strict (sync) policy: fail the whole batch when any event id repeats,
    within the batch or against the stored log, like a key violation that
    rolls the batch back. One bounded probe (at most one row reaches the
    driver) runs before anything is written."""
    hit = duplicate_event_ids(batch, stored).limit(1).collect()
    if hit:
        raise DuplicateEventError(f"duplicate event id: {hit[0]['event_id']}")
