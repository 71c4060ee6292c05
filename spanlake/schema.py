"""Schemas of the event model and of the five current-state relations."""

from __future__ import annotations

from pyspark.sql import types as T

S, TS, D, L = T.StringType(), T.TimestampType(), T.DoubleType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Fixed values of the event model: the fifteen event types.
TRACE_CREATE = "trace-create"
SCORE_CREATE = "score-create"
EVENT_TYPES = [
    "trace-create",
    "span-create",
    "span-update",
    "generation-create",
    "generation-update",
    "event-create",
    "score-create",
    "agent-create",
    "tool-create",
    "chain-create",
    "retriever-create",
    "embedding-create",
    "guardrail-create",
    "observation-create",
    "observation-update",
]

# Ingestion envelope as it lands: every field kept as text, the body as JSON text.
ENVELOPE = _struct(("id", S), ("timestamp", S), ("type", S), ("metadata", S), ("body", S))

EVENTS_RAW = _struct(
    ("event_id", S),
    ("project_id", S),
    ("manifest_key", S),
    ("object_key", S),
    ("event_type", S),
    ("event_timestamp", TS),
    ("entity_id", S),
    ("body_json", S),
    ("trace_id", S),
    ("observation_id", S),
    ("score_id", S),
)

TRACES = _struct(
    ("id", S),
    ("project_id", S),
    ("name", S),
    ("user_id", S),
    ("session_id", S),
    ("start_time", TS),
    ("end_time", TS),
    ("metadata_json", S),
    ("input_json", S),
    ("output_json", S),
    ("total_cost", D),
    ("updated_at", TS),
)

OBSERVATIONS = _struct(
    ("id", S),
    ("project_id", S),
    ("trace_id", S),
    ("parent_observation_id", S),
    ("type", S),
    ("name", S),
    ("start_time", TS),
    ("end_time", TS),
    ("metadata_json", S),
    ("input_json", S),
    ("output_json", S),
    ("usage_details_json", S),
    ("cost_details_json", S),
    ("total_cost", D),
    ("updated_at", TS),
)

SCORES = _struct(
    ("id", S),
    ("project_id", S),
    ("trace_id", S),
    ("observation_id", S),
    ("session_id", S),
    ("name", S),
    ("value", D),
    ("string_value", S),
    ("data_type", S),
    ("source", S),
    ("comment", S),
    ("metadata_json", S),
    ("timestamp", TS),
    ("updated_at", TS),
)

SESSIONS = _struct(
    ("id", S), ("project_id", S), ("first_seen_at", TS), ("last_seen_at", TS), ("trace_count", L)
)

MANIFEST = T.StructType(
    [
        T.StructField("batchId", S),
        T.StructField("projectId", S),
        T.StructField("createdAt", S),
        T.StructField(
            "objects",
            T.ArrayType(
                _struct(
                    ("key", S),
                    ("entityType", S),
                    ("entityId", S),
                    ("eventIds", T.ArrayType(S)),
                    ("minTimestamp", S),
                    ("maxTimestamp", S),
                    ("sha256", S),
                )
            ),
        ),
    ]
)

# OTLP/JSON resourceSpans. Ids, times and attribute values arrive in several
# encodings (text, numbers, byte arrays, {low, high} longs), so they stay VARIANT.
V = T.VariantType()
OTLP_ATTRIBUTE = _struct(("key", V), ("value", V))
OTLP_SPAN = _struct(
    ("traceId", V),
    ("spanId", V),
    ("parentSpanId", V),
    ("name", V),
    ("startTimeUnixNano", V),
    ("endTimeUnixNano", V),
    ("attributes", T.ArrayType(OTLP_ATTRIBUTE)),
)
OTLP_SCOPE_SPANS = _struct(("scope", V), ("spans", T.ArrayType(OTLP_SPAN)))
OTLP_RESOURCE_SPANS = _struct(
    ("resource", V),
    ("scopeSpans", T.ArrayType(OTLP_SCOPE_SPANS)),
    ("instrumentationLibrarySpans", T.ArrayType(OTLP_SCOPE_SPANS)),
)
