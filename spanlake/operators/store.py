"""Sinks: object layouts, entity-grouped objects and manifests, and row-to-event
converters for manual traces and scores.

Layout of stored objects (fixed format of the event model):
  <prefix>otel/<project>/yyyy/MM/dd/HH/mm/<batch>.json          raw OTLP batches
  <prefix><project>/<entityType>/<entityId>/<firstEventId>.json  entity events
  <prefix><project>/manifests/yyyy/MM/dd/HH/mm/<batch>.json      batch manifests
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.json import is_array, is_bool, is_number, is_string, js_string, parse_or_text
from spanlake.functions.time import iso_ms, minute_path
from spanlake.operators.validate import body_id, entity_type


def normalize_prefix(prefix: str) -> str:
    """A non-empty prefix always ends with ``/``."""
    return prefix if not prefix or prefix.endswith("/") else prefix + "/"


def otlp_object_key(project: str, write_time: Column, batch_id: Column, prefix: str = "") -> Column:
    """Key of a raw OTLP batch under the UTC-minute layout (K1)."""
    return F.concat(F.lit(f"{normalize_prefix(prefix)}otel/{project}/"), minute_path(write_time), F.lit("/"), batch_id, F.lit(".json"))


def manifest_key(project: str, created: Column, batch_id: Column, prefix: str = "") -> Column:
    """Key of a batch manifest under the UTC-minute layout (K3)."""
    return F.concat(F.lit(f"{normalize_prefix(prefix)}{project}/manifests/"), minute_path(created), F.lit("/"), batch_id, F.lit(".json"))


def entity_objects(accepted: DataFrame, project: str, batch_col: str = "batch", pos_col: str = "pos", prefix: str = "") -> DataFrame:
    """Group a batch's accepted events per (entity type, body id) (K2).

    Events are ordered by timestamp text, then batch position (a stable sort);
    the object key uses the first event's id. Events without a string body id
    are left out. One row per object with its ordered events; groups are
    bounded by one request batch.
    """
    ev = accepted.select(
        batch_col, pos_col, "id", "timestamp", "type", "body", (F.col("metadata") if "metadata" in accepted.columns else F.lit(None)).cast("string").alias("metadata"),
        entity_type(F.col("type")).alias("entity_type"), body_id(F.col("body")).alias("entity_id"),
    ).where(F.col("entity_id").isNotNull())
    item = F.struct(F.col("timestamp").alias("ts"), F.col(pos_col).alias("pos"), F.col("id").alias("id"), F.col("type").alias("type"), F.col("body").alias("body"), F.col("metadata").alias("metadata"))
    grouped = ev.groupBy(batch_col, "entity_type", "entity_id").agg(F.array_sort(F.collect_list(item)).alias("events"))
    first = F.col("events")[0]
    key = F.concat(
        F.lit(f"{normalize_prefix(prefix)}{project}/"), F.col("entity_type"), F.lit("/"), F.col("entity_id"), F.lit("/"), first["id"], F.lit(".json")
    )
    serialized = F.to_json(F.transform(F.col("events"), lambda e: F.struct(e["id"].alias("id"), e["ts"].alias("timestamp"), e["type"].alias("type"), F.parse_json(e["body"]).alias("body"), F.try_parse_json(e["metadata"]).alias("metadata"))))
    return grouped.select(
        batch_col,
        key.alias("key"),
        "entity_type",
        "entity_id",
        F.transform(F.col("events"), lambda e: e["id"]).alias("event_ids"),
        first["ts"].alias("min_timestamp"),
        F.element_at(F.col("events"), -1)["ts"].alias("max_timestamp"),
        serialized.alias("content"),
        F.sha2(serialized, 256).alias("sha256"),
    )


def batch_manifests(objects: DataFrame, project: str, created: Column, batch_col: str = "batch") -> DataFrame:
    """One manifest per batch listing its entity objects (K3)."""
    entry = F.struct(
        F.col("key"), F.col("entity_type").alias("entityType"), F.col("entity_id").alias("entityId"),
        F.col("event_ids").alias("eventIds"), F.col("min_timestamp").alias("minTimestamp"),
        F.col("max_timestamp").alias("maxTimestamp"), F.col("sha256"),
    )
    return objects.groupBy(batch_col).agg(
        F.collect_list(entry).alias("objects"), F.count(F.lit(1)).alias("n_objects"), F.sum(F.size("event_ids")).alias("n_events")
    ).select(batch_col, F.lit(project).alias("projectId"), created.alias("createdAt"), "objects", "n_objects", "n_events")


# ------------------------------------------------------- row → event builders


def _any_value(v: Column) -> Column:
    """OTLP AnyValue of a JSON value: booleans and numbers typed, arrays as lists of
    texts, objects as JSON text, strings as they are."""
    text = F.coalesce(F.when(is_string(v), F.try_variant_get(v, "$", "string")), F.to_json(v))
    items = F.transform(v.try_cast("array<variant>"), lambda x: F.struct(F.coalesce(js_string(x), F.to_json(x)).alias("stringValue")))
    return (
        F.when(is_bool(v), F.to_variant_object(F.struct(F.try_variant_get(v, "$", "boolean").alias("boolValue"))))
        .when(is_number(v), F.to_variant_object(F.struct(F.try_variant_get(v, "$", "double").alias("doubleValue"))))
        .when(is_array(v), F.to_variant_object(F.struct(F.struct(items.alias("values")).alias("arrayValue"))))
        .otherwise(F.to_variant_object(F.struct(text.alias("stringValue"))))
    )


def _attr(key: str, value: Column) -> Column:
    """OTLP attribute with a string value (skipped when the value is NULL)."""
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.to_variant_object(F.struct(value.alias("stringValue"))).alias("value")))


def _json_attr(key: str, text: Column) -> Column:
    """OTLP attribute of JSON or plain text."""
    return F.when(text.isNotNull(), F.struct(F.lit(key).alias("key"), _any_value(parse_or_text(text)).alias("value")))


def trace_rows_to_objects(rows: DataFrame) -> DataFrame:
    """Manual trace rows → one OTLP export object each (K9).

    rows: id, name, user_id, session_id, input, output (JSON or plain text),
    metadata (JSON object text), timestamp. The root span carries the trace
    name, identity, I/O (as trace and observation I/O) and one
    ``langfuse.trace.metadata.<k>`` attribute per metadata key.
    """
    name = F.coalesce(F.col("name"), F.lit("manual trace"))
    ns = (F.unix_micros(F.col("timestamp")) * 1000).cast("string")
    md = F.coalesce(F.try_parse_json("metadata").try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    md_attrs = F.transform(
        F.map_entries(md),
        lambda e: F.struct(F.concat(F.lit("langfuse.trace.metadata."), e["key"]).alias("key"), _any_value(e["value"]).alias("value")),
    )
    base = F.filter(
        F.array(
            _attr("langfuse.observation.type", F.lit("span")),
            _attr("langfuse.trace.name", name),
            _attr("langfuse.environment", F.lit("default")),
            _attr("user.id", F.nullif(F.col("user_id"), F.lit(""))),
            _attr("session.id", F.nullif(F.col("session_id"), F.lit(""))),
            _json_attr("langfuse.trace.input", F.col("input")),
            _json_attr("langfuse.observation.input", F.col("input")),
            _json_attr("langfuse.trace.output", F.col("output")),
            _json_attr("langfuse.observation.output", F.col("output")),
        ),
        lambda x: x.isNotNull(),
    )
    span = F.to_variant_object(
        F.struct(
            F.col("id").alias("traceId"),
            F.substring(F.sha2(F.col("id"), 256), 1, 16).alias("spanId"),
            name.alias("name"),
            ns.alias("startTimeUnixNano"),
            ns.alias("endTimeUnixNano"),
            F.concat(base, md_attrs).alias("attributes"),
        )
    )
    rs = F.to_variant_object(F.array(F.to_variant_object(F.struct(F.array(F.to_variant_object(F.struct(F.array(span).alias("spans")))).alias("scopeSpans")))))
    return rows.select(F.concat(F.lit("manual/"), F.col("id"), F.lit(".json")).alias("object_key"), rs.alias("resource_spans"))


SCORE_ROW_SOURCES = ["API", "ANNOTATION"]


def parse_score_value(text: Column) -> Column:
    """Score value from text: true/false → boolean, numeric → number, else text."""
    from spanlake.functions.json import lenient_number

    num = lenient_number(text)
    return (
        F.when(text == "true", F.lit(True).cast("variant"))
        .when(text == "false", F.lit(False).cast("variant"))
        .when(num.isNotNull(), num.cast("variant"))
        .otherwise(text.cast("variant"))
    )


def score_rows_to_events(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Annotation rows → score-create events (K10). Only API and ANNOTATION
    sources are allowed (missing → API); EVAL and unknown sources are refused
    and reported in ``status``.

    rows: id, trace_id, observation_id, session_id, name, value (text),
    data_type, source, comment, event_id.
    """
    now = now if now is not None else F.current_timestamp()
    source = F.coalesce(F.col("source"), F.lit("API"))
    ok = source.isin(*SCORE_ROW_SOURCES)
    body = F.to_json(
        F.to_variant_object(
            F.map_filter(
                F.create_map(
                    F.lit("id"), F.col("id").cast("variant"),
                    F.lit("traceId"), F.col("trace_id").cast("variant"),
                    F.lit("observationId"), F.col("observation_id").cast("variant"),
                    F.lit("sessionId"), F.col("session_id").cast("variant"),
                    F.lit("name"), F.col("name").cast("variant"),
                    F.lit("value"), parse_score_value(F.col("value")),
                    F.lit("dataType"), F.col("data_type").cast("variant"),
                    F.lit("source"), source.cast("variant"),
                    F.lit("comment"), F.col("comment").cast("variant"),
                    F.lit("createdAt"), iso_ms(now).cast("variant"),
                    F.lit("environment"), F.lit("default").cast("variant"),
                ),
                lambda k, v: v.isNotNull(),
            )
        )
    )
    return rows.select(
        F.col("event_id").alias("id"),
        iso_ms(now).alias("timestamp"),
        F.lit("score-create").alias("type"),
        F.when(ok, body).alias("body"),
        F.when(ok, "created").otherwise("refused").alias("status"),
        F.when(~ok, F.lit("source must be API or ANNOTATION")).alias("error"),
    )


def write_otlp_objects(objects: DataFrame, root: str, project: str, write_time: Column, prefix: str = "") -> None:
    """Write export objects one per line, each with its key, under the UTC minute
    layout ``otel/<project>/year=/month=/day=/hour=/minute=`` (K1); the time parts
    are partition columns, so ``files.otlp_window`` reads only the folders it needs."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH", "minute": "mm"}
    out = objects.select(
        F.to_json(F.struct(F.col("object_key").alias("key"), F.col("resource_spans").alias("resourceSpans"))).alias("value"),
        *[F.date_format(write_time, fmt).alias(name) for name, fmt in parts.items()],
    )
    out.write.mode("append").partitionBy(*parts).text(f"{root.rstrip('/')}/{normalize_prefix(prefix)}otel/{project}")


def write_objects(objects: DataFrame, root: str, key: str = "key", content: str = "content", sha256: str | None = None) -> DataFrame:
    """Write one file per row below ``root`` (K2, K3); returns key, n_bytes and sha256 of what was
    written. Keys are taken literally. With ``sha256``, a row whose content does not have that hash fails."""
    base = root if "://" in root else "file://" + re.sub(r"^file:/+", "/", root)
    rows = objects.select(F.col(key).alias("key"), F.col(content).alias("content"), (F.col(sha256) if sha256 else F.lit(None).cast("string")).alias("want"))

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(base.rstrip("/").replace("%", "%25").replace(" ", "%20"))
        for batch in batches:
            sizes, hashes = [], []
            for name, text, want in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "want"))):
                data = text.encode()
                digest = hashlib.sha256(data).hexdigest()
                if want is not None and want != digest:
                    raise ValueError(f"content of {name} does not have the stated hash")
                path = f"{top}/{name}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(path, compression=None) as f:
                    f.write(data)
                sizes.append(len(data))
                hashes.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], ["key", "n_bytes", "sha256"])

    return rows.mapInArrow(put, "key string, n_bytes long, sha256 string")
