"""OTLP/JSON resource spans → normalised ingestion events.

Objects (one export batch each) are flattened resource → scope → span with
positions kept, ids/times/attributes are decoded with column expressions, the
attribute conventions classify and enrich each span (``conventions``), and one
observation event per span plus the trace events are emitted. The first-seen
and shallow-trace rules are scoped to one stored object: ``otlp_events`` settles them
in one pass over the object's spans, ``trace_events`` by windows over mapped spans in
any order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.cache import per_context
from spanlake.functions.json import (
    is_array,
    is_bool,
    is_defined,
    is_number,
    is_object,
    is_string,
    js_string,
    vget,
)
from spanlake.functions.time import iso_ms, nanos_to_timestamp
from spanlake.operators import conventions as conv

DEFAULT_ENVIRONMENT = "default"
DEFAULT_SPAN_NAME = "otel-span"
OTEL_EVENT_METADATA = '{"source":"otel"}'


def _arr(v: Column) -> Column:
    """A VARIANT array as array<variant>; NULL when not an array."""
    return v.try_cast("array<variant>")


_SCOPES = "array<struct<spans: array<variant>>>"
_RESOURCE_SPANS = f"array<struct<scopeSpans: {_SCOPES}, instrumentationLibrarySpans: {_SCOPES}>>"


def flatten_spans(objects: DataFrame, col: str = "resource_spans") -> DataFrame:
    """One row per span with (rs_pos, ss_pos, span_pos) (O1).

    ``scopeSpans`` falls back to ``instrumentationLibrarySpans``; anything
    that is not an array is skipped. Other columns of ``objects`` pass through.
    """
    keep = [c for c in objects.columns if c != col]
    # all levels in one cast: what does not fit is NULL where it stands, a span is copied once
    rs = objects.select(*keep, F.posexplode(F.try_variant_get(F.col(col), "$", _RESOURCE_SPANS)).alias("rs_pos", "_rs"))
    scopes = F.coalesce("_rs.scopeSpans", "_rs.instrumentationLibrarySpans")
    ss = rs.select(*keep, "rs_pos", F.posexplode(scopes).alias("ss_pos", "_ss"))
    return ss.select(*keep, "rs_pos", "ss_pos", F.posexplode("_ss.spans").alias("span_pos", "span"))


def count_spans(objects: DataFrame, col: str = "resource_spans") -> DataFrame:
    """Spans per object, counting only ``scopeSpans`` arrays."""
    def spans_in(rs: Column) -> Column:
        scopes = F.coalesce(_arr(vget(rs, "$.scopeSpans")), F.array().cast("array<variant>"))
        return F.aggregate(
            F.transform(scopes, lambda s: F.coalesce(F.size(_arr(vget(s, "$.spans"))), F.lit(0))),
            F.lit(0),
            lambda acc, x: acc + F.greatest(x, F.lit(0)),
        )

    per_rs = F.transform(F.coalesce(_arr(F.col(col)), F.array().cast("array<variant>")), spans_in)
    return objects.select(
        "object_key", F.aggregate(per_rs, F.lit(0), lambda acc, x: acc + x).cast("long").alias("span_count")
    )


# ------------------------------------------------------------------ decoding


def long_like_text(v: Column) -> Column:
    """``{low, high, unsigned}`` → signed (or unsigned) 64-bit integer text (O3)."""
    low = F.try_variant_get(v, "$.low", "long")
    high = F.try_variant_get(v, "$.high", "long")
    numbers = is_number(vget(v, "$.low")) & is_number(vget(v, "$.high"))
    lo_u = (low.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(20,0)")
    hi_u = (high.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(20,0)")
    combined = hi_u * F.lit("4294967296").cast("decimal(20,0)") + lo_u
    unsigned = F.coalesce(F.try_variant_get(v, "$.unsigned", "boolean") & is_bool(vget(v, "$.unsigned")), F.lit(False))
    negative = high.bitwiseAND(F.lit(0x80000000)) != 0
    signed = F.when(~unsigned & negative, combined - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(combined)
    return F.when(is_object(v) & numbers, signed.cast("decimal(21,0)").cast("string"))


def string_field(v: Column) -> Column:
    """Text of a string, number or long-like object (the id/time encodings)."""
    return (
        F.when(is_string(v), F.try_variant_get(v, "$", "string"))
        .when(is_number(v), F.try_variant_get(v, "$", "string"))
        .otherwise(long_like_text(v))
    )


def _longs(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<bigint>")


def _hex_bytes(values: Column) -> Column:
    """array<bigint> of byte numbers → lower-case hex; empty → NULL."""
    hexed = F.transform(values, lambda b: F.lpad(F.lower(F.hex(b.bitwiseAND(F.lit(255)))), 2, "0"))
    return F.when(F.size(values) > 0, F.array_join(hexed, ""))


def bytes_to_hex(v: Column) -> Column:
    """Byte array, ``{type: "Buffer", data}`` or ``{"0": b0, "1": b1, …}`` → hex (O2)."""
    as_map = v.try_cast("map<string,variant>")
    entries = F.map_entries(F.coalesce(as_map, F.create_map().cast("map<string,variant>")))
    numeric_keys = F.forall(entries, lambda e: e["key"].rlike(r"^(0|[1-9][0-9]*)$") & is_number(e["value"]))
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    ordered = F.transform(
        F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].try_cast("long").alias("k"), e["value"].alias("v"))), by_key),
        lambda e: F.try_variant_get(e["v"], "$", "long"),
    )
    buffer = js_string(vget(v, "$.type")) == "Buffer"
    return (
        F.when(is_array(v), _hex_bytes(_longs(v)))
        .when(is_object(v) & buffer & is_array(vget(v, "$.data")), _hex_bytes(_longs(vget(v, "$.data"))))
        .when(is_object(v) & (F.size(entries) > 0) & numeric_keys, _hex_bytes(ordered))
    )


def id_field(v: Column, text: Column) -> Column:
    """Span/trace id: non-empty text form, else hex of a byte encoding (O2).
    ``text``: the ``string_field`` of the id."""
    return F.when(text != "", text).otherwise(bytes_to_hex(v))


#: Array levels that an AnyValue expression covers; deeper input is an error, never cut.
MAX_ARRAY_LEVELS = 12


def unwrap_any_value(v: Column, levels: int = MAX_ARRAY_LEVELS) -> Column:
    """OTLP AnyValue → plain JSON value (O6): the first present of string, int,
    double, bool and bytes values; arrays element-wise; other objects as they
    are; non-objects pass through. ``intValue`` text stays text (G23)."""
    return _unwrapped(v, _parts(v), levels)


_ANY_VALUE = ["stringValue", "intValue", "doubleValue", "boolValue", "bytesValue", "arrayValue"]


def _parts(v: Column) -> Column:
    """The members of an AnyValue, read in one go; NULL for what is no object."""
    return F.try_variant_get(v, "$", f"struct<{', '.join(f'{k}: variant' for k in _ANY_VALUE)}>")


def _unwrapped(v: Column, parts: Column, levels: int) -> Column:
    first = F.coalesce(*[parts[k] for k in _ANY_VALUE[:-1]])
    av = parts["arrayValue"]
    items = F.coalesce(_arr(av), F.try_variant_get(av, "$.values", "array<variant>"))
    if levels > 0:
        read = F.transform(items, lambda x: F.struct(x.alias("v"), _parts(x).alias("p")))
        unwrapped = F.transform(read, lambda x: _unwrapped(x["v"], x["p"], levels - 1))
        arrays = F.when(items.isNotNull(), F.to_variant_object(unwrapped))
    else:
        arrays = F.when(items.isNotNull(), F.raise_error(F.lit(f"attribute arrays nested more than {MAX_ARRAY_LEVELS} deep")).cast("string").cast("variant"))
    # (what is no object has no parts)
    return F.coalesce(first, arrays, v)


#: An attribute list as the cast of a span reads it: NULL for what is no object.
_ATTRIBUTES = "array<struct<key: variant, value: variant>>"


def attributes_record(attributes: Column) -> Column:
    """Attribute list (read as ``_ATTRIBUTES``) → ``map<string,variant>``; non-string
    keys skipped, the last duplicate key wins (session policy LAST_WIN) (O5)."""
    attrs = F.coalesce(attributes, F.array().cast(_ATTRIBUTES))
    usable = F.filter(attrs, lambda a: is_string(a["key"]))
    read = F.transform(
        usable, lambda a: F.struct(F.try_variant_get(a["key"], "$", "string").alias("k"), a["value"].alias("v"), _parts(a["value"]).alias("p"))
    )
    return F.map_from_entries(F.transform(read, lambda a: F.struct(a["k"].alias("k"), _unwrapped(a["v"], a["p"], MAX_ARRAY_LEVELS).alias("v"))))


# ------------------------------------------------------------- span → events


SPAN_FIELDS = ["traceId", "spanId", "parentSpanId", "startTimeUnixNano", "endTimeUnixNano", "name"]


@per_context
def _span_parts() -> list[Column]:
    """A span's members, read in one go."""
    members = ", ".join(f"{k}: variant" for k in SPAN_FIELDS)
    return [F.try_variant_get("span", "$", f"struct<{members}, attributes: {_ATTRIBUTES}>").alias("_s")]


@per_context
def _span_texts() -> list[Column]:
    return [string_field(F.col(f"_s.{k}")).alias(f"_t_{k}") for k in SPAN_FIELDS]


@per_context
def _span_columns() -> list[Column]:
    part, text = lambda k: F.col(f"_s.{k}"), lambda k: F.col(f"_t_{k}")
    return [
        id_field(part("traceId"), text("traceId")).alias("trace_id_raw"),
        id_field(part("spanId"), text("spanId")).alias("span_id_raw"),
        id_field(part("parentSpanId"), text("parentSpanId")).alias("parent_span_id"),
        nanos_to_timestamp(text("startTimeUnixNano")).alias("start_raw"),
        nanos_to_timestamp(text("endTimeUnixNano")).alias("end_time"),
        # (a long-like object is no name)
        F.coalesce(F.when(~is_object(part("name")), text("name")), F.lit(DEFAULT_SPAN_NAME)).alias("span_name"),
        attributes_record(part("attributes")).alias("attributes"),
    ]


def decode_spans(spans: DataFrame, fallback_time: Column | None = None) -> DataFrame:
    """Decode ids, times, name and attributes of flattened spans.

    Missing ids become deterministic hashes of the span position and a missing
    start time falls back to ``fallback_time`` (the object's modification time),
    so replaying an object yields identical events (G10).
    """
    keep = spans.columns
    out = spans.select("*", *_span_parts()).select("*", *_span_texts()).select(*keep, *_span_columns())
    pos = F.concat_ws(":", F.col("object_key"), F.col("rs_pos"), F.col("ss_pos"), F.col("span_pos"))
    fb = fallback_time if fallback_time is not None else F.current_timestamp()
    return out.select(
        "*",
        F.coalesce(F.col("trace_id_raw"), F.sha2(F.concat(pos, F.lit(":trace-id")), 256).substr(1, 32)).alias("trace_id"),
        F.coalesce(F.col("span_id_raw"), F.sha2(F.concat(pos, F.lit(":span-id")), 256).substr(1, 16)).alias("span_id"),
        F.coalesce(F.col("start_raw"), F.date_trunc("millisecond", fb)).alias("start_time"),
    ).drop("trace_id_raw", "span_id_raw", "start_raw")


def _bool_value(v: Column) -> Column:
    """booleanValue: booleans, and the texts "true"/"false"."""
    t = F.try_variant_get(v, "$", "string")
    return (
        F.when(is_bool(v), F.try_variant_get(v, "$", "boolean"))
        .when(is_string(v) & (t == "true"), F.lit(True))
        .when(is_string(v) & (t == "false"), F.lit(False))
    )


def is_root_span(parent_span_id: Column, attributes: Column) -> Column:
    """No parent, or flagged as (app) root."""
    a = lambda k: F.try_element_at(attributes, F.lit(k))
    return (
        parent_span_id.isNull()
        | F.coalesce(_bool_value(a("langfuse.internal.as_root")), F.lit(False))
        | F.coalesce(_bool_value(a("langfuse.internal.is_app_root")), F.lit(False))
    )


def meaningful(v: Column) -> Column:
    """hasMeaningfulValue of the shallow-trace rule: defined and, for text,
    arrays and objects, non-empty (``false`` and 0 count)."""
    return is_defined(v) & (
        F.when(is_string(v), F.length(F.try_variant_get(v, "$", "string")) > 0)
        .when(is_array(v), F.size(_arr(v)) > 0)
        .when(is_object(v), F.size(v.try_cast("map<string,variant>")) > 0)
        .otherwise(F.lit(True))
    )


def _entries(pairs: list[tuple[str, Column]]) -> Column:
    """Object with the given keys; SQL NULL values are left out (undefined)."""
    args = []
    for k, v in pairs:
        args += [F.lit(k), v]
    return F.to_variant_object(F.map_filter(F.create_map(*args), lambda k, v: v.isNotNull()))


def _sv(c: Column) -> Column:
    return c.cast("variant")


@per_context
def _mapping() -> tuple[list[Column], list[Column], list[str]]:
    """(staging columns, mapped columns, staging column names)."""
    m = conv.map_attributes(F.col("attributes"), staged=True)
    stage = conv.stage_columns(F.col("attributes"), m["keys"])
    names = [conv.staged_name(k, kind) for k in sorted(m["keys"]) for kind in conv.STAGE_KINDS]
    derived = [expr.alias(name) for name, expr in m["derived"].items()]
    return stage, derived, _mapped_columns(m), names + list(m["derived"])


def _mapped_columns(m: dict) -> list[Column]:
    obs, root, upd = m["observation"], m["root"], m["update"]
    out = [
        m["type"].alias("observation_type"),
        m["has_update"].alias("has_update"),
    ]
    for prefix, fields in (("o_", obs), ("r_", root), ("u_", upd)):
        for k, (present, value) in fields.items():
            out.append(present.alias(f"{prefix}{k}_p"))
            out.append(value.alias(f"{prefix}{k}"))
    return out


def map_spans(decoded: DataFrame) -> DataFrame:
    """Apply the attribute conventions (type + field bundles) to decoded spans.

    Two projections: every attribute the conventions read is looked up once,
    then the bundles are computed from those columns."""
    stage, derived, mapped, names = _mapping()
    return decoded.select("*", *stage).select("*", *derived).select("*", *mapped).drop(*names)


def _f(prefix: str, k: str) -> Column:
    """Value of a merged field when present (present-but-undefined → NULL)."""
    return F.when(F.col(f"{prefix}{k}_p"), F.col(f"{prefix}{k}"))


@per_context
def _observation_event_columns() -> list[Column]:
    iso = iso_ms(F.col("start_time"))
    attrs_obj = F.to_variant_object(F.col("attributes"))
    body = _entries(
        [
            ("id", _sv(F.col("span_id"))),
            ("traceId", _sv(F.col("trace_id"))),
            ("parentObservationId", _sv(F.col("parent_span_id"))),
            ("name", _sv(F.col("span_name"))),
            ("startTime", _sv(iso)),
            ("endTime", _sv(iso_ms(F.col("end_time")))),
            ("metadata", attrs_obj),
        ]
        + [(k, _f("o_", k)) for k in conv.OBSERVATION_FIELDS if k != "environment"]
        + [("environment", F.coalesce(_f("o_", "environment"), _sv(F.lit(DEFAULT_ENVIRONMENT))))]
    )
    pos = F.concat_ws(":", F.col("object_key"), F.col("rs_pos"), F.col("ss_pos"), F.col("span_pos"))
    return [
        F.sha2(F.concat(pos, F.lit(":observation")), 256).alias("id"),
        iso.alias("timestamp"),
        F.col("observation_type").alias("type"),
        F.lit(OTEL_EVENT_METADATA).alias("metadata"),
        F.to_json(body).alias("body"),
    ]


def observation_events(mapped: DataFrame) -> DataFrame:
    """One observation event per span."""
    keep = [c for c in ("object_key", "rs_pos", "ss_pos", "span_pos", "span_id", "trace_id") if c in mapped.columns]
    return mapped.select(*keep, *_observation_event_columns())


TRACE_BODY_FIELDS = ["name", "userId", "sessionId", "metadata", "input", "output", "tags", "public", "version"]
SHALLOW_FIELDS = ["name", "externalId", "input", "output", "sessionId", "userId", "metadata", "release", "version", "public", "tags"]


@per_context
def _trace_event_columns() -> list[Column]:
    iso = iso_ms(F.col("start_time"))
    root = F.col("is_root")
    upd = F.col("has_update") & ~root
    attrs_obj = F.to_variant_object(F.col("attributes"))

    def field(k: str) -> Column:
        if k == "name":
            r = F.coalesce(_f("r_", "name"), _sv(F.col("span_name")))
        elif k == "metadata":
            r = F.coalesce(_f("r_", "metadata"), attrs_obj)
        else:
            r = _f("r_", k)
        return F.when(root, r).when(upd, _f("u_", k))

    body_pairs = [
        ("id", _sv(F.col("trace_id"))),
        ("timestamp", _sv(iso)),
        ("environment", F.coalesce(_f("r_", "environment"), _sv(F.lit(DEFAULT_ENVIRONMENT)))),
        ("startTime", F.when(root | upd, _sv(iso))),
    ] + [(k, field(k)) for k in TRACE_BODY_FIELDS]
    full = F.lit(False)
    for k, v in body_pairs:
        if k in SHALLOW_FIELDS:
            full = full | F.coalesce(meaningful(v), F.lit(False))
    pos = F.concat_ws(":", F.col("object_key"), F.col("rs_pos"), F.col("ss_pos"), F.col("span_pos"))
    return [
        F.sha2(F.concat(pos, F.lit(":trace")), 256).alias("id"),
        iso.alias("timestamp"),
        F.lit("trace-create").alias("type"),
        F.lit(OTEL_EVENT_METADATA).alias("metadata"),
        F.to_json(_entries(body_pairs)).alias("body"),
        full.alias("is_full"),
        F.when(root, "root").when(upd, "update").otherwise("first").alias("trace_event_kind"),
    ]


def trace_events(mapped: DataFrame) -> DataFrame:
    """Trace events (O26–O29): emitted for root spans, spans with trace updates
    and the first span of each trace in an object; shallow events are dropped
    when the same object holds a full event for the trace."""
    w = Window.partitionBy("object_key", "trace_id").orderBy("rs_pos", "ss_pos", "span_pos")
    with_root = mapped.select(
        "*",
        is_root_span(F.col("parent_span_id"), F.col("attributes")).alias("is_root"),
        (F.row_number().over(w) == 1).alias("_first"),
    )
    emitted = with_root.where(F.col("is_root") | F.col("has_update") | F.col("_first"))
    ev = emitted.select("object_key", "rs_pos", "ss_pos", "span_pos", "span_id", "trace_id", "is_root", *_trace_event_columns())
    any_full = F.max(F.col("is_full").cast("int")).over(Window.partitionBy("object_key", "trace_id")) == 1
    return ev.select("*", any_full.alias("_any_full")).where(F.col("is_full") | ~F.col("_any_full")).drop("_any_full")


SPAN_EVENTS = "object_key string, id string, timestamp string, type string, metadata string, body string"


def _emit_events(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of spans that come object by object, in order.

    A trace event goes out for root spans, spans with trace updates and the first span
    of each trace in an object, but a shallow one only if the object has no full one
    for the trace. An object's rows may go on in the next batch, so the last object of
    a batch waits for it.
    """
    names = [x.split()[0] for x in SPAN_EVENTS.split(", ")]
    trace = [f"t_{n}" if n != "object_key" else n for n in names]

    def events(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        numbers = [rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("object_key", "trace_id")]
        _, of = np.unique(numbers[0].astype(np.int64) * (len(rows) + 1) + numbers[1], return_inverse=True)
        first = np.zeros(len(rows), bool)
        first[np.unique(of, return_index=True)[1]] = True
        emitted = first | rows.column("_emit").to_numpy()
        full = emitted & rows.column("is_full").to_numpy()
        some_full = np.bincount(of, full) > 0
        emitted &= full | ~some_full[of]
        yield from rows.select(names).to_batches()
        yield from rows.select(trace).filter(pa.array(emitted)).rename_columns(names).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column("object_key").to_pandas()
        last = len(batch) - int((keys[::-1] == keys.iloc[-1]).cumprod().sum())
        if last or (held and held[-1].column("object_key")[-1] != batch.column("object_key")[0]):
            yield from events(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from events(pa.Table.from_batches(held))


def otlp_events(objects: DataFrame, col: str = "resource_spans", fallback_time: Column | None = None) -> DataFrame:
    """Objects of resource spans → envelope rows (object_key, id, timestamp,
    type, metadata, body) of observation and trace events.

    Spans are decoded and mapped once, each row holds both of its events, and as an
    object's spans stay together in order, one pass over them settles which trace
    events go out: no window and no shuffle. An object that comes twice gives the same
    events twice (same ids)."""
    mapped = map_spans(decode_spans(flatten_spans(objects, col), fallback_time))
    mapped = mapped.select("*", is_root_span(F.col("parent_span_id"), F.col("attributes")).alias("is_root"), F.lit(False).alias("_first"))
    both = mapped.select(
        F.coalesce("object_key", F.lit("")).alias("object_key"), "trace_id", (F.col("is_root") | F.col("has_update")).alias("_emit"),
        F.struct(*_observation_event_columns()).alias("o"), F.struct(*_trace_event_columns()).alias("t"),
    )
    fields = ["id", "timestamp", "type", "metadata", "body"]
    rows = both.select("object_key", "trace_id", "_emit", "t.is_full", *(f"o.{f}" for f in fields), *(F.col(f"t.{f}").alias(f"t_{f}") for f in fields))
    return rows.mapInArrow(_emit_events, SPAN_EVENTS)
