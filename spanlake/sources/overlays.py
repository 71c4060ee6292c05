"""Deterministic overlays that turn the driver's tables into telemetry inputs.

The same formulas are written as DuckDB SQL in ``__spark_entry__.oracle_sql``.
Each overlay reads its table once; the rows derived from one input row are built
as an array and exploded, so no overlay needs a union or a second scan.

F1  ``events``        → ingestion events (observations, traces, faults, duplicates)
F2  ``conversations`` → conversation traces (turn timelines, parent ids, usage)
F3  ``documents`` + ``labels`` → traces and scores
F4  ``events``        → OTLP-style spans with attribute maps (four conventions)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.cache import per_context
from spanlake.functions.time import iso_ms
from spanlake.sources.tables import spread, table

PROJECT = "demo"

# Fixed overlay parameters (shared with the oracle SQL).
F1_OBS_DIV = 3
F1_TRACE_DIV = 12
F1_TRACE_EVERY = 4
F1_TRACE_UNNAMED = (8, 4)
F1_DUP_EVERY = 10
F1_BAD_TS_EVERY = 37
F1_BAD_TYPE_EVERY = 41
F1_BAD_ID_EVERY = 43
F1_BATCH_DIV = 100
F1_TYPE_BY_EVENT = {
    "click": "span-create",
    "view": "event-create",
    "purchase": "generation-create",
    "signup": "tool-create",
    "error": "generation-update",
}
F1_BAD_TIMESTAMP = "not-a-timestamp"
F1_BAD_TYPE = "unknown-create"
# Second batch of the incremental scenario: everything at or after this instant.
F1_SECOND_BATCH_FROM = "2024-01-25 00:00:00"


def _map_lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key)


def _pad(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 12, "0"))


def f1_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the overlay's derived columns (one row per source row)."""
    ev = spread(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props"))
    eid = F.col("event_id")
    return ev.select(
        eid.alias("eid"),
        F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
    )


def f1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one VARIANT ingestion event per row, with faults and duplicates.

    Columns: eid (source row), batch, copy (0 or 1), kind, event (VARIANT).
    """
    src = f1_source(spark, sf_dir)
    rows = src.select(*_f1_columns())
    event = F.when(F.col("x.kind") == "trace", F.col("trace_event")).otherwise(F.col("obs_event"))
    return rows.select("eid", "batch", "ts", "obs_event", "trace_event", F.explode("items").alias("x")).select(
        "eid", "batch", "ts", "x.kind", "x.copy", event.alias("event")
    )


@per_context
def _f1_columns() -> list[Column]:
    eid = F.col("eid")
    is_err = F.col("event_type") == "error"
    iso = iso_ms(F.col("ts"))
    ts_text = F.when(eid % F1_BAD_TS_EVERY == 0, F.lit(F1_BAD_TIMESTAMP)).otherwise(iso)

    def ev_id(prefix: str) -> Column:
        base = _pad(prefix, eid)
        return F.when(eid % F1_BAD_ID_EVERY == 0, F.concat(base, F.lit("\r"))).otherwise(base)

    def ev_type(t: Column) -> Column:
        return F.when(eid % F1_BAD_TYPE_EVERY == 0, F.lit(F1_BAD_TYPE)).otherwise(t)

    props = F.parse_json(F.col("props"))
    # metadata = props plus {<event_type>: user_id}; merging several events of an
    # entity therefore unions keys and keeps the latest "k".
    metadata = F.to_variant_object(
        F.map_concat(
            props.cast("map<string,variant>"),
            F.create_map(F.col("event_type"), F.col("user_id").cast("variant")),
        )
    )
    trace_key = F.concat(F.lit("t"), (eid.cast("long") / F1_TRACE_DIV).cast("long").cast("string"))
    obs_key = F.concat(F.lit("o"), (eid.cast("long") / F1_OBS_DIV).cast("long").cast("string"))
    obs_body = F.to_variant_object(
        F.struct(
            obs_key.alias("id"),
            F.when(~is_err, trace_key).alias("traceId"),
            F.when(~is_err, F.col("event_type")).alias("name"),
            F.when(F.col("event_type").isin("purchase", "view"), F.struct(F.col("value").alias("total"))).alias(
                "costDetails"
            ),
            metadata.alias("metadata"),
            F.when(is_err, props).alias("output"),
        )
    )
    obs_event = F.to_variant_object(
        F.struct(
            ev_id("e").alias("id"),
            ts_text.alias("timestamp"),
            ev_type(_map_lookup(F1_TYPE_BY_EVENT, F.col("event_type"))).alias("type"),
            obs_body.alias("body"),
        )
    )
    trace_body = F.to_variant_object(
        F.struct(
            trace_key.alias("id"),
            iso.alias("timestamp"),
            F.when(eid % F1_TRACE_UNNAMED[0] != F1_TRACE_UNNAMED[1], F.col("event_type")).alias("name"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("userId"),
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sessionId"),
            props.alias("metadata"),
        )
    )
    trace_event = F.to_variant_object(
        F.struct(
            ev_id("c").alias("id"),
            ts_text.alias("timestamp"),
            ev_type(F.lit("trace-create")).alias("type"),
            trace_body.alias("body"),
        )
    )
    has_trace = eid % F1_TRACE_EVERY == 0
    dup = eid % F1_DUP_EVERY == 0

    def item(kind: str, copy: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(copy).alias("copy"))

    # (the events stay outside the filtered array, which would interpret them)
    items = F.filter(
        F.array(
            item("observation", 0),
            F.when(has_trace, item("trace", 0)),
            F.when(dup, item("observation", 1)),
            F.when(dup & has_trace, item("trace", 1)),
        ),
        lambda x: x.isNotNull(),
    )
    batch = (eid.cast("long") / F1_BATCH_DIV).cast("long").alias("batch")
    return [eid, batch, F.col("ts"), obs_event.alias("obs_event"), F.when(has_trace, trace_event).alias("trace_event"), items.alias("items")]


# ---------------------------------------------------------------------- F3

F3_BASE = "2024-01-01 00:00:00"
F3_RECHECK_EVERY = 5
F3_META_SOURCE_EVERY = 3
F3_NUMERIC_GRADE_EVERY = 7


def _seconds_after_base(n: Column, extra_seconds: int = 0) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(F3_BASE)) + n + F.lit(extra_seconds))


def f3_trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 traces: one trace-create per document (direct writes, no validation)."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars"))
    return docs.select(*_f3_trace_columns())


@per_context
def _f3_trace_columns() -> list[Column]:
    d = F.col("doc_id")
    ts = iso_ms(_seconds_after_base(d))
    body = F.to_json(
        F.struct(
            F.concat(F.lit("d"), d.cast("string")).alias("id"),
            ts.alias("timestamp"),
            F.col("source").alias("name"),
            F.col("lang").alias("sessionId"),
            F.struct(F.col("n_chars").alias("n_chars")).alias("input"),
            F.struct(((F.col("n_chars") % 10) / 10.0).alias("compliance_score")).alias("output"),
        )
    )
    return [
        _pad("dt", d).alias("id"),
        ts.alias("timestamp"),
        F.lit("trace-create").alias("type"),
        body.alias("body"),
    ]


def f3_score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 scores from labels: quality (number, EVAL), toxic (boolean, source
    missing or given in metadata), grade (text, or numeric text declared
    NUMERIC); every fifth document gets a later comment-only update."""
    labels = spread(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return labels.select(F.explode(F.filter(F.array(*_f3_score_items()), lambda x: x.isNotNull())).alias("e")).select(
        "e.*"
    )


@per_context
def _f3_score_items() -> list[Column]:
    d = F.col("doc_id")
    trace = F.concat(F.lit("d"), d.cast("string"))
    ts = iso_ms(_seconds_after_base(d))
    later = iso_ms(_seconds_after_base(d, 3600))
    recheck = d % F3_RECHECK_EVERY == 0

    def ev(prefix: str, when_ts: Column, body: Column, cond: Column | None = None) -> Column:
        s = F.struct(
            _pad(prefix, d).alias("id"), when_ts.alias("timestamp"), F.lit("score-create").alias("type"), F.to_json(body).alias("body")
        )
        return s if cond is None else F.when(cond, s)

    grade_numeric = d % F3_NUMERIC_GRADE_EVERY == 0
    grade = F.when(grade_numeric, F.col("quality").cast("string")).otherwise(
        F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit("bad"))
    )
    toxic_md = F.when(
        d % F3_META_SOURCE_EVERY == 0, F.to_variant_object(F.struct(F.lit("ANNOTATION").alias("source")))
    ).otherwise(F.to_variant_object(F.struct(F.concat(F.lit("r"), (d % 4).cast("string")).alias("reviewer"))))
    return [
        ev("eq", ts, F.struct(F.concat(F.lit("q"), d.cast("string")).alias("id"), trace.alias("traceId"),
                              F.lit("quality").alias("name"), F.col("quality").alias("value"), F.lit("EVAL").alias("source"))),
        ev("ex", ts, F.struct(F.concat(F.lit("x"), d.cast("string")).alias("id"), trace.alias("traceId"),
                              F.lit("toxic").alias("name"), (F.col("toxic") == 1).alias("value"), toxic_md.alias("metadata"))),
        ev("eg", ts, F.struct(F.concat(F.lit("g"), d.cast("string")).alias("id"), trace.alias("traceId"),
                              F.lit("grade").alias("name"), grade.alias("value"),
                              F.when(grade_numeric, F.lit("NUMERIC")).alias("dataType"))),
        ev("fq", later, F.struct(F.concat(F.lit("q"), d.cast("string")).alias("id"), F.lit("rechecked").alias("comment")), recheck),
        ev("fx", later, F.struct(F.concat(F.lit("x"), d.cast("string")).alias("id"), F.lit("rechecked").alias("comment")), recheck),
    ]


# ---------------------------------------------------------------------- F4

F4_SPANS_PER_OBJECT = 8
F4_SPANS_PER_TRACE = 12
F4_BYTES_ID_EVERY = 5
F4_LONG_TIME_EVERY = 7
F4_LEGACY_SCOPE_EVERY = 3
# Fixed values of the overlay: the attribute value each convention carries per
# source event_type (some deliberately unmapped or in another letter case).
F4_LANGFUSE = {"click": "GENERATION", "view": "agent", "purchase": "Tool", "signup": "retriever", "error": "unknown"}
F4_OPENINFERENCE = {"click": "llm", "view": "CHAIN", "purchase": "Tool", "signup": "EMBEDDING", "error": "RERANKER"}
F4_GENAI = {"click": "chat", "view": "embeddings", "purchase": "execute_tool", "signup": "invoke_agent", "error": "Chat"}
F4_VERCEL = {
    "click": "ai.generateText.doGenerate",
    "view": "ai.embed.doEmbed",
    "purchase": "ai.toolCall",
    "signup": "ai.streamText.doStream",
    "error": "ai.other",
}


def _hex_id(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n.cast("long"))), width, "0")


def _any(kind: str, v: Column) -> Column:
    return F.to_variant_object(F.struct(v.alias(kind)))


def _attr(key: str, value: Column, cond: Column) -> Column:
    """An array with the attribute, if it is there."""
    a = F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))
    return F.when(cond, a).otherwise(F.array().cast("array<struct<key: string, value: variant>>"))


def f4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTLP/JSON export objects built from ``events``.

    Eight consecutive rows form one stored object, twelve one trace (the first
    of each twelve is the root). Columns: object_key, resource_spans (VARIANT).
    """
    src = f1_source(spark, sf_dir)
    spans = src.select(*_f4_span_columns())
    by_eid = lambda a, b: F.when(a["eid"] < b["eid"], -1).when(a["eid"] > b["eid"], 1).otherwise(0)
    objects = spans.groupBy("obj").agg(F.array_sort(F.collect_list(F.struct("eid", "span")), by_eid).alias("spans"))
    return objects.select(*_f4_object_columns())


@per_context
def _f4_object_columns() -> list[Column]:
    scope = F.struct(F.struct(F.lit("overlay").alias("name")).alias("scope"), F.col("spans.span").alias("spans"))
    legacy = F.col("obj") % F4_LEGACY_SCOPE_EVERY == 0
    resource = F.struct(F.lit("f4").alias("service")).alias("resource")

    def object_of(scopes: str) -> Column:
        # (made a VARIANT at once: every VARIANT within one is copied once more)
        return F.to_variant_object(F.array(F.struct(resource, F.array(scope).alias(scopes))))

    return [
        F.concat(F.lit(f"{PROJECT}/otel/"), F.lpad(F.col("obj").cast("string"), 8, "0"), F.lit(".json")).alias("object_key"),
        F.when(legacy, object_of("instrumentationLibrarySpans")).otherwise(object_of("scopeSpans")).alias("resource_spans"),
    ]


@per_context
def _f4_span_columns() -> list[Column]:
    eid = F.col("eid")
    et = F.col("event_type")
    uid = F.col("user_id")
    conv = eid % 6
    ns = F.unix_micros(F.col("ts")) * 1000
    span_bytes = F.to_variant_object(F.array(*[F.shiftright(eid, 8 * (7 - i)).bitwiseAND(F.lit(255)) for i in range(8)]))
    span_id = F.when(eid % F4_BYTES_ID_EVERY == 0, span_bytes).otherwise(_hex_id(eid, 16).cast("variant"))
    root = eid % F4_SPANS_PER_TRACE == 0
    parent = F.when(~root, _hex_id(eid - eid % F4_SPANS_PER_TRACE, 16))
    long_time = F.to_variant_object(
        F.struct(ns.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftright(ns, 32).alias("high"))
    )
    start = F.when(eid % F4_LONG_TIME_EVERY == 0, long_time).otherwise(ns.cast("string").cast("variant"))
    s = lambda v: _any("stringValue", v)
    lf = _map_lookup(F4_LANGFUSE, et)
    ga = _map_lookup(F4_GENAI, et)
    # (not a filtered array, which would interpret all of them)
    attrs = F.concat(
        _attr("langfuse.observation.type", s(lf), conv.isin(0, 4)),
        _attr("openinference.span.kind", s(_map_lookup(F4_OPENINFERENCE, et)), conv == 1),
        _attr("gen_ai.operation.name", s(ga), conv.isin(2, 4)),
        _attr("gen_ai.usage.input_tokens", _any("intValue", uid.cast("string")), conv == 2),
        _attr("gen_ai.usage.output_tokens", _any("intValue", F.get_json_object("props", "$.k").cast("long")), conv.isin(2, 4)),
        _attr("gen_ai.request.model", s(F.concat(F.lit("req-"), (eid % 3).cast("string"))), conv.isin(2, 4)),
        _attr("gen_ai.response.model", s(F.concat(F.lit("resp-"), (eid % 5).cast("string"))), (conv == 2) & (eid % 2 == 0)),
        _attr("gen_ai.agent.name", s(F.concat(F.lit("agent-"), uid.cast("string"))), (conv == 2) & (et == "signup")),
        _attr("operation.name", s(_map_lookup(F4_VERCEL, et)), conv == 3),
        _attr("ai.model.id", s(F.concat(F.lit("m-"), uid.cast("string"))), (conv == 3) & (uid % 2 == 0)),
        _attr(
            "langfuse.observation.model.name",
            F.to_variant_object(F.struct(F.to_variant_object(F.struct(F.array(s(F.lit("x"))).alias("values"))).alias("arrayValue"))),
            conv == 4,
        ),
        _attr("user.id", s(F.concat(F.lit("u"), uid.cast("string"))), eid % 4 == 0),
        _attr("ai.telemetry.metadata.userId", s(F.concat(F.lit("u"), uid.cast("string"))), eid % 4 == 1),
        _attr("session.id", s(F.concat(F.lit("s"), uid.cast("string"))), eid % 4 == 2),
        _attr("langfuse.trace.tags", s(F.concat(F.lit("t"), (uid % 3).cast("string"), F.lit(", x"))), eid % 3 == 0),
        _attr("tag.tags", s(F.lit('["p","q"]')), eid % 9 == 1),
        _attr("dup.key", s(F.lit("first")), eid % 10 == 3),
        _attr("dup.key", s(F.lit("second")), eid % 10 == 3),
    )
    span = F.to_variant_object(
        F.struct(
            _hex_id((eid / F4_SPANS_PER_TRACE).cast("long"), 32).alias("traceId"),
            span_id.alias("spanId"),
            parent.alias("parentSpanId"),
            F.concat(F.lit("span-"), et).alias("name"),
            start.alias("startTimeUnixNano"),
            (ns + 1_000_000_000).cast("string").alias("endTimeUnixNano"),
            attrs.alias("attributes"),
        )
    )
    return [eid, (eid / F4_SPANS_PER_OBJECT).cast("long").alias("obj"), span.alias("span")]


# ---------------------------------------------------------------------- F2

F2_BASE = "2024-01-01 00:00:00"
# Fixed overlay values: raw environment names by turn mod 4 (the last: absent).
F2_ENVIRONMENTS = ["Langfuse-Prod", "staging", "Bad Env!"]
F2_TRACE_ENVIRONMENT = "LANGFUSE_dev"
F2_TYPE_BY_ROLE = {"assistant": "generation-create", "user": "event-create", "system": "span-create"}


def f2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation turns as VARIANT ingestion events (validated path).

    One observation per turn (parent = previous turn) and one trace per
    conversation; assistant turns carry model, usage in the legacy or current
    shape, and usage/cost details with entries the cleaning must drop.
    """
    conv = spread(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conv.select(F.explode(F.filter(F.array(*_f2_items()), lambda x: x.isNotNull())).alias("x")).select(
        "x.conv_id", "x.turn", "x.event"
    )


@per_context
def _f2_items() -> list[Column]:
    c, t = F.col("conv_id"), F.col("turn")
    n = F.length(F.col("text"))
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(F2_BASE)) + c * 60 + t)
    iso = iso_ms(ts)
    trace = F.concat(F.lit("c"), c.cast("string"))
    obs_id = F.concat(trace, F.lit("-"), t.cast("string"))
    parent = F.when(t > 0, F.concat(trace, F.lit("-"), (t - 1).cast("string")))
    env = F.try_element_at(F.array(*[F.lit(e) for e in F2_ENVIRONMENTS]), (t % 4 + 1).cast("int"))
    assistant = F.col("role") == "assistant"
    legacy_usage = F.to_variant_object(
        F.struct(
            (n / 2).cast("long").alias("promptTokens"),
            n.cast("long").alias("completionTokens"),
            ((n / 2).cast("long") + n).alias("totalTokens"),
        )
    )
    usage = F.when(t % 3 == 0, legacy_usage).when(
        t % 3 == 1,
        F.to_variant_object(F.struct((n / 2).cast("long").alias("input"), n.cast("long").alias("output"), F.lit("CHARACTERS").alias("unit"))),
    )
    usage_details = F.to_variant_object(
        F.struct(
            (c % 50).alias("input"), n.cast("string").alias("output"), n.cast("long").alias("total"),
            F.lit(-1).alias("bad"), F.lit("abc").alias("note"),
        )
    )
    cost_details = F.to_variant_object(
        F.struct((n * 0.001).alias("total"), F.lit(-0.5).alias("neg"), F.lit("5").alias("txt"))
    )
    body = F.to_variant_object(
        F.struct(
            obs_id.alias("id"),
            trace.alias("traceId"),
            parent.alias("parentObservationId"),
            F.col("role").alias("name"),
            iso.alias("startTime"),
            F.when(F.col("role") == "system", iso_ms(ts + F.expr("INTERVAL 1 SECOND"))).alias("endTime"),
            F.col("text").alias("output"),
            env.alias("environment"),
            F.when(assistant, F.concat(F.lit("model-"), (c % 3).cast("string"))).alias("model"),
            F.when(assistant, usage).alias("usage"),
            F.when(assistant, usage_details).alias("usageDetails"),
            F.when(assistant, cost_details).alias("costDetails"),
        )
    )
    # to_variant_object keeps NULL struct fields as JSON null; drop them so an
    # absent field stays absent.
    body = F.to_variant_object(F.map_filter(body.cast("map<string,variant>"), lambda k, v: ~F.is_variant_null(v)))
    obs_event = F.to_variant_object(
        F.struct(
            F.concat(F.lit("v"), F.lpad(c.cast("string"), 8, "0"), F.lpad(t.cast("string"), 4, "0")).alias("id"),
            iso.alias("timestamp"),
            _map_lookup(F2_TYPE_BY_ROLE, F.col("role")).alias("type"),
            body.alias("body"),
        )
    )
    trace_event = F.to_variant_object(
        F.struct(
            F.concat(F.lit("w"), F.lpad(c.cast("string"), 8, "0")).alias("id"),
            iso.alias("timestamp"),
            F.lit("trace-create").alias("type"),
            F.to_variant_object(
                F.struct(
                    trace.alias("id"), iso.alias("timestamp"), F.lit("conversation").alias("name"),
                    F.concat(F.lit("cs"), (c % 20).cast("string")).alias("sessionId"),
                    F.concat(F.lit("cu"), (c % 30).cast("string")).alias("userId"),
                    F.lit(F2_TRACE_ENVIRONMENT).alias("environment"),
                )
            ).alias("body"),
        )
    )
    item = lambda e: F.struct(c.alias("conv_id"), t.alias("turn"), e.alias("event"))
    return [item(obs_event), F.when(t == 0, item(trace_event))]
