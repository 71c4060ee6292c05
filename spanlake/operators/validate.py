"""Validation and cleaning of ingestion events (accept/reject split).

Every element of a batch is checked on its own; problems are collected in an
``errors array<string>`` column so that a bad element never fails the batch.
Accepted bodies are cleaned (environment, legacy usage, usage and cost details,
score source) and re-serialised. Everything is column expressions over VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.json import (
    is_array,
    is_bool,
    is_defined,
    is_number,
    is_object,
    is_string,
    vget,
)
from spanlake.functions.cache import per_context
from spanlake.functions.time import strict_iso_ok
from spanlake.schema import EVENT_TYPES, SCORE_CREATE, TRACE_CREATE

# Fixed values of the event model.
LEVELS = ["DEBUG", "DEFAULT", "WARNING", "ERROR"]
SCORE_DATA_TYPES = ["NUMERIC", "CATEGORICAL", "BOOLEAN", "CORRECTION", "TEXT"]
SCORE_SOURCES = ["API", "EVAL", "ANNOTATION"]
LEGACY_OBSERVATION_TYPES = ["GENERATION", "SPAN", "EVENT"]
USAGE_UNITS = ["CHARACTERS", "TOKENS", "SECONDS", "MILLISECONDS", "IMAGES", "REQUESTS"]
USAGE_KEYS = ["input", "output", "total", "unit", "inputCost", "outputCost", "totalCost"]
LEGACY_USAGE_KEYS = ["promptTokens", "completionTokens", "totalTokens"]
ID_MAX_LENGTH = 800
TRACE_NAME_MAX_LENGTH = 1000
ENVIRONMENT_MAX_LENGTH = 40
DEFAULT_ENVIRONMENT = "default"
REJECT_STATUS = 400
ACCEPT_STATUS = 201
REJECT_MESSAGE = "Invalid request data"

OBSERVATION_TYPES = [t for t in EVENT_TYPES if t not in (TRACE_CREATE, SCORE_CREATE)]
SPAN_LIKE = ["span-create", "span-update"]
GENERATION_LIKE = [
    "generation-create",
    "generation-update",
    "agent-create",
    "tool-create",
    "chain-create",
    "retriever-create",
    "embedding-create",
    "guardrail-create",
    "observation-create",
    "observation-update",
]
LEGACY_TYPES = ["observation-create", "observation-update"]


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_int(v: Column) -> Column:
    d = F.try_variant_get(v, "$", "double")
    return is_number(v) & (d == F.floor(d))


# Body keys each check reads. Scalars get a type tag (``schema_of_variant`` of a
# small value) and their text; object-like keys only an "is object" flag. The
# tags are computed once per row in their own projection, so the checks below
# are plain comparisons instead of repeated VARIANT walks.
SCALAR_KEYS = [
    "id", "traceId", "parentObservationId", "observationId", "timestamp", "name",
    "externalId", "sessionId", "userId", "release", "version", "public",
    "startTime", "endTime", "completionStartTime", "level", "statusMessage",
    "model", "promptName", "promptVersion", "type", "value", "dataType", "source",
    "comment", "configId", "queueId", "authorUserId", "createdAt",
]
OBJECT_KEYS = ["metadata", "modelParameters", "usage", "usageDetails", "costDetails"]
_NUM = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


class _Tags:
    """Accessors over the staged tag columns of one row."""

    def tag(self, k: str) -> Column:
        return F.col(f"_t_{k}")

    def text(self, k: str) -> Column:
        return F.col(f"_s_{k}")

    def defined(self, k: str) -> Column:
        return self.tag(k).isNotNull() & (self.tag(k) != "VOID")

    def is_str(self, k: str) -> Column:
        return F.coalesce(self.tag(k) == "STRING", F.lit(False))

    def is_num(self, k: str) -> Column:
        return F.coalesce(self.tag(k).rlike(_NUM), F.lit(False))

    def is_int(self, k: str) -> Column:
        d = F.col(f"_d_{k}")
        return self.is_num(k) & F.coalesce(d == F.floor(d), F.lit(False))

    def is_bool(self, k: str) -> Column:
        return F.coalesce(self.tag(k) == "BOOLEAN", F.lit(False))

    def obj_defined(self, k: str) -> Column:
        return F.col(f"_od_{k}")

    def is_obj(self, k: str) -> Column:
        return F.col(f"_oo_{k}")


def id_check(g: _Tags, k: str, label: str) -> Column:
    t = g.text(k)
    return (
        F.when(~g.defined(k), F.lit(None).cast("string"))
        .when(~g.is_str(k), F.lit(f"{label}: expected string"))
        .when(F.length(t) < 1, F.lit(f"{label}: too short"))
        .when(F.length(t) > ID_MAX_LENGTH, F.lit(f"{label}: too long"))
        .when(F.instr(t, "\r") > 0, F.lit("ID cannot contain carriage return characters"))
    )


def _opt(g: _Tags, k: str, ok: Column, msg: str) -> Column:
    return F.when(g.defined(k) & ~F.coalesce(ok, F.lit(False)), F.lit(msg))


def _str(g: _Tags, k: str, max_len: int | None = None) -> list[Column]:
    out = [_opt(g, k, g.is_str(k), f"body.{k}: expected string")]
    if max_len:
        out.append(_opt(g, k, ~g.is_str(k) | (F.length(g.text(k)) <= max_len), f"body.{k}: too long"))
    return out


def _iso(g: _Tags, k: str) -> list[Column]:
    return [_opt(g, k, g.is_str(k) & strict_iso_ok(g.text(k)), f"body.{k}: invalid ISO datetime")]


def _record(g: _Tags, k: str) -> list[Column]:
    return [F.when(g.obj_defined(k) & ~g.is_obj(k), F.lit(f"body.{k}: expected record"))]


def _enum(g: _Tags, k: str, values: list[str]) -> list[Column]:
    return [_opt(g, k, g.is_str(k) & g.text(k).isin(*values), f"body.{k}: invalid enum value")]


def _ids(g: _Tags, *keys: str) -> list[Column]:
    return [id_check(g, k, f"body.{k}") for k in keys]


def _usage_problems(g: _Tags, b: Column) -> list[Column]:
    u = vget(b, "$.usage")
    checks = [F.when(g.obj_defined("usage") & ~g.is_obj("usage"), F.lit("body.usage: expected object"))]
    inner = []
    for k in ["input", "output", "total", *LEGACY_USAGE_KEYS]:
        v = vget(u, f"$.{k}")
        inner.append(F.when(is_defined(v) & ~_is_int(v), F.lit(f"body.usage.{k}: expected int")))
    for k in ["inputCost", "outputCost", "totalCost"]:
        v = vget(u, f"$.{k}")
        inner.append(F.when(is_defined(v) & ~is_number(v), F.lit(f"body.usage.{k}: expected number")))
    unit = vget(u, "$.unit")
    inner.append(
        F.when(is_defined(unit) & ~(is_string(unit) & _text(unit).isin(*USAGE_UNITS)), F.lit("body.usage.unit: invalid enum value"))
    )
    # Only objects are inspected further; most bodies carry no usage at all.
    return checks + [F.when(g.is_obj("usage"), c) for c in inner]


def _model_parameters(g: _Tags, b: Column) -> list[Column]:
    mp = vget(b, "$.modelParameters")

    def bad_entry(e: Column) -> Column:
        v = e["value"]
        simple = is_string(v) | is_number(v) | is_bool(v) | ~is_defined(v)
        str_array = is_array(v) & F.forall(
            F.coalesce((v).try_cast("array<variant>"), F.array().cast("array<variant>")), lambda x: is_string(x)
        )
        str_record = is_object(v) & F.forall(
            F.map_values(F.coalesce((v).try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))),
            lambda x: is_string(x),
        )
        return ~(simple | str_array | str_record)

    entries = F.map_entries(F.coalesce((mp).try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return [
        F.when(g.obj_defined("modelParameters") & ~g.is_obj("modelParameters"), F.lit("body.modelParameters: expected record")),
        F.when(g.is_obj("modelParameters") & F.exists(entries, bad_entry), F.lit("body.modelParameters: invalid value")),
    ]


def body_problems(t: Column, b: Column, g: _Tags | None = None) -> list[Column]:
    """All messages for the body of an event of type ``t`` (needs staged tags), each
    NULL where there is no problem."""
    g = g or _Tags()
    tags = vget(b, "$.tags")
    trace = (
        _ids(g, "id")
        + _iso(g, "timestamp")
        + _str(g, "name", TRACE_NAME_MAX_LENGTH)
        + _str(g, "externalId")
        + _record(g, "metadata")
        + _str(g, "sessionId")
        + _str(g, "userId")
        + _str(g, "release")
        + _str(g, "version")
        + [_opt(g, "public", g.is_bool("public"), "body.public: expected boolean")]
        + [
            F.when(
                is_defined(tags)
                & ~(
                    is_array(tags)
                    & F.forall(
                        F.coalesce(tags.try_cast("array<variant>"), F.array().cast("array<variant>")),
                        lambda x: is_string(x),
                    )
                ),
                F.lit("body.tags: expected array of strings"),
            )
        ]
    )
    observation = (
        _ids(g, "traceId", "parentObservationId", "id")
        + _str(g, "name")
        + _iso(g, "startTime")
        + _record(g, "metadata")
        + _enum(g, "level", LEVELS)
        + _str(g, "statusMessage")
        + _str(g, "version")
    )
    span = _iso(g, "endTime")
    generation = (
        _iso(g, "endTime")
        + _iso(g, "completionStartTime")
        + _str(g, "model")
        + _model_parameters(g, b)
        + _usage_problems(g, b)
        + _record(g, "usageDetails")
        + _record(g, "costDetails")
        + _str(g, "promptName")
        + [_opt(g, "promptVersion", g.is_int("promptVersion"), "body.promptVersion: expected int")]
    )
    legacy = _enum(g, "type", LEGACY_OBSERVATION_TYPES)
    score = (
        _ids(g, "id", "traceId", "observationId")
        + _str(g, "sessionId")
        + [
            F.when(~g.is_str("name"), F.lit("body.name: expected string")).when(
                F.length(g.text("name")) < 1, F.lit("body.name: too short")
            ),
            F.when(
                ~(g.is_num("value") | g.is_str("value") | g.is_bool("value")),
                F.lit("body.value: expected number, string or boolean"),
            ),
            F.when(
                g.tag("source").isNotNull() & ~(g.is_str("source") & g.text("source").isin(*SCORE_SOURCES)),
                F.lit("body.source: invalid enum value"),
            ),
        ]
        + _enum(g, "dataType", SCORE_DATA_TYPES)
        + _str(g, "comment")
        + _record(g, "metadata")
        + _str(g, "configId")
        + _str(g, "queueId")
        + _str(g, "authorUserId")
        + _iso(g, "createdAt")
    )

    def guarded(flag: str, msgs: list[Column]) -> list[Column]:
        return [F.when(F.col(flag), m) for m in msgs]

    return (
        guarded("_g_trace", trace)
        + guarded("_g_obs", observation)
        + guarded("_g_span", span)
        + guarded("_g_gen", generation)
        + guarded("_g_legacy", legacy)
        + guarded("_g_score", score)
    )


def id_problem(v: Column, name: str, required: bool = False) -> Column:
    """Message for an id value: string of 1..800 chars without carriage return."""
    t = _text(v)
    missing = F.lit(f"{name}: required") if required else F.lit(None).cast("string")
    return (
        F.when(~is_defined(v), missing)
        .when(~is_string(v), F.lit(f"{name}: expected string"))
        .when(F.length(t) < 1, F.lit(f"{name}: too short"))
        .when(F.length(t) > ID_MAX_LENGTH, F.lit(f"{name}: too long"))
        .when(F.instr(t, "\r") > 0, F.lit("ID cannot contain carriage return characters"))
    )


def _envelope_problems() -> list[Column]:
    e_id, ts, typ = F.col("_e_id"), F.col("_e_ts"), F.col("_e_type")
    t = F.col("_e_type_text")
    return [
        F.when(~F.col("_e_is_obj"), F.lit("expected object")),
        id_problem(e_id, "id", required=True),
        F.when(~(is_string(ts) & strict_iso_ok(_text(ts))), F.lit("timestamp: invalid ISO datetime")),
        F.when(~(is_string(typ) & t.isin(*EVENT_TYPES)), F.lit("type: invalid discriminator value")),
        F.when(F.col("_e_md_defined") & ~F.col("_e_md_obj"), F.lit("metadata: expected record")),
        F.when(is_string(typ) & t.isin(*EVENT_TYPES) & ~F.col("_e_body_obj"), F.lit("body: expected object")),
    ]


# ------------------------------------------------------------------ cleaning


def normalize_environment(env: Column) -> Column:
    """lower-case, strip a leading ``langfuse`` (+ ``-``/``_``), keep 40 chars,
    and fall back to ``default`` unless ``[a-z0-9-_]+`` remains (V11)."""
    s = F.substring(F.regexp_replace(F.lower(env), r"^langfuse[-_]?", ""), 1, ENVIRONMENT_MAX_LENGTH)
    return F.when(env.isNull(), F.lit(DEFAULT_ENVIRONMENT)).when(s.rlike(r"^[a-z0-9\-_]+$"), s).otherwise(
        F.lit(DEFAULT_ENVIRONMENT)
    )


def _vmap(v: Column) -> Column:
    return F.coalesce((v).try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _object_from_entries(m: Column) -> Column:
    """map<string,variant> without SQL NULL entries → VARIANT object."""
    return F.to_variant_object(F.map_filter(m, lambda k, v: v.isNotNull()))


def normalize_usage(u: Column) -> Column:
    """Legacy usage (V12). Returns a VARIANT object, VARIANT null (missing or
    null input), or SQL NULL meaning "drop the key"."""
    has_legacy = F.lit(False)
    for k in LEGACY_USAGE_KEYS:
        has_legacy = has_legacy | vget(u, f"$.{k}").isNotNull()
    legacy = F.create_map(
        F.lit("input"), vget(u, "$.promptTokens"),
        F.lit("output"), vget(u, "$.completionTokens"),
        F.lit("total"), vget(u, "$.totalTokens"),
        F.lit("unit"), F.lit("TOKENS").cast("variant"),
    )
    known = F.map_filter(_vmap(u), lambda k, v: k.isin(*USAGE_KEYS))
    all_null = F.forall(F.map_values(known), lambda v: ~is_defined(v))
    return (
        F.when(~is_defined(u), F.parse_json(F.lit("null")))
        .when(has_legacy, _object_from_entries(legacy))
        .when(all_null, F.lit(None).cast("variant"))
        .otherwise(F.to_variant_object(known))
    )


def _clean_numeric_record(v: Column, allow_text: bool) -> Column:
    """usageDetails / costDetails cleaning; SQL NULL means "drop the key"."""

    def keep(_k: Column, x: Column) -> Column:
        d = F.try_variant_get(x, "$", "double")
        lead = F.regexp_extract(_text(x), r"^\s*([+-]?\d+)", 1)
        parsed = F.when(lead != "", lead).try_cast("decimal(38,0)")
        if allow_text:
            return F.when(_is_int(x) & (d >= 0), x).when(is_string(x) & (parsed >= 0), F.coalesce(parsed.try_cast("long").cast("variant"), parsed.try_cast("double").cast("variant")))
        return F.when(is_number(x) & (d >= 0), x)

    cleaned = F.map_filter(F.transform_values(_vmap(v), keep), lambda k, x: x.isNotNull())
    return F.when(~is_defined(v), v).when(F.size(cleaned) > 0, F.to_variant_object(cleaned))


def clean_usage_details(v: Column) -> Column:
    """keep integers ≥ 0 and texts whose leading integer is ≥ 0."""
    return _clean_numeric_record(v, allow_text=True)


def clean_cost_details(v: Column) -> Column:
    """keep finite numbers ≥ 0, never texts."""
    return _clean_numeric_record(v, allow_text=False)


def _cleaned_columns() -> list[Column]:
    """What the cleaning puts in place of a body's keys (NULL: nothing)."""
    part = lambda k: F.try_element_at("_e_body_map", F.lit(k))
    gen, score = F.col("type").isin(*GENERATION_LIKE), F.col("type") == SCORE_CREATE
    env = part("environment")
    return [
        normalize_environment(F.when(is_string(env), _text(env))).cast("variant").alias("_c_environment"),
        F.when(gen, normalize_usage(part("usage"))).alias("_c_usage"),
        F.when(gen, clean_usage_details(part("usageDetails"))).alias("_c_usageDetails"),
        F.when(gen, clean_cost_details(part("costDetails"))).alias("_c_costDetails"),
        F.when(score, F.coalesce(part("source"), F.lit("API").cast("variant"))).alias("_c_source"),
        gen.alias("_c_gen"),
        score.alias("_c_score"),
    ]


def _cleaned_body() -> Column:
    """Re-serialise a valid body with the cleaning transforms applied.

    Every body gets a normalised ``environment``; generation-like bodies get
    cleaned ``usage`` / ``usageDetails`` / ``costDetails``; scores get a
    ``source`` (default API). Other keys are kept as they came.
    """
    gen_keys = ["usage", "usageDetails", "costDetails"]
    base = F.map_filter(
        "_e_body_map",
        lambda k, v: (k != "environment") & ~(F.col("_c_gen") & k.isin(*gen_keys)) & ~(F.col("_c_score") & (k == "source")),
    )
    none = F.create_map().cast("map<string,variant>")
    put = [F.when(F.col(f"_c_{k}").isNotNull(), F.create_map(F.lit(k), F.col(f"_c_{k}"))).otherwise(none) for k in ("environment", *gen_keys, "source")]
    return F.to_json(F.to_variant_object(F.map_concat(base, *put)))


@per_context
def _stage0_columns(event_col: str) -> list[Column]:
    return [F.col(event_col).try_cast("map<string,variant>").alias("_e_map")]


@per_context
def _stage1_columns() -> list[Column]:
    part = lambda k: F.try_element_at("_e_map", F.lit(k))
    md = part("metadata")
    return [
        F.col("_e_map").isNotNull().alias("_e_is_obj"),
        part("id").alias("_e_id"),
        part("timestamp").alias("_e_ts"),
        part("type").alias("_e_type"),
        _text(part("type")).alias("_e_type_text"),
        is_defined(md).alias("_e_md_defined"),
        md.try_cast("map<string,variant>").isNotNull().alias("_e_md_obj"),
        md.alias("_e_md"),
        part("body").alias("_e_body"),
        part("body").try_cast("map<string,variant>").alias("_e_body_map"),
    ]


@per_context
def _stage2_columns() -> list[Column]:
    cols = [F.col("_e_body_map").isNotNull().alias("_e_body_obj")]
    for k in SCALAR_KEYS:
        v = F.try_element_at("_e_body_map", F.lit(k))
        cols += [
            F.schema_of_variant(v).alias(f"_t_{k}"),
            F.try_variant_get(v, "$", "string").alias(f"_s_{k}"),
        ]
        if k in ("promptVersion",):
            cols.append(F.try_variant_get(v, "$", "double").alias(f"_d_{k}"))
    for k in OBJECT_KEYS:
        v = F.try_element_at("_e_body_map", F.lit(k))
        cols += [is_defined(v).alias(f"_od_{k}"), v.try_cast("map<string,variant>").isNotNull().alias(f"_oo_{k}")]
    t, body = F.coalesce(F.col("_e_type_text"), F.lit("")), F.col("_e_body_map").isNotNull()
    cols += [
        (body & (t == TRACE_CREATE)).alias("_g_trace"),
        (body & t.isin(*OBSERVATION_TYPES)).alias("_g_obs"),
        (body & t.isin(*SPAN_LIKE)).alias("_g_span"),
        (body & t.isin(*GENERATION_LIKE)).alias("_g_gen"),
        (body & t.isin(*LEGACY_TYPES)).alias("_g_legacy"),
        (body & (t == SCORE_CREATE)).alias("_g_score"),
    ]
    return cols


#: Between the messages of an event while they are one text; no message has it.
_BETWEEN = "\x01"


@per_context
def _stage3_columns() -> list[Column]:
    t = F.col("_e_type_text")
    # (texts and not arrays: filtering an array would interpret all the checks)
    problems = F.concat_ws(_BETWEEN, *_envelope_problems(), *body_problems(t, F.col("_e_body")))
    return [
        F.when(is_string(F.col("_e_id")), _text(F.col("_e_id"))).alias("id"),
        _text(F.col("_e_ts")).alias("timestamp"),
        t.alias("type"),
        F.when(F.col("_e_md_obj"), F.to_json(F.col("_e_md"))).alias("metadata"),
        problems.alias("_problems"),
    ]


@per_context
def _errors_column() -> Column:
    return F.when(F.col("_problems") == "", F.array().cast("array<string>")).otherwise(F.split("_problems", _BETWEEN)).alias("errors")


@per_context
def _clean_columns() -> tuple[list[Column], Column]:
    return _cleaned_columns(), F.when(F.size("errors") == 0, _cleaned_body()).alias("body")


def validate(events: DataFrame, event_col: str = "event") -> DataFrame:
    """Add ``errors`` and the envelope columns (id, timestamp, type, metadata,
    body) to a frame holding one VARIANT ingestion event per row.

    Narrow projections: envelope parts, per-key type tags of the body, the checks, what
    the cleaning puts in place, and the body put together. Event and body are cast to
    maps once, keys are looked up there. ``body`` is the cleaned JSON text for valid
    events and NULL for rejects.
    """
    keep = events.columns
    staged = events.select("*", *_stage0_columns(event_col)).select("*", *_stage1_columns())
    staged = staged.select("*", *_stage2_columns())
    checked = staged.select(*keep, "_e_body_map", *_stage3_columns())
    envelope = ["id", "timestamp", "type", "metadata", "errors"]
    checked = checked.select(*keep, "_e_body_map", *envelope[:-1], _errors_column())
    parts, body = _clean_columns()
    return checked.select("*", *parts).select(*keep, *envelope, body)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0)


def rejected(validated: DataFrame) -> DataFrame:
    """One row per reject: id (or ``unknown``), status 400, message, all problems
    joined by ``; `` (V2)."""
    return validated.where(F.size("errors") > 0).select(
        "*",
        F.coalesce(F.col("id"), F.lit("unknown")).alias("reject_id"),
        F.lit(REJECT_STATUS).alias("status"),
        F.lit(REJECT_MESSAGE).alias("message"),
        F.array_join("errors", "; ").alias("error"),
    )


def entity_type(t: Column) -> Column:
    """trace-create → trace, score-create → score, else observation."""
    return F.when(t == TRACE_CREATE, "trace").when(t == SCORE_CREATE, "score").otherwise("observation")


def body_id(body_text: Column) -> Column:
    """``body.id`` when it is a string."""
    v = vget(F.parse_json(body_text), "$.id")
    return F.when(is_string(v), _text(v))
