"""Attribute conventions: Langfuse, OpenInference, OTel GenAI and Vercel AI.

Each convention reads the span's ``map<string,variant>`` attributes and yields
an observation type and field bundles as column expressions; every field is a
(present, value) pair because the merge is first-*present* wins: a field a
higher-priority convention sets, even to an invalid (NULL) value, is not
filled in by a later one. Priority: Langfuse → OpenInference → GenAI → Vercel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.json import (
    is_array,
    is_bool,
    is_defined,
    is_number,
    is_object,
    is_string,
    js_string,
)

# Observation type names per convention.
LANGFUSE_TYPES = {
    "span": "span-create",
    "generation": "generation-create",
    "event": "event-create",
    "agent": "agent-create",
    "tool": "tool-create",
    "chain": "chain-create",
    "retriever": "retriever-create",
    "embedding": "embedding-create",
    "guardrail": "guardrail-create",
}
OPENINFERENCE_KINDS = {
    "CHAIN": "chain-create",
    "RETRIEVER": "retriever-create",
    "LLM": "generation-create",
    "EMBEDDING": "embedding-create",
    "AGENT": "agent-create",
    "TOOL": "tool-create",
    "GUARDRAIL": "guardrail-create",
}
GENAI_OPERATIONS = {
    "chat": "generation-create",
    "text_completion": "generation-create",
    "generate_content": "generation-create",
    "embeddings": "embedding-create",
    "create_agent": "agent-create",
    "invoke_agent": "agent-create",
    "agent_step": "chain-create",
    "execute_tool": "tool-create",
    "invoke_workflow": "chain-create",
    "retrieval": "retriever-create",
    "completion": "generation-create",
    "generate": "generation-create",
}
VERCEL_GENERATION_PREFIXES = [
    "ai.generateText",
    "ai.generateText.doGenerate",
    "ai.streamText.doStream",
    "ai.generateObject",
    "ai.generateObject.doGenerate",
    "ai.streamObject.doStream",
]
VERCEL_EMBEDDING_PREFIXES = ["ai.embedMany.doEmbed", "ai.embed.doEmbed"]
VERCEL_TOOL_PREFIXES = ["ai.toolCall"]
VERCEL_MODEL_KEYS = [
    "langfuse.observation.model.name",
    "ai.model.id",
    "gen_ai.request.model",
    "gen_ai.response.model",
]
USER_ID_KEYS = [
    "langfuse.user.id",
    "user.id",
    "langfuse.observation.metadata.langfuse_user_id",
    "langfuse.trace.metadata.langfuse_user_id",
    "ai.telemetry.metadata.userId",
]
SESSION_ID_KEYS = [
    "langfuse.session.id",
    "session.id",
    "gen_ai.conversation.id",
    "langfuse.observation.metadata.langfuse_session_id",
    "langfuse.trace.metadata.langfuse_session_id",
    "ai.telemetry.metadata.sessionId",
]
TAG_KEYS = [
    "langfuse.trace.tags",
    "langfuse.tags",
    "langfuse.observation.metadata.langfuse_tags",
    "langfuse.trace.metadata.langfuse_tags",
    "ai.telemetry.metadata.tags",
    "tag.tags",
]
TRACE_UPDATE_KEYS = [
    "langfuse.trace.name",
    "langfuse.trace.input",
    "langfuse.trace.output",
    "langfuse.trace.metadata",
    "user.id",
    "session.id",
    "langfuse.trace.public",
    "langfuse.trace.tags",
    "langfuse.user.id",
    "langfuse.session.id",
    "langfuse.observation.metadata.langfuse_user_id",
    "langfuse.observation.metadata.langfuse_session_id",
    "langfuse.observation.metadata.langfuse_tags",
    "langfuse.trace.metadata.langfuse_session_id",
    "langfuse.trace.metadata.langfuse_user_id",
    "langfuse.trace.metadata.langfuse_tags",
    "ai.telemetry.metadata.sessionId",
    "ai.telemetry.metadata.userId",
    "ai.telemetry.metadata.tags",
    "tag.tags",
]
TRACE_METADATA_PREFIX = "langfuse.trace.metadata."
LEVELS = ["DEBUG", "DEFAULT", "WARNING", "ERROR"]
DEFAULT_TYPE = "span-create"

OBSERVATION_FIELDS = [
    "input", "output", "usageDetails", "costDetails", "model", "modelParameters",
    "level", "statusMessage", "version", "environment",
]
TRACE_FIELDS = ["name", "userId", "sessionId", "metadata", "input", "output", "tags", "public", "version", "environment"]

def _none() -> Column:
    return F.lit(None).cast("variant")


def _false() -> Column:
    return F.lit(False)


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def parse_json_string(v: Column) -> Column:
    """Text → parsed JSON, or the text itself when not JSON; non-text → undefined."""
    return F.when(is_string(v), F.coalesce(F.try_parse_json(_text(v)), _text(v).cast("variant")))


def parse_json_attribute(v: Column) -> Column:
    """Like ``parse_json_string`` but non-text values pass through unchanged."""
    return F.when(is_string(v), F.coalesce(F.try_parse_json(_text(v)), _text(v).cast("variant"))).otherwise(v)


def parse_json_record(v: Column) -> Column:
    p = parse_json_string(v)
    return F.when(is_object(p), p)


def bool_value(v: Column) -> Column:
    t = _text(v)
    return (
        F.when(is_bool(v), F.try_variant_get(v, "$", "boolean"))
        .when(is_string(v) & (t == "true"), F.lit(True))
        .when(is_string(v) & (t == "false"), F.lit(False))
    )


def truthy(v: Column) -> Column:
    """JavaScript truthiness of a JSON value."""
    return F.coalesce(
        is_defined(v)
        & ~(is_bool(v) & ~F.coalesce(F.try_variant_get(v, "$", "boolean"), _false()))
        & ~(is_number(v) & (F.try_variant_get(v, "$", "double") == 0))
        & ~(is_string(v) & (_text(v) == "")),
        _false(),
    )


def staged_name(k: str, kind: str = "a") -> str:
    import hashlib

    return f"_{kind}_" + hashlib.sha1(k.encode()).hexdigest()[:12]


class _Attrs:
    """Attribute access. ``staged``: every key read becomes a column computed
    once per span in a preceding projection (see ``stage_columns``), instead of
    a map lookup repeated inside each conditional branch."""

    def __init__(self, a: Column, staged: bool = False):
        self.a = a
        self.staged = staged
        self.keys: set[str] = set()
        self.derived: dict[str, Column] = {}

    def derive(self, name: str, expr: Column) -> Column:
        """A value several expressions share: computed once in a second
        projection when staged."""
        if not self.staged:
            return expr
        self.derived[name] = expr
        return F.col(name)

    def kind(self, k: str) -> Column:
        """'s', 'n', 'b', 'o', 'a', 'z' (JSON null) or NULL (missing)."""
        if self.staged:
            self.keys.add(k)
            return F.col(staged_name(k, "k"))
        return value_kind(self.get(k))

    def get(self, k: str) -> Column:
        if self.staged:
            self.keys.add(k)
            return F.col(staged_name(k))
        return F.try_element_at(self.a, F.lit(k))

    def has(self, k: str) -> Column:
        if self.staged:
            self.keys.add(k)
            return F.col(staged_name(k, "h"))
        return F.coalesce(F.map_contains_key(self.a, F.lit(k)), _false())

    def parse_string(self, k: str) -> Column:
        """parse_json_string of one attribute, using its staged kind/text."""
        t = self.string(k)
        return F.when(self.kind(k) == "s", F.coalesce(F.try_parse_json(t), t.cast("variant")))

    def parse_attr(self, k: str) -> Column:
        return F.when(self.kind(k) == "s", self.parse_string(k)).otherwise(self.get(k))

    def parse_record(self, k: str) -> Column:
        p = self.parse_string(k)
        return F.when(F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), _false()), p)

    def boolean(self, k: str) -> Column:
        kd, t = self.kind(k), self.string(k)
        return F.when(kd == "b", t == "true").when((kd == "s") & t.isin("true", "false"), t == "true")

    def nonneg(self, k: str) -> Column:
        from spanlake.functions.json import lenient_number

        kd, t = self.kind(k), self.string(k)
        n = F.when(kd == "n", F.try_variant_get(self.get(k), "$", "double")).when(
            (kd == "s") & (F.trim(t) != ""), lenient_number(t)
        )
        return F.when(n >= 0, n)

    def string(self, k: str) -> Column:
        if self.staged:
            self.keys.add(k)
            return F.col(staged_name(k, "s"))
        return js_string(self.get(k))

    def first_string(self, keys: list[str]) -> Column:
        return F.coalesce(*[F.nullif(self.string(k), F.lit("")) for k in keys])


_KIND_BY_TYPE = {
    "STRING": "s", "BOOLEAN": "b", "TINYINT": "n", "SMALLINT": "n", "INT": "n", "BIGINT": "n",
    "FLOAT": "n", "DOUBLE": "n", "DECIMAL": "n", "OBJECT": "o", "ARRAY": "a", "VOID": "z",
}


def value_kind(v: Column) -> Column:
    """JSON kind of a VARIANT from one ``schema_of_variant`` call."""
    t = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    pairs = []
    for k, c in _KIND_BY_TYPE.items():
        pairs += [F.lit(k), F.lit(c)]
    return F.try_element_at(F.create_map(*pairs), t)


STAGE_KINDS = ("a", "h", "k", "s")


def stage_columns(attributes: Column, keys: set[str]) -> list[Column]:
    """Per attribute key the mappers read: its value, presence, JSON kind and
    scalar text, looked up once per span."""
    cols = []
    for k in sorted(keys):
        v = F.try_element_at(attributes, F.lit(k))
        kind = value_kind(v)
        cols.append(v.alias(staged_name(k)))
        cols.append(F.coalesce(F.map_contains_key(attributes, F.lit(k)), F.lit(False)).alias(staged_name(k, "h")))
        cols.append(kind.alias(staged_name(k, "k")))
        cols.append(F.when(kind.isin("s", "n", "b"), F.try_variant_get(v, "$", "string")).alias(staged_name(k, "s")))
    return cols



def trace_tags(at: _Attrs) -> Column:
    """Tags from the first non-null tag attribute: arrays as strings, JSON array
    text, comma lists (trimmed) or one tag; empty → undefined (O18)."""
    raw = at.derive("_d_tags_raw", F.coalesce(*[F.when(at.kind(k) != "z", at.get(k)) for k in TAG_KEYS]))
    t = at.derive("_d_tags_text", _text(raw))
    parsed = at.derive("_d_tags_parsed", F.when(is_string(raw), F.try_parse_json(t)))
    as_text = lambda arr: F.transform(arr, lambda x: js_string(x))
    tags = (
        F.when(is_array(raw), as_text(raw.try_cast("array<variant>")))
        .when(is_string(raw) & is_array(parsed), as_text(parsed.try_cast("array<variant>")))
        .when(is_string(raw) & (F.instr(t, ",") > 0), F.transform(F.split(t, ","), lambda x: F.trim(x)))
        .when(is_string(raw) & (t != ""), F.array(t))
        .when(is_defined(raw) & ~is_string(raw), F.array(js_string(raw)))
    )
    return F.when(tags.isNotNull(), F.to_variant_object(tags))


def trace_metadata(at: _Attrs) -> Column:
    """Parsed ``langfuse.trace.metadata`` object plus every
    ``langfuse.trace.metadata.<k>`` attribute; empty → undefined (O16)."""
    base = F.coalesce(at.parse_record("langfuse.trace.metadata").try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    extra = F.transform_values(
        F.transform_keys(
            F.map_filter(at.a, lambda k, v: k.startswith(TRACE_METADATA_PREFIX)),
            lambda k, v: F.substr(k, F.lit(len(TRACE_METADATA_PREFIX) + 1)),
        ),
        lambda k, v: F.when(is_string(v), parse_json_string(v)).otherwise(v),
    )
    merged = F.map_concat(base, extra)
    return F.when(F.size(merged) > 0, F.to_variant_object(merged))


def has_trace_updates(at: _Attrs) -> Column:
    """Any update key truthy, or any key starting with langfuse.trace.metadata."""
    any_truthy = _false()
    for k in TRACE_UPDATE_KEYS:
        kd, tx = at.kind(k), at.string(k)
        v = at.get(k)
        t = F.coalesce(
            kd.isin("o", "a")
            | ((kd == "s") & (tx != ""))
            | ((kd == "b") & (tx == "true"))
            | ((kd == "n") & (F.try_variant_get(v, "$", "double") != 0)),
            _false(),
        )
        any_truthy = any_truthy | t
    prefixed = F.exists(F.map_keys(at.a), lambda k: k.startswith("langfuse.trace.metadata"))
    return any_truthy | F.coalesce(prefixed, _false())


def _langfuse(at: _Attrs) -> dict:
    raw_type = at.string("langfuse.observation.type")
    typ = _lookup(LANGFUSE_TYPES, F.lower(raw_type))
    level = at.string("langfuse.observation.level")
    obs = {
        "input": (at.has("langfuse.observation.input"), at.parse_string("langfuse.observation.input")),
        "output": (at.has("langfuse.observation.output"), at.parse_string("langfuse.observation.output")),
        "usageDetails": (at.has("langfuse.observation.usage_details"), at.parse_record("langfuse.observation.usage_details")),
        "costDetails": (at.has("langfuse.observation.cost_details"), at.parse_record("langfuse.observation.cost_details")),
        "model": (at.has("langfuse.observation.model.name"), at.string("langfuse.observation.model.name").cast("variant")),
        "modelParameters": (at.has("langfuse.observation.model.parameters"), at.parse_record("langfuse.observation.model.parameters")),
        "level": (at.has("langfuse.observation.level"), F.when(level.isin(*LEVELS), level).cast("variant")),
        "statusMessage": (at.has("langfuse.observation.status_message"), at.string("langfuse.observation.status_message").cast("variant")),
        "version": (at.has("langfuse.version"), at.string("langfuse.version").cast("variant")),
        "environment": (at.has("langfuse.environment"), at.string("langfuse.environment").cast("variant")),
    }
    name = at.string("langfuse.trace.name")
    user = at.derive("_d_user", at.first_string(USER_ID_KEYS))
    session = at.derive("_d_session", at.first_string(SESSION_ID_KEYS))
    md = at.derive("_d_metadata", trace_metadata(at))
    tags = trace_tags(at)
    public = at.boolean("langfuse.trace.public")
    t_in = at.has("langfuse.trace.input")
    t_out = at.has("langfuse.trace.output")
    root = {
        "name": (name.isNotNull(), name.cast("variant")),
        "userId": (user.isNotNull(), user.cast("variant")),
        "sessionId": (session.isNotNull(), session.cast("variant")),
        "metadata": (md.isNotNull(), md),
        "input": (t_in | obs["input"][0], F.when(t_in, at.parse_string("langfuse.trace.input")).otherwise(obs["input"][1])),
        "output": (t_out | obs["output"][0], F.when(t_out, at.parse_string("langfuse.trace.output")).otherwise(obs["output"][1])),
        "tags": (tags.isNotNull(), tags),
        "public": (public.isNotNull(), public.cast("variant")),
        "version": obs["version"],
        "environment": obs["environment"],
    }
    upd_flag = at.derive("_d_has_update", has_trace_updates(at))
    update = {
        "name": root["name"],
        "userId": root["userId"],
        "sessionId": root["sessionId"],
        "metadata": root["metadata"],
        "input": (t_in, at.parse_string("langfuse.trace.input")),
        "output": (t_out, at.parse_string("langfuse.trace.output")),
        "tags": root["tags"],
        "public": root["public"],
        "version": obs["version"],
        "environment": (_false(), _none()),
    }
    update = {k: (upd_flag & p, v) for k, (p, v) in update.items()}
    return {"type": typ, "observation": obs, "root": root, "update": update, "has_update": upd_flag}


def _genai(at: _Attrs) -> dict:
    op = at.string("gen_ai.operation.name")
    typ = _lookup(GENAI_OPERATIONS, op)
    applies = typ.isNotNull()
    tool = op == "execute_tool"
    emb = op == "embeddings"

    def plural(v: Column) -> Column:
        arr = parse_json_attribute(v)
        return F.when(is_array(arr), F.to_variant_object(F.transform(arr.try_cast("array<variant>"), parse_json_attribute)))

    has_in = at.has("gen_ai.input.messages")
    has_out = at.has("gen_ai.output.messages")
    in_p = has_in | (tool & at.has("gen_ai.tool.call.arguments")) | (emb & (at.has("ai.values") | at.has("ai.value")))
    in_v = (
        F.when(emb & at.has("ai.values"), plural(at.get("ai.values")))
        .when(emb & at.has("ai.value"), at.parse_attr("ai.value"))
        .when(tool & at.has("gen_ai.tool.call.arguments"), at.parse_attr("gen_ai.tool.call.arguments"))
        .when(has_in, at.parse_attr("gen_ai.input.messages"))
    )
    out_p = has_out | (tool & at.has("gen_ai.tool.call.result")) | (emb & (at.has("ai.embeddings") | at.has("ai.embedding")))
    out_v = (
        F.when(emb & at.has("ai.embeddings"), plural(at.get("ai.embeddings")))
        .when(emb & at.has("ai.embedding"), at.parse_attr("ai.embedding"))
        .when(tool & at.has("gen_ai.tool.call.result"), at.parse_attr("gen_ai.tool.call.result"))
        .when(has_out, at.parse_attr("gen_ai.output.messages"))
    )
    ui = at.nonneg("gen_ai.usage.input_tokens")
    uo = at.nonneg("gen_ai.usage.output_tokens")
    usage_p = at.has("gen_ai.usage.input_tokens") | at.has("gen_ai.usage.output_tokens")
    usage_v = F.when(
        ui.isNotNull() | uo.isNotNull(),
        F.to_variant_object(
            F.map_filter(
                F.create_map(
                    F.lit("input"), ui.cast("variant"),
                    F.lit("output"), uo.cast("variant"),
                    F.lit("total"), (F.coalesce(ui, F.lit(0.0)) + F.coalesce(uo, F.lit(0.0))).cast("variant"),
                ),
                lambda k, v: v.isNotNull(),
            )
        ),
    )
    model = F.coalesce(at.string("gen_ai.response.model"), at.string("gen_ai.request.model"))
    agent = at.string("gen_ai.agent.name")
    none = (_false(), _none())
    obs = {k: none for k in OBSERVATION_FIELDS}
    obs.update(
        {
            "input": (in_p, in_v),
            "output": (out_p, out_v),
            "usageDetails": (usage_p, usage_v),
            "model": (model.isNotNull(), model.cast("variant")),
        }
    )
    root = {k: none for k in TRACE_FIELDS}
    root.update({"name": (agent.isNotNull(), agent.cast("variant")), "input": (in_p, in_v), "output": (out_p, out_v)})
    obs = {k: (applies & p, v) for k, (p, v) in obs.items()}
    root = {k: (applies & p, v) for k, (p, v) in root.items()}
    return {"type": typ, "observation": obs, "root": root}


def _vercel_type(at: _Attrs) -> Column:
    def meaningful(k: str) -> Column:
        v, kv = at.get(k), at.kind(k)
        return v.isNotNull() & (kv != "z") & ~((kv == "s") & (at.string(k) == "")) & F.coalesce(
            F.when(kv == "a", F.size(v.try_cast("array<variant>")) > 0)
            .when(kv == "o", F.size(v.try_cast("map<string,variant>")) > 0)
            .otherwise(F.lit(True)),
            _false(),
        )

    def text(k: str) -> Column:
        return F.when(meaningful(k), F.coalesce(at.string(k), F.to_json(at.get(k))))

    op_name = at.derive("_d_op_name", text("operation.name"))
    op_id = at.derive("_d_op_id", text("ai.operationId"))

    def matches(prefixes: list[str]) -> Column:
        starts = _false()
        for p in prefixes:
            starts = starts | F.coalesce(op_name.startswith(p), _false())
        return starts | F.coalesce(op_id.isin(*prefixes), _false())

    has_model = _false()
    for k in VERCEL_MODEL_KEYS:
        has_model = has_model | meaningful(k)
    has_model = at.derive("_d_has_model", has_model)
    return (
        F.when(matches(VERCEL_TOOL_PREFIXES), F.lit("tool-create"))
        .when(~has_model, F.lit(None).cast("string"))
        .when(matches(VERCEL_GENERATION_PREFIXES), F.lit("generation-create"))
        .when(matches(VERCEL_EMBEDDING_PREFIXES), F.lit("embedding-create"))
    )


def map_attributes(attributes: Column, staged: bool = False) -> dict:
    """Observation type, merged observation / root-trace / trace-update bundles
    and the trace-update flag for one span's attributes (O7–O24). With
    ``staged`` the result also carries ``keys``: the attribute keys to stage."""
    at = _Attrs(attributes, staged)
    lf = _langfuse(at)
    ga = _genai(at)
    oi_type = _lookup(OPENINFERENCE_KINDS, F.upper(at.string("openinference.span.kind")))
    typ = F.coalesce(lf["type"], oi_type, ga["type"], _vercel_type(at), F.lit(DEFAULT_TYPE))

    def first_present(a: dict, b: dict, keys: list[str]) -> dict:
        out = {}
        for k in keys:
            pa, va = a.get(k, (_false(), _none()))
            pb, vb = b.get(k, (_false(), _none()))
            out[k] = (pa | pb, F.when(pa, va).when(pb, vb))
        return out

    return {
        "type": typ,
        "observation": first_present(lf["observation"], ga["observation"], OBSERVATION_FIELDS),
        "root": first_present(lf["root"], ga["root"], TRACE_FIELDS),
        "update": lf["update"],
        "has_update": lf["has_update"],
        "keys": at.keys,
        "derived": at.derived,
    }
