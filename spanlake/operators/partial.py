"""Mergeable state of the fold (P5-P13): what a set of events leaves of each key.

A state row keeps per field the winning value together with its order key
``(timestamp, event id)``, so rows of one key merge by taking maxima, field by field,
in any order and grouping: batches that come late or out of order give the rows that
one fold over all events gives, and nothing of the history is read again. A key that
has no row yet is just its batch's row.

Metadata merges path by path. A key with a single value keeps its text; from the
second one on it keeps its paths, each with the orders that decide over it
(``operators.metadata``). Paths that are cut off are dropped from the state.

``state_of`` makes state rows from raw-log rows, ``merge`` puts several tables of them
together, ``finish`` turns them into the rows of a relation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.cache import per_context
from spanlake.operators import fold
from spanlake.operators.metadata import assembled, merge_entries, object_entries
from spanlake.schema import OBSERVATIONS, SCORES, TRACES

KEY = ["project_id", "id"]
ORDER = "struct<t: timestamp, i: string>"
ENTRIES = f"array<struct<path: array<string>, last: {ORDER}, leaf: string, last_leaf: {ORDER}, last_object: {ORDER}>>"
METADATA = ["md_n", "md_last", "md_scalar", "md_any", "md_paths"]


@dataclass(frozen=True)
class Relation:
    """How the columns of a relation come about: the last defined value of an event
    field (``latest``; with ``guarded`` an empty object does not count), the first
    event's value (``first``), or the smallest one (``least``)."""

    name: str
    id: str
    fields: Callable[[DataFrame], DataFrame]
    schema: T.StructType
    latest: dict[str, tuple[str, str]]
    guarded: tuple[str, ...]
    first: dict[str, tuple[str, str]] = field(default_factory=dict)
    least: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def state_schema(self) -> T.StructType:
        columns = ["project_id string", "id string"]
        columns += [f"s_{c}: struct<o: {ORDER}, v: {kind}>" for c, (_, kind) in self.latest.items()]
        if self.first:
            columns.append(f"s_first: struct<o: {ORDER}, v: struct<{', '.join(f'{c}: {kind}' for c, (_, kind) in self.first.items())}>>")
        columns += [f"s_{c}: {kind}" for c, (_, kind) in self.least.items()]
        columns += ["md_n bigint", *(f"{c}: struct<o: {ORDER}, v: string>" for c in METADATA[1:4]), f"md_paths {ENTRIES}"]
        return T._parse_datatype_string(", ".join(columns))


TRACE_STATE = Relation(
    "traces", "trace_id", fold.trace_fields, TRACES,
    latest={
        "name": ("f_name", "string"), "user_id": ("f_user", "string"), "session_id": ("f_session", "string"), "end_time": ("f_end", "timestamp"),
        "input_json": ("f_input", "string"), "output_json": ("f_output", "string"), "updated_at": ("event_timestamp", "timestamp"),
    },
    guarded=("name", "user_id", "session_id"),
    least={"start_time": ("f_trace_start", "timestamp")},
)
OBSERVATION_STATE = Relation(
    "observations", "observation_id", fold.observation_fields, OBSERVATIONS,
    latest={
        "trace_id": ("trace_id", "string"), "parent_observation_id": ("f_parent", "string"), "type": ("event_type", "string"), "name": ("f_name", "string"),
        "start_time": ("f_start", "timestamp"), "end_time": ("f_end", "timestamp"), "input_json": ("f_input", "string"), "output_json": ("f_output", "string"),
        "usage_details_json": ("f_usage", "string"), "cost_details_json": ("f_cost_details", "string"), "total_cost": ("f_total_cost", "double"),
        "updated_at": ("event_timestamp", "timestamp"),
    },
    guarded=("trace_id", "parent_observation_id", "type", "name", "usage_details_json", "cost_details_json"),
)
SCORE_STATE = Relation(
    "scores", "score_id", fold.score_fields, SCORES,
    latest={
        "trace_id": ("f_trace", "string"), "observation_id": ("f_observation", "string"), "session_id": ("f_session", "string"), "name": ("f_name", "string"),
        "pair": ("f_defined_pair", "struct<value: double, string_value: string>"), "data_type": ("f_data_type", "string"), "source": ("f_source", "string"),
        "comment": ("f_comment", "string"), "updated_at": ("event_timestamp", "timestamp"),
    },
    guarded=("trace_id", "observation_id", "session_id", "name", "data_type", "source", "comment"),
    # the first event's value stands, even ``{}``, until another one is defined
    first={
        **{c: (f, "string") for c, f in (
            ("trace_id", "f_trace"), ("observation_id", "f_observation"), ("session_id", "f_session"), ("name", "f_name"),
            ("data_type", "f_data_type"), ("source", "f_source"), ("comment", "f_comment"), ("metadata_json", "f_metadata"),
        )},
        "timestamp": ("f_timestamp", "timestamp"),
    },
)
RELATIONS = {r.name: r for r in (TRACE_STATE, OBSERVATION_STATE, SCORE_STATE)}


# ------------------------------------------------------------------ events → state


def _stamped(value: Column, where: Column) -> Column:
    return F.max(F.when(where, F.struct(fold.order_key().alias("o"), value.alias("v"))))


@per_context
def _aggregates(name: str) -> list[Column]:
    relation, md = RELATIONS[name], F.col("f_metadata")
    out = []
    for c, (f, _) in relation.latest.items():
        defined = F.col(f).isNotNull()
        out.append(_stamped(F.col(f), defined & (F.col(f) != "{}") if c in relation.guarded else defined).alias(f"s_{c}"))
    if relation.first:
        values = F.struct(*(F.col(f).alias(c) for c, (f, _) in relation.first.items()))
        out.append(F.min(F.struct(fold.order_key().alias("o"), values.alias("v"))).alias("s_first"))
    out += [F.min(f).alias(f"s_{c}") for c, (f, _) in relation.least.items()]
    counts = md.isNotNull() & (md != "{}")
    return [
        *out,
        F.count_if(counts).alias("md_n"),
        _stamped(md, counts).alias("md_last"),
        # metadata is JSON text, an object if it begins like one
        _stamped(md, md.isNotNull() & ~md.startswith("{")).alias("md_scalar"),
        _stamped(md, md.isNotNull()).alias("md_any"),
    ]


def _as(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def _with_paths(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` without paths, joined to those of ``entries`` (some keys, any number of
    entries for a path)."""
    entry = F.struct("path", "last", "leaf", "last_leaf", "last_object")
    paths = merge_entries(entries, KEY).groupBy(*KEY).agg(F.collect_list(entry).alias("_paths"))
    return rows.join(paths, KEY, "left")


def state_of(raw: DataFrame, name: str) -> DataFrame:
    """State rows of the keys that some raw-log rows touch."""
    relation = RELATIONS[name]
    events = relation.fields(raw)
    if name == "scores":
        events = events.withColumn("f_defined_pair", F.when(F.col("f_value_defined"), F.col("f_value_pair")))
    events = events.drop("id").withColumnRenamed(relation.id, "id")
    rows = events.groupBy(*KEY).agg(*_aggregates(name))
    # only keys with several values are looked at again
    several = events.join(rows.where("md_n > 1").select(*KEY), KEY, "left_semi").select(*KEY, "f_metadata", fold.order_key().alias("_ord"))
    out = _with_paths(rows, object_entries(several, KEY, "f_metadata", "_ord")).withColumnRenamed("_paths", "md_paths")
    return _as(out, relation.state_schema)


# ------------------------------------------------------------------ state + state


def merge(state: DataFrame, name: str) -> DataFrame:
    """One row per key from state rows of any number of batches."""
    relation = RELATIONS[name]
    kept = [f"s_{c}" for c in relation.latest] + [f"md_{c}" for c in ("last", "scalar", "any")]
    aggregates = [F.max(c).alias(c) for c in kept]
    aggregates += [F.min(f"s_{c}").alias(f"s_{c}") for c in relation.least]
    if relation.first:
        aggregates.append(F.min("s_first").alias("s_first"))
    # the paths of the one row that has some, or those of all rows put together
    aggregates += [F.sum("md_n").alias("md_n"), F.count_if(F.col("md_n") > 0).alias("_md_rows"), F.max_by("md_paths", "md_n").alias("_one")]
    rows = state.groupBy(*KEY).agg(*aggregates)
    several = state.where("md_n > 0").join(rows.where("_md_rows > 1").select(*KEY), KEY, "left_semi")
    single = several.where("md_n = 1").select(*KEY, F.col("md_last.o").alias("_ord"), F.col("md_last.v").alias("_text"))
    entries = several.where("md_n > 1").select(*KEY, F.explode("md_paths").alias("_e")).select(*KEY, "_e.path", "_e.last", "_e.leaf", "_e.last_leaf", "_e.last_object")
    entries = entries.unionByName(object_entries(single, KEY, "_text", "_ord"))
    out = _with_paths(rows, entries).withColumn("md_paths", F.when(F.col("_md_rows") > 1, F.col("_paths")).otherwise(F.col("_one")))
    return _as(out, relation.state_schema)


# ------------------------------------------------------------------ state → relation


def finish(state: DataFrame, name: str) -> DataFrame:
    """Rows of the relation (traces without cost) from merged state rows."""
    relation = RELATIONS[name]
    latest = lambda c: F.col(f"s_{c}.v")
    value = {c: F.coalesce(latest(c), F.col(f"s_first.v.{c}")) if c in relation.first else latest(c) for c in relation.latest}
    value |= {c: F.col(f"s_{c}") for c in relation.least} | {c: F.col(f"s_first.v.{c}") for c in relation.first if c not in relation.latest}
    # an object is put together from its paths only where several values have met
    merged = F.coalesce(F.when(F.size("md_paths") > 0, F.col("_object")), F.col("md_scalar.v"), F.col("md_any.v"))
    value["metadata_json"] = F.coalesce(F.when(F.col("md_n") > 1, merged).otherwise(F.col("md_last.v")), value.get("metadata_json", F.lit(None)))
    if name == "scores":
        value |= {"value": latest("pair")["value"], "string_value": latest("pair")["string_value"], "source": F.coalesce(value["source"], F.lit(fold.DEFAULT_SCORE_SOURCE))}
    value |= {c: F.col(c) for c in KEY}
    rows = state.withColumn("_object", assembled(F.coalesce("md_paths", F.array().cast(ENTRIES))))
    return rows.select(*(value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in relation.schema))


def observation_costs(state: DataFrame) -> DataFrame:
    """id, trace_id and total_cost of observations, from the two fields alone."""
    rows = state.groupBy(*KEY).agg(F.max("s_trace_id").alias("t"), F.max("s_total_cost").alias("c"))
    return rows.select(*KEY, F.col("t.v").alias("trace_id"), F.col("c.v").alias("total_cost"))
