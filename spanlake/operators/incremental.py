"""Incremental projection: which keys a batch touches, which of them already
have state, and the stored history that has to be replayed for them.

Folding ``stored history of touched keys ∪ new batch`` gives the same rows as a
full recompute, so an incremental commit only rewrites touched keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.schema import SCORE_CREATE, TRACE_CREATE

KINDS = ("trace", "observation", "score", "cost_trace")


def affected_keys(batch: DataFrame) -> DataFrame:
    """(kind, key) touched by a batch of raw rows.

    trace: trace-create trace ids; observation: observation ids of observation
    events; score: score ids; cost_trace: every referenced trace id (its cost may
    change). Empty ids never project.
    """
    t = F.col("event_type")
    is_obs = (t != TRACE_CREATE) & (t != SCORE_CREATE)
    items = F.array(
        F.when((t == TRACE_CREATE) & (F.col("trace_id") != ""), F.struct(F.lit("trace").alias("kind"), F.col("trace_id").alias("key"))),
        F.when(is_obs & (F.col("observation_id") != ""), F.struct(F.lit("observation").alias("kind"), F.col("observation_id").alias("key"))),
        F.when((t == SCORE_CREATE) & (F.col("score_id") != ""), F.struct(F.lit("score").alias("kind"), F.col("score_id").alias("key"))),
        F.when(F.col("trace_id") != "", F.struct(F.lit("cost_trace").alias("kind"), F.col("trace_id").alias("key"))),
    )
    return (
        batch.select("project_id", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("k"))
        .select("project_id", "k.kind", "k.key")
        .distinct()
    )


def existing_keys(keys: DataFrame, traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Touched keys that already have a state row (P4), plus the stored trace of
    every touched existing observation (a re-parented observation changes the
    cost of its old trace too)."""
    def probe(kind: str, table: DataFrame) -> DataFrame:
        k = keys.where(F.col("kind") == kind)
        return k.join(table.select("project_id", F.col("id").alias("key")), ["project_id", "key"], "left_semi")

    existing_obs = probe("observation", observations)
    old_traces = (
        existing_obs.join(
            observations.select("project_id", F.col("id").alias("key"), F.col("trace_id").alias("old_trace")),
            ["project_id", "key"],
        )
        .where(F.col("old_trace").isNotNull())
        .select("project_id", F.lit("cost_trace").alias("kind"), F.col("old_trace").alias("key"))
    )
    return (
        probe("trace", traces)
        .unionByName(existing_obs)
        .unionByName(probe("score", scores))
        .unionByName(old_traces)
        .distinct()
    )


def replay_history(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored raw events of touched existing keys (P5), tagged with kind/key."""
    t = F.col("event_type")
    is_obs = (t != TRACE_CREATE) & (t != SCORE_CREATE)
    parts = []
    for kind, key_col, cond in (
        ("trace", "trace_id", t == TRACE_CREATE),
        ("observation", "observation_id", is_obs),
        ("score", "score_id", t == SCORE_CREATE),
    ):
        k = keys.where(F.col("kind") == kind).select("project_id", F.col("key").alias(key_col))
        parts.append(
            stored.where(cond)
            .join(k, ["project_id", key_col], "left_semi")
            .select("*", F.lit(kind).alias("kind"), F.col(key_col).alias("key"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
