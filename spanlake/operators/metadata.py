"""Merge of metadata objects (P16), path by path.

Of a key's values in event order, later ones win: objects merge at any depth, any
other value replaces what it meets. Values that are not objects count only while
no non-empty object has come, and empty objects only if nothing else came.

Each object is flattened into its paths; a path is a leaf (a scalar, an array or
null) or an object. Per (key, path) the latest entry wins, so one aggregation with
map-side partial results settles all of them: no key's values are ever gathered.
What an object held before something else replaced it must not come back: a path
is dropped when an ancestor was a leaf later than the path's own last entry. Only
paths that have been both leaf and object can do that; they are looked up within the
rows of their key, which come together once, for this and for the document.
The surviving paths, which make up one document per key, are put together again.

Objects of scalars whose text needs no escape are taken apart and put together by
column expressions; only others go through Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATHS = "array<struct<path: array<string>, leaf: string>>"

_STRING = r'"[^"\\\x00-\x1f]*+"'
_SCALAR = rf"(?:{_STRING}|-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null)"
#: A compact object of scalars without escapes, and one of its pairs.
FLAT = rf"^\{{{_STRING}:{_SCALAR}(?:,{_STRING}:{_SCALAR})*+\}}\z"
PAIR = r'"([^"]*+)":("[^"]*+"|[^,}]++)'
#: Longer texts go through Python (a pattern's repeats use the stack).
FLAT_LENGTH = 2000


class _Number(str):
    """A number as it was written."""


def _dump(value) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, list):
        return f"[{','.join(map(_dump, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(value[k])}" for k in sorted(value)) + "}"
    return json.dumps(value, ensure_ascii=False)


def flatten(text: str) -> list[tuple[list[str], str | None]]:
    """Paths below the top of an object: leaves as JSON text, objects as null."""
    out, work = [], [([], json.loads(text, parse_int=_Number, parse_float=_Number))]
    while work:
        path, value = work.pop()
        if isinstance(value, dict):
            out.append((path, None))
            work += [([*path, k], v) for k, v in value.items()]
        else:
            out.append((path, _dump(value)))
    return out[1:]


def assemble(paths: list[tuple[list[str], str | None]]) -> str:
    """Object text (sorted keys) from paths; parents may be missing from the list."""
    root: dict = {}
    for path, leaf in sorted(paths, key=lambda x: len(x[0])):
        node = root
        for k in path[:-1]:
            node = node.setdefault(k, {})
        if leaf is not None:
            node[path[-1]] = _Leaf(leaf)
        else:
            node.setdefault(path[-1], {})
    out: list[str] = []
    work: list = [root]  # texts and nodes still to be written, last first
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        parts: list = ["{"]
        for i, k in enumerate(sorted(item)):
            parts += [("," if i else "") + json.dumps(k, ensure_ascii=False) + ":", item[k]]
        work += reversed([*parts, "}"])
    return "".join(out)


class _Leaf(str):
    """JSON text of a leaf."""


def _flatten(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda t: None if t is None else [{"path": p, "leaf": x} for p, x in flatten(t)])


def _assemble(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in paths:
        yield series.map(lambda rows: None if rows is None else assemble([(list(r["path"]), r["leaf"]) for r in rows]))


def is_object_text(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def object_entries(values: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """An entry per path of each non-empty object: ``keys``, its ``path``, the ``last``
    order at which it was set and its ``leaf`` then, and the last orders at which it
    was a leaf and an object."""
    value = F.col(text)
    flat = F.coalesce((F.length(value) <= FLAT_LENGTH) & value.rlike(FLAT), F.lit(False))
    names, leaves = (F.regexp_extract_all(value, F.lit(PAIR), F.lit(i)) for i in (1, 2))
    # (a name that comes twice keeps its last value)
    pairs = F.map_entries(F.map_from_arrays(names, leaves))
    cut = F.transform(pairs, lambda e: F.struct(F.array(e["key"]).alias("path"), e["value"].alias("leaf")))
    nested = F.when(~flat & is_object_text(value) & (F.size(F.json_object_keys(text)) > 0), value)
    cut_up = F.pandas_udf(_flatten, PATHS)
    both = values.select(*keys, F.col(order).alias("last"), F.when(flat, cut).alias("_flat"), cut_up(nested).alias("_nested"))
    paths = both.select(*keys, "last", F.explode(F.coalesce("_flat", "_nested")).alias("_p"))
    is_leaf = F.col("_p.leaf").isNotNull()
    return paths.select(
        *keys, F.col("_p.path").alias("path"), "last", F.col("_p.leaf").alias("leaf"),
        F.when(is_leaf, F.col("last")).alias("last_leaf"), F.when(~is_leaf, F.col("last")).alias("last_object"),
    )


def merge_entries(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One entry per (key, path), without the paths that an ancestor's leaf has cut
    off. Entries merge in any grouping: a path that is cut off stays cut off, whatever
    comes later, unless it is set again."""
    last = entries.groupBy(*keys, "path").agg(
        F.max("last").alias("last"),
        F.max_by(F.struct("leaf"), "last")["leaf"].alias("leaf"),
        F.max("last_leaf").alias("last_leaf"),
        F.max("last_object").alias("last_object"),
    )
    both = F.col("last_leaf").isNotNull() & F.col("last_object").isNotNull()
    barrier = F.when(both, F.struct(F.col("path"), F.col("last_leaf").alias("cut")))
    last = last.withColumn("_barriers", F.collect_list(barrier).over(Window.partitionBy(*keys)))
    # a path whose parent ends as a leaf goes as well: its last entry is older than the leaf
    above = lambda b: (F.size(b["path"]) < F.size("path")) & (F.slice("path", F.lit(1), F.size(b["path"])) == b["path"])
    dead = F.exists("_barriers", lambda b: above(b) & (b["cut"] > F.col("last")))
    return last.where((F.size("path") == 1) | (F.size("_barriers") == 0) | ~dead).drop("_barriers")


def assembled(paths: Column) -> Column:
    """Object text from an array of entries."""
    put_together = F.pandas_udf(_assemble, "string")
    rows = F.transform(paths, lambda p: F.struct(p["path"].alias("path"), p["leaf"].alias("leaf")))
    plain = F.forall(rows, lambda p: (F.size(p["path"]) == 1) & p["leaf"].isNotNull() & p["path"][0].rlike(r'^[^"\\\x00-\x1f]*+\z'))
    pairs = F.transform(F.sort_array(rows), lambda p: F.concat(F.lit('"'), p["path"][0], F.lit('":'), p["leaf"]))
    text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return F.coalesce(F.when(plain, text), put_together(F.when(~plain, rows)))


def merged_objects(values: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """``keys`` and ``_merged``, the merge of each key's non-empty objects; other keys
    are left out."""
    alive = merge_entries(object_entries(values, keys, text, order), keys)
    merged = alive.groupBy(*keys).agg(F.collect_list(F.struct("path", "leaf")).alias("_paths"))
    return merged.select(*keys, assembled(F.col("_paths")).alias("_merged"))


def merge_metadata(values: DataFrame, keys: list[str], text: str, order: Column) -> DataFrame:
    """``keys`` and ``metadata_json``, the merge of each key's ``text`` values in ``order``."""
    rows = values.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), order.alias("_ord"))
    merged = merged_objects(rows, keys, "_text", "_ord")
    # without a non-empty object: the last value that is not an object, else the empty one
    plain = rows.groupBy(*keys).agg(
        F.max_by(F.col("_text"), F.when(~is_object_text(F.col("_text")), F.col("_ord"))).alias("_scalar"), F.max_by("_text", "_ord").alias("_any")
    )
    out = plain.join(merged, keys, "left")
    return out.select(*keys, F.coalesce("_merged", "_scalar", "_any").alias("metadata_json"))
