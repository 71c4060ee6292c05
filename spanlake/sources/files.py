"""File sources: stored OTLP batches, OTLP export requests, ingestion event
batches, batch manifests and the entity objects they name.

Objects are JSON documents. They are read whole (``wholetext``: one row per
file, the layout the objects are written in by other producers) or one per line
(``lines``: the layout this package's writers produce). ``.gz`` files are
decompressed by the reader. ``object_key`` is the path relative to the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.json import is_array, is_string, vget
from spanlake.operators.store import normalize_prefix
from spanlake.schema import MANIFEST


def _plain(path: str) -> str:
    """A path without the scheme of the local file system."""
    return re.sub(r"^file:/+", "/", path)


def relative_key(path_col: Column, root: str) -> Column:
    """Object key of a file: its path below ``root``, as it is spelt (file paths
    come percent-encoded; ``+`` stands for itself)."""
    below = _plain(normalize_prefix(root))
    plain = F.url_decode(F.replace(F.regexp_replace(path_col, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    return F.when(plain.startswith(below), F.substr(plain, F.lit(len(below) + 1))).otherwise(plain)


def documents(rows: DataFrame, root: str) -> DataFrame:
    """(object_key, content, modified) of rows of the text source."""
    return rows.select(
        relative_key(F.col("_metadata.file_path"), root).alias("object_key"),
        F.col("value").alias("content"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def read_documents(spark: SparkSession, folder: str, root: str | None = None, lines: bool = False) -> DataFrame:
    """(object_key, content, modified) for every file below ``folder``; keys are
    relative to ``root`` (default: the folder)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("wholetext", str(not lines).lower())
    return documents(reader.text(folder), root or folder)


def fetch(entries: DataFrame, root: str) -> DataFrame:
    """``entries`` with the ``content`` of the object that ``object_key`` names below
    ``root``. Keys are taken literally; an object that is missing is an error."""
    names = entries.columns
    base = root if "://" in root else "file://" + _plain(root)

    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(base.rstrip("/").replace("%", "%25").replace(" ", "%20"))
        for batch in batches:
            texts = []
            for key in batch.column("object_key").to_pylist():
                with fs.open_input_stream(f"{top}/{key}", compression="detect") as f:
                    texts.append(f.read().decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "content"])

    return entries.mapInArrow(get, T.StructType([*entries.schema, T.StructField("content", T.StringType())]))


def unreadable(what: str) -> Column:
    """Fails the job: an object that cannot be read must not count as processed."""
    return F.raise_error(F.concat(F.lit(f"unreadable {what}: "), F.coalesce(F.col("object_key"), F.lit("?")))).cast("string").cast("variant")


def parse_errors(docs: DataFrame) -> DataFrame:
    """Keys of documents that are not JSON, for a look before a sync that fails on them."""
    return docs.where(F.try_parse_json("content").isNull()).select("object_key", "modified", F.length("content").alias("n_chars"))


def otlp_objects(docs: DataFrame) -> DataFrame:
    """Stored OTLP batches: each document is a JSON array of resourceSpans."""
    v = F.try_parse_json(F.col("content"))
    return docs.select("object_key", "modified", F.when(is_array(v), v).otherwise(unreadable("OTLP object")).alias("resource_spans"))


def otlp_lines(docs: DataFrame) -> DataFrame:
    """Objects of a file with one ``{"key": ..., "resourceSpans": [...]}`` per line."""
    v = F.try_parse_json(F.col("content"))
    key, spans = F.try_variant_get(v, "$.key", "string"), vget(v, "$.resourceSpans")
    good = key.isNotNull() & is_array(spans)
    return docs.select(key.alias("object_key"), "modified", F.when(good, spans).otherwise(unreadable("OTLP line in")).alias("resource_spans"))


def otlp_window(spark: SparkSession, root: str, project: str, since: str, until: str, prefix: str = "") -> DataFrame:
    """OTLP objects that ``store.write_otlp_objects`` wrote in minutes [since, until)
    (UTC ISO text). The time parts are partition columns: other folders are not read (S4)."""
    docs = spark.read.text(f"{normalize_prefix(root)}{normalize_prefix(prefix)}otel/{project}")
    minute = F.make_timestamp(*[F.col(c).cast("int") for c in ("year", "month", "day", "hour", "minute")], F.lit(0))
    within = (minute >= F.lit(since).cast("timestamp")) & (minute < F.lit(until).cast("timestamp"))
    docs = docs.where(within)
    return otlp_lines(docs.select(F.col("_metadata.file_path").alias("object_key"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified")))


def otlp_requests(docs: DataFrame) -> DataFrame:
    """OTLP/JSON export requests ``{resourceSpans: [...]}``; an empty or missing
    list yields no object (S6)."""
    v = F.try_parse_json(F.col("content"))
    rs = vget(F.when(v.isNotNull(), v).otherwise(unreadable("OTLP request")), "$.resourceSpans")
    return docs.select("object_key", "modified", F.when(is_array(rs), rs).alias("resource_spans")).where(
        F.size(F.col("resource_spans").try_cast("array<variant>")) > 0
    )


def event_batches(docs: DataFrame) -> DataFrame:
    """Ingestion batches ``{batch: [...], metadata?}``: one row per element with
    its position; elements may be anything, validation decides (S5). A document that
    is not such a batch fails the job."""
    batch = vget(F.try_parse_json(F.col("content")), "$.batch")
    events = F.when(is_array(batch), batch).otherwise(unreadable("event batch")).cast("array<variant>")
    return docs.select("object_key", "modified", F.posexplode(events).alias("pos", "event"))


def manifests(docs: DataFrame) -> DataFrame:
    """Batch manifests exploded to one row per named entity object."""
    v = F.try_parse_json(F.col("content"))
    good = is_array(vget(v, "$.objects")) & is_string(vget(v, "$.batchId"))
    text = F.when(good, F.col("content")).otherwise(unreadable("manifest").cast("string"))
    m = F.from_json(text, MANIFEST)
    return docs.select(F.col("object_key").alias("manifest_key"), "modified", m.alias("m")).select(
        "manifest_key", "modified", F.col("m.batchId").alias("batch_id"), F.col("m.projectId").alias("project_id"),
        F.explode("m.objects").alias("o"),
    ).select(
        "manifest_key", "modified", "batch_id", "project_id",
        F.col("o.key").alias("object_key"), F.col("o.entityType").alias("entity_type"), F.col("o.entityId").alias("entity_id"),
    )


def manifest_events(objects: DataFrame) -> DataFrame:
    """Events of the entity objects named by manifests (S3): only named objects
    are used (the manifest is the commit marker); the entity id comes from the
    manifest entry. ``objects``: manifest entries with the object's content."""
    v = F.try_parse_json("content")
    events = F.when(is_array(v), v).otherwise(unreadable("entity object")).cast("array<variant>")
    return objects.select("manifest_key", "object_key", "entity_id", F.posexplode(events).alias("pos", "event"))


def envelope(events: DataFrame, event_col: str = "event") -> DataFrame:
    """VARIANT events → (id, timestamp, type, body text) without validation
    (stored entity objects hold already accepted events)."""
    e = F.col(event_col)
    return events.select(
        "*",
        F.try_variant_get(e, "$.id", "string").alias("id"),
        F.try_variant_get(e, "$.timestamp", "string").alias("timestamp"),
        F.try_variant_get(e, "$.type", "string").alias("type"),
        F.to_json(vget(e, "$.body")).alias("body"),
    ).drop(event_col)
