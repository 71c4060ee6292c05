"""Incremental, replay-safe sync: stored objects → raw log → current state.

Two Structured Streaming file sources (OTLP batches and manifests) feed
``foreachBatch``. A micro-batch leaves out objects that the ledger has, maps the
rest to raw-log rows with deterministic event ids, skips event ids already stored,
folds what is new into state rows of its own, and publishes one commit record
(``streaming.store``): raw rows, state, ledger, counters and watermark become visible
together. A batch that fails at any step leaves no trace, and one that is replayed
after its commit finds its objects in the ledger.

A commit's cost follows its batch: no raw row, state row or cost of earlier commits is
read, and of the stored ids only the filters' words and what passes them; the ledger of
objects is joined whole.
"""

from __future__ import annotations

import contextlib
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import otlp, partial, raw, store
from spanlake.schema import SCORE_CREATE, TRACE_CREATE
from spanlake.sources import files
from spanlake.streaming.store import LEDGER, ConcurrentCommit, StateStore, at_once

#: Minutes by which the watermark stays behind the newest object of a commit.
FINAL_AFTER_MINUTES = 5
RELATION_KINDS = {"traces": "trace", "observations": "observation", "scores": "score"}
COUNTERS = ("events", "objects", "objects_skipped", "manifests", "manifests_skipped")


def fold_kind() -> Column:
    t = F.col("event_type")
    return F.when(t == TRACE_CREATE, "trace").when(t == SCORE_CREATE, "score").otherwise("observation")


def commit(
    state: StateStore,
    batch_raw: DataFrame,
    source: str = "direct",
    duplicates: str = "skip",
    processed: DataFrame | None = None,
    counters: dict | None = None,
    watermark: str | None = None,
) -> dict:
    """Fold new raw rows into the state and publish one record.

    ``processed``: ledger rows (kind, key, manifest_key) of the batch; ``counters``
    and ``watermark`` are recorded with it. Returns the batch's counters.
    """
    spark, record = state.spark, state.record()
    work = f"_work/{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{state.root}/{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{state.root}/{work}/{name}")

    batch = keep(batch_raw, "batch")
    n_bytes = state.written_bytes(f"{work}/batch")
    stored = state.known("ids", batch, record, keep)
    if duplicates == "strict":
        # an event id seen twice (in the batch or already stored) fails the whole batch
        raw.check_no_duplicates(batch, stored)
    parts = {"raw": state.put("raw", raw.dedupe_skip(batch, stored), n_bytes)}
    fresh = state.part("raw", parts["raw"])
    kinds = {r["kind"]: r["n"] for r in fresh.groupBy(fold_kind().alias("kind")).agg(F.count("*").alias("n")).collect()}
    n_fresh = sum(kinds.values())
    tasks = {}
    if n_fresh:
        tasks["ids"] = lambda: state.put("ids", fresh.select(*raw.EVENT_KEY), 40 * n_fresh)
    else:
        parts = {}
    for name, kind in RELATION_KINDS.items():
        if kinds.get(kind):
            tasks[name] = lambda name=name: state.put(name, partial.state_of(fresh, name), n_bytes)
    if processed is not None:
        tasks["ledger"] = lambda: state.put("ledger", processed, n_bytes)
    parts |= at_once(tasks)
    stats = {k: int((counters or {}).get(k, 0)) for k in COUNTERS} | {"events": n_fresh}
    new = record | {"parts": {name: old + ([parts[name]] if name in parts else []) for name, old in record["parts"].items()}}
    new["counters"] = {k: record["counters"].get(k, 0) + v for k, v in stats.items()}
    if watermark:
        new["watermark"] = record["watermark"] | {source: max(watermark, record["watermark"].get(source, watermark))}
    state.publish(new, record["n"])
    state.discard(work)
    # the batch is in; another writer that has come since will compact as well
    with contextlib.suppress(ConcurrentCommit):
        state.compact()
    state.vacuum()
    return stats | {"source": source}


class SyncJob:
    """Sync stored objects of one project into state tables.

    ``store_root``: object store root (OTLP under ``<prefix>otel/<project>/``,
    manifests under ``<prefix><project>/manifests/``); ``state_root``: where the
    state lives; ``checkpoint_root``: streaming checkpoints. With ``lines``, OTLP
    files hold one object per line with its key (``store.write_otlp_objects``).
    """

    def __init__(
        self,
        spark: SparkSession,
        store_root: str,
        project: str,
        state_root: str,
        checkpoint_root: str,
        prefix: str = "",
        max_files_per_trigger: int = 1000,
        max_file_age: str | None = None,
        lines: bool = False,
        duplicates: str = "skip",
    ):
        self.spark = spark
        self.store_root = store_root.rstrip("/") + "/"
        self.project = project
        self.prefix = store.normalize_prefix(prefix)
        self.state = StateStore(spark, state_root)
        self.checkpoint_root = checkpoint_root.rstrip("/")
        self.max_files = max_files_per_trigger
        self.max_file_age = max_file_age
        self.lines = lines
        self.duplicates = duplicates
        self.results: list[dict] = []
        self._one_commit = threading.Lock()

    def _folder(self, source: str) -> str:
        return f"{self.store_root}{self.prefix}" + (f"otel/{self.project}/" if source == "otel" else f"{self.project}/manifests/")

    def _stream(self, source: str) -> DataFrame:
        lines = self.lines and source == "otel"
        reader = self.spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(self.max_files))
        reader = reader.option("wholetext", str(not lines).lower())
        if self.max_file_age:
            reader = reader.option("maxFileAge", self.max_file_age)
        return files.documents(reader.load(self._folder(source)), self.store_root)

    def _commit_otlp(self, docs: DataFrame) -> None:
        """One micro-batch of OTLP objects."""
        with self._one_commit:
            objects = files.otlp_lines(docs) if self.lines else files.otlp_objects(docs)
            seen = objects.join(self.state.ledger().where("kind = 'object'").select(F.col("key").alias("object_key")), "object_key", "left_anti")
            events = otlp.otlp_events(seen, fallback_time=F.col("modified"))
            entity = F.coalesce(F.get_json_object(F.col("body"), "$.id"), F.col("object_key"))
            rows = raw.raw_rows(events, self.project, entity_id=entity)
            ledger = seen.select(F.lit("object").alias("kind"), F.col("object_key").alias("key"), F.lit(None).cast("string").alias("manifest_key")).distinct()
            self._finish(rows, "otel", ledger, docs, objects.select("object_key").distinct().count())

    def _commit_manifests(self, docs: DataFrame) -> None:
        """One micro-batch of manifests: the objects they name that are not processed yet."""
        with self._one_commit:
            done = self.state.ledger()
            entries = files.manifests(docs)
            new = docs.select(F.col("object_key").alias("manifest_key")).join(done.where("kind = 'manifest'").select(F.col("key").alias("manifest_key")), "manifest_key", "left_anti")
            entries = entries.join(new, "manifest_key", "left_semi").dropDuplicates(["object_key"])
            open_ = entries.join(done.where("kind = 'object'").select(F.col("key").alias("object_key")), "object_key", "left_anti")
            events = files.envelope(files.manifest_events(files.fetch(open_, self.store_root)))
            rows = raw.raw_rows(events, self.project, object_key=F.col("object_key"), manifest_key=F.col("manifest_key"), entity_id=F.col("entity_id"))
            ledger = open_.select(F.lit("object").alias("kind"), F.col("object_key").alias("key"), "manifest_key").unionByName(
                new.select(F.lit("manifest").alias("kind"), F.col("manifest_key").alias("key"), F.lit(None).cast("string").alias("manifest_key"))
            )
            self._finish(rows, "manifests", ledger, docs, entries.count())

    def _finish(self, rows: DataFrame, source: str, ledger: DataFrame, docs: DataFrame, n_objects: int) -> None:
        work = f"_work/{uuid.uuid4().hex}"
        ledger.write.parquet(f"{self.state.root}/{work}")
        processed = self.spark.read.schema(self.spark.createDataFrame([], LEDGER).schema).parquet(f"{self.state.root}/{work}")
        n = {r["kind"]: r["count"] for r in processed.groupBy("kind").count().collect()}
        n_docs = docs.count() if source == "manifests" else 0
        counters = {
            "objects": n.get("object", 0), "objects_skipped": n_objects - n.get("object", 0),
            "manifests": n.get("manifest", 0), "manifests_skipped": n_docs - n.get("manifest", 0),
        }
        newest = docs.agg(F.date_format(F.date_trunc("minute", F.max("modified")) - F.expr(f"interval {FINAL_AFTER_MINUTES} minutes"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
        self.results.append(commit(self.state, rows, source, self.duplicates, processed, counters, newest))
        self.state.discard(work)

    def run(self, available_now: bool = True, timeout: float | None = None) -> list[dict]:
        """Run both sources until caught up, or (``available_now`` false) until ``timeout``."""
        queries = []
        for source, handle in (("otel", self._commit_otlp), ("manifests", self._commit_manifests)):
            if not _exists(self.spark, self._folder(source)):
                continue
            writer = self._stream(source).writeStream.foreachBatch(lambda batch, epoch, handle=handle: handle(batch))
            writer = writer.option("checkpointLocation", f"{self.checkpoint_root}/{source}")
            queries.append((writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start())
            if available_now:
                queries[-1].awaitTermination(timeout)
        if not available_now:
            for q in queries:
                q.awaitTermination(timeout)
        return self.results

    def rebuild(self) -> list[dict]:
        """Fold all stored objects in one batch per source (into an empty state)."""
        for source, handle in (("otel", self._commit_otlp), ("manifests", self._commit_manifests)):
            if _exists(self.spark, self._folder(source)):
                handle(files.read_documents(self.spark, self._folder(source), self.store_root, lines=self.lines and source == "otel"))
        return self.results


def append_events(state: StateStore, events: DataFrame, project: str) -> dict:
    """Direct append (K7): accepted envelope rows into raw log and state; rows
    processed and skipped (ids already stored, or repeated in the batch)."""
    rows = raw.raw_rows(events, project)
    n = rows.count()
    stats = commit(state, rows, "direct")
    return {"processed": stats["events"], "skipped": n - stats["events"]}


def append_otlp(state: StateStore, objects: DataFrame, project: str) -> dict:
    """Direct append of OTLP objects (K8): (object_key, resource_spans)."""
    events = otlp.otlp_events(objects)
    entity = F.coalesce(F.get_json_object(F.col("body"), "$.id"), F.col("object_key"))
    rows = raw.raw_rows(events, project, entity_id=entity)
    n = rows.count()
    stats = commit(state, rows, "otel-direct")
    return {"processed": stats["events"], "skipped": n - stats["events"]}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
