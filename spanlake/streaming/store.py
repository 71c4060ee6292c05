"""The state a sync keeps: parts that merge, and one record that names them.

Layout under ``root``:
  raw/<id>/                   raw-log rows of one commit
  ids/<id>/bucket=<b>/        project and event id of the same rows
  ledger/<id>/bucket=<b>/     objects and manifests processed by one commit
  <table>/<id>/bucket=<b>/    state rows (``operators.partial``) of a batch's keys, by id
  ids-filter/<id>/, ledger-filter/<id>/   membership filter of a part
  _commits/<n>.json           the record

A commit adds parts made from its batch alone and publishes a record that names them:
it reads no raw rows and rewrites no state. State rows of one key merge in any order
and grouping, so readers put the parts together, and ``compact`` does the same for
good: as soon as ``FANOUT`` parts of about one size have come together they become
one, in a record of its own. A table thus has a number of parts that grows with the
logarithm of its size, and every row is rewritten as often as that.

Each part has as many hash buckets as its bytes ask for, a power of two, so a bucket of
a part with n buckets splits into two of one with 2n; a key's bucket in any part is
known from its hash.

Whether a key is already there (``known``) is asked of the filters first: a filter
is a table of 64-bit words, a key sets ``FILTER_BITS`` bits of the word that its hash
names. Only keys whose bits are all set are looked up in the part, in their buckets.

Readers see all of a commit or nothing, and what a failed attempt leaves behind is
named by no record. The last ``KEEP_RECORDS`` records stay readable; parts that only
older ones name are deleted with them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import schema
from spanlake.operators import fold, partial

IDS = "project_id string, event_id string"
LEDGER = "kind string, key string, manifest_key string"
FILTER = "word bigint, bits bigint"
#: What names a row of each bucketed table.
KEYS = {"ids": ["project_id", "event_id"], "ledger": ["kind", "key"]} | {name: partial.KEY for name in partial.RELATIONS}
FILTERED = ("ids", "ledger")
TABLES = ("raw", *KEYS)

#: Bytes of a part for each of its buckets.
BUCKET_BYTES = 32 << 20
#: Parts of one size that are merged into one, and the step from one size to the next.
FANOUT = 4
#: Parts of fewer bytes count as of one size.
LEAST_BYTES = 64 << 10
KEEP_RECORDS = 8
#: A filter has a word for so many keys, of which each sets so many bits.
KEYS_PER_WORD, FILTER_BITS = 4, 6


class ConcurrentCommit(RuntimeError):
    """Another commit was published meanwhile."""


def schema_of(name: str):
    if name in partial.RELATIONS:
        return partial.RELATIONS[name].state_schema
    return {"raw": schema.EVENTS_RAW, "ids": IDS, "ledger": LEDGER}[name]


def size_class(n_bytes: int) -> int:
    level = 0
    while n_bytes >= LEAST_BYTES * FANOUT**level:
        level += 1
    return level


def _word(keys: list[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(words))


def _masked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_mask``, the bits that a key sets: each six bits of a hash name one."""
    bits = (f"shiftleft(1L, cast(shiftrightunsigned(_h, {6 * i}) & 63 as int))" for i in range(FILTER_BITS))
    return rows.withColumn("_h", F.xxhash64(F.lit("bits"), *keys)).withColumn("_mask", F.expr(" | ".join(bits))).drop("_h")


class StateStore:
    """Tables under ``root``; a part has at least ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 1, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.least_buckets, self.bucket_bytes = spark, root.rstrip("/"), buckets, bucket_bytes

    # ------------------------------------------------------------ records

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _records(self) -> list[int]:
        fs, folder = self._path("_commits")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and not x.startswith("."))

    def record(self, n: int | None = None) -> dict:
        """The last commit's record, or that of commit ``n``."""
        found = self._records() if n is None else [n]
        if not found:
            return {"n": 0, "parts": {name: [] for name in TABLES}, "counters": {}, "watermark": {}}
        fs, path = self._path(f"_commits/{found[-1]:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, record: dict, expected: int) -> None:
        """Make ``record`` the last one, if ``expected`` still is.

        Of several writers one wins: the name is given by a hard link on a local file
        system, by a rename elsewhere, and either fails where the name is taken.
        """
        name = f"{expected + 1:012d}.json"
        fs, temporary = self._path(f"_commits/.{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps(record | {"n": expected + 1}).encode()))
        out.close()
        _, final = self._path(f"_commits/{name}")
        try:
            if fs.getUri().getScheme() == "file":
                as_file = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.spark._jvm.java.nio.file.Files.createLink(as_file(final), as_file(temporary))
                except Py4JJavaError as e:
                    if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                        raise
                    raise ConcurrentCommit(f"commit {name} was published by another writer") from e
            elif not fs.rename(temporary, final):
                raise ConcurrentCommit(f"commit {name} was published by another writer")
        finally:
            fs.delete(temporary, False)

    def discard(self, name: str) -> None:
        """Delete a folder."""
        fs, folder = self._path(name)
        fs.delete(folder, True)

    def vacuum(self, keep: int = KEEP_RECORDS) -> None:
        """Delete all records but the last ``keep``, and the parts that only they name."""
        found = self._records()
        for n, after in zip(found[:-keep], found[1:]):
            old, new = self.record(n)["parts"], self.record(after)["parts"]
            for name in TABLES:
                still = {p["id"] for p in new[name]}
                for p in old[name]:
                    if p["id"] not in still:
                        self.discard(f"{name}/{p['id']}")
                        self.discard(f"{name}-filter/{p['id']}")
            self.discard(f"_commits/{n:012d}.json")

    # ------------------------------------------------------------ parts

    def written_bytes(self, name: str) -> int:
        fs, folder = self._path(name)
        return fs.getContentSummary(folder).getLength()

    def put(self, name: str, rows: DataFrame, n_bytes: int) -> dict:
        """Write rows as a new part of a table; ``n_bytes`` is what they will take, about."""
        part = uuid.uuid4().hex
        if name == "raw":
            rows.write.parquet(f"{self.root}/raw/{part}")
            return {"id": part, "bytes": self.written_bytes(f"raw/{part}")}
        buckets = 1
        while buckets < self.least_buckets or buckets * self.bucket_bytes < n_bytes:
            buckets *= 2
        rows = rows.withColumn("bucket", self._bucket(name, buckets)).repartitionById(buckets, F.col("bucket"))
        rows.sortWithinPartitions("bucket", *KEYS[name]).write.partitionBy("bucket").parquet(f"{self.root}/{name}/{part}")
        entry = {"id": part, "buckets": buckets, "bytes": self.written_bytes(f"{name}/{part}")}
        if name in FILTERED:
            keys = self.part(name, entry).select(*KEYS[name])
            entry["words"] = max(1, keys.count() // KEYS_PER_WORD)
            words = _masked(keys, KEYS[name]).groupBy(_word(KEYS[name], entry["words"]).alias("word")).agg(F.bit_or("_mask").alias("bits"))
            words.write.parquet(f"{self.root}/{name}-filter/{part}")
        return entry

    @staticmethod
    def _bucket(name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], schema_of(name))
        # (folders of buckets are no partitions to a reader of several parts)
        return self.spark.read.schema(empty.schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else empty

    def part(self, name: str, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a part, or of some of its buckets."""
        folder = f"{self.root}/{name}/{entry['id']}"
        if buckets is None:
            return self._read(name, [folder])
        fs, path = self._path(f"{name}/{entry['id']}")
        there = {x.getPath().getName() for x in fs.listStatus(path)}
        return self._read(name, [f"{folder}/bucket={b}" for b in buckets if f"bucket={b}" in there])

    def rows(self, name: str, record: dict | None = None) -> DataFrame:
        """Rows of all parts of a table."""
        return self._read(name, [f"{self.root}/{name}/{p['id']}" for p in (record or self.record())["parts"][name]])

    def read_raw(self) -> DataFrame:
        return self.rows("raw")

    def ledger(self, record: dict | None = None) -> DataFrame:
        """Objects and manifests that have been processed (kind, key, manifest_key)."""
        return self.rows("ledger", record)

    # ------------------------------------------------------------ state

    def state(self, name: str, record: dict | None = None) -> DataFrame:
        """State rows of a relation, one per key."""
        record = record or self.record()
        rows = self.rows(name, record)
        return partial.merge(rows, name) if len(record["parts"][name]) > 1 else rows

    def read(self, name: str) -> DataFrame:
        """A relation as it is after the last commit. Trace costs are sums over two
        fields of the observations."""
        record = self.record()
        rows = partial.finish(self.state(name, record), name)
        if name != "traces":
            return rows
        return fold.rollup_trace_costs(rows, partial.observation_costs(self.rows("observations", record)))

    def get(self, name: str, project_id: str, id_: str) -> DataFrame:
        """The row of one key (a trace without its cost): one bucket of each part is read."""
        key = self.spark.createDataFrame([(project_id, id_)], "project_id string, id string")
        parts = self.record()["parts"][name]
        at = key.select(*(self._bucket(name, p["buckets"]) for p in parts)).first() if parts else ()
        found = self._read(name, [])
        for p, bucket in zip(parts, at):
            found = found.unionByName(self.part(name, p, [bucket]))
        found = found.where((F.col("project_id") == project_id) & (F.col("id") == id_))
        return partial.finish(partial.merge(found, name), name)

    # ------------------------------------------------------------ membership

    def known(self, name: str, rows: DataFrame, record: dict, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame | None:
        """Which of the keys of ``rows`` a table has; none if no filter lets any pass.

        ``keep(df, name)`` writes an intermediate table and reads it back.
        """
        keys, parts = KEYS[name], record["parts"][name]
        probe, passed = _masked(rows.select(*keys), keys), None
        for i, p in enumerate(parts):
            words = self.spark.read.schema(FILTER).parquet(f"{self.root}/{name}-filter/{p['id']}")
            hit = probe.withColumn("word", _word(keys, p["words"])).join(words, "word").where(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
            hit = hit.select(*keys, F.lit(i).alias("_part"), self._bucket(name, p["buckets"]).alias("_bucket"))
            passed = hit if passed is None else passed.unionByName(hit)
        if passed is None:
            return None
        passed = keep(passed, f"{name}-passed")
        touched: dict[int, list[int]] = {}
        for r in passed.select("_part", "_bucket").distinct().collect():  # at most all buckets
            touched.setdefault(r["_part"], []).append(r["_bucket"])
        if not touched:
            return None
        found = self._read(name, [])
        for i, buckets in sorted(touched.items()):
            found = found.unionByName(self.part(name, parts[i], buckets))
        return keep(found.select(*keys).join(passed.select(*keys), keys, "left_semi").distinct(), f"{name}-known")

    # ------------------------------------------------------------ compaction

    def compact(self) -> bool:
        """Merge parts of about one size; whether there were any."""
        record = self.record()
        new = {name: list(parts) for name, parts in record["parts"].items()}
        for name, parts in record["parts"].items():
            by_size: dict[int, list[dict]] = {}
            for p in parts:
                by_size.setdefault(size_class(p["bytes"]), []).append(p)
            for group in by_size.values():
                if len(group) < FANOUT:
                    continue
                rows = self._read(name, [f"{self.root}/{name}/{p['id']}" for p in group])
                if name in partial.RELATIONS:
                    rows = partial.merge(rows, name)
                elif name == "raw":
                    # as many files as the bytes ask for
                    rows = rows.coalesce(max(1, -(-sum(p["bytes"] for p in group) // self.bucket_bytes)))
                merged = self.put(name, rows, sum(p["bytes"] for p in group))
                gone = {p["id"] for p in group}
                new[name] = [p for p in new[name] if p["id"] not in gone] + [merged]
        if new == record["parts"]:
            return False
        self.publish(record | {"parts": new}, record["n"])
        return True


def at_once(tasks: dict[str, Callable[[], dict]], threads: int = 4) -> dict[str, dict]:
    """Results of independent writes, run side by side; the first failure is raised."""
    with ThreadPoolExecutor(threads) as pool:
        running = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: f.result() for name, f in running.items()}
