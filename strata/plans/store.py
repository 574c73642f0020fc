"""A durable key-value store: log batches, sorted runs and manifest versions in one folder of any store that Spark reaches.

Writing appends a batch to the log and publishes a manifest version that names it; a write is acknowledged when that is done. A flush
reduces the batches to a sorted run, a compaction merges all runs to one. Reads are DataFrames over the files of one version, so a
snapshot stays as it is while others write. There is one writer at a time; a second one gets a Conflict and may try again.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata import log
from strata.functions import record
from strata.operators import lww
from strata.schema import CLEAR, LOG, PUT, REMOVE
from strata.sources.files import Files
from strata.sources.manifest import Batch, Manifest, Manifests, Run

BLOOM_LIMIT = 1_000_000  # distinct keys that a row group's Bloom filter is made for at most


class SyncMode(Enum):
    """What an acknowledgement waits for. A committed file is the only way here; the others are accepted and mean the same."""

    NONE = 0
    FDATASYNC = 1
    FSYNC = 2


@dataclass(frozen=True)
class WalOptions:
    """Group commit of single writes: they wait in memory until one of the limits is reached. A commit that fails keeps them for the next one."""

    group_commit: bool = False
    max_buffer_bytes: int = 256 * 1024
    max_records: int = 1024
    max_interval_ms: float = 10.0  # that a write waits at most
    sync_mode: SyncMode = SyncMode.FDATASYNC


@dataclass(frozen=True)
class Options:
    flush_entries: int = 1024 * 1024  # different keys in the log, removed ones included, at which a write is followed by a flush
    compact_runs: int | None = None  # runs at which a flush is followed by a compaction; None: never
    wal: WalOptions = WalOptions()


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.options = spark, options
        self.files = Files(spark, path)
        self.manifests = Manifests(self.files)
        self.manifest = Manifest()
        self.pending: list[tuple[str, str, str]] = []
        self.committed_at = time.monotonic()
        self._lock, self._timer = threading.RLock(), None
        self._cache: tuple[int, DataFrame] | None = None
        self.open()

    # opening and state

    def open(self, version: int | None = None) -> "Store":
        """Loads the latest version. Damage raises; nothing is skipped."""
        self.manifest = self.manifests.load(version)
        self._count_at = self.options.flush_entries
        return self

    def snapshot(self, version: int) -> DataFrame:
        """The live view of an earlier version, while compaction has kept its files."""
        return lww.live(self._rows(self.manifests.load(version))).select("k", "v")

    def set_flush_entries(self, entries: int) -> None:
        self.options = Options(entries, self.options.compact_runs, self.options.wal)
        self._count_at = entries

    def configure_wal(self, options: WalOptions) -> None:
        self.options = Options(self.options.flush_entries, self.options.compact_runs, options)

    # rows

    def _read(self, paths: Iterable[str]) -> DataFrame:
        paths = [self.files.at(p) for p in paths]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def _rows(self, m: Manifest | None = None) -> DataFrame:
        """All records that count: batches of the log and entries of runs, which keep their sequence numbers."""
        m = m or self.manifest
        return self._read([*(b.path for b in m.batches), *(r.path for r in m.runs)]).where(F.col("seq") > m.cleared_seq)

    def live(self) -> DataFrame:
        """k, v of all live keys."""
        self._commit_pending()
        return lww.live(self._rows()).select("k", "v")

    def cached(self) -> DataFrame:
        """The live view, kept in memory and on the executors' disks until a newer version is asked for."""
        self._commit_pending()
        if self._cache is None or self._cache[0] != self.manifest.version:
            if self._cache:
                self._cache[1].unpersist()
            self._cache = (self.manifest.version, self.live().persist())
        return self._cache[1]

    def keys(self) -> DataFrame:
        return self.live().select("k").orderBy("k")

    def size(self) -> int:
        return self.live().count()

    def get(self, key: str) -> str | None:
        self._commit_pending()
        row = lww.get(self._rows(), key).first()
        return None if row is None else row.v

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def multi_get(self, probes: DataFrame, ordinal: str | None = None) -> DataFrame:
        """probes (k, ...) with v, null where the key isn't live; one job for all of them."""
        self._commit_pending()
        return lww.multi_get(self._rows(), probes, ordinal)

    # writing

    def put(self, key: str, value: str) -> bool:
        """The empty value removes the key."""
        return self._write_one(PUT if value else REMOVE, key, value)

    def remove(self, key: str) -> bool:
        """False, and nothing is written, if the key isn't live."""
        return self.exists(key) and self._write_one(REMOVE, key, "")

    def clear(self) -> None:
        """Empties the store, runs included."""
        self._commit_pending()
        m, seq = self.manifest, self.manifest.last_seq + 1
        rows = self.spark.createDataFrame([(seq, CLEAR, "", "")], LOG)
        path = self._store_log(rows)
        self._publish(m.with_(last_seq=seq, cleared_seq=seq, batches=(Batch(path, seq, seq),), runs=()))

    def _write_one(self, op: str, key: str, value: str) -> bool:
        with self._lock:
            self.pending.append((op, key, value))
            wal = self.options.wal
            held = sum(record.FIXED + len(k.encode()) + len(v.encode()) for _, k, v in self.pending)
            if not wal.group_commit or len(self.pending) >= wal.max_records or held >= wal.max_buffer_bytes or (time.monotonic() - self.committed_at) * 1000 >= wal.max_interval_ms:
                try:
                    self._commit_pending()
                except Exception:
                    self.pending.pop()  # this one isn't acknowledged; those before it stay
                    raise
            elif self._timer is None:
                self._timer = threading.Timer(wal.max_interval_ms / 1000, self._commit_in_time)
                self._timer.daemon = True
                self._timer.start()
        return True

    def _commit_in_time(self) -> None:
        try:
            self._commit_pending()
        except Exception as e:  # the writes stay; the next commit tells the caller
            log.get().warning("a commit failed: %s", e)

    def _commit_pending(self) -> None:
        """Commits the writes that wait. If that fails they still do, and a later commit, after open() where another writer was faster, has them."""
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
                self._timer = None
            self.committed_at = time.monotonic()
            if rows := list(self.pending):
                first = self.manifest.last_seq + 1
                self._append(self.spark.createDataFrame([(first + i, *r) for i, r in enumerate(rows)], LOG), len(rows))
                self.pending = self.pending[len(rows) :]
                self._flush_if_full()

    def flush_log(self) -> None:
        """Commits writes that wait in memory."""
        self._commit_pending()

    def put_all(self, rows: DataFrame, ordinal: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Writes rows (k, v, or op, k, v) as one batch; gives their number.

        Sequence numbers follow ``ordinal`` (ties and no ordinal: the order of the input). ``stream`` (name, micro-batch) makes a
        repeated batch of a stream do nothing.
        """
        self._commit_pending()
        if stream and self.manifest.streams.get(stream[0], -1) >= stream[1]:
            return 0
        rows = rows.withColumn("__order", F.struct(*([ordinal] if ordinal else []), F.monotonically_increasing_id().alias("i")))
        op = F.col("op") if "op" in rows.columns else F.lit(PUT)
        v = F.when(op == PUT, F.coalesce("v", F.lit(""))).otherwise("")
        shaped = rows.select("__order", F.when(v == "", F.when(op == CLEAR, op).otherwise(REMOVE)).otherwise(op).alias("op"), F.col("k").cast("string").alias("k"), v.cast("string").alias("v"))
        draft = f"log/draft-{uuid.uuid4().hex}"
        # a stored draft keeps the order while it is numbered: places within partitions, and a running sum over partitions
        sorted_rows = shaped.sort("__order") if ordinal else shaped
        sorted_rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop("__order").write.parquet(self.files.at(draft))
        stored = self.spark.read.parquet(self.files.at(draft))
        # one row per partition of the batch
        parts = stored.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect()
        n, shifts = 0, []
        for p in parts:
            shifts.append((p.part, self.manifest.last_seq + 1 + n - p.first))
            n += p.n
        numbered = stored.join(F.broadcast(self.spark.createDataFrame(shifts, "part int, shift long")), "part").select((F.col("at") + F.col("shift")).alias("seq"), "op", "k", "v")
        try:
            if n:
                self._append(numbered, n, stream, clears="op" in rows.columns)
                self._flush_if_full()
            elif stream:
                self._publish(self.manifest.with_(streams=self.manifest.streams | {stream[0]: stream[1]}))
        finally:
            self.files.delete(draft)
        return n

    def remove_all(self, keys: DataFrame) -> DataFrame:
        """Removes the live ones of keys (k) as one batch; gives (k, removed)."""
        self._commit_pending()
        out = lww.remove_results(self._rows(), keys.select("k").distinct())  # of the files of this version, which stay
        self.put_all(out.where("removed").select(F.lit(REMOVE).alias("op"), "k", F.lit("").alias("v")))
        return out

    def run_all(self, operations: list[tuple]) -> list:
        """Runs ("put", k, v), ("remove", k) and ("get", k); results in the order given. Neighbouring gets are one job, neighbouring puts or removals one batch."""
        out: list = []
        at = 0
        while at < len(operations):
            verb, end = operations[at][0], at
            while end < len(operations) and operations[end][0] == verb:
                end += 1
            some = operations[at:end]
            if verb == "put":
                self.pending += [(PUT if v else REMOVE, k, v) for _, k, v in some]
                self._commit_pending()
                out += [True] * len(some)
            elif verb == "get":
                probes = self.spark.createDataFrame([(i, o[1]) for i, o in enumerate(some)], "i long, k string")
                out += [r.v for r in self.multi_get(probes, "i").collect()]
            elif verb == "remove":
                probes = self.spark.createDataFrame([(i, o[1]) for i, o in enumerate(some)], "i long, k string")
                there = {r.k for r in self.multi_get(probes, "i").collect() if r.v is not None}
                found = []
                for o in some:
                    found.append(o[1] in there)
                    there.discard(o[1])
                self.pending += [(REMOVE, o[1], "") for o, f in zip(some, found) if f]
                self._commit_pending()
                out += found
            else:
                raise ValueError(f"{verb} is unknown")
            at = end
        return out

    def _store_log(self, rows: DataFrame) -> str:
        path = f"log/batch-{self.manifest.last_seq + 1:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(self.files.at(path))
        return path

    def _append(self, rows: DataFrame, n: int, stream: tuple[str, int] | None = None, clears: bool = False) -> None:
        m = self.manifest
        path = self._store_log(rows)
        first, last = m.last_seq + 1, m.last_seq + n
        cleared = m.cleared_seq
        if clears:
            stored = self._read([path]).where(F.col("op") == CLEAR).agg(F.max("seq")).first()[0]
            cleared = max(cleared, stored or 0)
        batches = tuple(b for b in (*m.batches, Batch(path, first, last)) if b.last_seq > cleared or b.path == path)
        runs = tuple(r for r in m.runs if r.last_seq > cleared)
        self._publish(m.with_(last_seq=last, cleared_seq=cleared, batches=batches, runs=runs, streams=m.streams | ({stream[0]: stream[1]} if stream else {})))

    def _flush_if_full(self) -> None:
        """Keys are counted when there are records enough; a record adds one key at most, which says when to count again."""
        records = sum(b.last_seq - b.first_seq + 1 for b in self.manifest.batches)
        if records < self._count_at:
            return
        keys = self._read(b.path for b in self.manifest.batches).where((F.col("seq") > self.manifest.cleared_seq) & (F.col("op") != CLEAR)).select("k").distinct().count()
        if keys >= self.options.flush_entries:
            self.flush()
        else:
            self._count_at = records + self.options.flush_entries - keys

    def _publish(self, manifest: Manifest) -> None:
        self.manifest = self.manifests.publish(manifest)
        log.get().debug("version %d: %d batches, %d runs", manifest.version, len(manifest.batches), len(manifest.runs))

    # runs

    def _write_run(self, rows: DataFrame, level: int, most: int, last_seq: int) -> tuple[Run, ...]:
        """A run is sorted by key over all its files, with Bloom filters on keys, made for ``most`` of them: lookups skip files and row groups. No rows, no run."""
        number = self.manifest.next_run
        path = f"runs/L{level}/run-{number:06d}-{uuid.uuid4().hex}"
        seen = Observation()
        writer = rows.sort("k").select("seq", "op", "k", "v").observe(seen, F.count(F.lit(1)).alias("n")).write
        writer.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", str(min(max(most, 1), BLOOM_LIMIT))).parquet(self.files.at(path))
        entries = seen.get["n"]
        if not entries:
            self.files.delete(path)
        return (Run(level, number, path, entries, last_seq),) if entries else ()

    def flush(self) -> bool:
        """The log's batches become a run of level 0, tombstones kept; False if there is nothing to flush. Batches go after the manifest is published."""
        self._commit_pending()
        m = self.manifest
        if not m.batches:
            return False
        rows = lww.latest(self._read(b.path for b in m.batches).where(F.col("seq") > m.cleared_seq))
        run = self._write_run(rows, 0, sum(b.last_seq - b.first_seq + 1 for b in m.batches), m.last_seq)
        self._publish(m.with_(batches=(), flushed_seq=m.last_seq, runs=m.runs + run, next_run=m.next_run + 1))
        self._count_at = self.options.flush_entries
        if self.options.compact_runs and len(self.manifest.runs) > self.options.compact_runs:
            self.compact()
        return True

    def compact(self) -> bool:
        """All runs become one of level 1, without removed keys; False if there is nothing to merge. Unflushed records stay in the log."""
        self._commit_pending()
        m = self.manifest
        if not m.runs or len(m.runs) == 1 and m.runs[0].level == 1:
            return False
        rows = lww.latest(self._read(r.path for r in m.runs).where(F.col("seq") > m.cleared_seq)).where(lww.is_live())
        run = self._write_run(rows, 1, sum(r.entries for r in m.runs), max(r.last_seq for r in m.runs))
        self._publish(m.with_(runs=run, next_run=m.next_run + 1))
        return True

    def vacuum(self) -> int:
        """Deletes files that the current version doesn't name; earlier snapshots end. Gives the number of folders deleted."""
        named = {b.path for b in self.manifest.batches} | {r.path for r in self.manifest.runs}
        found = [f"log/{n}" for n in self.files.names("log")] + [f"runs/{level}/{n}" for level in self.files.names("runs") for n in self.files.names(f"runs/{level}")]
        gone = [p for p in found if p not in named]
        for path in gone:
            self.files.delete(path)
        return len(gone)

    # looking inside

    def wal_table(self) -> DataFrame:
        """The log's records with their text form and checksum, in order."""
        self._commit_pending()
        rows = self._read(b.path for b in self.manifest.batches)
        crc = record.checksum(F.col("op"), F.col("k"), F.col("v"), F.col("seq"))
        return rows.withColumn("crc", crc).withColumn("text", record.describe(F.col("op"), F.col("k"), F.col("v"), F.col("seq"), F.col("crc"))).orderBy("seq")

    def runs_table(self) -> DataFrame:
        """Every entry of every run, tombstones included, newest run first."""
        named = [(self.files.at(r.path).rsplit("/", 1)[1], i, r.level, r.number) for i, r in enumerate(self.manifest.ordered_runs())]
        of = self.spark.createDataFrame(named, "folder string, rank int, level int, number long")
        rows = self._read(r.path for r in self.manifest.runs).withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
        # one row per run
        return rows.join(F.broadcast(of), "folder").orderBy("rank", "k").select("level", "number", "k", "op", "v", "seq")

    def manifest_table(self) -> DataFrame:
        return self.manifests.as_table(self.spark, self.manifest)

    def last_seq(self) -> int:
        return self.manifest.last_seq
