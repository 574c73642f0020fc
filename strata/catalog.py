"""The named queries of the engine over the driver's tables, and their SQL.

The key-value log is derived from ``events``: a record per event, in order. Queries that don't test CLEAR leave those records out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import binary, bloom, names, record
from strata.operators import blocks, lww
from strata.plans.store import Store
from strata.schema import CLEAR, PUT, REMOVE
from strata.sources import foreign, manifest
from strata.sources.files import Files, scratch

EPOCH = 1000  # records that become a run


def kv_log(spark: SparkSession, sf_dir: str, clears: bool = False) -> DataFrame:
    """seq, op, k, v."""
    op = F.when(F.col("event_id") % 400 == 250, CLEAR).when(F.col("event_type") == "error", REMOVE).otherwise(PUT)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("seq"), op.alias("op"), F.concat(F.lit("u"), F.col("user_id")).alias("k"), "props")
    rows = rows.select("seq", "op", "k", F.when(F.col("op") == PUT, F.col("props")).otherwise("").alias("v"))
    return rows if clears else rows.where(F.col("op") != CLEAR)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted runs: the latest record of each key and epoch, tombstones kept."""
    return lww.latest(kv_log(spark, sf_dir).withColumn("run", F.floor((F.col("seq") - 1) / EPOCH)), "run")


def levelled(rows: DataFrame) -> DataFrame:
    """The first three runs are of level 1, the others of level 0; numbers are the epochs."""
    return rows.withColumn("level", F.when(F.col("run") < 3, 1).otherwise(0)).withColumn("number", F.col("run"))


def all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_log(spark, sf_dir).select("k").distinct()


def point_get(spark, sf_dir):
    return lww.get(kv_log(spark, sf_dir), "u7")


def multi_get(spark, sf_dir):
    probes = spark.createDataFrame([(0, "u7"), (1, "u42"), (2, "nobody")], "ord int, k string")
    return lww.multi_get(kv_log(spark, sf_dir), probes)


def scan_live(spark, sf_dir):
    return lww.live(kv_log(spark, sf_dir))


def keys(spark, sf_dir):
    return lww.live(kv_log(spark, sf_dir)).select("k")


def size(spark, sf_dir):
    return lww.live(kv_log(spark, sf_dir)).agg(F.count("*").alias("n"))


def exists_semi(spark, sf_dir):
    return lww.existing(kv_log(spark, sf_dir), all_keys(spark, sf_dir))


def tombstoned_anti(spark, sf_dir):
    return lww.missing(kv_log(spark, sf_dir), all_keys(spark, sf_dir))


def remove_result(spark, sf_dir):
    return lww.remove_results(kv_log(spark, sf_dir), all_keys(spark, sf_dir).union(spark.createDataFrame([("nobody",)], "k string")))


def max_seq(spark, sf_dir):
    return kv_log(spark, sf_dir, clears=True).agg(F.max("seq").alias("max_seq"))


def checkpoint_tail(spark, sf_dir):
    log = kv_log(spark, sf_dir, clears=True)
    last = log.agg(F.max("seq").alias("last"))
    return log.join(F.broadcast(last), F.col("seq") > 0.9 * F.col("last")).groupBy("op").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def replay_with_clear(spark, sf_dir):
    return lww.replay(kv_log(spark, sf_dir, clears=True))


def sst_build(spark, sf_dir):
    return runs(spark, sf_dir)


def sst_stats(spark, sf_dir):
    return blocks.run_stats(runs(spark, sf_dir))


def compact(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumns({"level": F.lit(0), "number": F.col("run")})
    return lww.merge_runs(rows).select("k", "v")


def levels_precedence(spark, sf_dir):
    return lww.merge_runs(levelled(runs(spark, sf_dir)))


def read_amp(spark, sf_dir):
    return blocks.read_amplification(runs(spark, sf_dir))


def group_commit(spark, sf_dir):
    return blocks.group_commits(kv_log(spark, sf_dir, clears=True))


def _record() -> list[Column]:
    return [F.col("op"), F.col("k"), F.col("v"), F.col("seq")]


def wal_dump(spark, sf_dir):
    """The text form of every record."""
    return kv_log(spark, sf_dir, clears=True).select("seq", record.describe(*_record()).alias("text"))


def wal_record_size(spark, sf_dir):
    return kv_log(spark, sf_dir, clears=True).select("seq", record.size(F.col("k"), F.col("v")).alias("bytes"))


def wal_encode(spark, sf_dir):
    """The bytes of every record, in hex."""
    return kv_log(spark, sf_dir, clears=True).select("seq", F.hex(record.encode(*_record())).alias("record"))


def wal_crc(spark, sf_dir):
    """Checksums as they are stored, and whether those of the payloads read back are the same."""
    raw = kv_log(spark, sf_dir, clears=True).select("seq", record.encode(*_record()).alias("r"))
    stored = binary.unpack_uint(F.col("r"), 4, 4)
    return raw.select("seq", stored.alias("crc"), (F.crc32(F.expr("substring(r, 9)")) == stored).alias("holds"), binary.unpack_uint(F.col("r"), 0, 4).alias("bytes"))


def wal_read(spark, sf_dir):
    """The log as binary log files, read back record by record."""
    rows = foreign.read_wal(spark, foreign.write_wal(kv_log(spark, sf_dir, clears=True), scratch(spark)))
    return rows.select("seq", "op", F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"), "crc")


def sstable_read(spark, sf_dir):
    """The runs as table files, read back."""
    found = foreign.read_tables(spark, foreign.write_tables(runs(spark, sf_dir), scratch(spark), 512))
    return found.select("block_no", F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


def sstable_find(spark, sf_dir):
    """One key in every table file."""
    return foreign.find_in_tables(spark, foreign.write_tables(runs(spark, sf_dir), scratch(spark)), b"u7").select(F.col("v").cast("string").alias("v"))


def manifest_roundtrip(spark, sf_dir):
    """The levels and tables of the runs through a binary manifest file."""
    levels: dict[int, list[str]] = {}
    for r in levelled(runs(spark, sf_dir)).select("level", "number").distinct().orderBy("level", "number").collect():  # a row per table file
        levels.setdefault(r.level, []).append(f"sstables/L{r.level}/sstable-L{r.level}-{r.number:06d}.sst")
    files = Files(spark, scratch(spark))
    files.create("MANIFEST-000001", manifest.to_foreign(kv_log(spark, sf_dir).agg(F.max("seq")).first()[0], levels))
    last_seq, found = manifest.from_foreign(files.read("MANIFEST-000001"))
    return spark.createDataFrame([(last_seq, level, path) for level, paths in found.items() for path in paths], "last_seq long, level int, path string")


def _quarters(spark, sf_dir) -> list[DataFrame]:
    """The log without CLEAR in four batches, by sequence number."""
    rows = kv_log(spark, sf_dir)
    last = rows.agg(F.max("seq")).first()[0]
    return [rows.where(F.floor((F.col("seq") - 1) * 4 / last) == i) for i in range(4)]


def store_ingest(spark, sf_dir):
    """The whole log, CLEAR included, written to a store as one batch, and what is live then."""
    store = Store(spark, scratch(spark))
    store.put_all(kv_log(spark, sf_dir, clears=True), "seq")
    return store.live()


def store_flush(spark, sf_dir):
    """Four batches, each flushed to a run: every entry of every run."""
    store = Store(spark, scratch(spark))
    for rows in _quarters(spark, sf_dir):
        store.put_all(rows, "seq")
        store.flush()
    return store.runs_table().select("level", "number", "k", "op", "v")


def store_compact(spark, sf_dir):
    """Those runs compacted: one run without removed keys."""
    store = Store(spark, scratch(spark))
    for rows in _quarters(spark, sf_dir):
        store.put_all(rows, "seq")
        store.flush()
    store.compact()
    return store.runs_table().select("level", "number", "k", "op", "v")


def store_reopen(spark, sf_dir):
    """Two batches in runs, one of them compacted, two in the log; what another Store on the folder finds."""
    path = scratch(spark)
    store = Store(spark, path)
    for i, rows in enumerate(_quarters(spark, sf_dir)):
        store.put_all(rows, "seq")
        if i < 2:
            store.flush()
        if i == 0:
            store.compact()
    again = Store(spark, path)
    return again.live().withColumn("last_seq", F.lit(again.last_seq()).cast("long"))


def store_remove(spark, sf_dir):
    """Every key ending in 3 removed from a store as one batch: which were there, and what is live after it."""
    store = Store(spark, scratch(spark))
    store.put_all(kv_log(spark, sf_dir), "seq")
    removed = store.remove_all(all_keys(spark, sf_dir).where("k LIKE '%3'"))
    told = removed.select("k", F.when(F.col("removed"), "removed").otherwise("absent").alias("state"), F.lit("").alias("v"))
    return told.unionByName(store.live().select("k", F.lit("live").alias("state"), "v"))


def wal_truncate(spark, sf_dir):
    """The log after a flush and one more batch: records that no run holds, in their text form."""
    store = Store(spark, scratch(spark))
    quarters = _quarters(spark, sf_dir)
    store.put_all(quarters[0], "seq")
    store.flush()
    store.put_all(quarters[1], "seq")
    return store.wal_table().select("op", "k", "v")


def block_index(spark, sf_dir):
    return blocks.block_index(runs(spark, sf_dir), 512)


def next_block_lookup(spark, sf_dir):
    return blocks.block_for(blocks.block_index(runs(spark, sf_dir), 512), "u5")


def manifest_levels(spark, sf_dir):
    found = levelled(runs(spark, sf_dir)).select("level", "number").distinct()
    path = F.format_string("sstables/L%d/sstable-L%d-%06d.sst", "level", "level", "number")
    return found.groupBy("level").agg(F.count("*").alias("tables"), F.array_join(F.sort_array(F.collect_list(path)), ",").alias("paths"))


def name_parse(spark, sf_dir):
    """Level and number of table names of all forms, right and wrong ones, made from the events."""
    level, number = F.col("user_id") % 13, F.col("event_id").cast("string")
    forms = [F.format_string("sstable-L%d-%06d.sst", level, "event_id"), F.format_string("sstable-%06d.sst", "event_id"), F.concat(F.lit("sstable-L"), level, F.lit("-xyz.sst")), F.concat(number, F.lit(".txt")), F.lit("sstable-.sst")]
    name = F.get(F.array(*forms), (F.col("event_id") % 5).cast("int")).alias("name")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", name)
    return rows.select("event_id", "name", names.table_level(F.col("name")).alias("level"), names.table_number(F.col("name")).alias("number"))


def bloom_no_false_negative(spark, sf_dir):
    """What a filter of all keys says of them, and of as many others; its rate of 1e-9 leaves no false positive."""
    found = all_keys(spark, sf_dir)
    probes = found.union(found.select(F.concat(F.lit("no"), "k")))
    return bloom.might_contain(probes, "k", bloom.bloom_agg(found, found.count(), 1e-9))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        point_get, multi_get, scan_live, keys, size, exists_semi, tombstoned_anti, remove_result, max_seq, checkpoint_tail, replay_with_clear, sst_build, sst_stats, compact, levels_precedence,
        read_amp, group_commit, wal_dump, wal_record_size, wal_encode, wal_crc, block_index, next_block_lookup, manifest_levels, name_parse, bloom_no_false_negative,
        wal_read, sstable_read, sstable_find, manifest_roundtrip, store_ingest, store_flush, store_compact, store_reopen, store_remove, wal_truncate,
    )
}

LOG_SQL = """log AS (SELECT seq, op, k, CASE WHEN op = 'PUT' THEN props ELSE '' END AS v FROM (
    SELECT event_id + 1 AS seq, 'u' || CAST(user_id AS VARCHAR) AS k, props,
           CASE WHEN event_id % 400 = 250 THEN 'CLEAR' WHEN event_type = 'error' THEN 'REMOVE' ELSE 'PUT' END AS op FROM events)),
kv AS (SELECT * FROM log WHERE op <> 'CLEAR'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM kv),
live AS (SELECT k, v, seq FROM ranked WHERE rn = 1 AND op = 'PUT' AND v <> ''),
epochs AS (SELECT *, (seq - 1) // 1000 AS run FROM kv),
runs AS (SELECT run, k, seq, op, v FROM (SELECT *, row_number() OVER (PARTITION BY run, k ORDER BY seq DESC) AS rn FROM epochs) WHERE rn = 1),
quarters AS (SELECT quarter, k, op, v FROM (SELECT *, row_number() OVER (PARTITION BY quarter, k ORDER BY seq DESC) AS rn
    FROM (SELECT *, (seq - 1) * 4 // (SELECT max(seq) FROM kv) AS quarter FROM kv)) WHERE rn = 1)"""

# little-endian hex of an unsigned number
_le = lambda x, n: " || ".join(f"substr(lpad(hex({x}), {2 * n}, '0'), {2 * i + 1}, 2)" for i in reversed(range(n)))
_hex = lambda x: f"hex(encode({x}))"
_nibble = lambda x, i: f"(instr('0123456789ABCDEF', substr({x}, {i}, 1)) - 1)"

#: Payloads in hex, and their CRC-32 byte by byte with a table that is made from the polynomial.
RECORDS_SQL = f"""payloads AS (SELECT *, CASE op WHEN 'PUT' THEN '00' WHEN 'REMOVE' THEN '01' ELSE '02' END
    || {_le("strlen(k)", 4)} || {_hex("k")} || {_le("strlen(v)", 4)} || {_hex("v")} || {_le("seq", 8)} AS payload FROM log),
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
records AS (SELECT seq, op, k, v, payload, xor(list_reduce(
    list_transform(range(0, strlen(payload) // 2), lambda i: CAST(16 * {_nibble("payload", "2 * i + 1")} + {_nibble("payload", "2 * i + 2")} AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM payloads, crc_table)"""

_oracles = {
    "point_get": "SELECT k, v FROM live WHERE k = 'u7'",
    "multi_get": "SELECT p.ord, p.k, live.v FROM (VALUES (0, 'u7'), (1, 'u42'), (2, 'nobody')) AS p(ord, k) LEFT JOIN live ON live.k = p.k",
    "scan_live": "SELECT k, v, seq FROM live",
    "keys": "SELECT k FROM live",
    "size": "SELECT count(*) AS n FROM live",
    "exists_semi": "SELECT DISTINCT k FROM kv WHERE k IN (SELECT k FROM live)",
    "tombstoned_anti": "SELECT DISTINCT k FROM kv WHERE k NOT IN (SELECT k FROM live)",
    "remove_result": "SELECT p.k, p.k IN (SELECT k FROM live) AS removed FROM (SELECT DISTINCT k FROM kv UNION ALL SELECT 'nobody') AS p",
    "max_seq": "SELECT max(seq) AS max_seq FROM log",
    "checkpoint_tail": "SELECT op, count(*) AS n, min(seq) AS first_seq FROM log WHERE seq > 0.9 * (SELECT max(seq) FROM log) GROUP BY op",
    "replay_with_clear": """SELECT k, seq, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log
        WHERE seq > (SELECT coalesce(max(seq), 0) FROM log WHERE op = 'CLEAR')) WHERE rn = 1""",
    "sst_build": "SELECT run, k, seq, op, v FROM runs",
    "sst_stats": "SELECT run, count(*) AS entries, min(k) AS min_key, max(k) AS max_key, CAST(sum(8 + strlen(k) + strlen(v)) AS BIGINT) AS bytes FROM runs GROUP BY run",
    "compact": "SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run DESC) AS rn FROM runs) WHERE rn = 1 AND op = 'PUT' AND v <> ''",
    "levels_precedence": """SELECT k, op, v, level, number FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, number DESC) AS rn
        FROM (SELECT *, CASE WHEN run < 3 THEN 1 ELSE 0 END AS level, run AS number FROM runs)) WHERE rn = 1 AND op = 'PUT' AND v <> ''""",
    "read_amp": "SELECT k, count(*) AS runs, count(*) FILTER (WHERE op <> 'PUT' OR v = '') AS tombstones FROM runs GROUP BY k",
    "group_commit": "SELECT (seq - 1) // 1024 AS batch, count(*) AS records, min(seq) AS min_seq, max(seq) AS max_seq FROM log GROUP BY 1",
    "wal_dump": """SELECT seq, 'WalRecord(' || concat_ws(', ', '序列号=' || seq, '操作类型=' || op, '键=''' || k || '''', '值=''' || v || '''', 'CRC=' || lower(hex(crc))) || ')' AS text FROM records""",
    "wal_record_size": "SELECT seq, CAST(25 + strlen(k) + strlen(v) AS INTEGER) AS bytes FROM log",
    "wal_encode": f"SELECT seq, {_le('25 + strlen(k) + strlen(v)', 4)} || {_le('crc', 4)} || payload AS record FROM records",
    "wal_crc": "SELECT seq, crc, true AS holds, 25 + strlen(k) + strlen(v) AS bytes FROM records",
    "wal_read": "SELECT seq, op, k, v, crc FROM records",
    "sstable_find": "SELECT v FROM runs WHERE k = 'u7'",
    "manifest_roundtrip": """SELECT DISTINCT (SELECT max(seq) FROM kv) AS last_seq, level, 'sstables/L' || level || '/sstable-L' || level || '-' || lpad(CAST(run AS VARCHAR), 6, '0') || '.sst' AS path
        FROM (SELECT run, CASE WHEN run < 3 THEN 1 ELSE 0 END AS level FROM runs)""",
    "store_ingest": """SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log
        WHERE seq > (SELECT coalesce(max(seq), 0) FROM log WHERE op = 'CLEAR')) WHERE rn = 1 AND op = 'PUT' AND v <> ''""",
    "store_flush": "SELECT 0 AS level, quarter + 1 AS number, k, CASE WHEN v = '' THEN 'REMOVE' ELSE op END AS op, v FROM quarters",
    "store_compact": "SELECT 1 AS level, CAST(5 AS BIGINT) AS number, k, 'PUT' AS op, v FROM live",
    "store_reopen": "SELECT k, v, (SELECT count(*) FROM kv) AS last_seq FROM live",
    "store_remove": """SELECT k, CASE WHEN k IN (SELECT k FROM live) THEN 'removed' ELSE 'absent' END AS state, '' AS v FROM (SELECT DISTINCT k FROM kv WHERE k LIKE '%3')
        UNION ALL SELECT k, 'live', v FROM live WHERE k NOT LIKE '%3'""",
    "wal_truncate": "SELECT CASE WHEN v = '' THEN 'REMOVE' ELSE op END AS op, k, v FROM kv WHERE (seq - 1) * 4 // (SELECT max(seq) FROM kv) = 1",
    "manifest_levels": """SELECT level, count(*) AS tables, string_agg(path, ',' ORDER BY path) AS paths FROM (
        SELECT DISTINCT level, 'sstables/L' || level || '/sstable-L' || level || '-' || lpad(CAST(run AS VARCHAR), 6, '0') || '.sst' AS path
        FROM (SELECT run, CASE WHEN run < 3 THEN 1 ELSE 0 END AS level FROM runs)) GROUP BY level""",
    "name_parse": """SELECT event_id, name, coalesce(TRY_CAST(nullif(regexp_extract(name, '^sstable-L([0-9]+)-', 1), '') AS INTEGER), 0) AS level,
        coalesce(TRY_CAST(nullif(regexp_extract(name, '^sstable-(?:L[0-9]+-)?([0-9]+)[.]sst$', 1), '') AS BIGINT), 0) AS number FROM (
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'sstable-L' || user_id % 13 || '-' || CASE WHEN event_id < 1000000 THEN lpad(CAST(event_id AS VARCHAR), 6, '0') ELSE CAST(event_id AS VARCHAR) END || '.sst'
            WHEN 1 THEN 'sstable-' || CASE WHEN event_id < 1000000 THEN lpad(CAST(event_id AS VARCHAR), 6, '0') ELSE CAST(event_id AS VARCHAR) END || '.sst'
            WHEN 2 THEN 'sstable-L' || user_id % 13 || '-xyz.sst' WHEN 3 THEN event_id || '.txt' ELSE 'sstable-.sst' END AS name FROM events)""",
    "bloom_no_false_negative": "SELECT DISTINCT k, true AS found FROM kv UNION ALL SELECT DISTINCT 'no' || k, false FROM kv",
}
ORACLE_SQL: dict[str, str] = {name: f"WITH {LOG_SQL}{', ' + RECORDS_SQL if 'records' in sql else ''} {sql}" for name, sql in _oracles.items()}

_BLOCKS = """
ordered AS (SELECT run, k, CAST(8 + strlen(k) + strlen(v) AS BIGINT) AS n, row_number() OVER (PARTITION BY run ORDER BY k) AS i FROM runs),
walk AS (
    SELECT run, k, n, i, CAST(0 AS BIGINT) AS block_no, n AS held FROM ordered WHERE i = 1
    UNION ALL
    SELECT o.run, o.k, o.n, o.i, CASE WHEN w.held >= 512 THEN w.block_no + 1 ELSE w.block_no END, CASE WHEN w.held >= 512 THEN o.n ELSE w.held + o.n END
    FROM walk AS w JOIN ordered AS o ON o.run = w.run AND o.i = w.i + 1),
blocks AS (SELECT run, CAST(block_no AS INTEGER) AS block_no, min(k) AS first_key, max(k) AS last_key, CAST(sum(n) AS BIGINT) AS size, CAST(count(*) AS INTEGER) AS entries FROM walk GROUP BY run, block_no),
placed AS (SELECT run, block_no, first_key, last_key, CAST(sum(size) OVER (PARTITION BY run ORDER BY block_no) - size AS BIGINT) AS "offset", size, entries FROM blocks)"""
ORACLE_SQL["block_index"] = f"WITH RECURSIVE {LOG_SQL}, {_BLOCKS} SELECT * FROM placed"
ORACLE_SQL["sstable_read"] = f"WITH RECURSIVE {LOG_SQL}, {_BLOCKS} SELECT CAST(p.block_no AS INTEGER) AS block_no, r.k, r.v FROM runs AS r JOIN placed AS p ON p.run = r.run AND r.k BETWEEN p.first_key AND p.last_key"
ORACLE_SQL["next_block_lookup"] = f"""WITH RECURSIVE {LOG_SQL}, {_BLOCKS} SELECT run, block_no, last_key, "offset", size FROM placed
    WHERE last_key >= 'u5' QUALIFY row_number() OVER (PARTITION BY run ORDER BY last_key) = 1"""
