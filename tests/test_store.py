import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strata import log
from strata.operators import blocks, lww
from strata.plans.store import Options, Store, WalOptions
from strata.shell import answers
from strata.sources.files import Files
from strata.sources.manifest import Conflict


def as_dict(store):
    return {r.k: r.v for r in store.live().collect()}


def test_put_get_remove(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.put("k1", "v1") and s.put("k2", "v2")
    assert s.get("k1") == "v1" and s.exists("k2") and s.size() == 2
    assert s.remove("k1") and s.get("k1") is None
    assert not s.remove("k1") and s.last_seq() == 3  # nothing was written
    assert s.put("k2", "") and s.get("k2") is None  # the empty value removes


def test_flush_by_threshold_keeps_all_readable(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(flush_entries=7))
    for i in range(20):
        s.put(f"k{i}", f"v{i}")
    assert {r.level for r in s.manifest.runs} == {0}
    for i in range(0, 20, 3):
        assert s.get(f"k{i}") == f"v{i}"


def test_deleted_keys_stay_deleted_through_compactions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put_all(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"))
    s.flush()
    assert s.compact() and [r.level for r in s.manifest.runs] == [1]
    s.remove("a")
    s.flush()
    s.compact()
    assert as_dict(s) == {"b": "2"}
    s.remove("b")
    s.flush()
    s.compact()
    assert as_dict(s) == {} and s.manifest.runs == () and not s.compact()
    assert as_dict(Store(spark, str(tmp_path))) == {}


def test_clear_empties_runs_too(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("a", "1")
    s.flush()
    s.put("b", "2")
    s.clear()
    assert as_dict(s) == {}
    s.put("c", "3")
    assert as_dict(Store(spark, str(tmp_path))) == {"c": "3"}
    s.put_all(spark.createDataFrame([(1, "PUT", "d", "4"), (2, "CLEAR", "", ""), (3, "PUT", "e", "5")], "o int, op string, k string, v string"), "o")
    assert as_dict(s) == {"e": "5"}


def test_batches_keep_their_order(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.range(1000).select((999 - F.col("id")).alias("o"), F.concat(F.lit("k"), F.col("id") % 10).alias("k"), F.col("id").cast("string").alias("v")).repartition(5)
    assert s.put_all(rows, "o") == 1000 and s.last_seq() == 1000
    assert as_dict(s) == {f"k{i}": str(i) for i in range(10)}
    assert s.wal_table().agg(F.countDistinct("seq")).first()[0] == 1000


def test_run_all_and_multi_get(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.run_all([("put", "a", "1"), ("put", "b", "2"), ("get", "a"), ("get", "x"), ("remove", "a"), ("remove", "x"), ("remove", "a"), ("get", "a")]) == [True, True, "1", None, True, False, False, None]
    probes = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "i int, k string")
    assert [r.v for r in s.multi_get(probes, "i").collect()] == ["2", None, "2"]
    assert {r.k: r.removed for r in s.remove_all(probes).collect()} == {"a": False, "b": True}
    assert s.size() == 0


def test_group_commit_waits_and_reads_see_it(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(wal=WalOptions(group_commit=True, max_records=3, max_interval_ms=60_000)))
    s.put("a", "1")
    s.put("b", "2")
    assert s.manifest.version == 0
    s.put("c", "3")
    assert s.manifest.version == 1 and s.last_seq() == 3
    s.put("d", "4")
    assert s.get("d") == "4"
    s.configure_wal(WalOptions(group_commit=True, max_interval_ms=0))
    s.put("e", "5")
    assert s.pending == [] and s.last_seq() == 5


def test_acknowledged_writes_outlive_a_failed_commit(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), Options(wal=WalOptions(group_commit=True, max_records=3, max_interval_ms=60_000)))
    s.put("a", "1")
    s.put("b", "2")
    with monkeypatch.context() as m:
        m.setattr(s.manifests, "publish", lambda manifest: (_ for _ in ()).throw(OSError("the disk is full")))
        with pytest.raises(OSError):
            s.put("c", "3")
    assert [k for _, k, _ in s.pending] == ["a", "b"]
    other = Store(spark, str(tmp_path))
    other.put("d", "4")
    with pytest.raises(Conflict):
        s.flush_log()
    s.open().flush_log()
    assert as_dict(Store(spark, str(tmp_path))) == {"a": "1", "b": "2", "d": "4"}


def test_a_waiting_write_is_committed_in_time(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(wal=WalOptions(group_commit=True, max_interval_ms=200)))
    s.committed_at += 60
    s.put("a", "1")
    assert s.pending
    for _ in range(100):
        time.sleep(0.1)
        if not s.pending:
            break
    assert as_dict(Store(spark, str(tmp_path))) == {"a": "1"}


def test_keys_and_not_records_fill_the_log(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(flush_entries=3))
    for i in range(8):
        s.put("hot", str(i))
    s.put("b", "1")
    assert not s.manifest.runs
    s.remove("b")
    s.put("c", "1")
    assert len(s.manifest.runs) == 1 and not s.manifest.batches and as_dict(s) == {"hot": "7", "c": "1"}


def test_one_of_many_creators_succeeds(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.create("x/first", b"")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create("x/name", b"%d" % i), range(8)))
    assert sum(won) == 1 and files.read("x/name") == b"%d" % won.index(True) and files.names("x") == ["first", "name"]


def test_two_writers_conflict(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.put("k", "a")
    with pytest.raises(Conflict):
        b.put("k", "b")
    assert b.open().get("k") == "a"


def test_snapshots_and_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("a", "1")
    v = s.manifest.version
    s.put("a", "2")
    s.flush()
    assert [r.v for r in s.snapshot(v).collect()] == ["1"]
    assert s.vacuum() == 2 and as_dict(s) == {"a": "2"} and s.vacuum() == 0


def test_damaged_manifest_is_an_error(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("a", "1")
    path = tmp_path / "manifest" / "MANIFEST-000001"
    path.write_bytes(path.read_bytes()[:-2] + b"xx")
    (tmp_path / "manifest" / ".MANIFEST-000001.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path))


def test_model(spark, tmp_path):
    """Random operations against a dict, with flushes, compactions and reopening at random points."""
    rnd, model = random.Random(5), {}
    s = Store(spark, str(tmp_path))
    keys = ["", "a", "é", "10", "9", "B", "漢"]
    for _ in range(40):
        what = rnd.random()
        if what < 0.45:
            rows = [(i, rnd.choice(keys), rnd.choice(["", "x", "y", "z" * 9000])) for i in range(4)]
            s.put_all(spark.createDataFrame(rows, "i int, k string, v string"), "i")
            for _, k, v in rows:
                model.pop(k, None)
                if v:
                    model[k] = v
        elif what < 0.6:
            k = rnd.choice(keys)
            assert s.remove(k) == (k in model)
            model.pop(k, None)
        elif what < 0.75:
            s.flush()
        elif what < 0.87:
            s.compact()
        elif what < 0.97:
            s = Store(spark, str(tmp_path))
        else:
            s.clear()
            model = {}
    assert as_dict(s) == model
    assert [r.k for r in s.keys().collect()] == sorted(model, key=str.encode)


def test_runs_are_pruned_by_key(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put_all(spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("v").alias("v")))
    s.flush()
    plan = lww.get(s._rows(), "k7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,k7)" in plan


def test_shell(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    said = list(answers(s, ["put a 1 ignored", "get a", "get b", "del b", "del a", "", "put c 3", "exists c", "size", "keys", "wal", "flush", "compact", "sstables", "manifest", "nonsense", "put x", "help", "quit", "get c"]))
    assert said[:8] == ["OK", "1", "(nil)", "ERR", "OK", "OK", "1", "1"]
    assert said[8] == "c" and "操作类型=REMOVE" in said[9] and said[10:12] == ["OK", "OK"]
    assert said[12].endswith("c:3") and "last_seq 3" in said[13] and said[14].startswith("unknown") and said[15].startswith("unknown") and "put KEY" in said[16] and len(said) == 17


def test_logging(tmp_path):
    log.start(log.file(str(tmp_path)))
    log.get().info("hello %d", 1)
    log.get().debug("not shown")
    log.stop()
    text = (tmp_path / "strata.log").read_text()
    assert "[INFO] test_store.py" in text and "hello 1" in text and "not shown" not in text


def test_block_cuts():
    assert list(blocks.cut_blocks([10, 10, 10, 5], 20)) == [(0, 2), (2, 4)]
    assert list(blocks.cut_blocks([], 20)) == []


def test_memtable_epochs(spark):
    ops = [("PUT", "a"), ("PUT", "a"), ("PUT", "b"), ("REMOVE", "c"), ("PUT", "d"), ("CLEAR", ""), ("PUT", "e"), ("PUT", "f"), ("PUT", "e"), ("PUT", "g")]
    log = spark.createDataFrame([(i + 1, op, k, "") for i, (op, k) in enumerate(ops)], "seq long, op string, k string, v string").repartition(3)
    found = {r.seq: r.epoch for r in blocks.memtable_epochs(log, 3).collect()}
    assert [found[i + 1] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 1]


def test_cache_follows_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("a", "1")
    assert s.cached().count() == 1 and s.cached() is s.cached()
    s.put("b", "2")
    assert {r.k for r in s.cached().collect()} == {"a", "b"}
