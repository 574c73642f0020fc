"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR: the folder of tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (default 8).
"""

from __future__ import annotations

import json
import os
import random
import string
import sys
import tempfile
import time

REPO = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from strata import catalog  # noqa: E402
from strata.plans.store import Options, Store  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ["scan_live", "replay_with_clear", "compact", "levels_precedence", "sst_stats", "point_get", "multi_get", "exists_semi", "wal_encode", "group_commit"]
KEYS, KEY_BYTES, VALUE_BYTES = 20_000, 32, 1024


def timed(f, times: int = 3) -> float:
    """The best of some runs."""
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        f()
        best = min(best, time.perf_counter() - began)
    return best


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    for name in QUERIES:
        found[name] = timed(lambda name=name: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())

    # the published workload: 20,000 pairs of 32 and 1,024 bytes, written, and read by key
    rnd, letters = random.Random(12345), string.ascii_letters + string.digits
    pairs = [(i, "".join(rnd.choices(letters, k=KEY_BYTES)), "".join(rnd.choices(letters, k=VALUE_BYTES))) for i in range(KEYS)]
    rows = spark.createDataFrame(pairs, "i long, k string, v string").repartition(int(CPUS)).persist()
    rows.count()
    stores: list[Store] = []

    def ingest() -> None:
        store = Store(spark, tempfile.mkdtemp(prefix="bench-"), Options(flush_entries=10 * KEYS))
        store.put_all(rows, "i")
        store.flush()
        stores.append(store)

    found["ingest_20k"] = timed(ingest)
    store = stores[-1]
    probes = rows.select("i", "k")
    found["multi_get_20k"] = timed(lambda: store.multi_get(probes).write.format("noop").mode("overwrite").save())
    found["get_one"] = timed(lambda: store.get(pairs[777][1]))
    found["compact_20k"] = timed(lambda: store.compact() or store.live().count(), 1)
    mb = KEYS * (KEY_BYTES + VALUE_BYTES) / 2**20
    out = {
        "metric": "sum of headline query seconds",
        "value": round(sum(found[n] for n in QUERIES), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in found.items()},
        "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0) if os.path.basename(SF_DIR.rstrip("/")).startswith("sf") else SF_DIR,
        "ingest_ops_per_sec": round(KEYS / found["ingest_20k"]),
        "ingest_mb_per_sec": round(mb / found["ingest_20k"], 1),
        "multi_get_ops_per_sec": round(KEYS / found["multi_get_20k"]),
        "multi_get_mb_per_sec": round(mb / found["multi_get_20k"], 1),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
