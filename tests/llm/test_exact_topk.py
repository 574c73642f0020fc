import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from strata.llm import exact, topk

SCHEMA = "doc_id long, text string, digest string, keep_id int"


def brute(rows):
    groups = defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t, *_ in rows:
        groups[(t or "").translate(lower)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        out += [(-1 if d is None else d, -1 if keep is None else keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out)


def rows():
    rnd = random.Random(4)
    out = [(i, rnd.choice(["HOT", "hot"]) if i % 3 == 0 else f"Text {i // 5}", "x", 1) for i in range(600)]
    return out + [(None, "hot", "x", 1), (None, "only", "x", 1), (700, None, "x", 1), (701, "", "x", 1), (702, "É", "x", 1), (703, "é", "x", 1), (704, "Same", "x", 1), (704, "same", "x", 1), (705, "w " * 100_000, "x", 1)]


def test_copies_equal_brute_force(spark):
    for counters in (3, 1024):
        found = exact.find_copies(spark.createDataFrame(rows(), SCHEMA).repartition(7), counters).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in found) == brute(rows())
        kept = [r for r in found if r.kept]
        assert len(kept) == len({r.text_sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)


def test_rows_kept(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({(h) for *_, h in brute(rows())})
    assert exact.find_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_misra_gries_keeps_what_is_frequent(spark):
    rnd, counts = random.Random(1), Counter()
    words = ["a"] * 400 + ["b"] * 200 + [str(i) for i in range(400)]
    rnd.shuffle(words)
    for i in range(0, len(words), 50):
        counts.update(words[i : i + 50])
        counts = exact.shrink(counts, 9)
    assert len(counts) <= 9 and 300 <= counts["a"] <= 400
    found = {r.digest for r in exact.frequent(spark.createDataFrame([(w,) for w in words], "digest string").repartition(5), 9).collect()}
    assert {"a", "b"} <= found and len(found) <= 10


def vectors():
    rnd = np.random.default_rng(3)
    out = [(i, [float(x) if rnd.random() < 0.7 else 0.0 for x in rnd.normal(size=6).astype(np.float32)], "l", 1) for i in range(400)]
    out += [(500, out[1][1], "l", 1), (501, out[1][1], "l", 1), (600, None, "l", 1), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0], "l", 1), (800, [float("nan")] * 6, "l", 1), (900, [float("inf")] * 6, "l", 1), (None, [1.0] * 6, "l", 1), (502, [1.0, 2.0], "l", 1), (503, [], "l", 1), (7, out[7][1], "l", 1)]
    return out


def test_top_k_equals_brute_force(spark):
    rows = vectors()
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in sorted({i: v for i, v in ints if i % 100 == 0}.items()):
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ints if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, rank int")
    for queries, block in ((256, 8192), (2, 50)):
        assert sorted(map(tuple, topk.top_k(df, queries=queries, rows=block).collect())) == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert [r.rank for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()] == [1]


def test_large_components_do_not_overflow():
    big = np.array([[1 << 62, 5]], dtype=np.int64)
    assert topk.accumulate(big, big)[0, 0] == (1 << 63) - 1
    assert topk.accumulate(np.array([[3, 0]]), np.array([[2, 9], [0, 9], [1, 1]])).tolist() == [[6, 0, 3]]
