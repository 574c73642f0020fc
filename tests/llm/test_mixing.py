import math
import random
from collections import Counter

from pyspark.sql import functions as F

from strata.llm import mixing

SCHEMA = "doc_id long, text string, source string, weight string, whole int"


def docs(spark, more=()):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(1, 40))), "big" if i % 10 < 7 else "mid" if i % 10 < 9 else "small", "x", 1) for i in range(3000)]
    return spark.createDataFrame(rows + list(more), SCHEMA)


def used(out, spark):
    tokens, copies = Counter(), Counter()
    for r in out.collect():
        tokens[r.source] += len((r.text or "").split())
        copies[r.doc_id] += 1
    return tokens, copies


def solved(shares, right):
    """Brute force: the smallest exponent on a fine grid that is right."""
    for i in range(100_001):
        a = i / 100_000
        z = sum(p**a for p in shares)
        if right(a, [p**a / z for p in shares]):
            return a
    return 1.0


def test_repetition_limit(spark):
    df = docs(spark)
    out = mixing.mix(df, max_repetition=2.0)
    tokens, copies = used(out, spark)
    whole, _ = used(df, spark)
    total = sum(whole.values())
    shares = {s: n / total for s, n in whole.items()}
    a = solved(shares.values(), lambda a, w: (max(shares.values()) / min(shares.values())) ** (1 - a) <= 2)
    z = sum(p**a for p in shares.values())
    got = sum(tokens.values())
    for s, p in shares.items():
        assert abs(tokens[s] / got - p**a / z) < 0.005
    assert set(copies) == set(range(3000)) and max(copies.values()) == 2
    assert max(tokens[s] / whole[s] for s in whole) < 2.01
    weights = {r.source: r.mix_weight for r in out.select("source", "mix_weight").distinct().collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9 and out.columns == [*df.columns, "mix_epoch", "mix_weight", "mix_order"]


def test_target_entropy_and_budget(spark):
    df = docs(spark)
    whole, _ = used(df, spark)
    total = sum(whole.values())
    goal = 1.0
    out = mixing.mix(df, target_entropy=goal, max_repetition=None, budget=total / 2)
    w = {r.source: r.mix_weight for r in out.select("source", "mix_weight").distinct().collect()}
    assert abs(-sum(x * math.log(x) for x in w.values()) - goal) < 1e-4
    tokens, copies = used(out, spark)
    for s in whole:
        assert 0 <= tokens[s] - w[s] * total / 2 <= 41  # the last document may go over
    assert mixing.mix(df, target_entropy=math.log(3), max_repetition=None).select("mix_weight").distinct().count() <= 3


def test_amounts_equal_brute_force(spark):
    """The documents that a mixture uses, and how often, from the definition."""
    df = docs(spark, [(9000, None, "big", "", 0), (9001, "a b", None, "", 0)])
    for goals in ({"max_repetition": 2.0}, {"target_entropy": 0.9, "max_repetition": None, "budget": 20_000.0}):
        rows = df.withColumn("place", F.pmod(F.xxhash64(F.lit(0), "doc_id", "text"), F.lit(1 << 62))).collect()
        whole = Counter()
        for r in rows:
            whole[r.source] += len((r.text or "").split())
        total = sum(whole.values())
        out = mixing.mix(df, **goals).collect()
        weights = {r.source: r.mix_weight for r in out}
        spend = goals.get("budget") or max(whole[s] / weights[s] for s in weights)
        want = Counter()
        for s in weights:
            target = round(weights[s] * spend / whole[s], 9)
            rest = (target - int(target)) * whole[s]
            before = 0
            for r in sorted((r for r in rows if r.source == s), key=lambda r: r.place):
                want[r.doc_id] += int(target) + (before < rest)
                before += len((r.text or "").split())
        assert Counter(r.doc_id for r in out) == +want
        shares = {s: n / total for s, n in whole.items()}
        a = solved(shares.values(), lambda a, w: (goals.get("target_entropy") is None or -sum(x * math.log(x) for x in w) <= goals["target_entropy"]) and (goals["max_repetition"] is None or (max(shares.values()) / min(shares.values())) ** (1 - a) <= 2))
        z = sum(p**a for p in shares.values())
        assert all(abs(weights[s] - p**a / z) < 1e-3 for s, p in shares.items())


def test_blocks_stay_together(spark):
    """In the mixed order of an epoch, each block of a source's permutation is one run."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "concat('w ', id) AS text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source")
    out = mixing.mix(rows, max_repetition=3.0).withColumn("block", F.expr("pmod(xxhash64(0, doc_id, text), 1L << 62) >>> 50")).orderBy("mix_epoch", "mix_order").collect()
    for epoch in {r.mix_epoch for r in out}:
        blocks = [(r.source, r.block) for r in out if r.mix_epoch == epoch]
        assert sum(a != b for a, b in zip(blocks, blocks[1:])) + 1 == len(set(blocks))
    orders = [[r.block for r in out if r.mix_epoch == e and r.source == "a"] for e in (1, 2)]
    assert orders[0] != orders[1][: len(orders[0])] or not orders[1]


def test_epochs_are_whole_permutations(spark):
    out = mixing.mix(docs(spark), max_repetition=3.0).collect()
    by = {}
    for r in out:
        by.setdefault((r.source, r.mix_epoch), []).append(r.doc_id)
    sizes = {s: len(set(ids)) for (s, e), ids in by.items() if e == 1}
    for (s, e), ids in by.items():
        assert len(ids) == len(set(ids)) and (len(ids) == sizes[s] or (s, e + 1) not in by)


def test_odd_rows_and_empty_tables(spark):
    odd = [(None, "a b", None, "", 0), (5000, None, "empty", "", 0), (5001, "", "empty", "", 0), (5002, "x y", "", "", 0), (0, "same", "big", "", 0), (0, "same", "big", "", 0), (5003, "w " * 50_000, "big", "", 0)]
    out = mixing.mix(docs(spark, odd)).collect()
    assert {r.doc_id for r in out} >= {None, 5000, 5001, 5002, 5003}
    assert sum(r.source == "empty" for r in out) == 2 and sum(r.text == "same" for r in out) % 2 == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "s", "", 0)], SCHEMA)).count() == 1
    plan = mixing.mix(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
