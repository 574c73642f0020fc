"""Mixing sources by temperature, in DataFrame operations only.

A source's share p of all tokens becomes the weight p**a / sum(p**a): a = 1 keeps the shares, a = 0 makes all sources equal. The
exponent is bisected until the weights reach a target entropy, or until no source is repeated more often than a limit. Weights times
the budget give each source's tokens. They are realised as block permutations: a hash puts a source's documents into a fixed random
order, cut into blocks; whole permutations are used as often as the budget holds them, and of the last one the leading blocks and the
leading documents of one more block. The mixed order is a permutation of all sources' blocks, another one for each epoch: a hash deals
the blocks, and one more the documents within a block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut

BLOCKS = 1 << 12  # of a permutation
POINTS, ROUNDS = 17, 6  # exponents that a round of the bisection looks at; the interval shrinks by 16 in each

NO_SOURCE = "\0none"  # stands for null


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """kept (all columns), text, source (a key, never null), place in the source's permutation (0 up to 2**62), block."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 62))
    rows = docs.select(F.struct("*").alias("kept"), "text", F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("source"), place.alias("place"))
    return rows.withColumn("block", F.shiftrightunsigned("place", 50))  # BLOCKS of them


def solve_exponent(shares: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None, total: float) -> tuple[float, float, float]:
    """The exponent in [0, 1], sum(p**a) and the budget in tokens, for a table of positive shares (share).

    The exponent is the smallest whose weights have at most ``target_entropy`` (nats) and repeat no source more than
    ``max_repetition`` times. Without a budget, the budget is the least that uses every document at least once.
    """
    low, high = shares.agg(F.min("share"), F.max("share")).first()

    def repetition(a: float, z: float) -> float:
        return low ** (a - 1) / z * ((budget or cover(a, z)) / total)

    def cover(a: float, z: float) -> float:
        return total * z * high ** (1 - a)

    def right(a: float, z: float, pl: float) -> bool:
        entropy = math.log(z) - a * pl / z
        return (target_entropy is None or entropy <= target_entropy + 1e-12) and (max_repetition is None or repetition(a, z) <= max_repetition * (1 + 1e-12))

    def look(points: list[float]) -> list[tuple[float, float]]:
        aggs = [F.sum(F.pow("share", F.lit(a))) for a in points] + [F.sum(F.pow("share", F.lit(a)) * F.ln("share")) for a in points]
        row = shares.agg(*aggs).first()
        return list(zip(row[: len(points)], row[len(points) :]))

    a, b = 0.0, 1.0
    best = (1.0, look([1.0])[0][0])
    for _ in range(ROUNDS):
        points = [a + (b - a) * i / (POINTS - 1) for i in range(POINTS)]
        found = look(points)
        ok = [i for i, (z, pl) in enumerate(found) if right(points[i], z, pl)]
        if not ok:
            break  # not even the shares themselves: they are the nearest
        best = (points[ok[0]], found[ok[0]][0])
        if ok[0] == 0:
            break
        a, b = points[ok[0] - 1], points[ok[0]]
    return best[0], best[1], budget or cover(*best)


def plan(docs: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None, seed: int) -> DataFrame:
    """One stored row per source: source, tokens, share, weight, target_tokens, whole (permutations), last (place up to which one more is used; null: none)."""
    keys = cut(_keyed(docs, seed).select("source", "place", "block", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens")))
    per_block = keys.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    per_block = cut(per_block)
    sources = per_block.groupBy("source").agg(F.sum("tokens").cast("double").alias("tokens"))
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    shares = cut(sources.withColumn("share", F.col("tokens") / F.lit(max(total, 1.0))))
    if total > 0:
        a, z, spend = solve_exponent(shares.where("share > 0"), target_entropy, max_repetition, budget, total)
    else:
        a, z, spend = 1.0, 1.0, 0.0
    # sources without a token keep each row once
    weighted = shares.withColumn("weight", F.when(F.col("share") > 0, F.pow("share", F.lit(a)) / z).otherwise(0.0)).withColumn("target_tokens", F.col("weight") * spend)
    ratio = F.round(F.try_divide("target_tokens", "tokens"), 9)
    weighted = weighted.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(ratio)).otherwise(1).cast("int"))
    weighted = weighted.withColumn("rest", F.when(F.col("tokens") > 0, (ratio - F.col("whole")) * F.col("tokens")).otherwise(0.0))
    order = Window.partitionBy("source").orderBy("block")
    before = per_block.withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    edge = before.join(weighted.select("source", "rest"), "source").where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("tokens")))
    edge = cut(edge.select("source", "block", "before", "rest"))
    inside = keys.join(edge, ["source", "block"]).groupBy("source", "place").agg(F.sum("tokens").alias("tokens"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    within = Window.partitionBy("source").orderBy("place")
    last = inside.withColumn("start", F.col("before") + F.sum("tokens").over(within) - F.col("tokens")).where("start < rest").groupBy("source").agg(F.max("place").alias("last"))
    return cut(weighted.join(last, "source", "left").select("source", "tokens", "share", "weight", "target_tokens", "whole", "last"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 2.0, budget: float | None = None, seed: int = 0, marks: bool = True) -> DataFrame:
    """documents -> its rows, each as often as the mixture uses it, with columns mix_epoch (1, 2, ...), mix_weight (of the source) and mix_order (the place in the mixed order; sort by epoch and this).

    Tokens are words. With ``budget`` (tokens), sources whose target is less than they have are cut to it; without, every row is
    used at least once. Null text has no tokens, a null source is a source of its own, sources without tokens keep their rows once,
    equal rows share one place in the permutation and so are used equally often, texts of any length count whole, and an empty table
    gives no rows. Columns of the input with these names are replaced, or kept as they are without ``marks``; so are all other columns.
    """
    sources = plan(docs, target_entropy, max_repetition, budget, seed).select("source", "weight", "whole", "last")
    # the stored table of sources has a known size: Spark broadcasts it if small and shuffles, splitting hot sources, if not
    rows = _keyed(docs, seed).join(sources, "source")
    copies = F.col("whole") + F.when(F.col("place") <= F.col("last"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    if not marks:
        return rows.select("kept.*")
    of_block = F.pmod(F.xxhash64(F.lit(seed), "block", "epoch", "source"), F.lit(1 << 31))
    order = F.shiftleft(of_block, 32) + F.pmod(F.xxhash64("place", "epoch"), F.lit(1 << 32))
    kept = [F.col("kept")[c].alias(c) for c in docs.columns if c not in ("mix_epoch", "mix_weight", "mix_order")]
    return rows.select(*kept, F.col("epoch").alias("mix_epoch"), F.col("weight").alias("mix_weight"), order.alias("mix_order"))
