"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into blocks by a hash. How many rows each block sends to each shard is drawn first,
exactly as a uniform permutation would distribute them (a multivariate hypergeometric matrix
whose row sums are the block sizes and whose column sums the shard sizes). Each block then
permutes its rows and deals them out by its row of the matrix, the rows are exchanged, and each
shard permutes what it got. Only block sizes reach the driver, and there are at most ``MOST_BLOCKS``.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit

#: Rows of a block, about; fewest and most blocks (the driver draws a matrix of blocks by shards).
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 100_000, 256, 1 << 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` from ``good + bad``: inversion outward from the mode,
    which takes steps in the order of the standard deviation for populations of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def ln(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(ln(good, mode) + ln(bad, draws - mode) - ln(good + bad, draws))
    u, up, down, p_up, p_down = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(block_sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard; shard sizes differ by one at most."""
    rng, total = random.Random(seed), sum(block_sizes)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for size in block_sizes:
        row, left, others = [], size, sum(room)
        for j in range(shards):
            others -= room[j]
            row.append(hypergeometric(rng, room[j], others, left))
            left -= row[-1]
        room = [r - x for r, x in zip(room, row)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int, key: list[Column], seed: int = 7, blocks: int | None = None) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``key`` tells rows apart; rows equal in it are interchangeable, and nulls in it are values like
    others. ``blocks`` bounds what the driver sees: by default it follows the number of rows, so that a block fits a
    task's sort, which spills. Rows equal in ``key`` meet in one block, so give all that tells rows apart. An empty table gives an empty result. Same rows and seed: same shards and slots. Columns named
    ``shard`` or ``slot`` are replaced."""
    spark = df.sparkSession
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
    keys = [F.col(f"k{i}") for i in range(len(key))]
    blocks = blocks or min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-df.count() // BLOCK_ROWS)))
    rows = rows.select("row", (unit(*keys, seed=seed) * blocks).cast("int").alias("block"), F.xxhash64(*keys, F.lit(seed + 1)).alias("first"), F.xxhash64(*keys, F.lit(seed + 2)).alias("second"))

    sizes = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    sent = communication_matrix([sizes[b] for b in order], shards, seed)
    ends = {b: [sum(row[: j + 1]) for j in range(shards)] for b, row in zip(order, sent)}
    matrix = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"block": b, "ends": e} for b, e in ends.items()])), "array<struct<block:int,ends:array<long>>>")).alias("m")).select("m.block", "m.ends")

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("first", "second")))
    dealt = ranked.join(F.broadcast(matrix), "block").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))

    # The second permutation is the order of a hash; its leading digits cut a shard into parts
    # that are sorted each in a task of its own, after parts' sizes have given their first slots.
    part = F.shiftrightunsigned(F.col("second"), 56).cast("int")
    dealt = dealt.select("row", "shard", "second", "first", part.alias("part"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    placed = dealt.withColumn("in_part", F.row_number().over(Window.partitionBy("shard", "part").orderBy("second", "first")))
    out = placed.join(F.broadcast(starts), ["shard", "part"])
    return out.select("row.*", "shard", (F.col("start") + F.col("in_part") - 1).cast("long").alias("slot"))
