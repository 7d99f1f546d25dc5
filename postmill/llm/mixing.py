"""Mix overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources each belongs to). A flow
carries words from patterns to source quotas; using a pattern's words a second or third time
costs more (convex costs), so repetition is spread before it is deepened. The flow says how
many words each pattern gives; documents are then selected in seeded order, whole.
"""

from __future__ import annotations

import heapq
import json
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit, word_count, written

MAX_REPEATS = 3
#: Buckets of a level of the seeded order; the one that holds a cut is cut once more.
BUCKETS = 4096


def quotas(sizes: list[int], weights: list[int], most: int = MAX_REPEATS) -> list[Fraction]:
    """Shares of the total by weight; what a source can't take (``most`` times its size) is shared
    again by weight among the others until none is above."""
    total, caps = Fraction(sum(sizes)), [Fraction(most * s) for s in sizes]
    out: list[Fraction | None] = [None] * len(sizes)
    while True:
        free = [i for i, x in enumerate(out) if x is None]
        left = total - sum((x for x in out if x is not None), Fraction(0))
        weight = sum(weights[i] for i in free)
        shares = {i: left * weights[i] / weight for i in free}
        above = [i for i in free if shares[i] > caps[i]]
        if not above:
            return [shares[i] if x is None else x for i, x in enumerate(out)]
        for i in above:
            out[i] = caps[i]


def route(patterns: list[tuple[tuple[int, ...], int]], wanted: list[int], most: int = MAX_REPEATS) -> list[int]:
    """Words that each pattern (member sources, size) gives. Successive shortest paths over
    start -> pattern (an arc for each repetition, costs 0, 1, 3, ...) -> source -> end."""
    start, end = 0, 1
    of_pattern = lambda i: 2 + i
    of_source = lambda j: 2 + len(patterns) + j
    arcs: list[list[int]] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(wanted))]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])

    for i, (members, size) in enumerate(patterns):
        for k in range(most):
            arc(start, of_pattern(i), size, k * (k + 1) // 2)
        for j in members:
            arc(of_pattern(i), of_source(j), most * size, 0)
    for j, quota in enumerate(wanted):
        arc(of_source(j), end, quota, 0)

    level = [0] * len(out)
    while True:
        far, by, queue = [None] * len(out), [-1] * len(out), [(0, start)]
        far[start] = 0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, cost = arcs[e]
                if room and (far[b] is None or d + cost + level[a] - level[b] < far[b]):
                    far[b], by[b] = d + cost + level[a] - level[b], e
                    heapq.heappush(queue, (far[b], b))
        if far[end] is None:
            break
        level = [x + (y or 0) for x, y in zip(level, far)]
        path, b = [], end
        while b != start:
            path.append(by[b])
            b = arcs[by[b] ^ 1][0]
        moved = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= moved
            arcs[e ^ 1][1] += moved
    given = [0] * len(patterns)
    for e in out[start]:
        if e % 2 == 0:
            given[arcs[e][0] - 2] += arcs[e ^ 1][1]
    return given


def source_weights(names: list[str | None], cycle: tuple[int, ...] = (5, 2, 1)) -> dict[str | None, int]:
    """Weights by code point order of the names, null last."""
    ordered = sorted((n for n in names if n is not None)) + [None] * (None in names)
    return {n: cycle[i % len(cycle)] for i, n in enumerate(ordered)}


def _cut(rows: DataFrame, group: list[str], need: DataFrame) -> DataFrame:
    """Rows (group, cut, filled) for each group of ``need`` (group, need: words): in the order of (u, tie, r)
    the rows before ``cut`` are those whose sizes sum up to ``filled``, the most that the need holds; a
    null cut takes all rows.

    Cut down level by level: buckets of u, equal rows, buckets of r, rows. A task sorts sums by bucket,
    the distinct rows of one bucket, or one bucket of equal rows: no level follows a hot key."""
    levels = [(F.col("u") * BUCKETS).cast("int"), F.struct("u", "tie"), (F.col("r") * BUCKETS).cast("int"), F.col("r")]
    scope, state, cut = rows.select(*group, "u", "tie", "r", "size"), need.select(*group, "need", F.lit(0).cast("long").alias("filled")), []
    for i, level in enumerate(levels):
        name = f"p{i}"
        scope = scope.withColumn("level", level)
        sums = scope.groupBy(*group, "level").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy(*group).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))
        sums = sums.join(F.broadcast(state.select(*group, "need")), group)
        whole = F.col("upto") <= F.col("need")
        step = sums.groupBy(*group).agg(F.coalesce(F.max(F.when(whole, F.col("upto"))), F.lit(0)).alias("more"), F.min(F.when(~whole, F.col("level"))).alias(name))
        state = state.join(F.broadcast(step), group, "left").select(*group, (F.col("need") - F.coalesce("more", F.lit(0))).alias("need"), (F.col("filled") + F.coalesce("more", F.lit(0))).alias("filled"), *cut, name)
        state = written(state, "mix-cut")  # a row a group
        cut.append(name)
        if i < len(levels) - 1:
            scope = scope.join(F.broadcast(state.filter(F.col(name).isNotNull()).select(*group, F.col(name).alias("level"))), [*group, "level"]).drop("level")
            scope = written(scope, "mix-scope") if i == 0 else scope
    at = F.when(F.col("p3").isNotNull(), F.struct(F.col("p1.u").alias("u"), F.col("p1.tie").alias("tie"), F.col("p3").alias("r")))
    return state.select(*group, at.alias("cut"), "filled")


def _before(cut: str) -> Column:
    return F.col(cut).isNull() | (F.struct("u", "tie", "r") < F.col(cut))


def mix_sources(df: DataFrame, sources: Column, key: list[Column], size: Column | None = None, seed: int = 11, weights: dict | None = None, most: int = MAX_REPEATS) -> DataFrame:
    """Adds ``size``, ``source_size`` and ``target`` (of the first of the document's sources) and
    ``taken``: words the mix takes of the document, a multiple of its size up to ``most`` times.

    ``sources``: array of the source names a document belongs to; a null or empty array, or a null
    in it, is the null source. Size: words of the text unless given. ``weights`` by source name:
    by default 5, 2, 1, repeating, in code point order. The driver holds a row per membership
    pattern and per source; both depend on how the sources overlap, not on the number of documents.
    Documents of size 0 take nothing; an empty table gives an empty result. Same rows and seed:
    same mix: rows equal in ``key`` are told apart by their other columns (maps aside), and among rows
    equal in all it is open which ones are taken, but not how many. Columns of the added names are
    replaced.

    In seeded order documents are taken while they fit what the flow gives their pattern; what is left
    then, less than one document, is filled from all that follow, the largest that fit first, and by one
    more where that comes nearer."""
    spark = df.sparkSession
    added = ("size", "source_size", "target", "taken")
    own = [c for c in df.columns if c.lower() not in added]
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name in own and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    named = F.sort_array(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~")))))
    # A name and its pattern are told apart by "=" (a name) and "~" (null), which sorts after it.
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        F.when(F.size(named) == 0, F.array(F.lit("~"))).otherwise(named).alias("pattern"),
        (word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"),
        unit(*key, seed=seed).alias("u"),
        unit(*plain, seed=seed + 1).alias("tie"),
        F.rand(seed).alias("r"),
    )
    # Written once: sizes are counted once, and equal rows keep their places in every later pass.
    rows = written(rows, "mix-rows")
    narrow = rows.select("pattern", "size", "u", "tie", "r").filter("size > 0")
    held = rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    plan = _plan([(tuple(r["pattern"]), r["words"] or 0) for r in held], weights, most)
    flow = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), "array<struct<pattern:array<string>,rounds:int,rest:long,source_size:long,target:double>>")).alias("p")).select("p.*")

    cut = _cut(narrow, ["pattern"], flow.filter("rest > 0").select("pattern", F.col("rest").alias("need")))
    known = written(flow.join(F.broadcast(cut), "pattern", "left").withColumn("room", F.when(F.col("cut").isNotNull(), F.col("rest") - F.col("filled")).otherwise(0)), "mix-known")
    # Sizes of the documents behind the cut that may come near what is left there. Their number is
    # bounded by what is left, which is less than a document has words.
    behind = narrow.join(F.broadcast(known.filter("room > 0").select("pattern", "cut", "room")), "pattern").filter(~_before("cut") & (F.col("size") < 2 * F.col("room")))
    counts = behind.groupBy("pattern", "room", "size").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("pattern", "room").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    start = F.struct(F.col("room").cast("long").alias("left"), F.array().cast("array<struct<size:bigint,n:bigint>>").alias("out"), F.lit(None).cast("long").alias("over"))

    def fill(acc: Column, x: Column) -> Column:
        n = F.least(x["n"], F.floor(acc["left"] / x["size"]))
        out = F.when(n > 0, F.concat(acc["out"], F.array(F.struct(x["size"].alias("size"), n.alias("n"))))).otherwise(acc["out"])
        # The smallest size of which some stay: none of them fits any more.
        return F.struct((acc["left"] - n * x["size"]).alias("left"), out.alias("out"), F.when(n < x["n"], x["size"]).otherwise(acc["over"]).alias("over"))

    filled = sizes.select("pattern", F.aggregate("sizes", start, fill).alias("f"))
    one = F.when(F.coalesce(F.col("f.over") < 2 * F.col("f.left"), F.lit(False)), F.array(F.struct(F.col("f.over").alias("size"), F.lit(1).cast("long").alias("n")))).otherwise(F.array().cast("array<struct<size:bigint,n:bigint>>"))
    picks = filled.select("pattern", F.explode(F.concat("f.out", one)).alias("x")).groupBy("pattern", "x.size").agg((F.sum("x.n") * F.col("size")).cast("long").alias("need"))
    picks = written(picks, "mix-picks")
    chosen = behind.join(F.broadcast(picks.select("pattern", "size")), ["pattern", "size"]).select("pattern", "size", F.col("size").alias("of"), "u", "tie", "r")
    more = _cut(chosen, ["pattern", "of"], picks.select("pattern", F.col("size").alias("of"), "need"))

    out = rows.join(F.broadcast(known), "pattern").join(F.broadcast(more.select("pattern", F.col("of").alias("size"), F.col("cut").alias("cut_more"), F.lit(True).alias("fills"))), ["pattern", "size"], "left")
    again = (F.col("rest") > 0) & (_before("cut") | (F.coalesce("fills", F.lit(False)) & _before("cut_more")))
    times = F.least(F.lit(most), F.col("rounds") + again.cast("int"))
    return out.select("row.*", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def _plan(held: list[tuple[tuple[str, ...], int]], weights: dict | None, most: int) -> list[dict]:
    """For each pattern: full rounds over its documents, words of the round after them, and the
    size and target of its first source."""
    names = sorted({s for p, _ in held for s in p})
    if not names:
        return []
    place = {s: j for j, s in enumerate(names)}
    sizes = [sum(words for p, words in held if s in p) for s in names]
    by_name = weights or source_weights([None if s == "~" else s[1:] for s in names])
    # A document of several sources is counted in each, but the total counts it once.
    targets = quotas(sizes, [by_name[None if s == "~" else s[1:]] for s in names], most)
    scale = min(Fraction(1), Fraction(sum(w for _, w in held), max(1, sum(sizes))))
    targets = [t * scale for t in targets]
    given = route([(tuple(place[s] for s in p), w) for p, w in held], [round(t) for t in targets], most)
    out = []
    for (p, words), g in zip(held, given):
        rounds = min(most, g // words) if words else 0
        j = place[p[0]]
        out.append({"pattern": list(p), "rounds": rounds, "rest": g - rounds * words, "source_size": sizes[j], "target": float(targets[j])})
    return out
