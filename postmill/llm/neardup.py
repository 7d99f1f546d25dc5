"""Near-duplicates by ProbMinHash signatures, banding and verification.

A text is a weighted set of five-word shingles (weight 1 + ln of the occurrences). Each shingle is a
Poisson process of its weight's rate whose arrivals fall on signature slots at random; a slot keeps
the shingle that arrives first, and a shingle's process ends early when it is later than all slots.
Two texts agree in a slot with their probability Jaccard similarity. Texts that agree in all slots of
a band are candidates; each candidate pair is verified on its whole shingle sets.

Equal texts are one node. In a band, every node is compared with the smallest, which keeps pairs
linear in the group; nodes of one band that are not in one component then are compared with each
other, except where distances to the smallest (a metric) or shared shingles show that they are too far
apart. Both bounds are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, shingles, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
#: Members that one task compares with a leader it holds.
SPREAD = 256
#: Members of a block of a family and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
_GRAM = np.uint64((1 << 32) - 1)


def weighted_shingles(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, occurrences) of distinct five-word shingles, 32 bits each, by row, then shingle."""
    gram, row = shingles(Words(column), WORDS)
    both = np.sort((row.astype(np.uint64) << np.uint64(32)) | (gram & _GRAM))
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(both)))
    both = both[first]
    return (both >> np.uint64(32)).astype(np.int64), both & _GRAM, count


def signatures(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """Signature matrix of the rows; a slot holds the shingle that arrives there first."""
    first, winner = np.full(rows * slots, np.inf), np.zeros(rows * slots, np.uint64)
    seed, at, doc, rate, name = mix(gram + np.uint64(0x9E3779B97F4A7C15)), np.zeros(len(gram)), row, weight.astype(float), gram
    latest, arrival = np.full(rows, np.inf), 0
    while len(doc):
        arrival += 1
        h = mix(seed + np.uint64(arrival * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((h >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
        live = at < latest[doc]
        seed, at, doc, rate, name, h = seed[live], at[live], doc[live], rate[live], name[live], h[live]
        slot = ((mix(h) >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        place = doc * slots + slot.astype(np.int64)
        np.minimum.at(first, place, at)
        won = first[place] == at
        winner[place[won]] = name[won]
        active = np.flatnonzero(np.bincount(doc, minlength=rows)) if len(doc) else doc
        latest[active] = first.reshape(rows, slots)[active].max(axis=1)
    return winner.reshape(rows, slots)


def band_keys(column, bands: int = BANDS, rows: int = ROWS) -> list:
    """Array of band keys for each text; none for a text without words."""
    row, gram, count = weighted_shingles(column)
    sig = signatures(row, gram, 1 + np.log(count), len(column), bands * rows)
    key = np.zeros((len(column), bands), np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::rows] + np.arange(bands, dtype=np.uint64))
    has = np.bincount(row, minlength=len(column)) > 0
    return [k if ok else None for k, ok in zip(key.view(np.int64), has)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of the weighted shingles. Arguments: sorted shingles and their
    occurrences."""
    (ga, na), (gb, nb) = a, b
    if not len(ga) or not len(gb):
        return 0.0
    place = np.minimum(np.searchsorted(gb, ga), len(gb) - 1)
    shared = gb[place] == ga
    if not shared.any():
        return 0.0
    wa, wb = 1 + np.log(na), 1 + np.log(nb)
    x, y = wa[shared], wb[place[shared]]
    # For each shared shingle the sum, over all, of the larger of the two ratios of weights: those of
    # a larger ratio than its own count by a's weights, the others by b's.
    order = np.argsort(-x / y, kind="stable")
    x, y = x[order], y[order]
    upto = np.searchsorted(-x / y, -x / y, side="right")
    sum_x, sum_y = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(y))
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    return float((1 / ((only_a + sum_x[upto]) / x + (only_b + y.sum() - sum_y[upto]) / y)).sum())


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, label) for the ends of ``edges`` (a, b): the smallest id of each one's component. Star
    contraction, written tables a round: all neighbours move to the smallest, until each node has one edge
    to a smallest node.

    The smallest neighbours are written before edges meet them, so that both sides of the join are plain
    exchanges by its key, whose large partitions Spark splits: a node with very many edges is no one task's."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc")
    while True:
        ends = edges.select(F.col("b").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("a", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges.select(F.col("b").alias("id"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())
        # Larger neighbours of a node go to its smallest neighbour; then smaller ones and itself.
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
        large = written(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct(), "cc-large")
        small = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        edges = written(small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")).distinct(), "cc")


def _verify(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Rows (a, b, similarity) of the pairs (a: the one held, b) of at least ``least``. ``texts``: id, text.

    Both texts' shingles go to the held one's task; a held text with many partners is dealt over tasks
    by ``SPREAD`` of them, so no group grows with the data and partners stream past the one held."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    tasks = F.ceil(F.col("n") / SPREAD).cast("int")
    salt = F.pmod(F.xxhash64("b"), tasks.cast("long")).cast("int")
    partner = pairs.join(many, "a").select(F.col("b").alias("id"), F.struct(F.col("a").alias("a"), salt.alias("salt"), F.lit(1).alias("role")).alias("to"))
    held = many.select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt")).select("id", F.struct(F.col("id").alias("a"), "salt", F.lit(0).alias("role")).alias("to"))
    wanted = partner.union(held).groupBy("id").agg(F.collect_list("to").alias("to"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in pieces(batch.column(1)):
                row, gram, count = weighted_shingles(column)
                cuts = np.searchsorted(row, np.arange(len(column) + 1))
                ids = batch.column(0).slice(first, len(column))
                grams = [gram[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, cuts[1:])]
                counts = [count[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([ids, pa.array(grams, pa.large_binary()), pa.array(counts, pa.large_binary()), batch.column(2).slice(first, len(column))], ["id", "grams", "counts", "to"])

    # A merge join at any size, as most texts of a corpus of copies are wanted.
    shingled = texts.join(wanted.hint("merge"), "id").select("id", "text", "to").mapInArrow(emit, "id long, grams binary, counts binary, to array<struct<a:bigint,salt:int,role:int>>")
    dealt = shingled.select("id", "grams", "counts", F.explode("to").alias("to")).select("to.a", "to.salt", "to.role", "id", "grams", "counts")
    dealt = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held = None, None
        for batch in batches:
            out = []
            for a, role, b, grams, counts in zip(batch.column(0), batch.column(2), batch.column(3), batch.column(4), batch.column(5)):
                grams = np.frombuffer(grams.as_buffer(), np.uint32)
                own = (grams, np.frombuffer(counts.as_buffer(), np.uint32))
                if role.as_py() == 0:
                    held_id, held = a.as_py(), own
                elif a.as_py() == held_id and (s := similarity(held, own)) >= least:
                    out.append((held_id, b.as_py(), s))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return dealt.mapInArrow(compare, "a long, b long, similarity double")


class _Block:
    """Texts of a block by their shingles: ``most`` gives for one of them a number for each that is never below
    their similarity, and close to it where most shingles occur once."""

    def __init__(self, grams: list[np.ndarray], weights: list[np.ndarray]):
        self.grams, self.weights = grams, weights
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        self.owner, self.every, self.weight = owner[order], every[order], np.concatenate(weights)[order]
        self.total = np.array([w.sum() for w in weights])

    def most(self, i: int) -> np.ndarray:
        lo, hi = (np.searchsorted(self.every, self.grams[i], side=side) for side in ("left", "right"))
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        owner, theirs, mine = self.owner[at], self.weight[at], np.repeat(self.weights[i], n)
        x, y, larger = (np.bincount(owner, v, len(self.grams)) for v in (mine, theirs, np.maximum(mine, theirs)))
        # A shared shingle adds at most its larger weight over the weight of all shingles of both.
        return larger / (self.total[i] - x + self.total - y + np.maximum(x, y))


def _between(texts: DataFrame, shared: DataFrame, labels: DataFrame, checked: DataFrame) -> DataFrame:
    """Links (a, b) between members of one band that the comparison with the band's smallest has left
    in different components.

    Bands with one smallest node form a family, cut into blocks by members and bytes. In each pair of
    blocks the pairs of different components that no exact bound rules out are verified, those that may be
    most alike first; a pair joins its components, so that few pairs of a dense family are verified, and at
    most a link per member leaves the task."""
    family = shared.filter("id <> a").select("a", "id", "size").distinct()
    named = labels.select("id", "label")
    family = family.join(named, "id", "left").select("a", "id", "size", F.coalesce("label", "id").alias("comp"))
    family = family.join(checked.select("a", F.col("b").alias("id"), "similarity"), ["a", "id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    own = F.col("similarity") >= SIMILARITY
    near = (F.col("similarity") >= 1 - 2 * (1 - SIMILARITY)) & ~own
    shape = family.groupBy("a").agg(F.count("*").alias("n"), F.count(F.when(~own, 1)).alias("apart"), F.count(F.when(near, 1)).alias("near"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("size").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    # Without a near one, those linked with the smallest are too far from all that are not.
    shape = written(shape.filter("low < high and (apart > 1 or near > 0)").select("a", (F.col("near") > 0).alias("all"), blocks.alias("blocks")), "neardup-shape")
    family = written(family.join(shape, "a").filter(F.col("all") | ~own), "neardup-family")
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks").cast("long")).cast("int")
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    places = family.withColumn("block", block).select("id", F.explode(F.transform(tile, lambda t: F.struct(F.col("a"), F.col("comp"), F.col("similarity"), F.col("block"), t.alias("tile")))).alias("to"))
    wanted = places.groupBy("id").agg(F.collect_list("to").alias("to"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in pieces(batch.column(1)):
                row, gram, count = weighted_shingles(column)
                cuts = np.searchsorted(row, np.arange(len(column) + 1))
                spans = list(zip(cuts, cuts[1:]))
                packed = [pa.array([x[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.large_binary()) for x in (gram, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(column)), *packed, batch.column(2).slice(first, len(column))], ["id", "grams", "counts", "to"])

    def join(group: pa.Table) -> pa.Table:
        column = lambda name: group.column(name).combine_chunks()
        ids, comp, to_leader, block = (column(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "similarity", "block"))
        grams, counts = ([np.frombuffer(x.as_buffer(), np.uint32) for x in column(c)] for c in ("grams", "counts"))
        crossed = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        _, root = np.unique(comp, return_inverse=True)
        held, links, apart = _Block(grams, [1 + np.log(n) for n in counts]), [], 1 - SIMILARITY + 1e-9
        # Pairs with one component are found from their other end: that of the leader, whose members are not
        # gone through, or the largest.
        linked = np.flatnonzero(to_leader >= SIMILARITY)
        anchor = int(linked[0] if len(linked) else np.flatnonzero(root == np.bincount(root).argmax())[0])
        for i in np.flatnonzero(to_leader < SIMILARITY):
            if root[i] == root[anchor]:
                continue
            most = held.most(i)
            ok = (most >= SIMILARITY - 1e-9) & (root != root[i])
            ok &= (np.abs(to_leader - to_leader[i]) <= apart) | (to_leader == 0) | (to_leader[i] == 0)  # 0: too low to be known
            if crossed:
                ok &= block != block[i]
            other = np.flatnonzero(ok)
            for j in other[np.argsort(-most[other], kind="stable")].tolist():
                if root[i] != root[j] and similarity((grams[i], counts[i]), (grams[j], counts[j])) >= SIMILARITY:
                    links.append((int(ids[i]), int(ids[j])))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    place = "struct<a:bigint,comp:bigint,similarity:double,block:int,tile:struct<i:int,j:int>>"
    shingled = texts.join(wanted, "id").select("id", "text", "to").mapInArrow(emit, f"id long, grams binary, counts binary, to array<{place}>")
    tiles = shingled.select("id", "grams", "counts", F.explode("to").alias("to")).select("id", "grams", "counts", "to.a", "to.comp", "to.similarity", "to.block", "to.tile.i", "to.tile.j")
    return tiles.groupBy("a", "i", "j").applyInArrow(join, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (``key``, class_id, kept): a row per row of ``df``, the class being the smallest key among the
    documents linked with it, directly or by way of others. Links: equal texts, and pairs found by
    banding whose similarity on five-word shingles is 0.8 or more. ``kept`` is true in one row of each
    class, of the smallest key, however often rows are repeated.

    Null texts are empty, and all texts without words are equal only as they stand; a text of fewer
    than five words is one shingle. Rows without a key get no class and are not kept. Rows of one key are one document.
    Other columns are ignored. Whole texts are compared, however long."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    same = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), F.octet_length("text").cast("long").alias("size")]

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in pieces(batch.column(4), 12 << 20):
                fixed = [batch.column(i).slice(first, len(column)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(band_keys(column), pa.list_(pa.int64()))], ["id", "h1", "h2", "size", "bands"])

    signed = written(docs.filter("id is not null").select("id", *same, "text").mapInArrow(bands, "id long, h1 long, h2 long, size long, bands array<long>").withColumn("row", F.monotonically_increasing_id()), "neardup-bands")
    nodes = written(signed.groupBy("h1", "h2").agg(F.min("id").alias("node")), "neardup-nodes")
    banded = signed.join(nodes, (signed.h1 == nodes.h1) & (signed.h2 == nodes.h2) & (signed.id == nodes.node), "left_semi").select("id", "size", F.explode("bands").alias("band")).distinct()
    leaders = banded.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "a")
    shared = written(banded.join(leaders, "band"), "neardup-shared")

    pairs = written(shared.filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "neardup-pairs")
    texts = docs.filter("id is not null")
    near = 1 - 2 * (1 - SIMILARITY)  # beyond it from the leader, no link to what the leader is linked with
    checked = written(_verify(texts, pairs, near), "neardup-checked")
    links = checked.filter(F.col("similarity") >= SIMILARITY).select("a", "b")
    labels = written(components(links), "neardup-labels")
    links = links.union(_between(texts, shared, labels, checked))
    labels = components(links)

    out = signed.select("id", "h1", "h2", "row").join(nodes, ["h1", "h2"]).select("id", "node", "row")
    # A key with rows of several texts ties their classes together.
    several = out.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    if not several.isEmpty():
        labels = components(links.union(out.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("node").alias("b"))))
    labels = labels.select(F.col("id").alias("node"), "label")
    # Of the rows of a key that is there more than once, the first stands for it.
    repeated = signed.groupBy("id").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1").select("id", "first")
    found = out.join(labels, "node", "left").withColumn("class_id", F.coalesce("label", "node")).join(repeated, "id", "left")
    kept = (F.col("id") == F.col("class_id")) & (F.col("first").isNull() | (F.col("first") == F.col("row")))
    found = found.select(F.col("id").alias(key), "class_id", kept.alias("kept"))
    lost = docs.filter("id is null").select(F.col("id").alias(key), F.lit(None).cast("long").alias("class_id"), F.lit(False).alias("kept"))
    return found.union(lost)
