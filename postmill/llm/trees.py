"""Fitted tree ensembles as Column expressions, so that they score array elements in place:
no explode, no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _branch(node, field: Callable[[int], Column], leaf: Callable) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(leaf(node)))
    split = node.split()
    return F.when(field(split.featureIndex()) <= F.lit(float(split.threshold())), _branch(node.leftChild(), field, leaf)).otherwise(_branch(node.rightChild(), field, leaf))


def fit_boosted(rows: DataFrame, features: list[str], label: str = "label", rounds: int = 12, depth: int = 3, seed: int = 5) -> Callable[[Callable[[str], Column]], Column]:
    """Gradient boosting on ``rows``; gives a function from a feature getter to the probability."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", F.col(label).cast("double").alias("label"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed, maxBins=32).fit(data)
    trees, weights = list(model._java_obj.trees()), list(model._java_obj.treeWeights())

    def score(get: Callable[[str], Column]) -> Column:
        margin = F.lit(0.0)
        for tree, w in zip(trees, weights):
            margin = margin + F.lit(float(w)) * _branch(tree.rootNode(), lambda i: get(features[i]), lambda n: n.prediction())
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    return score


def fit_forest(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 6, seed: int = 5) -> Callable[[Callable[[str], Column]], Column]:
    """Random forest on ``rows``; gives a function from a feature getter to the share of class 1."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", F.col(label).cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(data)
    roots = [t.rootNode() for t in model._java_obj.trees()]

    def share(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[1] / max(sum(stats), 1e-12)

    def score(get: Callable[[str], Column]) -> Column:
        total = F.lit(0.0)
        for root in roots:
            total = total + _branch(root, lambda i: get(features[i]), share)
        return total / F.lit(float(len(roots)))

    return score


#: Items of a stretch of a scan.
STRETCH = 128


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Outputs (of type ``kind``) of a pass over an array: ``step(state, item)`` gives the next state and an
    output or null. A fold copies all that it holds at every step, so a first fold keeps only the state at
    the start of each stretch, and outputs are then gathered stretch by stretch."""
    none = F.array().cast(f"array<{kind}>")

    def gather(stretch: Column, state: Column) -> Column:
        def go(acc: Column, x: Column) -> Column:
            after, out = step(acc["state"], x)
            return F.struct(after.alias("state"), F.when(out.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(out))).alias("out"))

        return F.aggregate(stretch, F.struct(state.alias("state"), none.alias("out")), go, lambda acc: acc["out"])

    def through(cut: Column) -> Column:
        def go(acc: Column, stretch: Column) -> Column:
            return F.struct(F.aggregate(stretch, acc["state"], lambda state, x: step(state, x)[0]).alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))

        starts = F.aggregate(F.slice(cut, F.lit(2), F.size(cut)), F.struct(F.aggregate(F.element_at(cut, 1), zero, lambda state, x: step(state, x)[0]).alias("state"), F.array(zero).alias("starts")), go, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(cut, starts, gather))

    def all_of(every: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / STRETCH).cast("int")), lambda c: F.slice(every, c * STRETCH + 1, F.lit(STRETCH)))
        return F.when(F.size(every) <= STRETCH, gather(every, zero)).otherwise(_one(cut, through))

    return _one(items, all_of)


def _one(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that a lambda variable holds: a plain column would be worked out wherever ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of a pattern's matches, leftmost and not overlapping, in code
    points. What stands between the matches gives their places."""
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def walk(match: Column) -> Column:
        steps = F.zip_with(match["found"], F.slice(match["gaps"], F.lit(1), F.size(match["found"])), lambda w, g: F.struct(F.length(g).alias("gap"), F.length(w).alias("size")))
        starts = scan(steps, F.lit(0), lambda at, x: (at + x["gap"] + x["size"], at + x["gap"]), "int")
        spans = F.zip_with(match["found"], starts, lambda w, at: F.struct(at.alias("start"), (at + F.length(w)).alias("end"), w.alias("found")))
        return F.when(F.size(match["found"]) > 0, spans).otherwise(empty)

    return _one(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), walk)
