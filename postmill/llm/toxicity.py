"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its lower-cased bytes, each counted once. Their
log-count ratios between toxic and other labelled texts scale a logistic regression. The n-grams that
tell the classes apart best have weights of their own; all others seen in training share one, so each
weighs its ratio times it. All n-grams of whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, pieces, text_bytes, written

SIZES = (3, 4, 5)
BITS = 18
#: Labelled rows of each class that the fit uses at most (those of smallest hash), and n-grams with a
#: weight of their own.
TRAINING_ROWS = 3_000
FEATURES = 1024
SEED = 3
_PIECE = 1 << 20


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """(row, bucket) of every n-gram of the rows, by stretches of bytes, in each by size. Rows are set apart by
    white space, so that words at their ends have the same n-grams as others."""
    n = len(offsets) - 1
    flat = np.full(len(data) + 2 * n, 32, np.uint8)
    place = np.ones(len(flat), bool)
    starts = offsets[:-1] + 2 * np.arange(n)
    ends = offsets[1:] + 2 * np.arange(n) + 1
    place[starts] = place[ends] = False
    low = _LOWER[data]
    low[_SPACE[data]] = 32
    flat[place] = low
    stops = ends + 1
    for a in range(0, len(flat), _PIECE):
        part = flat[a : a + _PIECE + max(SIZES)].astype(np.uint32)
        inner = stops[(stops > a) & (stops < min(a + _PIECE, len(flat)))]
        steps = np.zeros(min(_PIECE, len(flat) - a), np.int32)
        steps[inner - a] = 1
        steps[0] = np.searchsorted(stops, a, side="right")
        row = np.cumsum(steps, dtype=np.int32)
        h = np.zeros(len(part), np.uint32)
        room = (stops[row] - np.arange(a, a + len(row))).astype(np.int32)
        out = []
        for k in range(max(SIZES)):
            h = h[: len(part) - k] * np.uint32(0x01000193) + part[k:]
            if k + 1 in SIZES:
                b = h[: len(row)] * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
                b ^= b >> np.uint32(15)
                b *= np.uint32(0x2C1B3C6D)
                b >>= np.uint32(32 - BITS)
                fits = room[: len(b)] >= k + 1
                out.append((row[: len(b)][fits], b[fits]))
        yield out


def _distinct(column) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct buckets) of the texts that have any. One table of marks serves all rows, so no row's
    n-grams are sorted, and a long text needs no more room than a short one."""
    marks = np.zeros(1 << BITS, bool)
    for first, part in pieces(column, _PIECE):
        now = -1
        for stretch in _ngrams(*text_bytes(part)):
            rows = [row for row, _ in stretch if len(row)]
            if not rows:
                continue
            low, high = min(int(r[0]) for r in rows), max(int(r[-1]) for r in rows)
            cuts = [np.searchsorted(row, np.arange(low, high + 2)).tolist() for row, _ in stretch]
            for r in range(low, high + 1):
                if r != now:
                    found = np.flatnonzero(marks) if now >= 0 else ()
                    if len(found):
                        marks[found] = False
                        yield first + now, found
                    now = r
                for (_, bucket), cut in zip(stretch, cuts):
                    marks[bucket[cut[r - low] : cut[r - low + 1]]] = True
        found = np.flatnonzero(marks)
        if len(found):
            marks[found] = False
            yield first + now, found


def _fit(label: np.ndarray, n: np.ndarray, feature: np.ndarray, ratios: np.ndarray, rest: np.ndarray, weights: tuple[float, float], steps: int = 300, penalty: float = 0.1) -> tuple[np.ndarray, float, float]:
    """Weights, weight of ``rest`` and intercept of the logistic regression on presence times ratio; Adam over
    all rows. Row i has the next ``n[i]`` of the features; ``rest`` is the sum of all other ratios."""
    y, rows = label.astype(float), len(label)
    cw = np.where(y > 0, weights[1], weights[0])
    cw /= cw.sum()
    at = np.repeat(np.arange(rows, dtype=np.int32), n)
    x = ratios[feature].astype(np.float32)
    scale = max(float(np.std(rest)), 1e-9)
    rest = rest / scale
    w, m, v = (np.zeros(len(ratios) + 2) for _ in range(3))
    p1 = min(max(float((cw * y).sum()), 1e-3), 1 - 1e-3)
    w[-1] = np.log(p1 / (1 - p1))
    for t in range(1, steps + 1):
        z = np.bincount(at, w.astype(np.float32)[feature] * x, rows) + w[-2] * rest + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cw
        grad = np.append(np.bincount(feature, g.astype(np.float32)[at] * x, len(ratios)) + penalty / max(1, len(ratios)) * w[:-2], [(g * rest).sum() + penalty * 1e-2 * w[-2], g.sum()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return w[:-2] * ratios, float(w[-2] / scale), float(w[-1])


def _ratios(have: np.ndarray, docs: np.ndarray, without: int | None = None) -> np.ndarray:
    """Log-count ratios of the buckets; as one document of class ``without`` that has them sees them, if given."""
    have, docs = have.astype(float), docs.astype(float)
    if without is not None:
        have[without] = np.maximum(have[without] - 1, 0)
        docs[without] -= 1
    return np.log((have[1] + 1) / (docs[1] + 2)) - np.log((have[0] + 1) / (docs[0] + 2))


class ToxicityModel:
    """Fits on ``labelled`` (text, label 0 or 1; other labels are ignored). Without rows of both
    classes every score is the share of label 1 (0 without rows)."""

    def __init__(self, spark: SparkSession, labelled: DataFrame, counts: dict[int, int] | None = None):
        # The sample is bounded, so a few tasks hold it and their dense counts have a fixed size.
        sample = written(labelled.filter("label in (0, 1)").select("text", F.col("label").cast("int").alias("label")).repartition(8, F.xxhash64("text")), "toxic-train")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, docs = np.zeros((2, 1 << BITS), np.float32), np.zeros(2, np.int64)
            for batch in batches:
                label = np.array(batch.column(1))
                docs += np.bincount(label, minlength=2)
                for row, found in _distinct(batch.column(0)):
                    total[label[row], found] += 1
            if docs.sum():
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([docs.tolist()])], ["counts", "docs"])

        parts = sample.mapInArrow(count, "counts binary, docs array<long>").collect()
        have = np.zeros((2, 1 << BITS))
        for p in parts:
            have += np.frombuffer(p["counts"], np.float32).reshape(2, -1)
        docs = np.sum([p["docs"] for p in parts], axis=0) if parts else np.zeros(2)
        self.weights, self.intercept = np.zeros(1 << BITS, np.float32), 0.0
        if min(docs) == 0:
            self.intercept = 30.0 if docs[1] else -30.0
            return
        ratio = _ratios(have, docs)
        # How far the class shares of documents stand apart, in standard errors.
        share = (have + 1) / (docs[:, None] + 2)
        pooled = (have.sum(axis=0) + 1) / (docs.sum() + 2)
        apart = np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / docs[1] + 1 / docs[0]) + 1e-12)
        apart[have.sum(axis=0) == 0] = -1
        best = np.argsort(-apart, kind="stable")[:FEATURES]
        best = best[apart[best] > 0]
        chosen = np.zeros(1 << BITS, np.uint16)
        chosen[best] = np.arange(1, len(best) + 1)
        # A training text must not see its own count in the ratios that it is judged by.
        others = [np.where((chosen == 0) & (have.sum(axis=0) > 0), _ratios(have, docs, c), 0).astype(np.float32) for c in (0, 1)]

        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label, n, rest, own = np.array(batch.column(1)), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), [np.zeros(0, np.uint16)]
                for row, found in _distinct(batch.column(0)):
                    rest[row] = others[label[row]][found].sum()
                    mine = chosen[found]
                    own.append(mine[mine > 0] - np.uint16(1))
                    n[row] = len(own[-1])
                parts = [label.astype(np.int32), n, np.concatenate(own), rest]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["label", "n", "features", "rest"])

        packed = sample.mapInArrow(select, "label binary, n binary, features binary, rest binary").collect()
        label, n, feature, rest = (np.concatenate([np.frombuffer(r[c], t) for r in packed]) for c, t in (("label", np.int32), ("n", np.int32), ("features", np.uint16), ("rest", float)))
        counts = counts or {0: docs[0], 1: docs[1]}
        own, common, self.intercept = _fit(label, n, feature.astype(np.int32), ratio[best], rest, (counts[0] / docs[0], counts[1] / docs[1]))
        self.weights = np.where(have.sum(axis=0) > 0, common * ratio, 0).astype(np.float32)
        self.weights[best] = own

    def probability(self, spark: SparkSession, text: Column) -> Column:
        """The score of a text column; null is an empty text."""
        model = spark.sparkContext.broadcast((self.weights, self.intercept))  # fixed size

        @F.arrow_udf("double")
        def score(column: pa.Array) -> pa.Array:
            weights, intercept = model.value
            out = np.full(len(column), intercept)
            if weights.any():
                for row, found in _distinct(column):
                    out[row] += weights[found].sum()
            return pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))

        return score(text)


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> ToxicityModel:
    """Fits on documents (doc_id, text) that ``labels`` (doc_id, toxic) mark and whose crc32(doc_id)
    modulo 5 is not 0: at most ``most`` rows of each class, those of smallest hash; classes weigh as they
    occur. Repeated rows count once. A document with several labels is toxic if one says so; null labels don't count."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.filter(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = lambda c: known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
    chosen = written(some(0).union(some(1)), "toxic-labels")
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``most``
    # Repeated rows count once, and a document with several texts may not take more than the bound.
    rows = labelled.groupBy("label", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h")).agg(F.first("text").alias("text"))
    rows = written(rows, "toxic-rows")
    if any(r["n"] > most for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()):
        first = lambda c: rows.filter(F.col("label") == c).select("label", "h").orderBy("h").limit(most)
        rows = rows.join(F.broadcast(first(0).union(first(1))), ["label", "h"])
    return ToxicityModel(docs.sparkSession, rows, {c: counts.get(c, 0) for c in (0, 1)})


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from 0.5 on). Every row is
    scored by its whole text; empty and null texts get the intercept's score. Equal texts get equal
    scores; rows and other columns stay, columns of the added names are replaced."""
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("score", "predicted")]
    out = df.select(*own, model.probability(df.sparkSession, F.col(f"`{text}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
