"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into overlapping passages that hold any window within the item, and these become
TF-IDF vectors (document frequencies of their words over the whole corpus).
They are dealt into latent spaces of at most as many passages as a space has dimensions, each by a
randomised SVD where its passages lie, so a space holds its passages whole however many there are.
Windows of every text are projected into each and compared with its passages; what comes near is
checked by the longest common subsequence of words, and where that alone doesn't settle it by the
item's answer, its last words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, pieces, word_count

#: Dimensions and most passages of a latent space, words of a window's half, and the cosine from which
#: a window is checked. It is also checked from this share of a passage's own norm, or, of a passage that
#: fits a half, from what the cheapest words that prove a leak alone have of it: the words around a short
#: passage lower the cosine.
RANK, HALF, COSINE, CONTAINED = 128, 24, 0.22, 0.35
#: Words of a passage, and from one to the next; a shorter item is one.
PASSAGE, STRIDE = 96, 48
#: Shares of an item's words in common order that prove a leak: alone, or with the answer.
ALONE, WITH_ANSWER, ANSWER_WORDS, ANSWER_SHARE = 0.7, 0.5, 8, 0.75
#: Passages of one pass over the texts (it bounds what the driver holds); more take further passes.
PASS = 1024
#: Most frequent words of a space whose occurrences are counted into a matrix, not added one by one.
DENSE = 192
LEAK = "array<struct<item_id:bigint,share:double,cosine:double,answer:boolean>>"


def common_words(item: dict[int, int], region: np.ndarray, size: int) -> int:
    """Length of the longest common subsequence; ``item`` has for each word the set of its places as
    bits. One addition handles a word of the region against the whole item."""
    return _common([item.get(word, 0) for word in region.tolist()], size)


def _common(places: list[int], size: int) -> int:
    every = (1 << size) - 1
    row = every
    for at in places:
        hit = row & at
        row = ((row + hit) | (row - hit)) & every
    return size - row.bit_count()


def _bits(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Benchmark:
    """The items (item_id, text) of one pass: their words, document frequencies over ``docs``, and the
    latent spaces. Items without words take no part; null ids are left out."""

    def __init__(self, items: DataFrame, docs: DataFrame, rank: int = RANK, seed: int = 23):
        spark = docs.sparkSession
        rows = items.select("item_id", "text").collect()  # at most PASS
        words = Words(pa.array([r["text"] for r in rows], pa.string()), lower=True, strip=True)
        cuts = np.cumsum(np.append(0, words.count))
        kept = [i for i in range(len(rows)) if words.count[i]]
        self.ids = [rows[i]["item_id"] for i in kept]
        self.words = [words.hash[cuts[i] : cuts[i + 1]] for i in kept]
        self.vocabulary = np.unique(np.concatenate(self.words)) if kept else np.zeros(0, np.uint64)
        vocabulary = self.vocabulary

        def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n = np.zeros(len(vocabulary), np.int64), 0
            for batch in batches:
                for _, column in pieces(batch.column(0)):
                    w = Words(column, lower=True, strip=True)
                    at, term = _terms(w.hash, vocabulary)
                    pairs = np.unique(w.doc[at] * len(vocabulary) + term)
                    found += np.bincount(pairs % max(1, len(vocabulary)), minlength=len(vocabulary))
                    n += len(column)
            hit = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(found[hit], n))], ["term", "n"])

        counts = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        have = np.array([counts.get(i, 0) for i in range(len(vocabulary))], float)
        self.rarest = float(np.log(counts.get(-1, 0) + 2.0))
        self.idf = np.log((counts.get(-1, 0) + 2.0) / (have + 1.0))
        self.have = have
        self.spaces = self._spaces(spark, rank, seed)

    def _spaces(self, spark, rank: int, seed: int) -> list[tuple]:
        """Latent spaces: (item of each passage, terms, basis times idf, passages as unit vectors, the dot
        product with each from which a window is checked at any cosine, the most that an occurrence of a
        term adds to any dot product, and the most frequent terms). Passages that fit a half have spaces
        of their own, as a window is checked for them from less."""
        if not self.words:
            return []
        idf = self.idf
        cuts = [(i, a) for i, w in enumerate(self.words) for a in [*range(0, len(w) - PASSAGE, STRIDE), max(0, len(w) - PASSAGE)]]
        cuts.sort(key=lambda c: len(self.words[c[0]]) > HALF)
        terms = [np.searchsorted(self.vocabulary, self.words[i][a : a + PASSAGE]).tolist() for i, a in cuts]
        short = sum(len(self.words[i]) <= HALF for i, _ in cuts)
        space = np.append(np.arange(short) // rank, -(-short // rank) + np.arange(len(cuts) - short) // rank)
        table = spark.createDataFrame(pa.table({"space": pa.array(space, pa.int32()), "item": pa.array([i for i, _ in cuts], pa.int32()), "terms": pa.array(terms, pa.list_(pa.int64()))}))

        def fit(group: pa.Table) -> pa.Table:
            rows = [np.unique(np.array(t, np.int64), return_counts=True) for t in group.column("terms").to_pylist()]
            own = np.unique(np.concatenate([t for t, _ in rows]))
            x = np.zeros((len(rows), len(own)))
            for i, (t, n) in enumerate(rows):
                x[i, np.searchsorted(own, t)] = n * idf[t]
            norm = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
            x /= norm[:, None]
            least = CONTAINED * norm
            for i, (t, n) in enumerate(rows):
                if n.sum() <= HALF:
                    cheap = np.sort(np.repeat(idf[t] ** 2, n))[: int(np.ceil(ALONE * n.sum()))]
                    least[i] = max(1e-6, min(least[i], 0.999 * cheap.sum() / norm[i]))
            # A random block that is wider than the space has passages misses nothing of them.
            block = np.random.default_rng(seed).standard_normal((len(own), rank + 8))
            held = np.linalg.qr(x @ block)[0]
            _, size, v = np.linalg.svd(held.T @ x, full_matrices=False)
            basis = v[size > 1e-9 * max(size[0], 1e-300)].T
            scaled, latent = basis * idf[own][:, None], x @ basis
            most = np.concatenate([(scaled[a : a + 4096] @ latent.T).max(axis=1) for a in range(0, len(own), 4096)])
            values = [group.column("item").to_numpy().astype(np.int32), own, scaled.astype(np.float32), latent.astype(np.float32), least.astype(np.float32), np.maximum(most, 0).astype(np.float32)]
            return pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(_SPACE, values)})

        out = []
        for r in table.groupBy("space").applyInArrow(fit, ", ".join(f"{k} binary" for k in _SPACE)).collect():
            item, own, least, most = (np.frombuffer(r[k], t) for k, t in (("item", np.int32), ("own", np.int64), ("least", np.float32), ("most", np.float32)))
            dense = np.argsort(-self.have[own], kind="stable")[:DENSE]
            out.append((item, own, np.frombuffer(r["scaled"], np.float32).reshape(len(own), -1), np.frombuffer(r["latent"], np.float32).reshape(len(item), -1), least, most, dense))
        return out

    def leaks(self, spark):
        """A function of a text column that gives the leaked items: array of (item_id, share of the
        item's words in common order, cosine, whether the answer is there)."""
        held = spark.sparkContext.broadcast((self.ids, self.words, self.vocabulary, self.idf, self.rarest, self.spaces))  # at most PASS items

        @F.arrow_udf(LEAK)
        def find(column: pa.Array) -> pa.Array:
            ids, words, vocabulary, idf, rarest, spaces = held.value
            if not ids:
                return pa.array([[]] * len(column), _LEAK)
            bits = [_bits(w) for w in words]
            answers = [_bits(w[-ANSWER_WORDS:]) for w in words]
            out: list = []
            for _, part in pieces(column):
                out += _search(part, ids, words, bits, answers, vocabulary, idf, rarest, spaces)
            return pa.array(out, _LEAK)

        return find


_SPACE = ("item", "own", "scaled", "latent", "least", "most")
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64()), ("answer", pa.bool_())]))


def _terms(words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in the vocabulary, and their numbers there."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    likely = np.zeros(1 << 16, bool)
    likely[vocabulary >> np.uint64(48)] = True
    at = np.flatnonzero(likely[words >> np.uint64(48)])
    term = np.minimum(np.searchsorted(vocabulary, words[at]), len(vocabulary) - 1)
    same = vocabulary[term] == words[at]
    return at[same], term[same]


def _projected(term: np.ndarray, half: np.ndarray, halves: int, scaled: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Sums of the terms' vectors by half; ``half`` rises. Occurrences of the ``dense`` terms are counted and
    meet their vectors in one product."""
    column = np.full(len(scaled), -1, np.int32)
    column[dense] = np.arange(len(dense), dtype=np.int32)
    k = column[term]
    often = k >= 0
    counts = np.bincount(half[often] * len(dense) + k[often], minlength=halves * len(dense)).reshape(halves, len(dense))
    out = counts.astype(np.float32) @ scaled[dense]
    t, h = term[~often], half[~often]
    for a in range(0, len(t), 1 << 15):
        part = h[a : a + (1 << 15)]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out[part[starts]] += np.add.reduceat(scaled[t[a : a + (1 << 15)]], starts, axis=0)
    return out


def _search(column, ids, words, bits, answers, vocabulary, idf, rarest, spaces) -> list:
    w = Words(column, lower=True, strip=True)
    n = len(w.count)
    out: list = [[] for _ in range(n)]
    if not len(w.hash):
        return out
    first = np.cumsum(w.count) - w.count
    halves = -(-w.count // HALF)
    half_first = np.cumsum(halves) - halves
    half = half_first[w.doc] + (np.arange(len(w.hash)) - first[w.doc]) // HALF
    total = int(halves.sum())
    at, term = _terms(w.hash, vocabulary)
    weight = np.full(len(w.hash), rarest)
    weight[at] = idf[term]
    doc = np.repeat(np.arange(n), halves)
    pair = np.append(doc[1:] == doc[:-1], False)
    behind = np.minimum(np.arange(1, total + 1), total - 1)

    def windows(x: np.ndarray) -> np.ndarray:
        """Of sums by half those of the windows: two halves, or one where none follows."""
        return x + np.where(pair, x[behind], 0)

    norm = np.sqrt(np.maximum(windows(np.bincount(half, weight**2, total)), 1e-12)).astype(np.float32)
    # A text's last half stands alone if it is its first, too.
    window = np.flatnonzero(pair | np.append(True, doc[1:] != doc[:-1]))
    known, known_half = w.hash[at], half[at]
    checked: dict[tuple[int, int], dict[int, float]] = {}  # cosines of a text's places for an item
    for items, own, scaled, latent, least, most, dense in spaces:
        local = np.full(len(vocabulary), -1, np.int32)
        local[own] = np.arange(len(own), dtype=np.int32)
        t = local[term]
        here = np.flatnonzero(t >= 0)
        t, h = t[here], known_half[here]
        # No dot product exceeds the sum of the most that each occurrence can add: windows that stay
        # below what the least passage asks for are not projected.
        bound = windows(np.bincount(h, most[t], total))[window] * 1.001 + 1e-6
        left = window[bound >= np.minimum(COSINE * norm[window], least.min())]
        for a in range(0, len(left), 1 << 12):
            rows = left[a : a + (1 << 12)]
            needed = np.zeros(behind[rows[-1]] + 1 - rows[0], bool)
            needed[rows - rows[0]] = True
            needed[behind[rows[pair[rows]]] - rows[0]] = True
            place = np.cumsum(needed) - 1
            part = slice(*np.searchsorted(h, [rows[0], rows[0] + len(needed)]))
            kept = needed[h[part] - rows[0]]
            vector = _projected(t[part][kept], place[h[part][kept] - rows[0]], int(place[-1]) + 1, scaled, dense)
            near = (vector[place[rows - rows[0]]] + np.where(pair[rows][:, None], vector[place[np.minimum(behind[rows] - rows[0], len(place) - 1)]], 0)) @ latent.T
            for i, j in zip(*np.nonzero(near >= np.minimum(COSINE * norm[rows][:, None], least))):
                places = checked.setdefault((int(doc[rows[i]]), int(items[j])), {})
                start = int((rows[i] - half_first[doc[rows[i]]]) * HALF)
                places[start] = max(places.get(start, -1.0), float(near[i, j] / norm[rows[i]]))
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    order = [(d, k, place, cosine) for (d, k), places in checked.items() for place, cosine in sorted(places.items(), key=lambda x: -x[1])]
    d_of, k_of, place_of = (np.array([x[i] for x in order], np.int64) for i in range(3))
    size_of = np.array([len(x) for x in words], np.int64)[k_of]
    low = np.searchsorted(at, first[d_of] + np.maximum(0, place_of - size_of)).tolist()
    high = np.searchsorted(at, first[d_of] + np.minimum(w.count[d_of], place_of + 2 * HALF + size_of)).tolist()
    whole: set[tuple[int, int]] = set()
    for (d, k, _, cosine), lo, hi in zip(order, low, high):
        if (d, k) in whole:  # those that follow have a lower cosine
            continue
        size = len(words[k])
        region = known[lo:hi].tolist()  # other words are in no item
        hits = [p for p in map(bits[k].get, region) if p]
        # No common order holds more of the item's places than the region's words have.
        if reduce(or_, hits, 0).bit_count() < WITH_ANSWER * size:
            continue
        share = _common(hits, size) / size
        if share < WITH_ANSWER:
            continue
        last = min(ANSWER_WORDS, size)
        answer = _common([p for p in map(answers[k].get, region) if p], last) / last >= ANSWER_SHARE
        if (share >= ALONE or answer) and (share, cosine) > best.get((d, k), (0.0, 0.0))[:2]:
            best[d, k] = (share, cosine, answer)
        if share == 1:
            whole.add((d, k))
    for (d, k), (share, cosine, answer) in sorted(best.items()):
        out[d].append({"item_id": ids[k], "share": share, "cosine": cosine, "answer": answer})
    return out


def find_leaks(df: DataFrame, items: DataFrame, docs: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Adds ``leaks``: array of (item_id, share, cosine, answer) of the benchmark items (item_id, text)
    found in each whole text, whatever their length; the cosine is that of the nearest passage. Document frequencies come from ``docs`` (by default ``df``).

    Null and empty texts have none; an empty benchmark gives none. Repeated items are each found. Rows
    are kept as they are; a column named ``leaks`` is replaced. Items go through in passes of ``PASS``
    in the order of their hash."""
    spark = df.sparkSession
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    more = F.greatest(F.lit(0), F.ceil((word_count(F.col("text")) - PASSAGE) / STRIDE))
    passes = max(1, -(-(items.agg(F.sum(more + 1)).head()[0] or 0) // PASS))
    of_pass = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    corpus = (docs if docs is not None else df).select(F.col(f"`{text}`").alias("text"))
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "leaks"])
    found = [Benchmark(items.filter(of_pass == p), corpus).leaks(spark)(F.col(f"`{text}`")) for p in range(passes)]
    return out.withColumn("leaks", F.concat(*found) if passes > 1 else found[0])
