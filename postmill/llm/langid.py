"""Language of texts by a convolutional network over bytes.

The network embeds each byte, slides filters of several widths over a window of fixed length, keeps each
filter's largest response (ReLU, then max pooling) and ends in a softmax. It is trained in numpy on windows of
labelled texts. A text is judged by all its windows, each weighing as its bytes.

A filter's response is a sum of one term for each byte it covers, so embedding and filters fold into tables: a
row of responses for every pair of bytes at a filter's start, and one for the pair after it. A position then
costs two lookups instead of a matrix product, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, pieces, text_bytes, written

#: Widths of the filters in bytes, filters of each width, numbers of a byte's embedding, bytes of a window (a
#: power of 2).
WIDTHS, FILTERS, EMBEDDING, WINDOW = (2, 3, 4), 24, 8, 128
#: Bounds of the fit: labelled texts of a language, all labelled texts, windows of a text.
TEXTS, ALL_TEXTS, WINDOWS = 500, 20_000, 3
UNKNOWN = "und"
SEED = 7
_REACH = max(WIDTHS)
_FOLD = _LOWER.copy()
_FOLD[_SPACE] = 32
_STRETCH = 32
_DEALT = 16


@dataclass
class Network:
    """Weights: a byte's embedding (256 x E), filters by width (width * E x filters), their biases, and the softmax
    layer."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.shift]


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n x (WINDOW + reach - 1) bytes, zeros behind a text's end) of whole texts, each window's text, and
    how many of its positions hold text. Windows follow each other without a gap; the filters' reach
    laps into the next."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + nth * WINDOW
    left = offsets[text + 1] - start
    at = np.arange(WINDOW + _REACH - 1)
    place = np.minimum(start[:, None] + at, len(data) - 1) if len(data) else np.zeros((0, len(at)), np.int64)
    out = _FOLD[data[place]] if len(data) else np.zeros((0, len(at)), np.uint8)
    out[at >= left[:, None]] = 0
    return out, text, np.minimum(left, WINDOW)


def pooled_plainly(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter (before ReLU) and its position, by convolution."""
    values = np.ascontiguousarray(net.embedding[windows].transpose(0, 2, 1))
    best, at = [], []
    for w, filters in zip(WIDTHS, net.filters):
        response = sum(filters[k * EMBEDDING : (k + 1) * EMBEDDING].T @ values[:, :, k : k + WINDOW] for k in range(w))
        at.append(response.argmax(2))
        best.append(np.take_along_axis(response, at[-1][:, :, None], 2)[:, :, 0])
    return np.concatenate(best, 1) + net.bias, np.concatenate(at, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, label: np.ndarray, classes: int, rounds: int = 4, batch: int = 64) -> Network:
    """A network fitted by Adam on windows; every class weighs alike."""
    rng = np.random.default_rng(SEED)
    part = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(part(256, EMBEDDING, scale=0.5), [part(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), part(len(WIDTHS) * FILTERS, classes, scale=0.1), np.zeros(classes, np.float32))
    weight = (len(label) / (classes * np.maximum(np.bincount(label, minlength=classes), 1)))[label].astype(np.float32)
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(rounds):
        order = rng.permutation(len(label))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            x, step = windows[own], step + 1
            pre, at = pooled_plainly(net, x)
            pooled = np.maximum(pre, 0)
            slope = _softmax(pooled @ net.out + net.shift)
            slope[np.arange(len(own)), label[own]] -= 1
            slope *= weight[own, None] / len(own)
            back = (slope @ net.out.T) * (pre > 0)
            grads, byte, into = [], [], []
            for i, (w, filters) in enumerate(zip(WIDTHS, net.filters)):
                mine = slice(i * FILTERS, (i + 1) * FILTERS)
                reach = at[:, mine, None] + np.arange(w)
                bytes_ = x[np.arange(len(own))[:, None, None], reach]
                patch = net.embedding[bytes_].reshape(len(own), FILTERS, -1)
                grads.append(np.einsum("bf,bfk->kf", back[:, mine], patch))
                byte.append(bytes_.reshape(-1))
                into.append((back[:, mine, None] * filters.T[None]).reshape(-1, EMBEDDING))
            byte, into = np.concatenate(byte), np.concatenate(into)
            embedding = np.stack([np.bincount(byte, into[:, e], 256) for e in range(EMBEDDING)], 1)
            grads = [embedding, *grads, back.sum(0), pooled.T @ slope, slope.sum(0)]
            for p, g, m, v in zip(net.parts(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (1 - epoch / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


class Folded:
    """The network as tables of responses by pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        # Response term of each filter for each byte at each place of its reach; none beyond its width.
        term = np.zeros((_REACH, 256, len(WIDTHS) * FILTERS), np.float32)
        for i, (w, filters) in enumerate(zip(WIDTHS, net.filters)):
            for place in range(w):
                term[place, :, i * FILTERS : (i + 1) * FILTERS] = net.embedding @ filters[place * EMBEDDING : (place + 1) * EMBEDDING]
        pair = lambda a, b: (term[a][:, None] + term[b][None]).reshape(1 << 16, -1)
        self.pairs = [pair(a, a + 1) for a in range(0, _REACH, 2)]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of each window; work space is that of ``_STRETCH`` windows."""
        out = np.empty((len(windows), len(self.net.shift)), np.float32)
        for a in range(0, len(windows), _STRETCH):
            x = windows[a : a + _STRETCH]
            pair = x[:, :-1].astype(np.uint16) * np.uint16(256) + x[:, 1:]
            response = self.pairs[0].take(pair[:, :WINDOW], axis=0)
            for k, table in enumerate(self.pairs[1:], 1):
                response += table.take(pair[:, 2 * k : 2 * k + WINDOW], axis=0)
            while (n := response.shape[1]) > 1:  # halves against each other: far faster than max() along this axis
                response = np.maximum(response[:, : n // 2], response[:, n // 2 :], out=response[:, : n // 2])
            pooled = np.maximum(response[:, 0] + self.net.bias, 0)
            out[a : a + _STRETCH] = _softmax(pooled @ self.net.out + self.net.shift)
        return out


_FOLDED: dict[int, Folded] = {}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _windows(text: Column) -> Column:
    """Up to ``WINDOWS`` windows of a text's bytes at places that its hash gives, each cut to a length that the
    hash gives too, so that short texts are learned."""
    data, size = text.cast("binary"), F.octet_length(text)
    place = lambda i: F.pmod(F.xxhash64(text, i), F.greatest(size - WINDOW, F.lit(0)) + 1).cast("int")
    length = lambda i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.pmod(F.xxhash64(text, i + 100), F.lit(WINDOW - 15)).cast("int") + 16)
    return F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substring(data, place(i) + 1, length(i)))


class LanguageNetwork:
    """A network trained on ``labelled`` (text, lang): at most ``texts`` distinct texts of each language, those of
    smallest hash, and at most ``all_texts`` of all, dealt round the languages (the others then stay
    unlearned). Rows without a language or without a letter teach nothing; repeated rows count once.

    ``languages``: what was learned, in code point order. With one language every text with a letter is of it;
    with none all are ``und``."""

    def __init__(self, labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = TEXTS, all_texts: int = ALL_TEXTS):
        rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
        rows = rows.withColumn("h", F.xxhash64("text", F.lit(SEED)))
        # Hashes first: texts move only when they are chosen. A frequent language's hashes are dealt over ``_DEALT``
        # tasks, of which each passes on ``texts`` at most, whatever the table's size.
        first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy("lang", *by).orderBy("h"))).filter(F.col("nth") <= texts)
        dealt = first(rows.select("lang", "h").distinct().withColumn("_deal", F.pmod("h", F.lit(_DEALT))), "_deal").drop("nth")
        chosen = first(dealt).orderBy("nth", "lang").limit(all_texts)
        chosen = written(chosen.select("lang", "h"), "language-texts")  # bounded by ``all_texts``
        sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first(_windows(F.col("text"))).alias("w"))
        got = sorted(((r["lang"], bytes(w)) for r in sample.collect() for w in set(map(bytes, r["w"]))), key=lambda x: (x[0].encode(), x[1]))
        self.languages = sorted({c for c, _ in got}, key=str.encode)
        self.network = None
        if len(self.languages) > 1:
            data = np.frombuffer(b"".join(w for _, w in got), np.uint8)
            windows, own, _ = windows_of(data, np.cumsum([0, *(len(w) for _, w in got)]))
            number = {c: i for i, c in enumerate(self.languages)}
            label = np.array([number[c] for c, _ in got])[own]
            self.network = train(windows, label, len(self.languages))

    def probabilities(self, spark: SparkSession, text: Column) -> Column:
        """Struct (n, score): the likeliest language's number, the first of equal ones, and its share of the
        windows' probability. Texts without bytes have neither."""
        network = spark.sparkContext.broadcast(self.network)  # fixed size

        @F.arrow_udf("n int, score double")
        def judge(column: pa.Array) -> pa.Array:
            net = network.value
            folded = _FOLDED.get(id(net))
            if folded is None:
                _FOLDED.clear()
                folded = _FOLDED[id(net)] = Folded(net)
            best, score = np.zeros(len(column), np.int32), np.zeros(len(column))
            for first, part in pieces(column, 1 << 20):
                windows, own, size = windows_of(*text_bytes(part))
                total = np.zeros((len(part), len(net.shift)))
                for a in range(0, len(own), 1 << 13):
                    some = slice(a, a + (1 << 13))
                    np.add.at(total, own[some], folded.probabilities(windows[some]) * size[some, None])
                total /= np.maximum(total.sum(1, keepdims=True), 1e-300)
                best[first : first + len(part)], score[first : first + len(part)] = total.argmax(1), total.max(1)
            return pa.StructArray.from_arrays([pa.array(best), pa.array(np.clip(score, 0, 1))], ["n", "score"])

        return judge(text)


def identify(df: DataFrame, model: LanguageNetwork, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1). A text that is null or has no letter is ``und`` with score 0.
    Whole texts are judged, equal ones alike; rows and other columns stay, columns of the added names are
    replaced."""
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("lang_pred", "score")]
    known, t = model.languages, F.col(f"`{text}`")
    if len(known) < 2:
        sure = F.when(has_letter(t), F.lit(known[0])) if known else F.lit(None).cast("string")
        return df.select(*own, F.coalesce(sure, F.lit(UNKNOWN)).alias("lang_pred"), F.when(sure.isNotNull(), 1.0).otherwise(0.0).alias("score"))
    rows = df.select(F.struct(*own).alias("row"), has_letter(t).alias("has"), model.probabilities(df.sparkSession, t).alias("p"))
    names = F.array(*map(F.lit, known))
    return rows.select("row.*", F.when(F.col("has"), F.get(names, F.col("p.n"))).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("has"), F.col("p.score")).otherwise(0.0).alias("score"))
