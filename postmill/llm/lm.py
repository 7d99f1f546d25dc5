"""Language-model scores from a log-frequency Bloom filter.

Unigram and bigram counts of the training texts are quantised on a logarithmic scale; an n-gram of
level q is inserted q times, as (n-gram, 1) to (n-gram, q). A count is read back by probing levels
until one is missing, and a probability is smoothed from such counts. The filter is built in parts
by hash, each by one task, and broadcast in rounds of bounded size. Exact unigram counts, which the
base score needs, stay distributed: words of at least a millionth of all tokens are broadcast (there
are a million at most), occurrences of the rest meet their counts by hash.

Words are compared by a 64-bit hash, bigrams by 48 bits of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, written

#: Probes and bits for each insertion; bytes of filter that one round broadcasts at most.
PROBES, BITS, ROUND_BYTES = 4, 8, 192 << 20
#: Words with at least this share of all tokens are broadcast.
HEAD = 1e-6
#: Rows whose sums move together: two to this power.
CHUNK = 12
#: Weight of the unigram model in tokens.
MU = 300.0
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_SALT = (np.uint64(0), np.uint64(0xA4093822299F31D0))
_BIGRAM_BITS = np.uint64(0xFFFFFFFFFFFF0000)
_COUNTS = "part int, kind int, key binary, n binary"


def _levels(ratio: float) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 45:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * ratio))))
    return np.array(out, np.int64)


#: Counts at which a level starts, of unigrams and of bigrams.
LEVELS = (_levels(1.25), _levels(2.0))
#: What a level reads as: the middle of its counts; level 0 is unseen.
VALUES = tuple(np.append(0.0, (x[:-1] + x[1:] - 1) / 2) for x in LEVELS)


def _tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and one end for each text, the hash before each (or the start), and rows."""
    w = Words(column, lower=True)
    at = np.cumsum(w.count + 1) - 1
    token = np.empty(len(w.hash) + len(w.count), np.uint64)
    inner = np.ones(len(token), bool)
    inner[at] = False
    token[at], token[inner] = _END, w.hash
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.append(0, at[:-1] + 1) if len(at) else []] = _START
    return token, before, np.repeat(np.arange(len(w.count)), w.count + 1)


def _bigram(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + token) & _BIGRAM_BITS


def _split(key: np.ndarray, bits: int):
    """(part, slice) of sorted hashes by their leading ``bits``."""
    part = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.append(starts[1:], len(key))):
        yield int(part[a]), slice(a, b)


def _planes(key: np.ndarray) -> bytes:
    """Hashes as eight planes of bytes: leading ones of sorted hashes compress well."""
    return key.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().reshape(-1).view(np.uint64)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _level(kind: int, n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS[kind], n, side="right")


def _places(key: np.ndarray, level, kind: int, size) -> Iterator[np.ndarray]:
    """Bit numbers of (n-gram, level) in a part of ``size`` bits (below 2**32), a probe at a time."""
    h = mix((key ^ _SALT[kind]) + np.uint64(0x452821E638D01377) * np.asarray(level, np.uint64))
    step = mix(h) | np.uint64(1)
    for _ in range(PROBES):
        yield ((h >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)
        h = h + step


class Filter:
    """Parts by the leading bits of the n-gram's hash, each a bit array of its own size."""

    def __init__(self, bits: int, sizes: np.ndarray, data: bytes, low: int = 0, high: int = 1 << 62):
        self.bits, self.low, self.high = bits, low, high  # parts from low to high are here, high excluded
        self.size = (sizes * 8).astype(np.uint64)
        self.first = np.cumsum(sizes * 8) - sizes * 8
        self.data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)

    def covers(self, key: np.ndarray) -> np.ndarray:
        part = self._part(key)
        return (part >= self.low) & (part < self.high)

    def _part(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)

    def level(self, key: np.ndarray, kind: int) -> np.ndarray:
        """Highest level up to which every probe finds the n-gram; never below the true one."""
        part = self._part(key)
        size, first = self.size[part], self.first[part]
        out = np.zeros(len(key), np.int64)
        live = np.flatnonzero(size > 0)
        level = 0
        while len(live):
            level += 1
            found = np.ones(len(live), bool)
            for place in _places(key[live], level, kind, size[live]):
                bit = first[live] + place.astype(np.int64)
                found &= (self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            live = live[found]
            out[live] = level
        return out


def count_ngrams(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (part, kind, key, n): summed counts of unigrams (kind 0) and bigrams (1) of ``text``, by
    part sorted hashes and their counts as bytes. Counts are summed within batches before they move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams: tuple[list, list] = ([], [])
            for _, column in pieces(batch.column(0), 1 << 20):
                token, before, _ = _tokens(column)
                grams[0].append(token)
                grams[1].append(_bigram(before, token))
            rows = []
            for kind in (0, 1):
                key = np.concatenate(grams[kind]) if grams[kind] else np.zeros(0, np.uint64)
                grams[kind].clear()
                key.sort()
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                n, key = np.diff(np.append(first, len(key))), key[first]
                rows += [(part, kind, _planes(key[s]), n[s].astype(np.uint32).tobytes()) for part, s in _split(key, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "key", "n"])

    def merge(group: pa.Table) -> pa.Table:
        part, rows = group.column("part")[0].as_py(), []
        kinds = np.array(group.column("kind"))
        for kind in (0, 1):
            own = group.filter(pa.array(kinds == kind))
            if own.num_rows:
                key, n = _summed(np.concatenate([_unplanes(x.as_py()) for x in own.column("key")]), np.concatenate([np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in own.column("n")]))
                held = (_planes(key), n.tobytes()) if kind == 0 else (None, None)
                rows.append((part, kind, *held, _bit_array(key, _level(kind, n), kind), len(key), int(n.sum())))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "kind", "key", "n", "bits", "types", "tokens"])

    parts = docs.select("text").mapInArrow(count, _COUNTS)
    return parts.groupBy("part").applyInArrow(merge, _COUNTS + ", bits binary, types long, tokens long")


def _bit_array(key: np.ndarray, level: np.ndarray, kind: int) -> bytes:
    """A part of the filter: each n-gram inserted at every level up to its own."""
    size = -(-int(level.sum()) * BITS // 64) * 64
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max()) + 1):
        for place in _places(key[level >= q], q, kind, size):
            bits[place] = True
    return np.packbits(bits, bitorder="little").tobytes()


class LanguageModel:
    """Counts of the training texts (``text`` of ``docs``), and their filter in rounds of at most
    ``round_bytes`` of bigrams beside the unigrams."""

    def __init__(self, docs: DataFrame, round_bytes: int = ROUND_BYTES, part_tokens: int = 4_000_000):
        docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
        self.spark, self.docs = docs.sparkSession, size["n"]
        # Parts follow the size of the corpus, whatever it is, so that one stays in a task's memory and its
        # places in 32 bits.
        self.bits = max(4, int(np.ceil(np.log2(max(1, size["b"] / 5 / part_tokens)))))
        self.counts = written(count_ngrams(docs, self.bits), "lm-counts")
        by = self.counts.select("part", "kind", "types", "tokens", F.octet_length("bits").alias("bytes")).collect()
        self.tokens = sum(r["tokens"] for r in by if r["kind"] == 0)
        self.types = sum(r["types"] for r in by if r["kind"] == 0)
        # Each round is a range of parts; together they are all parts.
        bytes_of = {r["part"]: r["bytes"] for r in by if r["kind"] == 1}
        starts, used = [0], 0
        for part in range(1 << self.bits):
            need = bytes_of.get(part, 0)
            if used and used + need > round_bytes:
                starts.append(part)
                used = 0
            used += need
        self.rounds = list(zip(starts, [*starts[1:], 1 << self.bits]))

    def _broadcast(self, kind: int, parts: tuple[int, int] | None = None):
        rows = self.counts.filter(F.col("kind") == kind).select("part", "bits")
        low, high = parts or (0, 1 << self.bits)
        rows = rows.filter((F.col("part") >= low) & (F.col("part") < high))
        held = {r["part"]: bytes(r["bits"]) for r in rows.toLocalIterator()}
        sizes = np.array([len(held.get(p, b"")) for p in range(1 << self.bits)], np.int64)
        return self.spark.sparkContext.broadcast((self.bits, sizes, b"".join(held[p] for p in sorted(held)), low, high))

    def head(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of at least ``HEAD`` of all tokens, 1 / HEAD at most: sorted hashes and counts."""
        least = max(2, int(np.ceil(self.tokens * HEAD)))

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, ns = [], []
                for key, n in zip(*batch.columns):
                    n = np.frombuffer(n.as_py(), np.int64)
                    keys.append(_unplanes(key.as_py())[n >= least])
                    ns.append(n[n >= least])
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes() for x in (keys,)] if keys else [], pa.binary()), pa.array([np.concatenate(x).tobytes() for x in (ns,)] if keys else [], pa.binary())], ["key", "n"])

        rows = self.counts.filter("kind = 0").select("key", "n").mapInArrow(frequent, "key binary, n binary").collect()
        key = np.concatenate([np.frombuffer(r["key"], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
        n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(key)
        return key[order], n[order]

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` has ``id`` (any values) and ``text``. Rows (id, n_tokens, n_known, base_score, score).

        Base: exact counts c of N tokens and V types, the sum of log10((c + 1) / (N + V + 1)). Score:
        the sum of log10((c(h, w) + MU p(w)) / (c(h) + MU)) with p(w) = (c(w) + 1) / (N + V + 1) and all
        counts read from the filter; h is the token before, or the start. Null and empty texts have
        one token, the end. Rows are scored one by one: repeated rows and ids each give a row. Other columns
        are ignored; an empty table gives no rows, and a model of no texts knows no token."""
        head = self.spark.sparkContext.broadcast(self.head())  # at most 1 / HEAD words
        unigrams = self._broadcast(0)
        bits, n_docs, total = self.bits, float(self.docs), float(self.tokens + self.types + 1)
        docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
        if len(self.rounds) > 1:
            docs = written(docs, "lm-rounds")  # rounds must see the same row numbers
        kind_id = docs.schema["id"].dataType.simpleString()

        def probed(token, before, at, singles: Filter, bigrams: Filter, size: int) -> np.ndarray:
            """Sums of log10 probabilities of the tokens whose bigrams this round's filter holds."""
            both = _bigram(before, token)
            here = bigrams.covers(both)
            token, before, at, both = token[here], before[here], at[here], both[here]
            word, place = np.unique(np.concatenate([token, before]), return_inverse=True)
            c = VALUES[0][singles.level(word, 0)]
            c[word == _START] = n_docs
            c_word, c_before = c[place[: len(token)]], c[place[len(token) :]]
            c_both = VALUES[1][bigrams.level(both, 1)]
            p = (c_both + MU * (c_word + 1) / total) / (np.maximum(c_before, c_both) + MU)
            return np.bincount(at, np.log10(p), size)

        def first_round(bigrams):
            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                """Of each piece: a row per text, and by part the occurrences of words outside the head."""
                filters = Filter(*unigrams.value), Filter(*bigrams.value)
                for batch in batches:
                    for a, column in pieces(batch.column(1), 1 << 20):
                        n, ids, number = len(column), batch.column(0).slice(a, len(column)), batch.column(2).slice(a, len(column))
                        token, before, at = _tokens(column)
                        order = np.argsort(token, kind="stable")
                        c = np.zeros(len(token), np.int64)
                        c[order] = _find(token[order], *head.value)
                        score = probed(token, before, at, *filters, n)
                        order = order[c[order] == 0]
                        rare, rare_at = token[order], np.array(number)[at[order]].astype(np.uint64)
                        rows = [(p, _planes(rare[s]), _planes(rare_at[s])) for p, s in _split(rare, bits)]
                        columns = [pa.array(np.bincount(at, minlength=n)), pa.array(np.bincount(at, c > 0, n).astype(np.int64)), pa.array(np.bincount(at, np.log10(c + 1.0), n)), pa.array(score)]
                        none = lambda t, k: pa.nulls(k, t)
                        names = ["row", "id", "n_tokens", "n_known", "logs", "score", "part", "key", "at"]
                        yield pa.RecordBatch.from_arrays([number, ids, *columns, none(pa.int32(), n), none(pa.binary(), n), none(pa.binary(), n)], names)
                        k = len(rows)
                        yield pa.RecordBatch.from_arrays([none(pa.int64(), k), none(ids.type, k), none(pa.int64(), k), none(pa.int64(), k), none(pa.float64(), k), none(pa.float64(), k), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names)

            return docs.mapInArrow(scan, f"row long, id {kind_id}, n_tokens long, n_known long, logs double, score double, part int, key binary, at binary")

        def further_round(bigrams):
            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = Filter(*unigrams.value), Filter(*bigrams.value)
                for batch in batches:
                    for a, column in pieces(batch.column(1), 1 << 20):
                        yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, len(column)), pa.array(probed(*_tokens(column), *filters, len(column)))], ["row", "score"])

            return docs.mapInArrow(scan, "row long, score double")

        def meet(occurrences: pa.Table, vocabulary: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)]
            if occurrences.num_rows and vocabulary.num_rows:
                key, n = _unplanes(vocabulary.column("key")[0].as_py()), np.frombuffer(vocabulary.column("n")[0].as_py(), np.int64)
                at, logs = [], []
                for k, a in zip(occurrences.column("key"), occurrences.column("at")):
                    c = _find(_unplanes(k.as_py()), key, n)
                    at.append(_unplanes(a.as_py())[c > 0])
                    logs.append(np.log10(c[c > 0] + 1.0))
                number, place, count = np.unique(np.concatenate(at), return_inverse=True, return_counts=True)
                out = [number, np.bincount(place, np.concatenate(logs), len(number)), count]
            number = out[0].astype(np.int64)
            chunk, first = np.unique(number >> CHUNK, return_index=True)
            spans = list(zip(first, np.append(first[1:], len(number))))
            packed = [[x[a:b].tobytes() for a, b in spans] for x in (number, out[2].astype(np.int64), out[1].astype(float))]
            return pa.Table.from_arrays([pa.array(chunk.astype(np.int64)), *[pa.array(x, pa.binary()) for x in packed]], names=["chunk", "at", "n", "logs"])

        def fold(group: pa.Table) -> pa.Table:
            start = group.column("chunk")[0].as_py() << CHUNK
            at, n, logs = (np.concatenate([np.frombuffer(x.as_py(), t) for x in group.column(c)]) for c, t in (("at", np.int64), ("n", np.int64), ("logs", float)))
            known = np.bincount(at - start, n)
            hit = np.flatnonzero(known)
            return pa.Table.from_arrays([pa.array(hit + start), pa.array(known[hit].astype(np.int64)), pa.array(np.bincount(at - start, logs)[hit])], names=["row", "n_known", "logs"])

        first = written(first_round(self._broadcast(1, self.rounds[0])), "lm-scores")
        words = self.counts.filter("kind = 0").select("part", "key", "n")
        tail = first.filter("part is not null").select("part", "key", "at").groupBy("part").cogroup(words.groupBy("part")).applyInArrow(meet, "chunk long, at binary, n binary, logs binary")
        tail = tail.groupBy("chunk").applyInArrow(fold, "row long, n_known long, logs double")
        parts = first.filter("part is null").select("row", "id", "n_tokens", "n_known", "logs", "score").unionByName(tail, allowMissingColumns=True)
        for group in self.rounds[1:]:
            parts = parts.unionByName(further_round(self._broadcast(1, group)), allowMissingColumns=True)
        by_row = parts.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("logs").alias("logs"), F.sum("score").alias("score"))
        return by_row.select("id", "n_tokens", "n_known", (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total)))).alias("base_score"), "score")


def _find(key: np.ndarray, among: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` of the keys that are among sorted ones, else 0."""
    if not len(among):
        return np.zeros(len(key), np.int64)
    i = np.minimum(np.searchsorted(among, key), len(among) - 1)
    return np.where(among[i] == key, n[i], 0)
