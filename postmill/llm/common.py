"""Shared helpers: the folder all executors see, written tables, byte-level word
splitting for Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a temporary one, but only on a local master, whose
    tasks share the driver's disk: a cluster must name a folder that all its machines see."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="postmill-")
    # With its file system, so that Python readers and writers find the one Spark means.
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return uri.replace("file:/", "file:///", 1).replace("file://///", "file:///", 1).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage in a
    way that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the values of ``cols`` and the seed alone."""
    h = F.xxhash64(*cols, F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- Arrow batches: words as byte ranges -----------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a uint64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n, kept for the size of a chunk."""
    known = _TABLES.get(int(base))
    if known is not None and len(known) > n:
        return known[: n + 1]
    out = np.full(max(n, _CHUNK) + 1, base, np.uint64)
    out[0] = 1
    out = np.cumprod(out)
    if len(out) == _CHUNK + 1:
        _TABLES[int(base)] = out
    return out[: n + 1]


class Words:
    """Words of a batch: ``start``, ``end`` (byte offsets), ``doc`` (row), ``hash`` (uint64 of
    the word, lower-cased over A-Z if asked). Work space is bounded by the chunk, not the batch."""

    def __init__(self, column, lower: bool = False, strip: bool = False):
        self.data, self.offsets = text_bytes(column)
        n = len(self.data)
        solid = ~_SPACE[self.data]
        opens = np.zeros(n + 1, bool)
        opens[self.offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~solid[:-1]
        self.start = np.flatnonzero(solid & (before | opens[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = ~solid[1:]
        self.end = np.flatnonzero(solid & (after | opens[1:])) + 1
        self.count = np.diff(np.searchsorted(self.start, self.offsets))
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        if strip:  # up to three marks at either end, but never all of a word
            for _ in range(3):
                self.end -= _MARK[self.data[self.end - 1]] & (self.end - self.start > 1)
                self.start += _MARK[self.data[self.start]] & (self.end - self.start > 1)
        self.hash = self._hash(_LOWER[self.data] if lower else self.data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + _CHUNK, side="right")))
            part = data[a : self.end[j - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _powers(_P, len(part))[:-1], out=sums[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * _powers(_P_INV, len(part))[s]
            i = j
        return mix(out)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``n`` words; a shorter text that has words gives one
    shingle of all its words."""
    h, doc = words.hash, words.doc
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h.copy()
    for k in range(1, n):
        acc[: len(h) - k] = acc[: len(h) - k] * _P + h[k:]
    whole = np.zeros(len(h), bool)
    if len(h) >= n:
        whole[: len(h) - n + 1] = doc[: len(h) - n + 1] == doc[n - 1 :]
    out, rows = mix(acc[whole]), doc[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.array([np.bitwise_xor.reduce(mix(h[a : a + c] + np.arange(c, dtype=np.uint64))) for a, c in zip(first, words.count[short])], np.uint64)
        out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def pieces(column, limit: int = 4 << 20):
    """Slices (first row, column) of a string column of about ``limit`` bytes each, so that work
    space does not follow the size of a batch. A longer text is a slice of its own."""
    _, offsets = text_bytes(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, column.slice(a, b - a)
        a = b
