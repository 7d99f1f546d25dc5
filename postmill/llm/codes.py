"""Vector code compression: each vector as the numbers of its parts' nearest codebook entries.

Codebooks are fitted by Lloyd rounds with Elkan's bounds. A written table keeps, for each part of each
vector, an upper bound on the distance to its entry and a lower bound for every entry. Entries that move
shift the bounds by how far; a distance is worked out only where the bounds leave open which entry is
nearest. All numbers are integers and all bounds are rounded outwards, so an entry is skipped only where it
is strictly farther, and what is left is compared exactly, ties to the lower number.

A round reads and writes the table once, with nothing shuffled but one row of sums for each part, entry and
batch. Only codebooks (``parts`` x ``entries`` pieces) reach the driver and the tasks' closures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components stay below this, so that squared distances and bounds of 1024 dimensions fit their types.
LIMIT = 1 << 26
_FAR = np.int64(1) << 40
#: Sums of a batch; those of part -1 tell of the distances worked out and possible.
_SUMS = "struct<part:int,entry:int,n:long,total:array<long>>"


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) of an array of numbers; null where the array is null or a component is null or
    not finite. Larger components than ``LIMIT`` are an error: their distances would fit no long."""
    number = lambda x: x.cast("double")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    bounded = lambda x: F.when(F.abs(number(x) * scale) < LIMIT, F.floor(number(x) * scale).cast("int")).otherwise(F.raise_error(F.lit(f"components times {scale} must stay below {LIMIT}")).cast("int"))
    return F.when(vector.isNotNull() & ~odd, F.transform(vector, bounded))


def cuts(size: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end: equal ones, or the first ones longer by one."""
    return [0, *np.cumsum([size // parts + (i < size % parts) for i in range(parts)]).tolist()]


def root_up(squares: np.ndarray) -> np.ndarray:
    """The least integers whose squares are not below ``squares``."""
    out = root_down(squares)
    return out + (out * out < squares)


def root_down(squares: np.ndarray) -> np.ndarray:
    """The largest integers whose squares are not above ``squares``."""
    out = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    out -= out * out > squares
    return out + ((out + 1) * (out + 1) <= squares)


class Books:
    """Codebooks of all parts, with what the bounds need: the entries' distances and how far they moved."""

    def __init__(self, entries: list[np.ndarray], before: Books | None = None):
        self.entries = entries
        self.apart = [root_down(((e[:, None, :] - e[None, :, :]) ** 2).sum(-1)) for e in entries]
        self.moved = [root_up(((e - b) ** 2).sum(-1)) if before else np.zeros(len(e), np.int64) for e, b in zip(entries, before.entries if before else entries)]

    def moved_to(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Books:
        """Codebooks whose entries are the floored means of their parts; unused ones stay."""
        after = [e.copy() for e in self.entries]
        for (part, entry), (n, total) in sums.items():
            after[part][entry] = [t // n for t in total]
        return Books(after, self)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part.tolist() for x in entry).encode()).hexdigest()


def assign(x: np.ndarray, books: Books, part: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code, upper and lower bounds of one part of a batch (rows x length), for bounds that held before the
    entries moved; and the number of distances worked out."""
    entries, apart = books.entries[part], books.apart[part]
    rows, k = np.arange(len(x)), len(entries)
    upper = upper + books.moved[part][code]
    lower = np.maximum(lower - books.moved[part], 0)
    open_ = lambda at: (lower[at] <= upper[at, None]) & (apart[code[at]] <= 2 * upper[at, None]) & (np.arange(k) != code[at][:, None])
    some = rows[open_(rows).any(1)]
    distance = lambda at, e: ((x[at] - entries[e]) ** 2).sum(1)
    own = distance(some, code[some])
    upper[some] = root_up(own)
    lower[some, code[some]] = root_down(own)
    asked, entry = np.nonzero(open_(some))
    squares = distance(some[asked], entry)
    lower[some[asked], entry] = root_down(squares)
    # Of what could be nearest, the smallest distance, ties to the lower entry.
    best = np.full((len(some), k), np.iinfo(np.int64).max)
    best[np.arange(len(some)), code[some]] = own
    best[asked, entry] = squares
    code = code.copy()
    code[some] = best.argmin(1)
    upper[some] = root_up(best.min(1))
    return code, upper, lower, len(some) + len(asked)


def _numbers(column, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


class VectorCodes:
    """Codebooks fitted on all rows of ``df`` (id, vector and any others) and the codes of these rows.

    Rows whose vector is null or holds a null or non-finite component take no part, nor do vectors of
    another length than that of the smallest id. Codebooks begin as the parts of the ``entries`` rows of
    smallest id (null ids last, ties by the vector); fewer rows give fewer entries, and no rows give no
    codes. Repeated rows and equal vectors count as often as they stand. Columns other than ``keep`` are
    left out; ``code`` and ``error`` are those of the operator.

    ``codes``: rows (id, keep..., code array<int>, error long: the squared distances of all parts summed, in
    scaled units). ``books``: the final codebooks. ``asked`` and ``possible``: distances that were worked
    out, and those without bounds."""

    def __init__(self, df: DataFrame, id: str, vector: str, keep: list[str] = [], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
        spark = df.sparkSession
        own = [F.col(f"`{c}`") for c in dict.fromkeys([id, *keep]) if c.lower() not in ("code", "error")]
        rows = df.select(F.struct(*own).alias("row"), F.col(f"`{id}`").alias("id"), whole_components(F.col(f"`{vector}`"), scale).alias("v")).filter("v is not null")
        first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        size = len(first[0]["v"]) if first else 0
        seeds = [r["v"] for r in first if len(r["v"]) == size]
        seeds = np.array(seeds, np.int64).reshape(len(seeds), size)
        bounds = cuts(size, parts)
        self.books = Books([seeds[:, a:b] for a, b in zip(bounds, bounds[1:])])
        self.asked = self.possible = 0
        k = len(seeds)
        start = rows.filter(F.size("v") == size).select("row", "v", F.array_repeat(F.lit(0), parts).alias("code"), F.array_repeat(F.lit(int(_FAR)), parts).alias("upper"), F.array_repeat(F.lit(0), parts * k).alias("lower"))
        state, path = start, None
        for n in range(rounds + 1):
            done, before = _pass(state, self.books, bounds, last=n == rounds), path
            path = scratch(spark, "codes")
            done.write.partitionBy("kind").parquet(path)
            read = lambda kind: spark.read.schema(done.schema).parquet(path).filter(F.col("kind") == kind)
            if before:
                forget(spark, before)
            sums = read("sum").select("sum.*")
            seen = sums.filter("part < 0").agg(F.sum("n").alias("asked"), F.sum(F.get("total", F.lit(0))).alias("possible")).first()
            self.asked, self.possible = self.asked + (seen["asked"] or 0), self.possible + (seen["possible"] or 0)
            if n < rounds:
                width = max(np.diff(bounds), default=0)
                totals = sums.filter("part >= 0").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)])
                # A row for each part and entry: at most parts x entries.
                self.books = self.books.moved_to({(r["part"], r["entry"]): (r["n"], [r[f"t{i}"] for i in range(bounds[r["part"] + 1] - bounds[r["part"]])]) for r in totals.collect()})
            state = read("row").select("row", "v", "code", "upper", "lower")
        self.codes = read("row").select("row.*", "code", "error")


def _pass(state: DataFrame, books: Books, bounds: list[int], last: bool) -> DataFrame:
    """One assignment of all rows: rows of kind ``row`` with their state, and of kind ``sum`` with a batch's sums for
    each part and entry. The last one gives errors instead of vectors and bounds."""
    schema = f"kind string, row {state.schema['row'].dataType.simpleString()}, v array<int>, code array<int>, upper array<long>, lower array<int>, error long, sum {_SUMS}"
    parts, k = len(bounds) - 1, len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()))
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            cell = {name: batch.column(name) for name in batch.schema.names}
            v = _numbers(cell["v"], np.int64).reshape(n, bounds[-1])
            code = _numbers(cell["code"], np.int64).reshape(n, parts)
            upper = _numbers(cell["upper"], np.int64).reshape(n, parts)
            lower = _numbers(cell["lower"], np.int64).reshape(n, parts, k)
            error, sums, asked = np.zeros(n, np.int64), [], 0
            for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                x = v[:, a:b]
                code[:, p], upper[:, p], lower[:, p], worked = assign(x, books, p, code[:, p], upper[:, p], lower[:, p])
                asked += worked
                if last:
                    error += ((x - books.entries[p][code[:, p]]) ** 2).sum(1)
                    continue
                order = np.argsort(code[:, p], kind="stable")
                used, at, count = np.unique(code[order, p], return_index=True, return_counts=True)
                totals = np.add.reduceat(x[order], at, axis=0) if b > a else np.zeros((len(used), 0), np.int64)
                sums += [{"part": p, "entry": int(e), "n": int(c), "total": t.tolist()} for e, c, t in zip(used, count, totals)]
            sums.append({"part": -1, "entry": 0, "n": asked, "total": [n * parts * k]})
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (x.size // n), pa.int32()), pa.array(x.reshape(-1), kind))
            none = lambda kind, m=n: pa.nulls(m, kind)
            sum_type = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
            kept = (none(kinds[0]), lists(code, pa.int32()), none(kinds[1]), none(kinds[0]), pa.array(error)) if last else (cell["v"], lists(code, pa.int32()), lists(upper, pa.int64()), lists(np.minimum(lower, 2**31 - 1), pa.int32()), none(pa.int64()))
            names = ["kind", "row", "v", "code", "upper", "lower", "error", "sum"]
            yield pa.RecordBatch.from_arrays([pa.array(["row"] * n), cell["row"], *kept, none(sum_type)], names)
            m = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(["sum"] * m), none(cell["row"].type, m), none(kinds[0], m), none(kinds[0], m), none(kinds[1], m), none(kinds[0], m), none(pa.int64(), m), pa.array(sums, sum_type)], names)

    return state.mapInArrow(run, schema)
