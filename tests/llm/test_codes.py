"""Vector codes against plain Lloyd rounds in Python numbers."""

import hashlib
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from postmill.llm import codes, queries

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    at = codes.cuts(size, parts)
    cut = lambda v: [v[a:b] for a, b in zip(at, at[1:])]
    books = [[list(cut(v)[p]) for _, v in kept[:entries]] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v in kept:
                x = cut(v)[p]
                own.setdefault(nearest(x, p), []).append(x)
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v in kept:
        code = [nearest(x, p) for p, x in enumerate(cut(v))]
        out.append((i, code, sum(far(x, books[p][e]) for p, (x, e) in enumerate(zip(cut(v), code)))))
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(3)
    fitted = codes.VectorCodes(df, "vec_id", "embedding", ["label", "code"], **more)
    return sorted(((r["vec_id"], r["code"], r["error"]) for r in fitted.codes.collect()), key=str), fitted


def test_codes_of_odd_rows(spark):
    """Ties, repeated rows, null ids, nulls, odd numbers, and fewer rows than entries."""
    rng = random.Random(1)
    vector = lambda: [rng.choice([-0.5, -1e-5, 0.0, 0.25, 0.2500001, 0.5]) for _ in range(16)]
    rows = [(i // 2, vector()) for i in range(300)] + [(7, [0.25] * 16)] * 40 + [(None, vector()), (None, None), (901, [None] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [0.0] * 15)]
    for some in (rows, rows[:5], rows[:1] * 4):
        got, fitted = run(spark, some)
        want, digest = brute(some)
        assert got == want and fitted.books.sha256() == digest
    assert run(spark, [])[0] == [] and run(spark, [(1, None)])[0] == []


def test_other_lengths_and_ranges(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(11)]) for i in range(80)]
    got, fitted = run(spark, [*rows, (500, [1.0]), (501, [])], parts=3, entries=5, rounds=3)
    want, digest = brute(rows, 3, 5, 3)
    assert got == want and fitted.books.sha256() == digest
    with pytest.raises(PySparkException):
        run(spark, [(1, [1e30] * 8)])


def test_bounds_skip_distances(spark, sf_dir):
    """Bounds leave most distances out, and the query's columns follow from the codes."""
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(16)]
    rows = [(i, [m + rng.gauss(0, 0.05) for m in middles[i % 16]]) for i in range(4000)]
    fitted = run(spark, rows)[1]
    assert fitted.possible == 7 * 4000 * 8 * 16 and fitted.asked < fitted.possible / 4
    out = queries.op11_codes(spark, sf_dir)
    per = out.agg(F.sum("error").alias("e"), F.min(F.length("code")).alias("a"), F.max(F.length("code")).alias("b")).first()
    assert (per["a"], per["b"]) == (16, 16)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    want, digest = brute([tuple(r) for r in table.collect()])
    assert out.select("codebooks_sha256").distinct().collect()[0][0] == digest and per["e"] == sum(e for *_, e in want)


def test_roots():
    import numpy as np

    squares = np.array([0, 1, 2, 3, 4, 2**52 - 1, 2**52, (2**31 - 1) ** 2 - 1, (2**31 - 1) ** 2, 2**61])
    for s, a, b in zip(squares.tolist(), codes.root_down(squares).tolist(), codes.root_up(squares).tolist()):
        assert a == math.isqrt(s) and b == a + (a * a < s)
