"""WARC round trip, nearest neighbours and near-duplicates against plain Python versions."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postmill.llm import ann, common, neardup, queries, warc


def test_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(9001, "u", "same"), (9002, "u\n2", "same"), (9003, None, None), (9004, "u", "")], pages.schema)
    rows = pages.union(more)
    index = warc.write_archives(rows.withColumn("file", F.lit("own")))
    got = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    first = {}
    for r in sorted(rows.collect(), key=lambda r: r["page_id"]):
        data = (r["html"] or "").encode()
        g, want = got[r["page_id"]], first.setdefault(data, r["page_id"])
        assert g["payload_bytes"] == len(data) and g["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (g["record_type"], g["refers_to"]) == (("response", None) if want == r["page_id"] else ("revisit", want))
        assert g["record_type"] == "revisit" or bytes(g["payload"]) == data
    one = warc.read_archives(index.filter("page_id = 9001")).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == b"same"
    assert warc.write_archives(more.limit(0)).count() == 0
    assert warc.read_archives(warc.write_archives(more, least=1)).filter("record_type = 'response'").count() == 3


def test_warc_repeated_rows(spark):
    """One response for each payload, whatever is repeated; long, empty and missing payloads come back whole."""
    long = "<p>é" * 200_000
    rows = [(5, "u", "same")] * 40 + [(7, "u", "same"), (1, "v", long), (1, "v", long), (2, None, None), (3, "w", ""), (None, "n", "null id"), (None, "n", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages)
    got = warc.read_archives(index.withColumn("payload", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["payload_digest"], []).append(r)
    for text, n, refers in (("same", 41, 5), (long, 2, 1), ("", 2, 2), ("null id", 2, None)):
        group = by[base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()]
        answers = [r for r in group if r["record_type"] == "response"]
        assert len(group) == n and len(answers) == 1 and bytes(answers[0]["payload"]) == text.encode()
        assert answers[0]["page_id"] == refers and all(r["refers_to"] == refers and r["payload"] is None for r in group if r is not answers[0])
    assert index.agg(F.sum("length")).first()[0] > 0 and warc.read_archives(index.limit(0)).count() == 0


def test_nearest(spark, sf_dir):
    got = queries.op6_ann(spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, v = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)
    hit = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        other = ids != q
        want = ids[other][np.lexsort((ids[other], d[other]))[:10]]
        hit, total = hit + len(set(want) & set(g.vec_id)), total + len(want)
        assert list(g.sort_values("rank")["rank"]) == list(range(1, len(g) + 1))
        assert np.allclose(np.sort(g.score), g.sort_values("rank").score)
    assert hit / total >= 0.9 and got.query_id.nunique() == (ids % 100 == 0).sum()


def test_warc_against_sql(spark, sf_dir):
    import oracle

    ours, theirs, names = oracle.difference(queries.op3_warc(spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()["op3_warc"])
    assert (ours[:3], theirs[:3], names) == ([], [], [])


def test_nearest_over_shards(spark, monkeypatch):
    """Several shards, more queries than a batch has rows, repeated rows and an empty table."""
    monkeypatch.setattr(ann, "SHARD", 300)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 6)).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(1500)] + [(0, v[0].tolist())] * 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
        got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=5).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:5]
        hit += len(set(want) & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, d[g.sort_values("rank").vec_id]) and len(g) == 5
    assert got.query_id.nunique() == 150 and hit >= 0.95 * 750
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [3.0, 0.0]), (8, [3.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(6, 0.0), (7, 0.0), (8, 2.0)]


def test_chi_square():
    assert abs(ann.chi_square(15.507, 8) - 0.95) < 1e-4 and abs(ann.chi_square_at(0.95, 8) - 15.507) < 1e-2


def shingle_sets(texts):
    out = []
    for t in texts:
        w = t.split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 300, 150)).astype(np.uint64)
    b = np.unique(np.concatenate([a[:90], rng.integers(300, 500, 20).astype(np.uint64)]))
    na, nb = rng.integers(1, 9, len(a)), rng.integers(1, 9, len(b))
    wa, wb = dict(zip(a.tolist(), 1 + np.log(na))), dict(zip(b.tolist(), 1 + np.log(nb)))
    exact = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in set(wa) | set(wb)) for d in set(wa) & set(wb))
    assert abs(neardup.similarity((a, na), (b, nb)) - exact) < 1e-9
    sig = neardup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([1 + np.log(na), 1 + np.log(nb)]), 2, 20000)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.02


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    base = "the quick brown fox jumps over a lazy dog while seven wizards brew potions in the old tower of " + " ".join(f"n{i}" for i in range(60))
    family = [(10_000 + i, base.replace(f"n{i}", "changed")) for i in range(12)]
    odd = [(20_000, ""), (20_001, ""), (20_002, None), (20_003, "one two"), (20_004, "one  two"), (20_005, " ")]
    every = [(r["doc_id"], r["text"]) for r in rows] + family + odd
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(every, "doc_id long, text string").withColumn("class_id", F.lit(0))).collect()}
    texts = [t or "" for _, t in every]
    sets, ids = shingle_sets(texts), [i for i, _ in every]
    links = []
    for a in range(len(every)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if texts[a] == texts[b] or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8):
                links.append((ids[a], ids[b]))
    assert got == classes(links, ids)


def test_family_of_near_and_far(spark):
    """A hub of 3000 copies with one change each, texts near one another but not near the smallest, repeated rows
    and rows without a key: the classes are those of all pairs, and one row of each is kept."""
    base = [f"n{i}" for i in range(120)]
    rows = [(i, " ".join(base[: i % 100] + [f"c{i}"] + base[i % 100 + 1 :])) for i in range(3000)]
    for k in range(60):  # half of the base; near their neighbour only
        own = base[:80] + [f"t{k // 2}x{i}" for i in range(40)]
        rows.append((10_000 + k, " ".join(own[:60] + [f"v{k}"] + own[61:])))
    odd = [(5, rows[5][1])] * 40 + [(20_000, "one two three four five six")] * 200 + [(None, "null key")] * 3
    got = neardup.near_duplicates(spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) + len(odd)
    sets = shingle_sets([t for _, t in rows])
    far = [i for i in range(3000, len(rows))]
    links = [(rows[a][0], rows[b][0]) for a in far for b in range(3000, a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    links += [(0, i) for i in range(3000)]  # one change each: at least 106 of 126 shingles shared
    want = classes(links, [i for i, _ in rows] + [20_000])
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(139, 7)]
    got = {r["id"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 41), *range(100, 140)]}


def test_words():
    w = common.Words(pa.array(["a b", None, " c\td ", "", "É x"]), lower=True)
    assert list(w.count) == [2, 0, 2, 0, 2] and list(w.doc) == [0, 0, 2, 2, 4, 4]
    same = common.Words(pa.array(["AbC, (abc)"]), lower=True, strip=True)
    assert same.hash[0] == same.hash[1]


def test_projections_leave_vectors_out():
    """In clusters few vectors are verified; what is found is all but complete."""
    rng = np.random.default_rng(8)
    middles = rng.standard_normal((60, 64))
    v = np.concatenate([m + 0.2 * rng.standard_normal((60, 64)) for m in middles])
    shard, hit = ann.Shard(np.arange(len(v)), v, ann.DIRECTIONS, 17), 0
    for q in range(0, len(v), 40):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10]) & set(shard.nearest(q, v[q], 10)[0]))
    asked = len(range(0, len(v), 40))
    assert hit >= 0.95 * 10 * asked and shard.verified < 0.05 * asked * len(v)
