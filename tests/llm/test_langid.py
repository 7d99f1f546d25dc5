"""Language network: folded tables against plain convolution, whole texts, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import langid, queries
from postmill.llm.common import text_bytes

import pyarrow as pa


def brute(net, data: bytes):
    """Largest response of each filter over one window, position by position."""
    low = [32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in data] + [0] * (langid.WINDOW + 3 - len(data))
    out = []
    for w, filters in zip(langid.WIDTHS, net.filters):
        for f in range(langid.FILTERS):
            out.append(max(sum(float(net.embedding[low[t + k]] @ filters[k * langid.EMBEDDING : (k + 1) * langid.EMBEDDING, f]) for k in range(w)) for t in range(langid.WINDOW)))
    z = np.maximum(np.array(out) + net.bias, 0) @ net.out + net.shift
    z = np.exp(z - z.max())
    return z / z.sum()


def test_folded_network_is_the_convolution():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(c) for c in rng.integers(32, 400, n)) for n in (1, 5, 60, 40, 55)] + ["A\tB"]
    data, offsets = text_bytes(pa.array(texts))
    windows, own, size = langid.windows_of(data, offsets)
    assert own.tolist() == [0, 1, 2, 3, 4, 5] and size.tolist() == [len(t.encode()) for t in texts]
    net = langid.train(windows, np.arange(6) % 3, 3, rounds=2)
    got = langid.Folded(net).probabilities(windows)
    for t, p in zip(texts, got):
        assert np.allclose(p, brute(net, t.encode()), atol=1e-5)


def test_windows_cover_whole_texts():
    texts = ["", "x" * 127, "y" * 128, "z" * 129, None, "w" * 1000]
    data, offsets = text_bytes(pa.array(texts))
    windows, own, size = langid.windows_of(data, offsets)
    assert np.bincount(own, size, 6).tolist() == [0, 127, 128, 129, 0, 1000]
    for i, t in enumerate(texts):
        mine = windows[own == i]
        assert b"".join(bytes(w[: langid.WINDOW]) for w in mine).rstrip(b"\0") == (t or "").encode()
        assert all(bytes(a[langid.WINDOW :]).rstrip(b"\0") == bytes(b[:3]).rstrip(b"\0") for a, b in zip(mine, mine[1:]))
    assert len(langid.windows_of(*text_bytes(pa.array([None, ""], pa.string())))[0]) == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = queries.op12_langid(spark, sf_dir).join(docs, "doc_id")
    row = out.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("all"), F.avg(F.when(F.col("held_out"), (F.col("lang") == F.col("lang_pred")).cast("int"))).alias("held"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row["n"] == docs.count() and row["all"] > 0.97 and row["held"] > 0.95 and 0 <= row["low"] <= row["high"] <= 1


def test_odd_rows(spark, odd, empty):
    """Nulls, no letters, very long and repeated texts, clashing columns, few languages, nothing to learn."""
    german, english = "und der die das nicht schöner größe über ", "the and with this shall other which "
    rows = [(i, german * (1 + i % 3), "de") for i in range(40)] + [(100 + i, english * (1 + i % 4), "en") for i in range(40)] + [(200, "1234 !!", "de"), (201, None, "en"), (202, "the text", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.LanguageNetwork(labelled.union(labelled))
    assert model.languages == ["de", "en"]
    ask = spark.createDataFrame([(1, german, "x"), (2, english, "x"), (3, "12 3", "x"), (4, "", "x"), (5, None, "x"), (6, english * 30_000, "x"), (6, english * 30_000, "x"), (7, english * 200 + german * 20, "x")], "doc_id long, text string, score string")
    got = langid.identify(ask, model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["de", "en", "und", "und", "und", "en", "en", "en"]
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in got) and len(got[0]) == 4
    assert langid.identify(odd, model).count() == odd.count() and langid.identify(empty, model).count() == 0
    one = langid.identify(ask, langid.LanguageNetwork(labelled.filter("lang = 'de'"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("de", 1.0), ("und", 0.0)}
    none = langid.identify(ask, langid.LanguageNetwork(labelled.limit(0))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


@pytest.mark.parametrize("texts, most", [(5, 1000), (500, 6)])
def test_bounds_of_the_fit(spark, texts, most):
    """The sample keeps its bounds, also where one text is a third of all rows."""
    rows = [(f"text number {i} is here", "en" if i % 4 else "de") for i in range(200)] + [("same text", "en")] * 100
    model = langid.LanguageNetwork(spark.createDataFrame(rows, "text string, lang string"), texts=texts, all_texts=most)
    assert model.languages == ["de", "en"] and model.network is not None
