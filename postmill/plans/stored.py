"""Registered queries over written tables: dictionaries, upserts, pages, ids, digests in parts, pruned top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import SKILLS
from ..operators import batch as B
from ..operators import dictionary as X
from ..operators import history as H
from ..operators import tfidf as I
from ..sources.tables import KeyedTable, small, work_folder, written
from ..streaming import digest as D
from ..streaming.replay import replay
from . import duck as Q
from .catalog import CATALOG, EVENTS, RECORDED, VECTORS, _recorded, _scored_events, joined, query, read, texts
from .replays import SPELL


@query(CATALOG["extract_skills"][1])
def skills_by_table(spark, sf_dir):
    """``extract_skills`` with its dictionary as a table."""
    terms = spark.createDataFrame(list(enumerate(SKILLS)), "pos int, term string")
    return X.skills_by_table(texts(spark, sf_dir), terms, "doc_id").select("doc_id", joined("skills").alias("skills"))


RUNS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_]+'))"


@query(f"WITH b AS (SELECT text, lower(text) AS low FROM benchmark), t1 AS (SELECT DISTINCT unnest({RUNS}) AS term FROM b), t2 AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT regexp_extract_all(low, '[0-9a-z_]+') AS w, regexp_split_to_array(low, '[0-9a-z_]+') AS g FROM b), LATERAL (SELECT unnest(range(1, len(w))) AS i) WHERE g[i + 1] = ' '), t AS (SELECT * FROM t1 WHERE length(term) >= 5 UNION ALL SELECT * FROM t2), d AS (SELECT doc_id, {RUNS} AS w1, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_]+') AS w, regexp_split_to_array(lower(coalesce(text, '')), '[0-9a-z_]+') AS g FROM documents), x AS (SELECT doc_id, unnest(w1) AS term FROM d UNION SELECT doc_id, w[i] || ' ' || w[i + 1] FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS i) WHERE g[i + 1] = ' ') SELECT doc_id, count(t.term)::BIGINT AS n, md5(coalesce(string_agg(t.term, '|' ORDER BY encode(t.term)), '')) AS terms FROM d LEFT JOIN (SELECT doc_id, term FROM x JOIN t USING (term)) t USING (doc_id) GROUP BY doc_id")
def skills_large_dictionary(spark, sf_dir):
    """A dictionary from data: words and pairs of words of all benchmark items, in all documents."""
    low = F.lower(F.coalesce("text", F.lit("")))
    items = read(spark, sf_dir, "benchmark").select(low.alias("low"))
    words = items.select(F.explode(X.grams(F.col("low"), (1, False, False))).alias("term")).filter(F.length("term") >= 5)
    pairs = items.select(F.explode(X.grams(F.col("low"), (2, False, False))).alias("term")).filter(F.col("term").rlike("^[0-9a-z_]+ [0-9a-z_]+$"))
    terms = words.union(pairs).distinct().select(F.col("term").alias("pos"), "term")
    out = X.skills_by_table(texts(spark, sf_dir), terms, "doc_id", phrases=False)
    return out.select("doc_id", F.size("skills").cast("long").alias("n"), F.md5(joined("skills").cast("binary")).alias("terms"))


@query(f"WITH {VECTORS}, {Q.token_cte('benchmark', 'item_id', 'text', 'bt')}, bx AS (SELECT item_id, unnest(tokens) AS term, len(tokens) AS n FROM bt), b AS (SELECT item_id, term, 1.0::DOUBLE / n * coalesce(idf, 0) AS weight FROM bx LEFT JOIN d USING (term)), nv AS (SELECT doc_id, sqrt(sum(weight * weight)) AS na FROM v GROUP BY doc_id), nb AS (SELECT item_id, sqrt(sum(weight * weight)) AS nb FROM b GROUP BY item_id), dots AS (SELECT doc_id, item_id, sum(v.weight * b.weight) AS dot FROM v JOIN b USING (term) WHERE v.weight <> 0 AND b.weight <> 0 GROUP BY ALL), c AS (SELECT doc_id, item_id, floor(dot / (na * nb) * 1e6 + 0.5) / 1e6 AS cosine FROM dots JOIN nv USING (doc_id) JOIN nb USING (item_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id)::BIGINT AS rank FROM c WHERE cosine <> 0) WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    """The five nearest documents of each benchmark item."""
    docs = I.prepared(texts(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")), "doc_id", "t")
    items = I.prepared(read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t")), "item_id", "t")
    tf = I.term_frequency(docs, "doc_id", "t", once=True)
    idf = written(I.inverse_document_frequency(docs, "t", tf), "idf")
    return I.TopCosine(I.tfidf_vectors(docs, "doc_id", "t", idf, tf), small(written(I.tfidf_vectors(items, "item_id", "t", idf), "items")), "doc_id", "item_id", 5).result


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(event_id)::BIGINT AS event_id FROM events GROUP BY user_id")
def status_upsert(spark, sf_dir):
    """Statuses merged batch by batch into a keyed table."""
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("state"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    folder = work_folder(spark, "status")
    schema = f"user_id {rows.schema['user_id'].dataType.simpleString()}, state string, event_id bigint, at bigint"
    table = KeyedTable(spark, f"{folder}/table", ["user_id"], schema)

    def start(stream):
        return stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, i: table.merge(df, i, ["at", "event_id"]) and None).start()

    replay(rows, F.expr(SPELL), start, folder)
    return table.read().select("user_id", "state", "event_id")


@query(f"SELECT * FROM (SELECT 'first' AS page, id, matched_at FROM {RECORDED} ORDER BY matched_at DESC, id DESC LIMIT 20) UNION ALL SELECT * FROM (SELECT 'deep', id, matched_at FROM {RECORDED} ORDER BY matched_at DESC, id DESC LIMIT 35 OFFSET 1033) UNION ALL SELECT * FROM (SELECT 'last', id, matched_at FROM {RECORDED} ORDER BY matched_at DESC, id DESC LIMIT 500 OFFSET 1450) UNION ALL SELECT * FROM (SELECT 'filtered', id, matched_at FROM {RECORDED} WHERE score >= 40 AND platform = 'F' ORDER BY matched_at DESC, id DESC LIMIT 50 OFFSET 321)")
def history_deep_pages(spark, sf_dir):
    """Pages far behind, read from the ranges that hold them."""
    table = H.PagedTable.write(_recorded(spark, sf_dir), work_folder(spark, "paged"), 16)
    asked = {"first": (20, 0), "deep": (35, 1033), "last": (500, 1450), "filtered": (50, 321, 40, "F")}
    pages = [table.page(*a).select(F.lit(name).alias("page"), "id", "matched_at") for name, a in asked.items()]
    return pages[0].union(pages[1]).union(pages[2]).union(pages[3])


@query("SELECT row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey)::BIGINT AS id, 'Job ' || o_orderkey AS job_title FROM orders")
def insert_ids(spark, sf_dir):
    """Ids without gaps over two inserts."""
    path = work_folder(spark, "inserted")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Job "), F.col("o_orderkey").cast("string")).alias("job_title"))
    for k in (0, 1):
        H.insert(rows.filter(F.col("o_orderkey") % 2 == k), path, "2024-01-01", ["o_orderkey"])
    return H.read(spark, path).select("id", "job_title")


@query("WITH ev AS (SELECT user_id AS owner, event_id % 3 AS id, date_trunc('second', ts) AS t, event_id FROM events WHERE event_type IN ('signup', 'error')), ve AS (SELECT owner, id, t, max({'deleted': event_id % 11 = 0, 'enabled': event_id % 5 <> 0, 'm': greatest(CASE WHEN event_id % 7 = 0 THEN 60 ELSE event_id % 7 * 600 END, 15)}) AS v FROM ev GROUP BY ALL), ra AS (SELECT *, lead(t) OVER (PARTITION BY owner, id ORDER BY t) AS until FROM ve), sa AS (SELECT owner, t AS saved, lead(t) OVER (PARTITION BY owner ORDER BY t) AS next FROM (SELECT DISTINCT owner, t FROM ve)), me AS (SELECT ra.owner, id, saved, next, v.m AS m, coalesce(next, TIMESTAMP '2024-01-31') AS bound FROM ra JOIN sa ON sa.owner = ra.owner AND saved >= t AND (until IS NULL OR saved < until) WHERE v.enabled AND NOT v.deleted), ru AS (SELECT owner, id, next, unnest(generate_series(saved + INTERVAL (m) MINUTE, bound, INTERVAL (m) MINUTE)) AS r FROM me) SELECT owner, id, strftime(r, '%Y-%m-%d %H:%M:%S') AS runs_at FROM ru WHERE next IS NULL OR r < next")
def alarm_history(spark, sf_dir):
    """Scans of profiles that are edited, paused and deleted."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    versions = rows.select(F.col("user_id").alias("owner"), (k % 3).alias("id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), (k % 7 * 600).alias("interval"), (k % 5 != 0).alias("enabled"), (k % 11 == 0).alias("deleted"))
    return D.alarm_history(versions, "2024-01-31 00:00:00").select("owner", "id", F.date_format("runs_at", "yyyy-MM-dd HH:mm:ss").alias("runs_at"))


#: Bytes of a part, and a recipient with a third of all matches.
PART = 5000
HOT = "CASE WHEN ord % 3 = 0 THEN 0 ELSE user_id END"


@query(f"WITH e AS (SELECT {HOT} AS r, score, ord, '<tr><td><a href=\"#\">' || title || '</a> ' || company || '</td><td style=\"color:' || (CASE WHEN score >= 80 THEN '#10B981' WHEN score >= 60 THEN '#F59E0B' ELSE '#EF4444' END) || '\">' || score::BIGINT || '%</td><td>' || company || '</td><td>N/A</td></tr>' AS line FROM {EVENTS}), p AS (SELECT *, coalesce(sum(octet_length(encode(line))) OVER (PARTITION BY r ORDER BY score DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PART} AS part FROM e) SELECT r AS recipient, part::BIGINT AS part, count(*)::BIGINT AS n, md5(string_agg(line, '' ORDER BY score DESC, ord)) AS body FROM p GROUP BY ALL")
def digest_parts(spark, sf_dir):
    """Digests in parts, one recipient with a third of all matches."""
    rows = _scored_events(spark, sf_dir).select(F.expr(HOT).alias("recipient"), "ord", "title", "company", "score", F.lit(None).cast("string").alias("url"), F.array("company").alias("matched_skills"), F.array().cast("array<string>").alias("missing_skills"))
    return B.digest_parts(rows, "recipient", size=PART).withColumn("body", F.md5(F.col("body").cast("binary")))
