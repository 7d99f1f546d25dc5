"""Registered queries of the matching engine over the driver's tables, each with its DuckDB equivalent.

The tables hold no postings or profiles, so documents stand in for postings, benchmark items for
profiles, events and orders for recorded matches. Each entry: name -> (Spark query, SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions import text as T
from ..operators import batch as B
from ..operators import history as H
from ..operators import matcher as M
from ..operators import requests as J
from ..operators import rescoring as R
from ..operators import tfidf as I
from ..sources import files as U
from ..sources import html as W
from ..sources.tables import small, written
from ..streaming import digest as D
from . import duck as Q

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str]] = {}
#: A profile and a dictionary that meet the corpus, whose words are invented.
PROFILE = "Senior Python developer. Rest API, C++17, thre tion that ingth. 5+ years of experience, full-stack. des que ther"
DICTIONARY = ["python", "r", "rest", "apache", "c++", "ther", "thre", "tion", "que", "des", "ing", "ed", "en", "er", "las", "die"]
WORDS = "coalesce(text, '') || ' ' || CASE doc_id % 6 WHEN 0 THEN 'CI/CD, Node.js & REST  API, 5+ years of experience' WHEN 1 THEN 'C++17 and ASP.NET; Full-Stack, full stack' WHEN 2 THEN 'machine  learning, back end, c# f#' WHEN 3 THEN 'devops engineer in site reliability k8s' WHEN 4 THEN '10 years experience; data scientist' ELSE 'restapi natural language processing' END"


def query(sql: str):
    def add(f: Query) -> Query:
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table for each core from which its files alone keep all cores busy.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, as its one row group would be read by one task; a table of
    ``SMALL`` bytes a core or more stays as its files are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id, text), whose texts cost more than their bytes."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        F.col("doc_id").alias("ord"),
        F.lit(None).cast("string").alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        F.col("text").alias("description"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("platform"),
    )


def joined(items) -> F.Column:
    return F.array_join(items, "|")


def micro(x) -> F.Column:
    """A number cut to six decimals, so that the last bits of either engine don't matter."""
    return (F.floor(x * 1e6 + 0.5) / 1e6).cast("double")


JOB = "(SELECT doc_id, concat_ws(' ', nullif(source, ''), nullif(text, ''), nullif(lang, '')) AS t FROM documents)"
TOKENS = Q.token_cte("documents", "doc_id", "text")
JOB_TOKENS = Q.token_cte(JOB, "doc_id", "t")
JOB_SKILLS = Q.skill_cte(JOB, "doc_id", "t", DICTIONARY)
MINE = Q.token_cte(f"(SELECT {Q.q(PROFILE)} AS p)", "p", "p", "me") + ", " + Q.skill_cte(f"(SELECT {Q.q(PROFILE)} AS p)", "p", "p", DICTIONARY, "mysk")
SCORED = f"""{JOB_TOKENS}, {JOB_SKILLS}, {MINE},
 s0 AS (SELECT tok.doc_id, CASE WHEN len(list_intersect(tok.tokens, me.tokens)) > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS tfidf_score, sk.skills AS job, mysk.skills AS mine,
   list_filter(sk.skills, lambda x: list_contains(mysk.skills, x)) AS matched, list_filter(sk.skills, lambda x: NOT list_contains(mysk.skills, x)) AS missing
   FROM tok JOIN sk USING (doc_id), me, mysk),
 s1 AS (SELECT *, CASE WHEN len(job) = 0 THEN 0.0::DOUBLE ELSE floor(len(matched)::DOUBLE / len(job) * 100 * 100 + 0.5) / 100 END AS skill_score FROM s0),
 scored AS (SELECT *, floor((tfidf_score * 0.6::DOUBLE + skill_score * 0.4::DOUBLE) * 100 + 0.5) / 100 AS score FROM s1)"""


@query(f"WITH {TOKENS} SELECT doc_id, array_to_string(tokens, '|') AS tokens, len(tokens)::BIGINT AS n FROM tok")
def tokenize_documents(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", joined("t").alias("tokens"), F.size("t").cast("long").alias("n"))


@query(f"SELECT doc_id, array_to_string({Q.tech(f'({WORDS})')}, '|') AS terms FROM documents")
def tech_terms(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", joined(T.tech_terms(F.expr(WORDS))).alias("terms"))


@query(f"WITH {Q.skill_cte('documents', 'doc_id', 'text')} SELECT doc_id, array_to_string(skills, '|') AS skills FROM sk")
def extract_skills(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", joined(T.skills(F.col("text"))).alias("skills"))


@query(f"WITH {Q.skill_cte(f'(SELECT doc_id, {WORDS} AS t FROM documents)', 'doc_id', 't')} SELECT doc_id, array_to_string(skills, '|') AS skills FROM sk")
def phrase_skills(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", joined(T.skills(F.expr(WORDS))).alias("skills"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '. ', chr(13) || chr(10) || chr(10) || chr(10) || ' ' || chr(9)), chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def normalize_text(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.normalize(F.replace("text", F.lit(". "), F.lit("\r\n\n\n \t"))).alias("text"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n FROM documents")
def word_count(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n"))


@query("SELECT doc_id AS ord, concat_ws(' ', nullif(source, ''), nullif(text, ''), nullif(lang, '')) AS t FROM documents")
def job_text(spark, sf_dir):
    return jobs(spark, sf_dir).select("ord", T.job_text(*map(F.col, ("title", "company", "description", "location"))).alias("t"))


@query("SELECT doc_id AS ord FROM documents WHERE length(text) > 20")
def content_filter(spark, sf_dir):
    return B.content_filter(jobs(spark, sf_dir)).select("ord")


@query("SELECT doc_id AS ord, source AS platform FROM documents WHERE source IN ('src1', 'src3')")
def platform_gate(spark, sf_dir):
    return B.platform_gate(jobs(spark, sf_dir), {"src1": True, "src2": False, "src3": True}).select("ord", "platform")


@query(f"WITH {TOKENS}, {Q.token_cte('benchmark', 'item_id', 'text', 'bt')}, a AS (SELECT DISTINCT doc_id, unnest(tokens) AS x FROM tok), b AS (SELECT DISTINCT item_id, unnest(tokens) AS x FROM bt) SELECT item_id, count(DISTINCT doc_id)::BIGINT AS n, count(DISTINCT doc_id) * 100.0::DOUBLE AS total FROM a JOIN b USING (x) GROUP BY item_id")
def pair_score_closed(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    items = read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("tokens"))
    # A pair with a shared token scores 100, any other 0.
    return M.shared_token_counts(docs, items, "doc_id", "item_id").select("item_id", "n", (F.col("n") * 100.0).alias("total"))


@query(f"WITH {TOKENS}, pairs AS (SELECT a.doc_id AS p, a.tokens AS a, b.tokens AS b FROM tok a JOIN tok b ON b.doc_id = a.doc_id + 1), x AS (SELECT p, 'a' AS side, unnest(a) AS term, len(a) AS n FROM pairs UNION ALL SELECT p, 'b', unnest(b), len(b) FROM pairs), d AS (SELECT p, term, ln(2.0::DOUBLE / (1 + count(*))) AS idf FROM x GROUP BY ALL), w AS (SELECT p, side, term, 1.0::DOUBLE / n * idf AS w FROM x JOIN d USING (p, term)), dots AS (SELECT u.p, sum(u.w * v.w) AS dot FROM w u JOIN w v ON u.p = v.p AND u.term = v.term AND u.side = 'a' AND v.side = 'b' GROUP BY u.p), norms AS (SELECT p, sqrt(sum(w * w) FILTER (side = 'a')) * sqrt(sum(w * w) FILTER (side = 'b')) AS nn FROM w GROUP BY p) SELECT pairs.p AS doc_id, CASE WHEN len(list_intersect(a, b)) > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS closed, CASE WHEN coalesce(nn, 0) = 0 THEN 0.0::DOUBLE ELSE floor(coalesce(dot, 0) / nn * 100 * 100 + 0.5) / 100 END AS generic FROM pairs LEFT JOIN dots ON dots.p = pairs.p LEFT JOIN norms ON norms.p = pairs.p")
def pair_score_generic(spark, sf_dir):
    """Each document with the next one; the SQL goes by the term weights of the two."""
    docs = texts(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("a"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return docs.join(after, "doc_id").select("doc_id", I.pair_score(F.col("a"), F.col("b")).alias("closed"), I.pair_score_generic(F.col("a"), F.col("b")).alias("generic"))


@query(f"WITH {SCORED} SELECT doc_id AS ord, score, tfidf_score, skill_score, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing, len(mine)::BIGINT AS profile_skill_count, len(job)::BIGINT AS job_skill_count FROM scored")
def score_jobs(spark, sf_dir):
    out = M.score_jobs(jobs(spark, sf_dir), M.Profile.of(spark, PROFILE, DICTIONARY), dictionary=DICTIONARY)
    return out.select("ord", "score", "tfidf_score", "skill_score", joined("matched_skills").alias("matched"), joined("missing_skills").alias("missing"), "profile_skill_count", "job_skill_count")


@query(f"WITH {SCORED} SELECT doc_id AS ord, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank FROM scored WHERE score >= 50")
def match_jobs(spark, sf_dir):
    out = M.match_jobs(jobs(spark, sf_dir), M.Profile.of(spark, PROFILE, DICTIONARY), M.SERVICE_THRESHOLD, dictionary=DICTIONARY)
    return B.ranked(out.select("ord", "score"))


@query(f"WITH {SCORED} SELECT CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'low' END AS category, count(*)::BIGINT AS n FROM scored GROUP BY 1")
def score_category(spark, sf_dir):
    out = M.score_jobs(jobs(spark, sf_dir), M.Profile.of(spark, PROFILE, DICTIONARY), dictionary=DICTIONARY)
    return out.groupBy(formats.score_category(F.col("score")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN len(job) = 0 THEN 0.0::DOUBLE ELSE floor(len(matched)::DOUBLE / len(job) * 1e6 + 0.5) / 1e6 END AS ratio FROM scored")
def skill_match_ratio(spark, sf_dir):
    profile = M.Profile.of(spark, PROFILE, DICTIONARY)
    skills = M.with_features(jobs(spark, sf_dir), DICTIONARY)
    return skills.select(F.col("ord").alias("doc_id"), micro(M.skill_ratio(F.array(*map(F.lit, profile.skills)), F.col("job_skills"))).alias("ratio"))


@query(f"WITH {TOKENS}, {Q.token_cte('benchmark', 'item_id', 'text', 'bt')}, {Q.skill_cte('documents', 'doc_id', 'text', DICTIONARY)}, {Q.skill_cte('benchmark', 'item_id', 'text', DICTIONARY, 'bs')}, p AS (SELECT item_id, doc_id, CASE WHEN len(list_intersect(bt.tokens, tok.tokens)) > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS t, len(list_intersect(bs.skills, sk.skills)) AS k, len(sk.skills) AS n FROM (tok JOIN sk USING (doc_id)), (bt JOIN bs USING (item_id))), s AS (SELECT item_id, doc_id, floor((t * 0.6::DOUBLE + CASE WHEN n > 0 THEN floor(k::DOUBLE / n * 100 * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END * 0.4::DOUBLE) * 100 + 0.5) / 100 AS score FROM p WHERE t > 0 OR k > 0) SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM s) WHERE rank <= 5")
def many_profiles_topk(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", F.lit("").alias("title"), F.lit("").alias("company"), F.lit("").alias("location"), F.col("text").alias("description"))
    out = M.match_many(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"), 5, "doc_id", "item_id", dictionary=DICTIONARY)
    return out.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


RAW = "raw AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS term FROM documents)"


def _raw(spark, sf_dir, name="documents", key="doc_id"):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    return read(spark, sf_dir, name).select(key, words.alias("words"))


@query(f"WITH {RAW}, c AS (SELECT doc_id, term, count(*) AS n FROM raw GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id) SELECT doc_id, term, floor(n::DOUBLE / total::DOUBLE * 1e6 + 0.5) / 1e6 AS tf FROM c JOIN t USING (doc_id)")
def term_frequency(spark, sf_dir):
    return I.term_frequency(_raw(spark, sf_dir), "doc_id", "words").select("doc_id", "term", micro(F.col("tf")).alias("tf"))


@query(f"WITH {TOKENS}, x AS (SELECT doc_id, unnest(tokens) AS term FROM tok) SELECT term, count(*)::BIGINT AS df FROM x GROUP BY term")
def document_frequency(spark, sf_dir):
    return I.document_frequency(texts(spark, sf_dir).select(T.tokens(F.col("text")).alias("t")), "t")


@query(f"WITH {TOKENS}, x AS (SELECT doc_id, unnest(tokens) AS term FROM tok), d AS (SELECT term, count(*) AS df FROM x GROUP BY term) SELECT term, df::BIGINT AS df, floor(ln((SELECT count(*) FROM documents)::DOUBLE / (1 + df)) * 1e6 + 0.5) / 1e6 AS idf FROM d")
def inverse_document_frequency(spark, sf_dir):
    out = I.inverse_document_frequency(texts(spark, sf_dir).select(T.tokens(F.col("text")).alias("t")), "t")
    return out.select("term", "df", micro(F.col("idf")).alias("idf"))


VECTORS = f"{TOKENS}, x AS (SELECT doc_id, unnest(tokens) AS term, len(tokens) AS n FROM tok), d AS (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / (1 + count(*))) AS idf FROM x GROUP BY term), v AS (SELECT doc_id, term, 1.0::DOUBLE / n * idf AS weight FROM x JOIN d USING (term))"


@query(f"WITH {VECTORS} SELECT doc_id, term, floor(weight * 1e6 + 0.5) / 1e6 AS weight FROM v")
def tfidf_vector(spark, sf_dir):
    docs = I.prepared(texts(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")), "doc_id", "t")
    return I.tfidf_vectors(docs, "doc_id", "t", tf=I.term_frequency(docs, "doc_id", "t", once=True)).select("doc_id", "term", micro(F.col("weight")).alias("weight"))


@query(f"WITH {VECTORS}, {Q.token_cte('benchmark', 'item_id', 'text', 'bt')}, bx AS (SELECT item_id, unnest(tokens) AS term, len(tokens) AS n FROM bt), b AS (SELECT item_id, term, 1.0::DOUBLE / n * coalesce(idf, 0) AS weight FROM bx LEFT JOIN d USING (term)), nv AS (SELECT doc_id, sqrt(sum(weight * weight)) AS na FROM v GROUP BY doc_id), nb AS (SELECT item_id, sqrt(sum(weight * weight)) AS nb FROM b GROUP BY item_id), dots AS (SELECT doc_id, item_id, sum(v.weight * b.weight) AS dot FROM v JOIN b USING (term) WHERE v.weight <> 0 AND b.weight <> 0 GROUP BY ALL) SELECT doc_id, item_id, floor(dot / (na * nb) * 1e6 + 0.5) / 1e6 AS cosine FROM dots JOIN nv USING (doc_id) JOIN nb USING (item_id)")
def cosine_sparse(spark, sf_dir):
    docs = I.prepared(texts(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")), "doc_id", "t")
    items = I.prepared(read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t")), "item_id", "t")
    tf = I.term_frequency(docs, "doc_id", "t", once=True)
    idf = written(I.inverse_document_frequency(docs, "t", tf), "idf")
    out = I.cosine_sparse(I.tfidf_vectors(docs, "doc_id", "t", idf, tf), small(written(I.tfidf_vectors(items, "item_id", "t", idf), "items")), "doc_id", "item_id")
    return out.select("doc_id", "item_id", micro(F.col("cosine")).alias("cosine"))


@query("SELECT a.vec_id, floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_dense(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", micro(I.cosine_dense(F.col("embedding"), F.col("next"))).alias("cosine"))


@query("SELECT event_type, user_id, min(event_id)::BIGINT AS event_id FROM events GROUP BY ALL")
def dedup_first_seen(spark, sf_dir):
    return B.first_seen(read(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], "event_id")


@query("SELECT page_id AS ord, 'detail' AS kind, url FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'card', url FROM pages")
def detail_union_cards(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url")
    out = B.detail_and_cards(pages.filter("ord % 3 = 0").withColumn("kind", F.lit("detail")), pages.withColumn("kind", F.lit("card")))
    return out.select("ord", "kind", "url")


@query("WITH m AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'u' || o_custkey END AS url FROM orders), h AS (SELECT DISTINCT url FROM m WHERE o_orderkey % 50 = 0 OR url IS NULL) SELECT o_orderkey FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.url IS NOT DISTINCT FROM m.url)")
def select_new_anti_join(spark, sf_dir):
    url = F.when(F.col("o_custkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), F.col("o_custkey").cast("string")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))
    return B.select_new(rows, rows.filter("o_orderkey % 50 = 0 or url is null").select("url")).select("o_orderkey")


@query("WITH u AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS g FROM orders) SELECT o_orderkey, row_number() OVER (ORDER BY g, o_orderkey)::BIGINT AS position FROM u ORDER BY g, o_orderkey LIMIT 200")
def history_cap(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    out = B.cap_history(rows.filter("o_orderstatus = 'O'"), rows.filter("o_orderstatus <> 'O'"), "o_orderkey")
    return out.select("o_orderkey", F.col("position").cast("long").alias("position"))


def _recorded(spark, sf_dir):
    score = (F.col("o_totalprice") % 101).cast("double")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), score.alias("score"), F.col("o_orderstatus").alias("platform"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("matched_at"))


RECORDED = "(SELECT o_orderkey AS id, (o_totalprice % 101)::DOUBLE AS score, o_orderstatus AS platform, strftime(o_orderdate, '%Y-%m-%d') AS matched_at FROM orders)"


@query(f"SELECT id, platform, matched_at FROM {RECORDED} WHERE score >= 40 AND platform = 'F' ORDER BY matched_at DESC, id DESC LIMIT 120 OFFSET 30")
def history_page(spark, sf_dir):
    return H.page(_recorded(spark, sf_dir), "120rows", "30", "40", "F").select("id", "platform", "matched_at")


@query("SELECT count(*)::BIGINT AS total FROM orders")
def history_count(spark, sf_dir):
    return H.total(_recorded(spark, sf_dir))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Job ' || o_orderkey END AS job_title, '' AS company, '' AS url, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 101)::DOUBLE END AS score, coalesce(o_orderstatus, '') AS platform, '[]' AS matched_skills, '[]' AS missing_skills, CASE WHEN o_orderkey % 4 = 0 THEN '2024-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS matched_at, '2024-01-01' AS created_at FROM orders")
def insert_defaults(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.when(key % 3 != 0, F.concat(F.lit("Job "), key.cast("string"))).alias("job_title"), F.when(key % 5 == 0, F.lit(float("nan"))).otherwise((key % 101).cast("double")).alias("score"), F.col("o_orderstatus").alias("platform"), F.when(key % 4 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("matched_at"))
    return H.with_defaults(rows, "2024-01-01")


def _scored_events(spark, sf_dir):
    score = F.floor(F.abs(F.col("value"))) % 101
    return read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.concat(F.lit("Job "), F.col("event_id").cast("string")).alias("title"), F.col("event_type").alias("company"), score.cast("double").alias("score"))


EVENTS = "(SELECT user_id, event_id AS ord, 'Job ' || event_id AS title, event_type AS company, (floor(abs(value))::BIGINT % 101)::DOUBLE AS score FROM events)"


@query(f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ord) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM {EVENTS}) SELECT user_id, least(n, 6)::BIGINT AS n, (CASE WHEN score >= 80 THEN '🟢' WHEN score >= 60 THEN '🟡' ELSE '🔴' END) || ' Job Match: ' || score::BIGINT || '%' AS title, CASE WHEN n <= 5 THEN title || ' at ' || company ELSE '+' || (total - 5) || ' more matches found' END AS message, CASE WHEN score >= 80 THEN 2 ELSE 1 END::BIGINT AS priority FROM e WHERE n <= 5 OR n = total")
def notifications(spark, sf_dir):
    return B.notifications(_scored_events(spark, sf_dir), "user_id")


@query(f"SELECT user_id, count(*)::BIGINT AS n, max(score) AS top_score, count(*) || (CASE WHEN count(*) = 1 THEN ' new match' ELSE ' new matches' END) || ' (top score: ' || max(score)::BIGINT || '%)' AS subject, '<p>' || count(*) || (CASE WHEN count(*) = 1 THEN ' new match' ELSE ' new matches' END) || ' found</p><table>' || string_agg('<tr><td><a href=\"#\">' || title || '</a> ' || company || '</td><td style=\"color:' || (CASE WHEN score >= 80 THEN '#10B981' WHEN score >= 60 THEN '#F59E0B' ELSE '#EF4444' END) || '\">' || score::BIGINT || '%</td><td>' || company || '</td><td>N/A</td></tr>', '' ORDER BY score DESC, ord) || '</table>' AS body FROM {EVENTS} GROUP BY user_id")
def digest_summary(spark, sf_dir):
    rows = _scored_events(spark, sf_dir).select("*", F.lit(None).cast("string").alias("url"), F.array("company").alias("matched_skills"), F.array().cast("array<string>").alias("missing_skills"))
    return B.digest(rows, "user_id")


@query("WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events), f AS (SELECT user_id, k, t_ms, t_ms AS last, true AS sent, 1::BIGINT AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.t_ms, CASE WHEN e.t_ms - f.last >= 86400000 THEN e.t_ms ELSE f.last END, e.t_ms - f.last >= 86400000, CASE WHEN f.sent THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1) SELECT user_id, t_ms::BIGINT AS sent_at, n::BIGINT AS n FROM f WHERE sent")
def digest_cooldown(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return D.cooldown_batch(events, 24 * 60, "user_id", "at", "event_id")


@query(f"WITH j AS (SELECT ord, score FROM {EVENTS}), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS r FROM j) SELECT ord, CASE WHEN r <= 10 AND r % 2 = 0 THEN floor((0.7::DOUBLE * score + 0.3::DOUBLE * (r * 9)) * 100 + 0.5) / 100 ELSE score END AS score, CASE WHEN r <= 10 AND r % 2 = 0 THEN score END AS local_score FROM b")
def hybrid_blend(spark, sf_dir):
    replies = spark.range(1, 11).select(F.col("id").cast("int").alias("rank"), F.when(F.col("id") % 2 == 0, (F.col("id") * 9).cast("double")).alias("model_score"))
    return B.blend(_scored_events(spark, sf_dir).select("ord", "score"), replies).select("ord", "score", "local_score")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 85.0 WHEN 1 THEN 100.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN toxic * 50.0 + 12.5 END::DOUBLE AS score, CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 5 THEN NULL ELSE '' END AS rationale, CASE doc_id % 6 WHEN 0 THEN 'a|b' WHEN 5 THEN NULL ELSE '' END AS strengths FROM labels")
def llm_parse_validate(spark, sf_dir):
    kind = F.col("doc_id") % 6
    reply = (
        F.when(kind == 0, '{"score": "85", "rationale": "ok", "keyStrengths": ["a", "b"], "gaps": []}')
        .when(kind == 1, '  {"score": 150, "keyStrengths": "none"} ')
        .when(kind == 2, '{"score": true}')
        .when(kind == 3, '```json\n{"score": null}\n```')
        .when(kind == 4, F.concat(F.lit('Here: {"score": '), (F.col("toxic") * 50 + 12.5).cast("string"), F.lit("} as asked")))
        .otherwise('a {"g":{"x":1}} b')
    )
    got = read(spark, sf_dir, "labels").select("doc_id", R.parse_reply(reply).alias("r"))
    return got.select("doc_id", "r.score", "r.rationale", joined("r.key_strengths").alias("strengths"))


@query("SELECT doc_id, sha256('Rate from 0 to 100 how well the resume fits the job.' || chr(10) || chr(10) || 'RESUME:' || chr(10) || 'me' || chr(10) || chr(10) || 'JOB:' || chr(10) || 'Title: N/A' || chr(10) || 'Company: ' || source || chr(10) || 'Location: ' || lang || chr(10) || 'Description:' || chr(10) || substr(text, 1, 2000) || chr(10) || chr(10) || 'Reply as {\"score\": 0-100, \"rationale\": \"...\", \"keyStrengths\": [\"...\"], \"gaps\": [\"...\"]}') AS prompt FROM documents")
def llm_prompt(spark, sf_dir):
    p = R.prompt(F.lit("me"), F.col("title"), F.col("company"), F.col("location"), F.col("description"))
    return jobs(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.sha2(p.cast("binary"), 256).alias("prompt"))


@query("SELECT event_id, least(85, 10 + floor((event_id % 6) / 5.0::DOUBLE * 75 + 0.5))::BIGINT AS progress FROM events")
def scan_progress(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", formats.scan_progress(F.col("event_id") % 6, F.lit(5)).cast("long").alias("progress"))


@query("SELECT p_partkey AS id, strftime(t, '%Y-%m-%d %H:%M') AS runs_at FROM (SELECT p_partkey, unnest(generate_series(TIMESTAMP '2024-01-01' + INTERVAL (m) MINUTE, TIMESTAMP '2024-01-01 06:00:00', INTERVAL (m) MINUTE)) AS t FROM (SELECT p_partkey, greatest(CASE WHEN p_size % 10 = 0 THEN 60 ELSE p_size END, 15) AS m FROM part WHERE p_partkey % 4 <> 0))")
def alarm_schedule(spark, sf_dir):
    profiles = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size")).alias("interval"), (F.col("p_partkey") % 4 != 0).alias("enabled"))
    return D.alarm_times(profiles, "2024-01-01 00:00:00", "2024-01-01 06:00:00").select("id", F.date_format("runs_at", "yyyy-MM-dd HH:mm").alias("runs_at"))


@query("SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS age FROM (SELECT event_id, floor((1800000000 - epoch(ts)::BIGINT) % 300000 / 60)::BIGINT AS m FROM events)")
def time_ago(spark, sf_dir):
    now, at = F.lit(1800000000), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 0.5)
    return read(spark, sf_dir, "events").select("event_id", formats.time_ago(now - (now - at) % 300000, now).alias("age"))


@query("SELECT p_partkey, CASE WHEN m < 60 THEN 'Every ' || m || 'm' WHEN m < 1440 THEN 'Every ' || (CASE WHEN m % 60 = 0 THEN (m // 60)::VARCHAR ELSE (m / 60.0::DOUBLE)::VARCHAR END) || 'h' ELSE 'Daily' END AS label FROM (SELECT p_partkey, p_size * 30 AS m FROM part)")
def interval_label(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", formats.interval_label(F.col("p_size") * 30).alias("label"))


@query("SELECT p_partkey, 'https://www.linkedin.com/jobs/search/?keywords=' || replace(p_name, ' ', '+') || CASE p_partkey % 4 WHEN 0 THEN '&location=New+York' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN '&f_WT=2' WHEN 1 THEN '&f_WT=1' WHEN 2 THEN '&f_WT=3' ELSE '' END || '&sortBy=DD&_jm_scan=1' AS url FROM part")
def search_url(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "remote").when(k % 5 == 1, "onsite").when(k % 5 == 2, "hybrid").when(k % 5 == 3, "any")
    return read(spark, sf_dir, "part").select("p_partkey", formats.search_url(F.col("p_name"), F.when(k % 4 == 0, "New York").otherwise(""), kind).alias("url"))


@query("SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(replace(regexp_replace(replace(html, '</w:p>', chr(10)), '<w:br[^>]*/>', chr(10), 'g'), '<w:tab/>', chr(9)), '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''') AS text FROM pages")
def xml_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.strip_xml(F.col("html")).alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM pages")
def html_escape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("text"))


@query("SELECT page_id, 'card' AS kind, 'Job ' || page_id AS title, 'https://board.example/jobs/view/' || page_id AS url, 'ACME ' || page_id % 7 AS company FROM pages UNION ALL SELECT page_id, 'detail', 'Lead ' || page_id, url, '' FROM pages WHERE page_id % 2 = 0")
def html_extract(spark, sf_dir):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k = F.col("page_id")
    card = text('<li class="job_seen_beacon"><h2 class="jobTitle"><a href="/jobs/view/', k, '"> Job ', k, '</a></h2><span class="companyName">ACME ', k % 7, "</span></li>")
    detail = F.when(k % 2 == 0, text('<div class="jobsearch-JobInfoHeader-title">Lead ', k, '</div><div id="jobDescriptionText">text</div>')).otherwise("")
    # Before the whole page, which holds no posting of its own.
    pages = spread(read(spark, sf_dir, "pages").select("page_id", F.lit("https://board.example/x").alias("url"), F.col("url").alias("own"), F.concat(card, card, detail, F.coalesce("html", F.lit(""))).alias("html")))
    out = W.extract(pages, "indeed").join(pages.select("page_id", "own"), "page_id")
    return out.select("page_id", "kind", "title", F.when(F.col("kind") == "card", F.col("url")).otherwise(F.col("own")).alias("url"), "company")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def status_last_value(spark, sf_dir):
    return B.latest_status(read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("state"), "ts", "event_id"), "user_id", "state", ["ts", "event_id"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def navigation_changes(spark, sf_dir):
    return D.changes(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id")


@query("SELECT p_partkey, replace(replace(replace(replace(replace(replace(t, '\\n', chr(10)), '\\r', chr(13)), '\\t', chr(9)), '\\(', '('), '\\)', ')'), '\\\\', '\\') AS text FROM (SELECT p_partkey, p_name || '\\(a\\)\\n\\tb\\\\' AS t FROM part)")
def pdf_string(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.decode_pdf_string(F.concat("p_name", F.lit("\\(a\\)\\n\\tb\\\\"))).alias("text"))


@query(f"SELECT ord, CASE WHEN ord % 4 = 0 THEN 'Untitled' ELSE title END AS title, CASE WHEN ord % 5 < 2 THEN 'Unknown Company' ELSE company END AS company, CASE ord % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'indeed' ELSE 'unknown' END || CASE WHEN ord % 2 = 0 THEN ' + LLM' ELSE '' END AS platform, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'low' END AS category, array_to_string(list_transform(range(least(ord % 9, 5)), lambda i: 's' || i), '|') AS matched, array_to_string(list_transform(range(least(ord % 7, 3)), lambda i: 'm' || i), '|') AS missing, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS age FROM (SELECT *, (ord * 37 % 300000) // 60 AS m FROM {EVENTS})")
def card_view(spark, sf_dir):
    k = F.col("ord")
    some = lambda n, letter: F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit(letter), i.cast("string"))))
    rows = _scored_events(spark, sf_dir)
    rows = rows.withColumns({"title": F.when(k % 8 == 0, "").when(k % 4 != 0, F.col("title")), "company": F.when(k % 5 == 0, "").when(k % 5 != 1, F.col("company")), "platform": F.when(k % 3 == 0, "").when(k % 3 == 1, "indeed"), "model_score": F.when(k % 2 == 0, F.lit(50.0)), "matched_at": 2_000_000 - k * 37 % 300_000, "matched_skills": some(k % 9, "s"), "missing_skills": some(k % 7, "m")})
    out = B.card_view(rows, F.lit(2_000_000), "ord")
    return out.withColumns({"matched": joined("matched"), "missing": joined("missing")})


@query("WITH r AS (SELECT user_id AS id, max(event_id)::VARCHAR AS ran, count(*) AS found FROM events WHERE event_id % 2 = 0 GROUP BY user_id) SELECT c_custkey AS id, coalesce(ran, 'never') AS last_run, (c_custkey % 3 + coalesce(found, 0))::BIGINT AS result_count FROM customer LEFT JOIN r ON r.id = c_custkey")
def profile_runs(spark, sf_dir):
    runs = read(spark, sf_dir, "events").filter("event_id % 2 = 0").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").cast("string").alias("last_run"), F.count("*").alias("jobs_found"))
    profiles = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("never").alias("last_run"), (F.col("c_custkey") % 3).alias("result_count"))
    return B.bump_profiles(profiles, runs)


@query("WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t_ms, event_id % 5 <> 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id % 5 <> 0) AS k FROM events), f AS (SELECT user_id, k, t_ms, CASE WHEN ok THEN t_ms END AS last, CASE WHEN ok THEN 'sent' ELSE 'send_failed' END AS result, NULL::BIGINT AS retry_after FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.t_ms, CASE WHEN coalesce(f.last + 86400000 - e.t_ms, 0) > 0 OR NOT e.ok THEN f.last ELSE e.t_ms END, CASE WHEN coalesce(f.last + 86400000 - e.t_ms, 0) > 0 THEN 'rate_limited' WHEN e.ok THEN 'sent' ELSE 'send_failed' END, CASE WHEN f.last + 86400000 - e.t_ms > 0 THEN ceil((f.last + 86400000 - e.t_ms) / 1000.0::DOUBLE)::BIGINT END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1) SELECT user_id, t_ms::BIGINT AS \"at\", result, retry_after FROM f")
def rate_limit(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 5 != 0).alias("delivered"))
    return D.rate_limited(rows, 24 * 60, "user_id")


@query("SELECT user_id, count(*)::VARCHAR AS text FROM events GROUP BY user_id")
def badge_count(spark, sf_dir):
    return B.badge(read(spark, sf_dir, "events").select("user_id"), "user_id")


@query(f"SELECT ord, CASE WHEN ord % 3 = 0 THEN '' ELSE 'Local ' || score::BIGINT || '% + LLM ' || (ord % 101) || '%' END AS breakdown, CASE WHEN ord % 3 = 0 THEN '' ELSE 'said' END AS rationale, CASE WHEN ord % 3 = 0 THEN '' ELSE 'a|b|c' END AS strengths, CASE WHEN ord % 3 = 0 THEN '' ELSE 'x' END AS gaps FROM {EVENTS}")
def card_insight(spark, sf_dir):
    has = F.col("ord") % 3 != 0
    rows = _scored_events(spark, sf_dir).select("ord", F.col("score").alias("local_score"), F.when(has, (F.col("ord") % 101).cast("double")).alias("model_score"), F.when(has, "said").alias("rationale"), F.when(has, F.array(*map(F.lit, "abcd"))).alias("key_strengths"), F.when(has, F.array(F.lit("x"))).alias("gaps"))
    return B.card_insight(rows).select("ord", "breakdown", "rationale", joined("strengths").alias("strengths"), joined("gaps").alias("gaps"))


@query(f"SELECT title AS job_title, company, '' AS url, score, '' AS platform, ord AS matched_at FROM {EVENTS}")
def lossy_projection(spark, sf_dir):
    rows = _scored_events(spark, sf_dir).select("title", "company", F.lit(None).cast("string").alias("url"), "score", F.lit(None).cast("string").alias("platform"), F.col("ord").alias("matched_at"), F.lit("lost").alias("matched_skills"))
    return H.lossy_projection(rows)


@query(f"SELECT title, company, 'u' || ord AS url, score, company AS matched_skills, '' AS missing_skills FROM {EVENTS}")
def digest_rows(spark, sf_dir):
    rows = _scored_events(spark, sf_dir).select("*", F.concat(F.lit("u"), F.col("ord").cast("string")).alias("url"), F.array("company").alias("matched_skills"), F.array().cast("array<string>").alias("missing_skills"))
    return B.digest_rows(rows).withColumns({c: joined(c) for c in ("matched_skills", "missing_skills")})


@query("SELECT event_id, (epoch_us(ts) // 1000 + event_id * 700) AS at, round((event_id * 700) / 1000.0::DOUBLE + 1e-9)::BIGINT AS elapsed, floor(event_id * 1234567 / 1e6::DOUBLE + 0.5)::BIGINT AS duration FROM events")
def elapsed_and_duration(spark, sf_dir):
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    end = start + F.col("event_id") * 700
    return read(spark, sf_dir, "events").select("event_id", end.alias("at"), formats.elapsed_seconds(start, end).alias("elapsed"), R.duration_ms(F.col("event_id") * 1234567).alias("duration"))


BODIES = "CASE p_partkey % 7 WHEN 0 THEN '{\"matches\": [{\"score\": 1}], \"email\": \"a@b\", \"resumeText\": \"me\", \"jobs\": [{}], \"job\": {\"title\": \"x\"}}' WHEN 1 THEN '{\"matches\": [], \"email\": \"ab\", \"resumeText\": 5, \"jobs\": {}}' WHEN 2 THEN '{\"resumeText\": \"\", \"job\": \"x\", \"email\": \"a@b\"}' WHEN 3 THEN '{\"resumeText\": \"me\", \"job\": null, \"matches\": \"x\"}' WHEN 4 THEN '[]' WHEN 5 THEN '{\"resumeText\": \"me\", \"job\": [1], \"jobs\": [1]}' ELSE 'no json' END"
NO_MATCHES, NO_TEXT, BAD = "'matches array is required'", "'resumeText string is required'", "'invalid JSON'"


@query(f"SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 6 THEN {BAD} ELSE {NO_MATCHES} END AS insert_error, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 5 THEN NULL WHEN 3 THEN 'job object is required' WHEN 6 THEN {BAD} ELSE {NO_TEXT} END AS score_error, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 5 THEN NULL WHEN 3 THEN 'jobs array is required' WHEN 6 THEN {BAD} ELSE {NO_TEXT} END AS batch_error, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 2 THEN {NO_MATCHES} WHEN 6 THEN {BAD} ELSE 'Valid email address is required' END AS notify_error FROM part")
def request_errors(spark, sf_dir):
    body = F.col("body")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(BODIES).alias("body"))
    return rows.select("p_partkey", J.insert_error(body).alias("insert_error"), J.score_error(body).alias("score_error"), J.score_batch_error(body).alias("batch_error"), J.notify_error(body).alias("notify_error"))


@query("SELECT o_orderkey, 'Job ' || o_orderkey || '.' || n AS job_title, (o_orderkey % 101)::DOUBLE AS score FROM orders, (VALUES (1), (2)) t(n) WHERE o_orderkey % 3 <> 0")
def request_matches(spark, sf_dir):
    one = lambda n: F.format_string('{"job_title": "Job %d.' + n + '", "score": %d}', "o_orderkey", F.col("o_orderkey") % 101)
    body = F.when(F.col("o_orderkey") % 3 == 0, '{"matches": []}').otherwise(F.concat(F.lit('{"matches": ['), one("1"), F.lit(", "), one("2"), F.lit("]}")))
    return J.matches_of(read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))).select("o_orderkey", "job_title", "score")


@query("SELECT user_id, epoch_us(ts) // 1000 AS \"at\", 'smtp_not_configured' AS result, NULL::BIGINT AS retry_after, 0::BIGINT AS n FROM events")
def mail_not_configured(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit(True).alias("delivered"), F.lit(1).alias("matches"))
    return D.rate_limited(rows, 24 * 60, "user_id", configured=False, matches="matches")


def _site_pages(spark, sf_dir, html: str):
    """Whole pages behind markup made of their ids."""
    parts = [F.lit(p) for p in html.split("#")]
    whole = parts[0]
    for p in parts[1:]:
        whole = F.concat(whole, F.col("page_id").cast("string"), p)
    return spread(read(spark, sf_dir, "pages").select("page_id", F.lit("https://board.example/x").alias("url"), F.concat(whole, F.coalesce("html", F.lit(""))).alias("html")))


LINKEDIN = '<link rel="canonical" href="https://board.example/jobs/view/9#"><h1 class="the-job-title-x">Lead #</h1><div id="job-details">A long description #</div><div class="job-card-container"><a href="/jobs/view/#"> Job # </a><span class="job-card-container__primary-description">ACME</span></div><li data-occludable-job-id="1"><a href="/jobs/view/#">Again</a></li>'


@query("SELECT page_id, 'detail' AS kind, 'Lead ' || page_id AS title, '' AS company, 'A long description ' || page_id AS description, 'https://board.example/jobs/view/9' || page_id AS url FROM pages UNION ALL SELECT page_id, 'card', 'Job ' || page_id, 'ACME', '', 'https://board.example/jobs/view/' || page_id FROM pages")
def linkedin_extract(spark, sf_dir):
    return W.extract(_site_pages(spark, sf_dir, LINKEDIN), "linkedin").select("page_id", "kind", "title", "company", "description", "url")


GLASSDOOR = '<div class="jobDescriptionContent">Text #</div><h1 data-test="job-title">Chef #</h1><div data-test="employerName">Inn</div><li data-jobid="1"><a class="job-title" href="/j/#">Cook #</a><i data-test="emp-name">Bistro</i></li>'


@query("SELECT page_id, 'detail' AS kind, 'Chef ' || page_id AS title, 'Inn' AS company, 'Text ' || page_id AS description, 'https://board.example/x' AS url FROM pages UNION ALL SELECT page_id, 'card', 'Cook ' || page_id, 'Bistro', NULL, 'https://board.example/j/' || page_id FROM pages")
def glassdoor_extract(spark, sf_dir):
    return W.extract(_site_pages(spark, sf_dir, GLASSDOOR), "glassdoor").select("page_id", "kind", "title", "company", "description", "url")


@query("SELECT page_id, kind, title, pass FROM (SELECT page_id, 'detail' AS kind, 'Lead ' || page_id AS title, 1 AS pass FROM pages UNION ALL SELECT page_id, 'card', 'Job ' || page_id, 1 FROM pages UNION ALL SELECT page_id, 'card', 'New ' || page_id, 2 FROM pages)")
def scan_passes(spark, sf_dir):
    later = LINKEDIN.replace("Job #", "Other #") + '<div class="job-card-container"><a href="/jobs/view/n#">New #</a></div>'
    both = [_site_pages(spark, sf_dir, html).withColumn("pass", F.lit(n)) for n, html in ((1, LINKEDIN), (2, later))]
    return W.scan_passes(both[0].union(both[1]), "linkedin").select("page_id", "kind", "title", "pass")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS text, CASE WHEN p_partkey % 3 = 2 THEN 'Unsupported file type: image/png' END AS error FROM part")
def parse_uploads(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    content = F.when(kind == 0, F.concat(F.lit("%PDF BT ("), "p_name", F.lit(") Tj ET"))).otherwise(F.concat(F.lit("\r\n "), F.regexp_replace("p_name", " ", " \t "), F.lit("  ")))
    files = read(spark, sf_dir, "part").select("p_partkey", F.when(kind == 0, "application/pdf").when(kind == 1, "text/plain").otherwise("image/png").alias("mime"), content.cast("binary").alias("content"))
    return U.parse_files(files).select("p_partkey", "text", "error")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items()}
