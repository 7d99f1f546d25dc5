"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, decontam, langid, lm, mixing, neardup, pii, secrets, sharding, toxicity, turns, warc
from .common import table, word_count, written


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards whose row counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shuffle_into_shards(docs, 24, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans by kind, a digest of all base spans, and all spans."""
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each secret found in a document; the source stands for the path."""
    out = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path="source")
    # Not explode(): the filter that Spark infers from it would scan each text once more.
    return out.select("doc_id", F.explode_outer("secrets").alias("s")).filter("s is not null").select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.rule", "s.score", "s.sha256")


def _fold(folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by their index."""
    index = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates among all documents; one row of the smallest doc_id of a class is kept."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth, among all vectors."""
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a classifier that learned from labels outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item found in a document."""
    out = decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.share", "x.cosine", "x.answer")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by counts of those outside fold 2 of 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.LanguageModel(docs.filter(_fold(7) != 2))
    out = model.score(docs.select(F.col("doc_id").alias("id"), "text"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score").select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1, repeating."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mixing.mix_sources(docs, F.array("source"), [F.col("doc_id")], size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as 8 numbers of codebook entries, with their errors, alone and summed over equal labels."""
    fitted = codes.VectorCodes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = written(fitted.codes.select("vec_id", "label", code.alias("code"), "error"), "codes")
    # Written, so that its size is known: few labels are broadcast, many are joined by key.
    sums = written(rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
    both = rows.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(fitted.books.sha256()).alias("codebooks_sha256"))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by a network that learned from those outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.LanguageNetwork(docs.filter(_fold(3) != 1))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that the crc32 of ``conv_id:turn`` gives, nulls as one space: rows (conv_id, turn,
    role, text, there)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired: what was wrong, the cheapest edits, and a digest of the result."""
    done = turns.repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("there"))
    found = done.digests().withColumnRenamed("conv_id", "c")
    return done.summary.join(found, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_shard, op2_secrets, op3_warc, op4_pii, op5_neardup, op6_ann, op7_toxicity, op8_mix, op9_decontam, op10_lm, op11_codes, op12_langid, op13_turns, pipeline)}


#: A SHA-1 in base32: each of 32 digits are five bits out of two hexadecimal digits.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((strpos('0123456789abcdef', substr(sha, (5 * i) // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(sha, (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '')"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM p"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds: every distance of every part to every entry."""
    kept = "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))"
    cut = f"p AS (SELECT r, part::INT AS part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) t(part))"
    step = [f"b0 AS (SELECT part, (r - 1)::INT AS entry, x AS e FROM p WHERE r <= {entries})"]
    floored = "(s - ((s % n) + n) % n) // n"
    for i in range(rounds + 1):
        step.append(f"a{i} AS (SELECT r, part, x, min({{'d': d, 'entry': entry}}) AS best FROM (SELECT r, p.part, x, entry, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{i} USING (part)) GROUP BY r, part, x)")
        if i < rounds:
            step.append(f"m{i} AS (SELECT part, entry, list({floored} ORDER BY j) AS e FROM (SELECT part, best.entry AS entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY ALL) GROUP BY ALL), b{i + 1} AS (SELECT part, entry, coalesce(m{i}.e, b{i}.e) AS e FROM b{i} LEFT JOIN m{i} USING (part, entry))")
    last = f"c AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r), h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})"
    return f"WITH {kept}, {cut}, {', '.join(step)}, {last} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN c USING (r), h"


def _turns_sql() -> str:
    """One row of a conversation after the other, with the cheapest way into each of the four states."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda s, cost, edit, line="": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t || {line or chr(39) * 2}}}"
    user, assistant, own = "'user:' || chr(10)", "'assistant:' || chr(10)", "e.role || ':' || e.text || chr(10)"
    new = lambda role: f"'{role}:' || e.text || chr(10)"
    rows = "SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, k FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc32(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) % 20 AS k FROM conversations)"
    crc = "crc AS (SELECT list(v ORDER BY i) AS t FROM (WITH RECURSIVE r AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS n FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM r WHERE n < 8) SELECT i, v FROM r WHERE n = 8))"
    keys = "keys AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), hashed AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM keys, crc)"
    rows = rows.replace("crc32(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) % 20 AS k FROM conversations", "h % 20 AS k FROM conversations JOIN hashed ON key = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    faults = f"d AS (SELECT *, row_number() OVER () AS id FROM d0, LATERAL (SELECT unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END))) WHERE k <> 0), o AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS i, row_number() OVER w AS n, lag(substr(role, 1, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) AS seen, rtrim(text, {space}) AS solid FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id)), e AS (SELECT *, CASE WHEN solid = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o)"
    insert = f"least(f.s2, {add('f.s0', 3, 'I', user)}, {add('f.s1', 3, 'I', user)}, {add('f.s3', 3, 'I', user)})"
    closed = f"(SELECT conv_id, n, s0, s1, s2, least(s3, {add('s2', 3, 'I', assistant)}) AS s3 FROM (SELECT conv_id, n, s0, s1, {insert} AS s2, s3 FROM f))"
    to_user = f"least(f.s0, f.s1, f.s3)"
    keep = lambda ok, s: f"CASE WHEN {ok} THEN {add(s, 't', 'K', own)} END"
    stay = lambda s: add(s, 4, "D")
    live = "e.fault NOT IN ('b', 'd')"
    role = lambda s, name: f"CASE WHEN {live} THEN {add(s, '3 + t', 'R', new(name))} END"
    step = f"SELECT e.conv_id, e.n, {stay('f.s0')} AS s0, least({stay('f.s1')}, {keep(live + chr(32) + 'AND e.i = ' + chr(39) + 's' + chr(39), 'f.s0')}) AS s1, least({stay('f.s2')}, {keep(live + ' AND e.i = ' + chr(39) + 'u' + chr(39), 'f.su')}, {role('f.su', 'user')}) AS s2, least({stay('f.s3')}, {keep(live + ' AND e.i = ' + chr(39) + 'a' + chr(39), 'f.s2')}, {role('f.s2', 'assistant')}) AS s3 FROM (SELECT *, {to_user} AS su FROM {closed} f) f JOIN (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t FROM e) e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.n = f.n + 1"
    none = "{'c': 1000000000000, 'a': '', 't': ''}"
    zero = "{'c': 0, 'a': '', 't': ''}"
    kind = "::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    run = f"f AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, {zero}{kind} AS s0, {none}{kind} AS s1, {none}{kind} AS s2, {none}{kind} AS s3 FROM conversations UNION ALL {step})"
    counts = "g AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id)"
    ends = f"z AS (SELECT x.conv_id, least(s0, s3) AS s, g.* EXCLUDE (conv_id) FROM {closed} x LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id WHERE x.n = coalesce(g.rows, 0))"
    return f"WITH RECURSIVE {crc}, {keys}, d0 AS ({rows}), {faults}, {run}, {counts}, {ends} SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, s.c AS cost, s.a AS audit, sha256(substr(s.t, 1, greatest(length(s.t) - 1, 0))) AS repaired_sha256 FROM z"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose rows it can express; the others have models, random draws or hashes in their
    rows and are tested against brute force, exact round trips or held-out rows."""
    return {"op3_warc": _WARC, "op11_codes": _codes_sql(), "op13_turns": _turns_sql()}
