"""Scoring postings against profile texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dialect import r2
from ..functions.vocab import SKILLS
from .tfidf import pair_score

# Weights of the two scores and thresholds of the library and of the running service.
WEIGHTS = (0.6, 0.4)
LIBRARY_THRESHOLD, SERVICE_THRESHOLD = 70.0, 50.0
JOB_COLUMNS = ("title", "company", "location", "description", "url", "platform")


@dataclass(frozen=True)
class Profile:
    """What scoring needs of a profile text, worked out once: it enters plans as literals."""

    tokens: list[str]
    skills: list[str]
    text: str = ""

    @classmethod
    def of(cls, spark: SparkSession, text: str, dictionary: list[str] | None = None) -> Profile:
        row = spark.range(1).select(T.tokens(F.lit(text)).alias("t"), T.skills(F.lit(text), dictionary).alias("s")).first()
        return cls(list(row["t"]), list(row["s"]), text)


def _strings(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def skill_ratio(profile: Column, job: Column) -> Column:
    """Share of the job's skills, repeated ones counted, that the profile has; 0 if it has none."""
    low = F.transform(profile, F.lower)
    return F.when(F.size(job) == 0, 0.0).otherwise(F.size(F.filter(job, lambda s: F.array_contains(low, F.lower(s)))) / F.size(job))


def final_score(tfidf: Column, skill: Column, weights: tuple[float, float] = WEIGHTS) -> Column:
    return r2(tfidf * weights[0] + skill * weights[1])


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row. A filter on what is made of them would otherwise
    be pushed below with the whole expression, which then runs for the filter and again for the output."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")).select(*df.columns, "_once.*")


def with_features(jobs: DataFrame, dictionary: list[str] | None = None) -> DataFrame:
    """Adds ``job_tokens`` and ``job_skills``."""
    text = T.job_text(*(F.col(c) for c in ("title", "company", "description", "location")))
    out = _once(jobs, _text=F.lower(text))
    return _once(out, job_tokens=T.tokens(F.col("_text")), job_skills=T.skills(F.col("_text"), dictionary)).drop("_text")


def score_jobs(jobs: DataFrame, profile: Profile, weights: tuple[float, float] = WEIGHTS, dictionary: list[str] | None = None, poisoned: bool = False) -> DataFrame:
    """Adds score, tfidf_score, skill_score, matched_skills, missing_skills and both skill counts to jobs.

    One pass without a shuffle. ``poisoned``: the token ``constructor`` on either side makes the score
    null, as in a well-known defect of counting in plain objects."""
    mine, known = _strings(profile.skills), _strings(profile.tokens)
    out = with_features(jobs, dictionary)
    skill = F.floor(skill_ratio(mine, F.col("job_skills")) * 100 * 100 + 0.5) / 100
    tfidf = pair_score(known, F.col("job_tokens")) if profile.tokens else F.lit(0.0)
    hit = F.lit(False)
    if poisoned:
        hit = (F.array_contains("job_tokens", "constructor") | F.lit("constructor" in profile.tokens)) & (F.size("job_tokens") > 0)
    out = _once(out, tfidf_score=tfidf, skill_score=skill, _hit=hit)
    score = F.when(~F.col("_hit"), final_score(F.col("tfidf_score"), F.col("skill_score"), weights))
    return out.withColumns(
        {
            "score": score,
            "matched_skills": F.array_intersect("job_skills", mine),
            "missing_skills": F.array_except("job_skills", mine),
            "profile_skill_count": F.lit(len(profile.skills)).cast("long"),
            "job_skill_count": F.size("job_skills").cast("long"),
        }
    ).drop("job_tokens", "job_skills", "_hit")


def above(score: Column, threshold: float) -> Column:
    """Threshold test: inclusive; NaN and null never pass."""
    return score.isNotNull() & ~F.isnan(score) & (score >= threshold)


def match_jobs(jobs: DataFrame, profile: Profile, threshold: float = SERVICE_THRESHOLD, weights: tuple[float, float] = WEIGHTS, order: str = "ord", dictionary: list[str] | None = None) -> DataFrame:
    """Jobs at or above the threshold, best first; ties keep arrival order (column ``order``)."""
    scored = score_jobs(jobs, profile, weights, dictionary)
    return scored.filter(above(F.col("score"), threshold)).orderBy(F.desc("score"), F.asc(order))


def match_many(jobs: DataFrame, profiles: DataFrame, k: int, job_key: str = "job_id", profile_key: str = "profile_id", weights: tuple[float, float] = WEIGHTS, dictionary: list[str] | None = None) -> DataFrame:
    """Best ``k`` jobs of each of many profiles (profile_key, text): rows (profile_key, job_key, score, rank),
    ties to the smaller job_key; pairs that share neither token nor skill score 0 and are not reported.
    Job keys are unique.

    A pair's score depends on the job's set of skills and on whether they share a token, so of all jobs of
    one set that hold one token only the ``k`` of smallest key can be among the best. These are kept before
    rows move (a window limit per task), and profiles meet them by token: no hot token or skill makes
    pairs of all jobs with all profiles. The first weight must not be less than the second."""
    if weights[0] < weights[1]:
        raise ValueError("a shared token must weigh at least as much as all skills")
    job = with_features(jobs, dictionary).select(job_key, "job_tokens", "job_skills")
    mine = profiles.select(profile_key, T.tokens(F.col("text")).alias("tokens"), T.skills(F.col("text"), dictionary).alias("skills"))
    ratio = skill_ratio(F.col("skills"), F.col("job_skills"))
    score = lambda tfidf: final_score(F.lit(tfidf), F.floor(ratio * 100 * 100 + 0.5) / 100, weights).alias("score")
    first = lambda rows, keys, n: rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(job_key))).filter(F.col("n") <= n).drop("n")
    by_token = first(job.select(job_key, "job_skills", F.explode_outer("job_tokens").alias("x")), ["x", "job_skills"], k)
    on_token = mine.select(profile_key, "skills", F.explode_outer("tokens").alias("x")).join(by_token, "x").select(profile_key, job_key, score(100.0))
    # Without a shared token no pair beats those with one. If fewer than ``k`` jobs share a token with the
    # profile, all of them are known here, and 2 k of each set of skills hold k others.
    text = T.job_text(*(F.col(c) for c in ("title", "company", "description", "location")))
    by_skills = first(_once(jobs, job_skills=T.skills(text, dictionary)).select(job_key, "job_skills").filter(F.size("job_skills") > 0), ["job_skills"], 2 * k)
    sets = by_skills.select("job_skills").distinct().select("job_skills", F.explode("job_skills").alias("s"))
    near = mine.select(profile_key, "skills", F.explode_outer("skills").alias("s")).join(sets, "s").select(profile_key, "skills", "job_skills").distinct()
    on_skill = near.join(by_skills, "job_skills").select(profile_key, job_key, score(0.0))
    pairs = on_token.union(on_skill).groupBy(profile_key, job_key).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(profile_key).orderBy(F.desc("score"), F.asc(job_key)))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def shared_token_counts(docs: DataFrame, profiles: DataFrame, key: str, profile_key: str, tokens: str = "tokens") -> DataFrame:
    """Rows (profile_key, n): how many documents share a token with each profile (those with none are left out). Keys
    of documents are whole numbers; a repeated key counts once, a null one not at all.

    Documents with a token are bits: one bitmap for each token that profiles hold and each 32768 keys, built where the
    documents are read. A profile's bitmaps are joined by OR, so nothing is made, moved or grouped by pair."""
    asked = profiles.select(profile_key, F.explode(F.array_distinct(tokens)).alias("x"))
    held = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.explode_outer(tokens).alias("x"))
    held = held.join(asked.select("x").distinct(), "x", "left_semi")
    maps = held.groupBy("x", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    ored = maps.join(asked, "x").groupBy(profile_key, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return ored.groupBy(profile_key).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def default_dictionary() -> list[str]:
    return list(SKILLS)
