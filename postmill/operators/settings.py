"""Stored settings and search profiles: rows (owner, key, value as JSON text), read with the service's defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the service.
DEFAULTS = {
    "notificationsEnabled": True,
    "emailEnabled": False,
    "emailAddress": "",
    "serverUrl": "http://localhost:3456",
    "llmEnabled": False,
    "llmWeight": 0.3,
}
PLATFORMS, WEIGHTS, THRESHOLD = ("linkedin", "indeed", "glassdoor"), {"tfidf": 0.6, "skills": 0.4}, 50.0
_SETTINGS = "notificationsEnabled boolean, emailEnabled boolean, emailAddress string, serverUrl string, platforms map<string,boolean>, weights struct<tfidf:double,skills:double>, llmEnabled boolean, llmWeight double"
PROFILE = "id string, keywords string, location string, workType string, interval long, enabled boolean, lastRun string, resultCount long"


def read_settings(stored: DataFrame) -> DataFrame:
    """A row for each owner: the settings, ``threshold``, ``resume_text`` and ``scan_status`` (profile to its status
    as JSON). A field that is missing, null or no JSON has its default; a map given replaces the default map
    whole. Owners come from ``stored`` with any key; a key's largest value counts."""
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value"))).alias(key)
    kept = stored.groupBy("owner").agg(*map(value, ("settings", "threshold", "resumeText", "scanStatus")))
    s = F.from_json("settings", _SETTINGS)
    kept = kept.withColumn("s", s)
    plain = [F.coalesce(f"s.{name}", F.lit(default)).alias(name) for name, default in DEFAULTS.items()]
    platforms = F.create_map(*[F.lit(x) for p in PLATFORMS for x in (p, True)])
    weights = F.struct(*[F.lit(w).alias(n) for n, w in WEIGHTS.items()])
    text = F.from_json(F.concat(F.lit('{"t":'), "resumeText", F.lit("}")), "t string")["t"]
    return kept.select(
        "owner",
        *plain,
        F.coalesce("s.platforms", platforms).alias("platforms"),
        F.coalesce("s.weights", weights).alias("weights"),
        F.coalesce(F.expr("try_cast(threshold AS double)"), F.lit(THRESHOLD)).alias("threshold"),
        F.coalesce(text, F.lit("")).alias("resume_text"),
        F.coalesce(F.from_json("scanStatus", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("scan_status"),
    )


def read_profiles(stored: DataFrame) -> DataFrame:
    """A row for each search profile of each owner, in the stored order (``place``)."""
    rows = stored.filter("key = 'searchProfiles'").select("owner", F.posexplode(F.from_json("value", f"array<struct<{PROFILE.replace(' ', ':').replace(',:', ',')}>>")).alias("place", "p"))
    return rows.select("owner", "place", "p.*")
