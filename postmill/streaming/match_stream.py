"""The match loop over micro-batches: gate, filter, score, anti-join with the capped history, commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import batch as B
from ..operators import matcher as M
from ..operators import rescoring as R


@dataclass(frozen=True)
class Settings:
    """Settings with the service's defaults; a map given replaces the default map whole."""

    platforms: dict[str, bool] = field(default_factory=lambda: {"linkedin": True, "indeed": True, "glassdoor": True})
    weights: tuple[float, float] = M.WEIGHTS
    threshold: float = M.SERVICE_THRESHOLD
    llm_weight: float = 0.3
    cap: int = B.HISTORY_CAP

    @classmethod
    def of(cls, stored: dict) -> Settings:
        """Settings from stored ones; what is missing or null has its default."""
        known = {k: v for k, v in stored.items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(**known | ({"weights": tuple(known["weights"])} if "weights" in known else {}))


class MatchLoop:
    """Matches of each batch in ``folder``/matches=N, all of them, and the capped history in versions beside, one
    for each batch that had new matches; the last two stay. A batch that is run again starts from the
    version before it and writes its own anew, so a restart changes nothing. Sinks get all new matches
    of the batch that reach the threshold, however many the history keeps."""

    def __init__(self, spark: SparkSession, profile: M.Profile, folder: str, settings: Settings | None = None, mode: str = "interactive", scorer: Callable[[str], str] | None = None, sinks: list[Callable[[DataFrame, int], None]] | None = None, dictionary: list[str] | None = None, model: str | None = None):
        self.spark, self.profile, self.folder, self.mode = spark, profile, folder.rstrip("/"), mode
        self.settings, self.scorer, self.sinks, self.dictionary, self.model = settings or Settings(), scorer, sinks or [], dictionary, model

    def _versions(self) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(place):
            return []
        names = [s.getPath() for s in system.listStatus(place)]
        done = [p for p in names if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version="))

    def history(self, before: int | None = None) -> DataFrame | None:
        known = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.folder}/version={known[-1]}") if known else None

    def matches(self) -> DataFrame:
        """All matches of all batches so far, with their ``batch_id``."""
        return self.spark.read.parquet(f"{self.folder}/matches=*")

    def new_matches(self, jobs: DataFrame, history: DataFrame | None) -> DataFrame:
        """What a batch adds. Scans skip the platform gate and keep every score; the threshold then only
        decides what is notified."""
        s = self.settings
        if self.mode == "interactive":
            jobs = B.platform_gate(jobs, s.platforms)
        threshold = s.threshold if self.mode == "interactive" else 0.0
        found = M.match_jobs(B.content_filter(jobs), self.profile, threshold, s.weights, dictionary=self.dictionary)
        return found if history is None else B.select_new(found, history)

    def run_batch(self, jobs: DataFrame, batch_id: int) -> DataFrame | None:
        """Processes a batch; gives its new matches, or none."""
        if not self.profile.tokens and not self.profile.skills:
            return None
        history = self.history(batch_id)
        new = self.new_matches(jobs, history)
        if self.scorer is not None:
            best = B.rank_matches(new.orderBy(F.desc("score"), "ord").limit(R.BATCH))
            asked = best.select("rank", R.prompt(F.lit(self.profile.text), F.col("title"), F.col("company"), F.col("location"), F.col("description")).alias("prompt"))
            said = R.ask(asked, self.scorer).select("rank", R.parse_reply(F.col("reply")).alias("r"))
            replies = said.select("rank", F.col("r.score").alias("model_score"), "r.rationale", "r.key_strengths", "r.gaps", F.when(F.col("r").isNotNull(), F.lit(self.model)).alias("model"))
            new = B.blend(new, replies, self.settings.llm_weight)
        new = new.withColumns({"batch_id": F.lit(batch_id), "matched_at": F.current_timestamp(), "from_scheduled_scan": F.lit(self.mode == "scan")})
        path = f"{self.folder}/matches={batch_id}"
        new.write.mode("overwrite").parquet(path)
        added = self.spark.read.schema(new.schema).parquet(path)
        if added.isEmpty():
            return None
        # Only the best of the batch can enter the history, so their order needs no more than the cap.
        top = added.orderBy(F.desc("score"), "ord").limit(self.settings.cap)
        top = top.withColumn("place", F.row_number().over(_by_score()))
        capped = B.cap_history(top, history if history is not None else top.limit(0), "place", self.settings.cap)
        capped.drop("place").withColumnRenamed("position", "place").write.mode("overwrite").parquet(f"{self.folder}/version={batch_id}")
        self._forget([v for v in self._versions() if v < batch_id][:-1])
        notified = added.filter(M.above(F.col("score"), self.settings.threshold))
        for sink in self.sinks:
            sink(notified, batch_id)
        return added

    def _forget(self, versions: list[int]) -> None:
        for v in versions:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version={v}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def start(self, jobs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs over a stream of jobs with the columns of a posting and ``ord``."""
        return jobs.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda df, i: self.run_batch(df, i) and None).start()


def _by_score():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), F.asc("ord"))
