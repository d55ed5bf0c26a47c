"""Intake of dropped archives: each is audited once and its report stored once, whatever is restarted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewarden.operators import findings as fs
from tracewarden.operators import registry
from tracewarden.operators.corpus import skills
from tracewarden.plans import audit
from tracewarden.session import staged
from tracewarden.sources import skilltree


def own_submissions(files: DataFrame) -> DataFrame:
    """Each skill as its own submission: its id is the archive's name without the ending."""
    name = F.element_at(F.split("skill_id", "/"), -1)
    return skills(files).select(name.alias("id"), F.col("skill_id").alias("skillId"), F.lit("AUDITING").alias("status"))


def audit_arrivals(spark: SparkSession, drop: str, where: str, checkpoint: str, submissions: DataFrame | None = None, now: Column | None = None) -> StreamingQuery:
    """Audits the archives that have been dropped into a folder since the last call, stores what is found, and returns the finished query.

    The log of arrivals lies beside the query's checkpoint.  A batch is stored under its number, in one commit, so one
    that is run again after a failure stores nothing twice.  An archive that can't be read makes its own submission REJECTED.
    ``submissions`` (id, skillId, status) says whose the archives are; without it each is its own submission.
    """
    skilltree.register(spark)
    files = spark.readStream.format("skilltree").option("arrivals", f"{checkpoint}/arrivals").load(drop)
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def batch(rows: DataFrame, n: int) -> None:
        rows = staged(rows)
        bad = skilltree.failed(rows)
        good = rows.where("error is null")
        found = staged(audit.findings(good))
        known = own_submissions(rows) if submissions is None else submissions.join(skills(rows).select(F.col("skill_id").alias("skillId")), "skillId", "left_semi")
        if submissions is None:
            registry.append(known, where, "submissions", f"{name}-{n}-submissions")
        registry.store(where, known, fs.reports(skills(good), found), found, bad, now, f"{name}-{n}")
        for df in (rows, found):
            df.unpersist()

    q = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
