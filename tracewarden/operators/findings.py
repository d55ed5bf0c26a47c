"""Findings and what is made of them: de-duplication, scores, levels, summaries, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.rules import DETECTORS, WEIGHTS

#: Columns of every table of findings.
COLUMNS = ["skill_id", "detector", "severity", "rule_id", "description", "file_path", "line_number", "match"]


def finding(detector: str, severity: str, rule_id: str | Column, description: str | Column, line_number: Column, match: Column | str) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(detector).alias("detector"), F.lit(severity).alias("severity"), col(rule_id).alias("rule_id"), col(description).alias("description"), line_number.cast("int").alias("line_number"), col(match).alias("match"))


def no_findings() -> Column:
    return F.array().cast("array<struct<detector:string,severity:string,rule_id:string,description:string,line_number:int,match:string>>")


def exploded(rows: DataFrame, found: Column) -> DataFrame:
    """Findings of an array of (possibly null) finding structs beside skill_id and file_path."""
    return rows.select("skill_id", "file_path", F.explode(F.array_compact(found)).alias("f")).select("skill_id", "f.*", "file_path").select(*COLUMNS)


def first_of_each(findings: DataFrame, order: Column) -> DataFrame:
    """One finding for each (skill, file, line, rule): the first in ``order``."""
    w = Window.partitionBy("skill_id", "file_path", "line_number", "rule_id").orderBy(order)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def weight(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), severity), F.lit(0))


def risk_level(score: Column) -> Column:
    return F.when(score == 0, "none").when(score <= 10, "low").when(score <= 30, "medium").when(score <= 60, "high").otherwise("critical")


def _count(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity)


def _verdict() -> list[Column]:
    return [(F.col("total_findings") == 0).alias("passed"), F.col("risk_score"), risk_level(F.col("risk_score")).alias("risk_level"), F.col("total_findings")]


def reports(skills: DataFrame, findings: DataFrame) -> DataFrame:
    """(skill_id, passed, risk_score, risk_level, total_findings) for each skill."""
    sums = findings.groupBy("skill_id").agg(F.sum(weight(F.col("severity"))).alias("risk_score"), F.count(F.lit(1)).alias("total_findings"))
    out = skills.select("skill_id").distinct().join(sums, "skill_id", "left").fillna(0, ["risk_score", "total_findings"])
    return out.select("skill_id", *_verdict())


def summary(skills: DataFrame, findings: DataFrame) -> DataFrame:
    """(skill_id, detector, passed, findings, critical, high, medium, low): all detectors, ``runner`` only where it found something."""
    counts = findings.groupBy("skill_id", "detector").agg(F.count(F.lit(1)).alias("findings"), *(_count(s).alias(s) for s in WEIGHTS))
    every = skills.select("skill_id").distinct().withColumn("detector", F.explode(F.array(*map(F.lit, DETECTORS))))
    every = every.unionByName(counts.where("detector = 'runner'").select("skill_id", "detector"))
    out = every.join(counts, ["skill_id", "detector"], "left").fillna(0)
    return out.select("skill_id", "detector", (F.col("findings") == 0).alias("passed"), "findings", *WEIGHTS)


def severity_pivot(findings: DataFrame) -> DataFrame:
    """(skill_id, critical, high, medium, low); low is what the other three leave."""
    n = findings.groupBy("skill_id").agg(*(_count(s).alias(s) for s in ("critical", "high", "medium")), F.count(F.lit(1)).alias("n"))
    return n.select("skill_id", "critical", "high", "medium", (F.col("n") - F.col("critical") - F.col("high") - F.col("medium")).alias("low"))


def rollup(findings: DataFrame) -> DataFrame:
    """(level, detector, severity, findings, skills, weight): totals by detector and severity, by detector, and of all; what a level doesn't part by is null."""
    level = F.element_at(F.create_map(F.lit(0), F.lit("severity"), F.lit(1), F.lit("detector"), F.lit(3), F.lit("all")), F.grouping_id().cast("int"))
    sums = [F.count(F.lit(1)).alias("findings"), F.count_distinct("skill_id").alias("skills"), F.coalesce(F.sum(weight(F.col("severity"))), F.lit(0)).cast("long").alias("weight")]
    return findings.rollup("detector", "severity").agg(level.alias("level"), *sums).select("level", "detector", "severity", "findings", "skills", "weight")


def documents(skills: DataFrame, findings: DataFrame) -> DataFrame:
    """(skill_id, report): the JSON document of each skill's audit, results in canonical order.

    ``findings`` may be a whole audit, so they are read once: lists, counts and weights come from one grouping.
    """
    line = F.struct("detector", "severity", "rule_id", "description", "file_path", "line_number", "match")
    lists = F.array_sort(F.collect_list(F.struct("file_path", "line_number", "rule_id", line.alias("f")))).alias("x")
    per = findings.groupBy("skill_id", "detector").agg(lists, F.count(F.lit(1)).alias("n"), *(_count(s).alias(s) for s in WEIGHTS), F.sum(weight(F.col("severity"))).alias("weight"))
    entry = F.struct("detector", F.col("n").alias("findings"), F.struct(*WEIGHTS).alias("by_severity"), F.transform("x", lambda x: x["f"]).alias("list"))
    shown = F.when(F.col("detector").isin([*DETECTORS, "runner"]), entry)
    per = per.groupBy("skill_id").agg(F.collect_list(shown).alias("d"), F.sum("weight").alias("risk_score"), F.sum("n").alias("total_findings"))
    found = F.coalesce("d", F.array().cast(per.schema["d"].dataType))
    clean = F.struct(*(F.lit(0).cast("long").alias(s) for s in WEIGHTS))
    rest = F.array_except(F.array(*map(F.lit, DETECTORS)), F.transform(found, lambda x: x["detector"]))
    rest = F.transform(rest, lambda x: F.struct(x.alias("detector"), F.lit(0).cast("long").alias("findings"), clean.alias("by_severity"), F.array().cast(per.schema["d"].dataType.elementType["list"].dataType).alias("list")))
    out = skills.select("skill_id").where("skill_id is not null").distinct().join(per, "skill_id", "left").fillna(0, ["risk_score", "total_findings"])
    out = out.select("skill_id", *_verdict(), F.array_sort(F.concat(found, rest)).alias("d"))
    passed = lambda x: (x["findings"] == 0).alias("passed")
    summaries = F.transform("d", lambda x: F.struct(x["detector"], F.struct(passed(x), x["findings"].alias("findings"), x["by_severity"].alias("by_severity"))))
    results = F.transform("d", lambda x: F.struct(x["detector"].alias("detector"), passed(x), x["list"].alias("findings")))
    parts = F.struct(F.col("skill_id").alias("skill_path"), "passed", "risk_score", "risk_level", "total_findings", F.map_from_entries(summaries).alias("summary"), results.alias("results"))
    return out.select("skill_id", F.to_json(parts).alias("report"))
