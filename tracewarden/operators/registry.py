"""The registry of skills: its tables, what is written to them, and the queries that read them.

skills(id, name, description, author, repositoryUrl, submittedAt); submissions(id, skillId, status,
paymentStatus, createdAt, updatedAt); audit_reports(id, submissionId, skillId, riskScore, riskLevel, passed,
completedAt); findings(id, reportId, detector, severity, ruleId, description, filePath, lineNumber, match).
Names of tables, fields and states, and texts of complaints, are fixed values.  submission_status(id, status, updatedAt) has what
became of submissions later; ``load`` gives submissions with their latest status.

A registry is a folder or a database (``where`` is a path or a JDBC URL).  In a folder every write is a commit: its files go to folders of
their own, and one small file in ``commits/``, moved there in one step under the commit's key, makes all of them visible at
once.  A commit that fails before that leaves nothing to be seen, and one whose key is there already does nothing.  In a
database tables are written one by one, reports after their findings, and rows whose ids are there already are left out, so that a
write that failed is completed by doing it again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.functions.text import strip
from tracewarden.functions.url import is_http, url_fails

SCHEMAS = {
    "skills": "id string, name string, description string, author string, repositoryUrl string, submittedAt timestamp",
    "submissions": "id string, skillId string, status string, paymentStatus string, createdAt timestamp, updatedAt timestamp",
    "submission_status": "id string, status string, updatedAt timestamp",
    "audit_reports": "id string, submissionId string, skillId string, riskScore int, riskLevel string, passed boolean, completedAt timestamp",
    "findings": "id string, reportId string, detector string, severity string, ruleId string, description string, filePath string, lineNumber int, match string",
}
TABLES = tuple(SCHEMAS)
#: States in the order in which they follow one another.
STATES = ("PENDING", "AUDITING", "COMPLETE", "REJECTED")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
RENAMED = {"rule_id": "ruleId", "file_path": "filePath", "line_number": "lineNumber"}


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike(UUID), F.lit(False))


def validated(rows: DataFrame) -> DataFrame:
    """Adds ``error``, the first complaint about a submission (name, description, author, repositoryUrl), null if it is accepted."""
    n = lambda c: F.length(strip(F.coalesce(F.col(c), F.lit(""))))
    url = F.coalesce("repositoryUrl", F.lit(""))
    error = (
        F.when(n("name") < 2, "name must be at least 2 characters")
        .when(n("name") > 100, "name must be under 100 characters")
        .when(n("description") < 10, "description must be at least 10 characters")
        .when(n("author") < 2, "author must be at least 2 characters")
        .when(url == "", "repositoryUrl is required")
        .when(url_fails(url), "repositoryUrl must be a valid URL")
        .when(~is_http(url), "repositoryUrl must be a valid http or https URL")
    )
    return rows.withColumn("error", error)


def intake(rows: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(skills, submissions) to append for accepted rows: trimmed fields, PENDING and UNPAID.

    ids are made once: stage ``rows`` with ids of its own (skill_id, submission_id) if both tables are written separately.
    """
    at = now if now is not None else F.current_timestamp()
    ok = validated(rows).where("error is null")
    skills = ok.select(F.col("skill_id").alias("id"), *(strip(F.col(c)).alias(c) for c in ("name", "description", "author", "repositoryUrl")), at.alias("submittedAt"))
    submissions = ok.select(F.col("submission_id").alias("id"), F.col("skill_id").alias("skillId"), F.lit("PENDING").alias("status"), F.lit("UNPAID").alias("paymentStatus"), at.alias("createdAt"), at.alias("updatedAt"))
    return skills, submissions


def report_rows(reports: DataFrame, submissions: DataFrame, now: Column | None = None) -> DataFrame:
    """audit_reports to append: the audit's reports of submitted skills, one for each submission; id is the submission's."""
    s = submissions.select(F.col("id").alias("submissionId"), "skillId")
    r = reports.select(F.col("skill_id").alias("skillId"), F.col("risk_score").cast("int").alias("riskScore"), F.col("risk_level").alias("riskLevel"), "passed")
    at = now if now is not None else F.current_timestamp()
    return s.join(r, "skillId").select(F.col("submissionId").alias("id"), "submissionId", "skillId", "riskScore", "riskLevel", "passed", at.alias("completedAt"))


def finding_rows(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """findings to append, in the registry's names."""
    r = reports.select(F.col("id").alias("reportId"), F.col("skillId").alias("skill_id"))
    out = findings.join(r, "skill_id").withColumnsRenamed(RENAMED)
    columns = ["reportId", "detector", "severity", "ruleId", "description", "filePath", "lineNumber", "match"]
    # the same finding has the same id whenever it is made; equal findings of a report are told apart by number
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0)))
    x = F.md5(F.to_json(F.struct(*columns, nth.alias("nth"))))
    id_ = F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.substring(x, 13, 4), F.substring(x, 17, 4), F.substring(x, 21, 12))
    return out.select(id_.alias("id"), *columns)


def settled(submissions: DataFrame, reports: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """submissions with the status that their audit gives: COMPLETE or REJECTED; those in ``failed`` (id) are REJECTED without a report."""
    out = submissions.join(reports.select(F.col("submissionId").alias("id"), "passed"), "id", "left")
    status = F.when(F.col("passed"), "COMPLETE").when(~F.col("passed"), "REJECTED").otherwise(F.col("status"))
    if failed is not None:
        out = out.join(failed.select("id").distinct().withColumn("_f", F.lit(True)), "id", "left")
        status = F.when(F.col("_f"), "REJECTED").otherwise(status)
    return out.withColumn("status", status).select(*submissions.columns)


def _database(where: str) -> bool:
    return where.startswith("jdbc:")


def _shaped(rows: DataFrame, table: str) -> DataFrame:
    """Rows with the columns of a table, and their types; those that ``rows`` hasn't got are null."""
    want = rows.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


class _Folder:
    """Files of a registry's folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where, self.jvm = spark, where.rstrip("/"), spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, *below: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.where, *below]))

    def has(self, *below: str) -> bool:
        return self.fs.exists(self.path(*below))

    def publish(self, key: str, folders: dict[str, str]) -> bool:
        """Writes the file of a commit under its key in one step; false if there is one."""
        draft = self.path("drafts", uuid.uuid4().hex)
        with_ = self.fs.create(draft)
        with_.write(bytearray(json.dumps({"key": key, "folders": folders}).encode()))
        with_.close()
        self.fs.mkdirs(self.path("commits"))
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            self.context.rename(draft, self.path("commits", f"{key}.json"), options)
        except Exception:
            if self.has("commits", f"{key}.json"):
                return False
            raise
        return True

    def folders(self, table: str) -> list[str]:
        """The folders that commits name for a table."""
        if not self.has("commits"):
            return []
        told = self.spark.read.schema("key string, folders map<string, string>").json(f"{self.where}/commits")
        return sorted(r["f"] for r in told.select(F.get(F.array(F.col("folders")[table]), F.lit(0)).alias("f")).where("f is not null").collect())


def commit(spark: SparkSession, where: str, tables: dict[str, DataFrame], key: str | None = None, **options: str) -> bool:
    """Adds rows to several tables, in a folder all of them or none; false if a commit with that key has been made."""
    if _database(where):
        for table, rows in tables.items():
            _shaped(rows, table).write.format("jdbc").mode("append").options(**options, url=where, dbtable=table).save()
        return True
    at, key = _Folder(spark, where), key or uuid.uuid4().hex
    if at.has("commits", f"{key}.json"):
        return False
    folders = {table: f"{table}/{key}-{uuid.uuid4().hex}" for table in tables}
    for table, rows in tables.items():
        _shaped(rows, table).write.parquet(f"{at.where}/{folders[table]}")
    return at.publish(key, folders)


def append(rows: DataFrame, where: str, table: str, key: str | None = None, **options: str) -> bool:
    """Adds rows to one table of the registry (user, password, driver as options of a database)."""
    return commit(rows.sparkSession, where, {table: rows}, key, **options)


def create(spark: SparkSession, where: str, **options: str) -> None:
    """Makes the tables that a database hasn't got yet; a folder needs none."""
    if _database(where):
        for table, schema in SCHEMAS.items():
            spark.createDataFrame([], schema).write.format("jdbc").mode("ignore").options(**options, url=where, dbtable=table).save()


def _stored(spark: SparkSession, where: str, table: str, **options: str) -> DataFrame:
    if _database(where):
        return spark.read.format("jdbc").options(**options, url=where, dbtable=table).load()
    at = _Folder(spark, where)
    folders = at.folders(table)
    return spark.read.schema(SCHEMAS[table]).parquet(*(f"{at.where}/{f}" for f in folders)) if folders else spark.createDataFrame([], SCHEMAS[table])


def load(spark: SparkSession, where: str, table: str, **options: str) -> DataFrame:
    """A table of the registry; of a database, ``partitionColumn``, bounds and ``numPartitions`` as options split the reading."""
    rows = _stored(spark, where, table, **options)
    if table != "submissions":
        return rows
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    plain = {k: v for k, v in options.items() if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    later = _stored(spark, where, "submission_status", **plain).groupBy("id").agg(F.max(F.struct(rank.alias("rank"), "updatedAt", "status")).alias("s"))
    rows = rows.join(later.select(F.col("id").alias("_id"), "s"), F.col("id") == F.col("_id"), "left")
    return rows.select("id", "skillId", F.coalesce("s.status", "status").alias("status"), "paymentStatus", "createdAt", F.coalesce("s.updatedAt", "updatedAt").alias("updatedAt"))


def store(where: str, submissions: DataFrame, reports: DataFrame, findings: DataFrame, failed: DataFrame | None = None, now: Column | None = None, key: str | None = None, **options: str) -> DataFrame:
    """Stores an audit's reports, their findings and what they make of their submissions, and returns the submissions with that status.

    A submission is one skill's; skills in ``failed`` (skill_id, error) are REJECTED without a report, and hold up no others.  A
    submission that has a report keeps it: storing an audit twice stores it once.  ``key`` names the write, such as a batch of a
    stream: in a folder, a second one with the same key does nothing.
    """
    spark, bad = submissions.sparkSession, None
    create(spark, where, **options)
    if failed is not None:
        bad = submissions.join(failed.select(F.col("skill_id").alias("skillId")).distinct(), "skillId").select("id")
        reports = reports.join(failed.select("skill_id").distinct(), "skill_id", "left_anti")
    made = report_rows(reports, submissions, now)
    done = settled(submissions, made, bad)
    new = lambda rows, table, id_="id": rows.join(_stored(spark, where, table, **options).select(F.col("id").cast("string").alias(id_)), id_, "left_anti")
    ended = done.where(F.col("status").isin("COMPLETE", "REJECTED")).select("id", "status", (now if now is not None else F.current_timestamp()).alias("updatedAt"))
    fresh = new(made, "audit_reports")
    # of a database, findings that a failed write has left are completed
    found = new(finding_rows(findings, fresh), "findings") if _database(where) else finding_rows(findings, fresh)
    commit(spark, where, {"findings": found, "audit_reports": fresh, "submission_status": new(ended, "submission_status")}, key, **options)
    return done


def current_status(events: DataFrame) -> DataFrame:
    """(submission_id, status): the latest of each submission's status events (submission_id, status, ts, seq)."""
    return events.groupBy("submission_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key; the larger id on a tie."""
    best = F.max_by(F.struct(*rows.columns), F.struct(at, "id")).alias("r")
    return rows.groupBy(key).agg(best).select("r.*")


def directory(skills: DataFrame, reports: DataFrame) -> DataFrame:
    """All skills, newest submission first, each with its latest report, if any."""
    r = latest(reports, "skillId", "completedAt").select("skillId", "riskScore", "riskLevel", "passed", "completedAt")
    return skills.join(r, skills["id"] == r["skillId"], "left").drop("skillId").orderBy(F.desc("submittedAt"), "id")


def with_findings(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """reports with a column ``findings``, the list of theirs."""
    f = findings.groupBy("reportId").agg(F.array_sort(F.collect_list(F.struct("filePath", "lineNumber", "ruleId", "detector", "severity", "description", "match"))).alias("findings"))
    return reports.join(f, reports["id"] == f["reportId"], "left").drop("reportId")


def detail(skills: DataFrame, reports: DataFrame, findings: DataFrame, submissions: DataFrame, id_: str | int | None = None) -> DataFrame:
    """Skills (or one) with their latest report and its findings, and their latest submission's status."""
    if id_ is not None:
        skills, reports, submissions = skills.where(F.col("id") == id_), reports.where(F.col("skillId") == id_), submissions.where(F.col("skillId") == id_)
    r = with_findings(latest(reports, "skillId", "completedAt"), findings)
    r = r.select(F.col("skillId").alias("_r"), F.struct("id", "riskScore", "riskLevel", "passed", "completedAt", "findings").alias("report"))
    s = latest(submissions, "skillId", "createdAt").select(F.col("skillId").alias("_s"), "status", "createdAt")
    return skills.join(r, skills["id"] == r["_r"], "left").join(s, skills["id"] == s["_s"], "left").drop("_r", "_s")


def badges(skills: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, label, color, svg): verified in green; a risk level, or unknown without a report, in red."""
    r = latest(reports, "skillId", "completedAt").select("skillId", "riskLevel", "passed")
    out = skills.join(r, skills["id"] == r["skillId"], "left")
    label = F.when(F.col("passed"), "verified").otherwise(F.coalesce("riskLevel", F.lit("unknown")))
    color = F.when(F.col("passed"), "#22c55e").otherwise("#ef4444")
    svg = F.format_string("<svg xmlns='http://www.w3.org/2000/svg' width='120' height='20'><rect width='120' height='20' fill='%s'/><text x='60' y='14' text-anchor='middle' fill='white'>%s</text></svg>", "color", "label")
    return out.select("id", label.alias("label"), color.alias("color")).withColumn("svg", svg)


#: Short names of detectors; others are shown by their own.
LABELS = {"credential_detector": "cred", "obfuscation_detector": "obfs", "permission_scanner": "perm", "typosquat_checker": "typo", "dependency_scanner": "deps", "network_destination_analyzer": "net", "exfiltration_detector": "exfil"}


def detector_label(detector: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), detector), detector)


def risk_badge(level: Column, passed: Column) -> Column:
    """(text, style): VERIFIED, or the level in capitals; a level that isn't known is styled as low."""
    style = F.when(passed, "verified").when(level.isin("critical", "high", "medium"), level).otherwise("low")
    return F.struct(F.when(passed, "VERIFIED").otherwise(F.upper(level)).alias("text"), style.alias("style"))


def directory_totals(skills: DataFrame, reports: DataFrame) -> DataFrame:
    """(skills, verified): how many skills there are, and how many have passed by their latest report."""
    return directory(skills, reports).agg(F.count(F.lit(1)).alias("skills"), F.count_if(F.col("passed")).alias("verified"))


def submission_status(submissions: DataFrame, reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Submissions with their report, if any, and its findings."""
    r = with_findings(reports, findings).select(F.col("submissionId").alias("_s"), "riskScore", "riskLevel", "passed", "findings")
    return submissions.join(r, submissions["id"] == r["_s"], "left").drop("_s")


def orphans(rows: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Rows whose foreign key has no parent: Spark tables don't enforce keys, this checks them."""
    return rows.join(parents.select(F.col("id").alias(key)), key, "left_anti")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Values of a unique key that occur more than once."""
    return rows.groupBy(key).count().where("count > 1")
