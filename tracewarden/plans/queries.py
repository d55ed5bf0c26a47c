"""Registered queries of the audit engine over the synthetic tables, each through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import rules as R
from tracewarden.functions import url
from tracewarden.functions.text import lines as text_lines
from tracewarden.operators import findings as fs
from tracewarden.operators import line_rules, manifests, registry, similar_names, skill_rules
from tracewarden.operators.corpus import from_texts, lines, readable, skills
from tracewarden.plans import audit, derived
from tracewarden.session import staged
from tracewarden.streaming import limits, submissions

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _short(findings: DataFrame) -> DataFrame:
    return findings.select("skill_id", "rule_id", "severity", "file_path", "line_number", "match")


def _code_lines(spark: SparkSession, d: str, suffixes: list[str]) -> DataFrame:
    return lines(readable(derived.code(spark, d), suffixes))


def line_explode(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.posexplode(text_lines(F.col("text"))).alias("p", "line"))
    return docs.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"), F.md5("line").alias("digest"))


def regex_rules_obfs(spark, d):
    return _short(line_rules.obfuscation_lines(_code_lines(spark, d, R.TEXT_SUFFIXES)))


def ast_calls(spark, d):
    """One file for each order line of the corpus, so that a line that doesn't parse spoils no other."""
    rows = _code_lines(spark, d, [".py"]).select("skill_id", F.concat(F.lit("l"), F.col("line_no").cast("string"), F.lit(".py")).alias("file_path"), F.col("line").alias("content"))
    return _short(line_rules.ast_calls(from_texts(rows)))


def ast_calls_lateral(spark, d):
    """The same in SQL, by the table function."""
    line_rules.register_ast_calls(spark)
    files = _code_lines(spark, d, [".py"]).select("skill_id", F.concat(F.lit("l"), F.col("line_no").cast("string"), F.lit(".py")).alias("file_path"), F.col("line").alias("content"))
    hits = spark.sql("select f.skill_id, f.file_path, a.rule_id, a.name, a.line_number, a.col from {files} f, lateral ast_calls(f.content) a", files=files)
    return _short(line_rules.ast_findings(hits))


def first_pattern_wins(spark, d):
    c = _t(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("skill_id"), F.concat(F.col("turn").cast("string"), F.lit(".md")).alias("file_path"), F.col("text").alias("content"))
    rows = _code_lines(spark, d, R.PROSE_SUFFIXES).unionByName(lines(from_texts(c)))
    return _short(line_rules.injection_lines(rows))


def whole_file_rule(spark, d):
    return _short(line_rules.injection_files(derived.code(spark, d)))


def exfil_lookahead(spark, d):
    return line_rules.exfiltration_lines(_code_lines(spark, d, R.WIDE_SUFFIXES)).select("skill_id", "file_path", "line_number", "description", "match")


def _page_lines(spark, d):
    pages = _t(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("skill_id"), F.lit("url.txt").alias("file_path"), F.col("url").alias("content"))
    return _code_lines(spark, d, R.WIDE_SUFFIXES).unionByName(lines(from_texts(pages)))


def network_raw_ip(spark, d):
    return _short(line_rules.raw_addresses(_page_lines(spark, d)))


def network_ordered(spark, d):
    return _short(line_rules.endpoints(_page_lines(spark, d)))


def network_domain(spark, d):
    return line_rules.domains(_page_lines(spark, d)).select("skill_id", "file_path", "line_number", "description", "match")


def permission_violation(spark, d):
    return _short(skill_rules.permissions(derived.corpus(spark, d)))


def typosquat_names(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("skill_id"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("skill_name"))
    k = skill_rules.skill_names(derived.corpus(spark, d)).select(F.regexp_replace("skill_id", "s", "-").cast("long").alias("skill_id"), "skill_name")
    near = skill_rules.look_alikes(p.unionByName(k))
    return near.select("skill_id", "skill_name", "known", F.col("distance").cast("long").alias("distance"))


def name_neighbours(spark, d):
    """Names of parts, each made one of its own by four letters of a digest, that are within two edits of one another."""
    n = _t(spark, d, "part").select(F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 4)).alias("name"))
    near = similar_names.neighbours(n, n.withColumnRenamed("name", "known"))
    return near.select("name", "known", F.col("distance").cast("long").alias("distance"))


def _dep(part: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark, d):
        return _short(part(derived.manifests(spark, d)))

    return query


def dep_runtime(spark, d):
    return _short(manifests.runtime_pip(derived.code(spark, d)))


def credential_lines(spark, d):
    docs = _t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("skill_id"), F.lit("a.txt").alias("file_path"), F.col("text").alias("content"))
    return _short(line_rules.credential_lines(lines(from_texts(docs)).unionByName(_code_lines(spark, d, R.WIDE_SUFFIXES))))


def preflight(spark, d):
    return skill_rules.pre_flight(derived.entries(spark, d)).select("skill_id", "rule_id", "severity", "file_path", "description", "match")


def _order_findings(spark, d):
    """Lines of orders as findings: severity by the line's status, with repeated keys."""
    kind = F.when(F.col("l_returnflag") == "A", "critical").when(F.col("l_returnflag") == "N", "high").when(F.col("l_linestatus") == "F", "medium").otherwise("low")
    return _t(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("skill_id"), F.element_at(F.array(*map(F.lit, R.DETECTORS)), (F.col("l_partkey") % 5 + 1).cast("int")).alias("detector"), kind.alias("severity"), F.concat(F.lit("R"), (F.col("l_partkey") % 5).cast("string")).alias("rule_id"),
        F.lit("x").alias("description"), F.concat(F.lit("f"), (F.col("l_partkey") % 40).cast("string")).alias("file_path"), (F.col("l_orderkey") % 50).cast("int").alias("line_number"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("match"), "l_orderkey", "l_linenumber",
    )


def dedupe_first(spark, d):
    return fs.first_of_each(_order_findings(spark, d), F.struct("l_orderkey", "l_linenumber")).select("skill_id", "file_path", "line_number", "rule_id", "match")


def _fifty(spark, d):
    return _t(spark, d, "supplier").select((F.col("s_suppkey") % 60).alias("skill_id")).distinct()


def risk_score(spark, d):
    return fs.reports(_fifty(spark, d), _order_findings(spark, d))


def risk_level(spark, d):
    scores = _t(spark, d, "orders").select((F.col("o_orderkey") % 71).alias("score")).distinct()
    return scores.select("score", fs.risk_level(F.col("score")).alias("risk_level"))


def summary_by_detector(spark, d):
    return fs.summary(_fifty(spark, d), _order_findings(spark, d))


def severity_pivot(spark, d):
    return fs.severity_pivot(_order_findings(spark, d))


def _registry(spark, d):
    """Customers as skills, orders as submissions and (finished ones) reports, order lines as findings."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("c_custkey") % 30).cast("int"))).alias("submittedAt"))
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("PENDING")
    subs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("skillId"), status.alias("status"), F.col("o_orderdate").alias("createdAt"))
    score = (F.floor("o_totalprice") % 90).cast("long")
    reports = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("submissionId"), F.col("o_custkey").alias("skillId"), score.alias("riskScore"), fs.risk_level(score).alias("riskLevel"), (F.col("o_orderstatus") == "F").alias("passed"), F.col("o_orderdate").alias("completedAt"))
    found = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("reportId"), F.lit("f").alias("filePath"), F.col("l_linenumber").alias("lineNumber"), F.col("l_returnflag").alias("ruleId"), F.lit("x").alias("detector"), F.col("l_linestatus").alias("severity"), F.lit("x").alias("description"), F.lit("m").alias("match"))
    return c, subs, reports, found


def findings_rollup(spark, d):
    return fs.rollup(_order_findings(spark, d))


def latest_report(spark, d):
    return registry.latest(_registry(spark, d)[2], "skillId", "completedAt").select("skillId", "id", "riskScore", "riskLevel", "passed")


def directory_listing(spark, d):
    c, _, r, _ = _registry(spark, d)
    return registry.directory(c, r).select("id", "name", "riskScore", "riskLevel", "passed")


def skill_detail(spark, d):
    c, s, r, f = _registry(spark, d)
    out = registry.detail(c, r, f, s)
    return out.select("id", "name", F.col("report.id").alias("report_id"), F.col("report.riskScore").alias("risk_score"), F.coalesce(F.size("report.findings"), F.lit(0)).cast("long").alias("n_findings"), F.array_join(F.transform("report.findings", lambda x: F.concat(x["lineNumber"].cast("string"), x["ruleId"])), ",").alias("rules"), "status")


def badge(spark, d):
    c, _, r, _ = _registry(spark, d)
    return registry.badges(c, r).select("id", "label", "color")


def directory_totals(spark, d):
    c, _, r, _ = _registry(spark, d)
    return registry.directory_totals(c, r)


def risk_badges(spark, d):
    _, _, r, _ = _registry(spark, d)
    return r.select("id", registry.risk_badge(F.col("riskLevel"), F.col("passed")).alias("b")).select("id", "b.text", "b.style")


def detector_labels(spark, d):
    return _order_findings(spark, d).groupBy(registry.detector_label(F.col("detector")).alias("label")).agg(F.count(F.lit(1)).alias("findings"))


def submission_status(spark, d):
    _, s, r, f = _registry(spark, d)
    out = registry.submission_status(s, r, f)
    return out.select("id", "status", "riskLevel", "passed", F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_findings"))


def _bodies(spark, d):
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    return _t(spark, d, "customer").select(
        k.alias("id"), pick(["  a ", "a skill", " ok ", None], 4).alias("name"), pick(["too short", "long enough text", "   spaces    "], 3).alias("description"),
        pick(["x", "an author"], 2).alias("author"), pick(["https://x.example/y", "ftp://x", "nothing", None, "HTTP://X.EXAMPLE"], 5).alias("repositoryUrl"),
    )


def validate_submission(spark, d):
    return registry.validated(_bodies(spark, d)).select("id", "error")


def validate_urls(spark, d):
    """Each kind of URL, over and over, a third of them with the customer's number as a fragment."""
    k = F.col("c_custkey")
    text = F.element_at(F.array(*(F.lit(u) for u, _ in url.EXAMPLES)), (k % len(url.EXAMPLES) + 1).cast("int"))
    text = F.when(k % 3 == 0, F.concat(text, F.lit("#"), k.cast("string"))).otherwise(text)
    return _t(spark, d, "customer").select(k.alias("id"), (~url.url_fails(text)).alias("valid"), url.is_http(text).alias("http"))


def uuid_filter(spark, d):
    x = F.md5(F.col("c_name"))
    dash = F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.substring(x, 13, 4), F.substring(x, 17, 4), F.substring(x, 21, 12))
    rows = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper(dash)).when(F.col("c_custkey") % 3 == 1, x).otherwise(dash).alias("uuid"))
    return rows.where(registry.is_uuid(F.col("uuid")))


def rate_limit_window(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("ip"), "ts")
    return limits.requests_per_window(e, "1 hour").select("ip", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", (F.col("requests") > 5).alias("over"))


def rate_limit_all(spark, d):
    """The limit of all requests, 100 in 15 minutes; the requests of all days count as one address's on one day."""
    day = F.col("ts") - F.make_dt_interval(days=F.date_diff(F.col("ts"), F.lit("2024-01-01").cast("date")))
    e = _t(spark, d, "events").select(F.lit("all").alias("ip"), day.alias("ts"))
    window, most = limits.ALL_REQUESTS
    n = limits.requests_per_window(e, window)
    return n.select("ip", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", (F.col("requests") > most).alias("over"))


def rate_limit_anchored(spark, d):
    """Windows of an hour that begin with a user's first request, and again with the first one after they have ended."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("ip"), "ts")
    n = limits.anchored_windows(e, "1 hour")
    return n.select("ip", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "requests", F.greatest(F.col("requests") - limits.SUBMISSIONS[1], F.lit(0)).alias("refused"))


def rate_limit_decisions(spark, d):
    """Whether each event is within the limit of 5 in its user's hour."""
    e = _t(spark, d, "events").select("event_id", F.col("user_id").alias("ip"), "ts")
    return limits.decided(e, order="event_id").select("event_id", F.col("nth").cast("long").alias("nth"), "allowed")


def _submission_events(spark, d):
    """Events as what happens to submissions, four events a submission at most of the time in the right order."""
    kind = F.element_at(F.array(*map(F.lit, ["PENDING", "AUDITING", "COMPLETE", "REJECTED", "AUDITING", "PENDING", "ERROR"])), (F.col("event_id") * 5 % 7 + 1).cast("int"))
    return _t(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 17).alias("submission_id"), kind.alias("event"), "ts", F.col("event_id").alias("seq"))


def submission_machine(spark, d):
    return submissions.current(_submission_events(spark, d))


def status_log(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id")).alias("submission_id"), F.element_at(F.array(*map(F.lit, ["PENDING", "AUDITING", "COMPLETE", "REJECTED"])), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), "ts", F.col("event_id").alias("seq"))
    return registry.current_status(e)


def audit_reports(spark, d):
    """The whole audit of the derived corpus, each line of Python a file: the verdict on each skill."""
    return audit.audit(staged(derived.corpus(spark, d, parted=True)))[1]  # every detector reads the files


def audit_documents(spark, d):
    files = staged(derived.corpus(spark, d))
    return fs.documents(skills(files), audit.findings(files))


def queries() -> dict[str, Query]:
    named = [
        line_explode, regex_rules_obfs, ast_calls, ast_calls_lateral, first_pattern_wins, whole_file_rule, exfil_lookahead, network_raw_ip, network_ordered, network_domain, permission_violation, typosquat_names, name_neighbours, dep_runtime, credential_lines, preflight, dedupe_first,
        risk_score, risk_level, summary_by_detector, severity_pivot, findings_rollup, latest_report, directory_listing, skill_detail, badge, directory_totals, risk_badges, detector_labels, submission_status, validate_submission, validate_urls, uuid_filter, rate_limit_window, rate_limit_all, rate_limit_anchored, rate_limit_decisions, submission_machine, status_log, audit_reports, audit_documents,
    ]
    deps = {"dep_requirements": manifests.requirements, "dep_npm": manifests.npm, "dep_setup": manifests.setup_py, "dep_pyproject": manifests.pyproject, "dep_pipfile": manifests.pipfile, "dep_conda": manifests.conda}
    return {f.__name__: f for f in named} | {k: _dep(v) for k, v in deps.items()}
