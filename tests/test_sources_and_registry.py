import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import findings as fs
from tracewarden.operators import registry, skill_rules
from tracewarden.plans import audit
from tracewarden.sources import skilltree
from tracewarden.streaming import limits


def tree(tmp_path):
    a = tmp_path / "in" / "a"
    (a / ".hidden").mkdir(parents=True)
    (a / "SKILL.md").write_text("# Nice name\r\nno network\r\n")
    (a / ".env").write_bytes(b"eval(x)\xff\xfe\n")
    (a / ".hidden" / "_u.py").write_text("import requests")
    os.symlink("/etc/hostname", a / "link")
    deep = a.joinpath(*"abcdefghijk")
    deep.mkdir(parents=True)
    (deep / "f.txt").write_text("x")
    (tmp_path / "in" / "empty").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "z.zip", "w") as z:
        z.writestr("SKILL.md", "# web-serch\n")
        z.writestr("../evil.py", "eval(x)")
        z.writestr("/abs.py", "eval(x)")
        z.writestr("big.txt", "y" * 2000)
    return str(tmp_path / "in")


def test_tree_and_archive(spark, tmp_path):
    skilltree.register(spark)
    root = tree(tmp_path)
    files = spark.read.format("skilltree").option("maxFile", 5000).load(root).withColumn("skill_id", F.element_at(F.split("skill_id", "/"), -1)).persist()
    rows = {(r["skill_id"], r["file_path"]): r for r in files.collect()}
    assert rows["a", ".env"]["content"] == "eval(x)\ufffd\ufffd\n" and rows["a", ".env"]["suffix"] == ""
    assert rows["a", ".hidden/_u.py"]["depth"] == 2
    assert rows["a", "link"]["is_symlink"] and rows["a", "link"]["content"] is None
    assert rows["a", "SKILL.md"]["content"] == "# Nice name\nno network\n"
    assert ("z", "../evil.py") not in rows and ("z", "/abs.py") not in rows and rows["z", "big.txt"]["content"] == "y" * 2000
    found, reports = audit.audit(files)
    got = {}
    for r in found.collect():
        got.setdefault(r["skill_id"], set()).add(r["rule_id"])
    assert {"RUN_001", "RUN_003", "OBFS_001", "PERM_NET_001"} <= got["a"]
    assert got["empty"] == {"RUN_002", "PERM_000", "TYPO_000"} and "TYPO_001" in got["z"]
    level = {r["skill_id"]: (r["risk_score"], r["risk_level"]) for r in reports.collect()}
    assert level["empty"] == (40, "high")
    [deep] = skill_rules.pre_flight(files).where("rule_id = 'RUN_003'").collect()
    assert deep["match"] == "11" and deep["file_path"] == "a/b/c/d/e/f/g/h/i/j/k"
    one = spark.read.format("skilltree").option("single", "true").load(root + "/a")
    assert one.where("is_file").count() == 4


def test_skills_that_cannot_be_read_fail_alone(spark, tmp_path):
    skilltree.register(spark)
    root = tree(tmp_path)
    bad = tmp_path / "in"
    (bad / "noise.zip").write_bytes(b"PK\x03\x04 this is no archive")
    (bad / "void.zip").write_bytes(b"")
    with zipfile.ZipFile(bad / "nested.zip", "w") as z:
        z.writestr("a/b/SKILL.md", "# x\n")
    with zipfile.ZipFile(bad / "sum.zip", "w") as z:
        z.writestr("SKILL.md", "# a title\n" * 30)
    raw = bytearray((bad / "sum.zip").read_bytes())
    raw[60] ^= 1
    (bad / "sum.zip").write_bytes(bytes(raw))
    with zipfile.ZipFile(bad / "locked.zip", "w") as z:
        z.writestr("SKILL.md", "x")
    raw = bytearray((bad / "locked.zip").read_bytes())
    for at in (raw.index(b"PK\x03\x04") + 6, raw.index(b"PK\x01\x02") + 8):
        raw[at] |= 1  # as if encrypted
    (bad / "locked.zip").write_bytes(bytes(raw))
    (bad / "large").mkdir()
    (bad / "large" / "f.txt").write_text("z" * 6000)
    files = spark.read.format("skilltree").option("maxFile", 5000).option("skillsPerTask", 3).load(root).withColumn("skill_id", F.element_at(F.split("skill_id", "/"), -1)).persist()
    failed = {r["skill_id"]: r["error"] for r in skilltree.failed(files).collect()}
    assert set(failed) == {"noise", "void", "sum", "locked", "large"}
    assert [r["file_path"] for r in files.where("skill_id = 'large'").collect()] == ["."]
    assert {r["file_path"] for r in files.where("skill_id = 'nested'").collect()} == {".", "a", "a/b", "a/b/SKILL.md"}
    found, reports = audit.audit(files)
    subs = spark.createDataFrame([(f"u-{k}", k, "AUDITING") for k in ("a", "z", "noise", "large", "nested")], "id string, skillId string, status string")
    at = str(tmp_path / "registry")
    done = registry.store(at, subs, reports, found, skilltree.failed(files), F.lit(dt.datetime(2024, 1, 1)))
    status = {r["skillId"]: r["status"] for r in done.collect()}
    assert status == {"a": "REJECTED", "z": "REJECTED", "noise": "REJECTED", "large": "REJECTED", "nested": "REJECTED"}
    stored = registry.load(spark, at, "audit_reports")
    assert {r["skillId"] for r in stored.collect()} == {"a", "z", "nested"} and registry.load(spark, at, "findings").count() == found.where("skill_id in ('a', 'z', 'nested')").count()
    registry.append(stored, at, "audit_reports")
    assert registry.load(spark, at, "audit_reports").count() == 6


def test_levels(spark):
    want = {0: "none", 5: "low", 10: "low", 11: "medium", 30: "medium", 31: "high", 60: "high", 61: "critical"}
    df = spark.createDataFrame([(k,) for k in want], "s int")
    assert {r["s"]: r["l"] for r in df.select("s", fs.risk_level(F.col("s")).alias("l")).collect()} == want


def test_submission_flow(spark):
    cols = "skill_id string, submission_id string, name string, description string, author string, repositoryUrl string"
    rows = spark.createDataFrame([("s1", "u1", " a skill ", "long enough text", "me", "https://x.example"), ("s2", "u2", "x", "long enough text", "me", "https://x"), ("s3", "u3", "ok", "long enough text", "me", "ftp://x"), ("s4", "u4", "ok", None, "me", "https://x")], cols)
    errors = {r["skill_id"]: r["error"] for r in registry.validated(rows).collect()}
    assert errors["s1"] is None and errors["s2"].startswith("name") and "http or https" in errors["s3"] and errors["s4"].startswith("description")
    skills, subs = registry.intake(rows, F.lit(dt.datetime(2024, 1, 1)))
    assert [r["name"] for r in skills.collect()] == ["a skill"] and subs.first()["status"] == "PENDING" and subs.first()["paymentStatus"] == "UNPAID"
    reports = registry.report_rows(spark.createDataFrame([("s1", False, 40, "high", 1)], "skill_id string, passed boolean, risk_score long, risk_level string, total_findings long"), subs)
    assert registry.settled(subs, reports).first()["status"] == "REJECTED"
    f = spark.createDataFrame([("s1", "d", "high", "R", "x", "f.py", 3, "m")], "skill_id string, detector string, severity string, rule_id string, description string, file_path string, line_number int, match string")
    kept = registry.finding_rows(f, reports)
    assert kept.columns == ["id", "reportId", "detector", "severity", "ruleId", "description", "filePath", "lineNumber", "match"] and kept.count() == 1
    out = registry.detail(skills, reports, kept, registry.settled(subs, reports), "s1").first()
    assert out["report"]["findings"][0]["lineNumber"] == 3 and out["status"] == "REJECTED"
    assert registry.badges(skills, reports).first()["label"] == "high"
    assert registry.orphans(kept, "reportId", reports).isEmpty() and registry.repeated(reports, "submissionId").isEmpty()
    assert registry.settled(subs, reports.limit(0), subs.select("id")).first()["status"] == "REJECTED"


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("a", t + dt.timedelta(minutes=i)) for i in range(7)] + [("b", t)]
    spark.createDataFrame(rows, "ip string, ts timestamp").write.parquet(str(tmp_path / "req"))
    stream = spark.readStream.schema("ip string, ts timestamp").parquet(str(tmp_path / "req"))
    q = limits.over_limit(stream, late="1 hour").writeStream.format("memory").queryName("over").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["ip"], r["requests"]) for r in spark.table("over").collect()] == [("a", 7)]
    seen = []
    limits.intake(spark, str(tmp_path / "req"), "ip string, ts timestamp", lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    assert sum(seen) == 8


def test_command_line(spark, tmp_path, capsys):
    import json

    from tracewarden.__main__ import main

    assert main([]) == 1 and json.loads(capsys.readouterr().out) == {"error": "No skill path provided"}
    assert main(["/no/such"]) == 1 and "does not exist" in json.loads(capsys.readouterr().out)["error"]
    assert main([tree(tmp_path) + "/a"]) == 0
    d = json.loads(capsys.readouterr().out)
    assert not d["passed"] and d["risk_level"] == "critical" and {"runner", "credential_detector"} <= set(d["summary"])
    [f] = [f for r in d["results"] if r["detector"] == "permission_scanner" for f in r["findings"]]
    assert f == {"detector": "permission_scanner", "severity": "critical", "rule_id": "PERM_NET_001", "description": "Skill declares no network access but code exhibits network behavior", "file_path": ".hidden/_u.py", "line_number": 1, "match": "undeclared network usage"}


def test_urls(spark):
    from tracewarden.functions import url

    df = spark.createDataFrame([*url.EXAMPLES, (None, False), ("http://exämple.de", True), ("http://名前.example:80/", True)], "u string, ok boolean")
    assert [r["u"] for r in df.where(url.url_fails(F.col("u")) == F.col("ok")).collect()] == []


def small_audit(spark):
    cols = "skill_id string, detector string, severity string, rule_id string, description string, file_path string, line_number int, match string"
    f = spark.createDataFrame([("s1", "d", "high", "R", "x", "f.py", 3, "m")] * 2 + [("s2", "d", "low", "R", "x", "f.py", 4, "m")], cols)
    reports = spark.createDataFrame([("s1", False, 40, "high", 2), ("s2", False, 5, "low", 1), ("s3", True, 0, "none", 0)], "skill_id string, passed boolean, risk_score long, risk_level string, total_findings long")
    subs = spark.createDataFrame([("u1", "s1", "AUDITING"), ("u2", "s2", "AUDITING"), ("u3", "s3", "AUDITING"), ("u4", "s4", "AUDITING")], "id string, skillId string, status string")
    return subs, reports, f


def check_stored(spark, at, **options):
    rows = lambda t: registry.load(spark, at, t, **options)
    assert sorted(r["id"] for r in rows("audit_reports").collect()) == ["u1", "u2", "u3"]
    found = rows("findings").collect()
    assert sorted(r["reportId"] for r in found) == ["u1", "u1", "u2"] and len({r["id"] for r in found}) == 3 and all(rows("findings").select(registry.is_uuid(F.col("id")).alias("u")).collect())
    assert {r["id"]: r["status"] for r in rows("submissions").collect()} == {"u1": "REJECTED", "u2": "REJECTED", "u3": "COMPLETE", "u4": "AUDITING"}


def test_an_audit_is_stored_once(spark, tmp_path, monkeypatch):
    """Twice gives one report; a failure at any point before the commit leaves nothing to be seen, and doing it again completes it."""
    import pytest

    at = str(tmp_path / "registry")
    subs, reports, f = small_audit(spark)
    for t in registry.TABLES:
        assert registry.load(spark, at, t).isEmpty()
    assert registry.append(subs, at, "submissions", "s") and not registry.append(subs, at, "submissions", "s")
    now = F.lit(dt.datetime(2024, 1, 1))
    whole = registry._shaped
    for stop in ("findings", "audit_reports", "submission_status", "publish"):
        def shaped(rows, table):
            if table == stop:
                raise OSError("stopped")
            return whole(rows, table)

        monkeypatch.setattr(registry, "_shaped", shaped)
        publish = registry._Folder.publish
        if stop == "publish":
            monkeypatch.setattr(registry._Folder, "publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            registry.store(at, subs, reports, f, None, now, "k")
        monkeypatch.setattr(registry, "_shaped", whole)
        monkeypatch.setattr(registry._Folder, "publish", publish)
        assert all(registry.load(spark, at, t).isEmpty() for t in ("findings", "audit_reports", "submission_status"))
        assert {r["status"] for r in registry.load(spark, at, "submissions").collect()} == {"AUDITING"}
    for key in ("k", "k", "another", None):
        done = registry.store(at, subs, reports, f, None, now, key)
        assert {r["id"]: r["status"] for r in done.collect()}["u3"] == "COMPLETE"
        check_stored(spark, at)
    # the rename itself: of two writers with one key the second finds it taken
    folder = registry._Folder(spark, at)
    assert folder.publish("race", {}) and not folder.publish("race", {"findings": "nowhere"})


def test_a_database(spark, tmp_path):
    """The same in a database, here the one that comes with Spark's own metastore."""
    at = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    subs, reports, f = small_audit(spark)
    registry.create(spark, at, **options)
    registry.append(subs, at, "submissions", **options)
    now = F.lit(dt.datetime(2024, 1, 1))
    # a write that failed after its findings
    made = registry.report_rows(reports, subs, now)
    registry.append(registry.finding_rows(f, made), at, "findings", **options)
    for _ in range(2):
        registry.store(at, subs, reports, f, None, now, **options)
        check_stored(spark, at, **options)


def test_name_neighbours(spark):
    import random

    from tracewarden.operators import similar_names

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    r = random.Random(1)
    names = ["", "a", "ab", None, "é", "ée", *("".join(r.choice("abcé") for _ in range(r.randrange(1, 9))) for _ in range(120))]
    known = [None, "", "b", "abc", *("".join(r.choice("abcé") for _ in range(r.randrange(1, 9))) for _ in range(60)), *names[10:20]]
    df = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    near = similar_names.neighbours(df(names, "name"), df(known, "known"))
    got = sorted(tuple(x) for x in near.collect())
    assert got == sorted({(a, b, plain(a, b)) for a in names for b in known if a is not None and b is not None and a != b and plain(a, b) <= 2})
    assert "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in near._jdf.queryExecution().executedPlan().toString()
    skills = spark.createDataFrame([("1", "web-serch"), ("2", "githib"), ("3", "Gmail"), ("4", "csv-procesor-v2"), ("5", "0penclaws"), ("6", None), ("7", "slakc")], "skill_id string, skill_name string")
    from tracewarden.functions import rules

    want = sorted(tuple(x) for x in skill_rules.look_alikes(skills).collect())
    assert want and sorted(tuple(x) for x in skill_rules.look_alikes_among(skills, df(rules.KNOWN_SKILLS, "known")).collect()) == want


def test_variants_of_names_are_not_broadcast(spark):
    from tracewarden.operators import similar_names

    names = spark.range(3000).selectExpr("concat('plain-name-', id) as name")  # a few bytes a name to the planner, a hundred variants each
    near = similar_names.neighbours(names, names.withColumnRenamed("name", "known"))
    assert near.where("name = 'plain-name-7'").count() > 0
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_all_short_names(spark, most):
    """Each pair of all short texts of two letters, so that each way to be near occurs, with runs too, once."""
    import functools
    import itertools

    from tracewarden.operators import similar_names

    @functools.cache
    def plain(a, b):
        return max(len(a), len(b)) if not a or not b else min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))

    texts = ["".join(x) for n in range(7) for x in itertools.product("aé", repeat=n)]
    names = spark.createDataFrame([(t,) for t in texts], "name string")
    got = sorted(tuple(r) for r in similar_names.neighbours(names, names.withColumnRenamed("name", "known"), most).collect())
    assert got == sorted((a, b, plain(a, b)) for a in texts for b in texts if 1 <= plain(a, b) <= most)


def test_pairs_of_names_are_not_shuffled(spark):
    from tracewarden.operators import similar_names

    names = spark.range(3000).selectExpr("concat('name-', id) as name")
    near = similar_names.neighbours(names, names.withColumnRenamed("name", "known"))
    pairs = [tuple(r) for r in near.collect()]
    assert len(set(pairs)) == len(pairs) > 3000
    plan = near._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    above = plan.partition("SortMergeJoin")[0]
    assert "Aggregate" not in above and "Exchange" not in above and "levenshtein" not in plan  # pairs are neither shuffled nor measured
    assert "ReusedExchange" in plan and "REPARTITION_BY_NUM" in plan  # the rows of names are made once for both sides, by several tasks
