"""Anchored limits, the submission machine and the intake of archives, as tables and as streams, against plain loops."""

import datetime as dt
import random
import shutil
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import registry
from tracewarden.sources import skilltree
from tracewarden.streaming import archives, inorder, limits, submissions

T = dt.datetime(2024, 3, 1, 9)


def plain_windows(rows, width):
    by, out = defaultdict(list), Counter()
    for ip, ts in rows:
        if ts is not None:
            by[ip].append(ts)
    for ip, times in by.items():
        start = None
        for t in sorted(times):
            if start is None or t >= start + width:
                start = t
            out[ip, start] += 1
    return out


def requests(seed, n=800):
    """Busy, idle and very busy keys; many equal times; times that end a window exactly."""
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, 4, None]), T + dt.timedelta(minutes=r.randrange(0, 60 * 24 * 20, 5) if r.random() < 0.5 else r.randrange(0, 600))) for _ in range(n)]
    return rows + [(5, T + dt.timedelta(hours=k)) for k in range(200)] + [(6, T + dt.timedelta(minutes=59 * k, microseconds=k)) for k in range(200)] + [(7, None), (8, T), (8, T), (9, dt.datetime(1969, 12, 31, 23, 59)), (9, dt.datetime(1970, 1, 1, 0, 58, 59))]


@pytest.mark.parametrize("stretch", [64, 2, 1])
def test_anchored_windows(spark, stretch, monkeypatch):
    """Stretches of any length give the same windows, whatever is open where one ends."""
    monkeypatch.setattr(limits, "STRETCH", stretch)
    rows = requests(stretch)
    df = spark.createDataFrame(rows, "ip long, ts timestamp").repartition(5)
    got = {(r["ip"], r["window_start"]): r["requests"] for r in limits.anchored_windows(df, "1 hour").collect()}
    assert got == plain_windows(rows, dt.timedelta(hours=1))
    assert limits.anchored_windows(df.where("ip = 99"), "1 hour").isEmpty()
    named = df.select(F.concat(F.lit("k"), F.col("ip").cast("string")).alias("ip"), "ts")
    got = {(r["ip"], r["window_start"]): r["requests"] for r in limits.anchored_windows(named, "15 minutes").collect()}
    assert got == plain_windows([(None if k is None else f"k{k}", t) for k, t in rows], dt.timedelta(minutes=15))


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_anchored_windows_go_through_sorted_rows(spark, batch, monkeypatch):
    """Not through groups, each of which costs more than its rows; a stretch may lie in any number of batches."""
    monkeypatch.setattr(limits, "STRETCH", 16)
    rows = requests(batch, 300) + [(k, T + dt.timedelta(hours=100 * k)) for k in range(100, 200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        windows = limits.anchored_windows(spark.createDataFrame(rows, "ip long, ts timestamp"), "1 hour")
        got = {(r["ip"], r["window_start"]): r["requests"] for r in windows.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_windows(rows, dt.timedelta(hours=1))
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_decisions(spark):
    rows = [(k, ip, t) for k, (ip, t) in enumerate(requests(9))]
    got = {r["id"]: (r["nth"], r["allowed"]) for r in limits.decided(spark.createDataFrame(rows, "id long, ip long, ts timestamp"), ("1 hour", 3), "id").collect()}
    start, n = {}, Counter()
    for k, ip, t in sorted((x for x in rows if x[2] is not None), key=lambda x: (x[2], x[0])):
        if ip not in start or t >= start[ip] + dt.timedelta(hours=1):
            start[ip], n[ip] = t, 0
        n[ip] += 1
        assert got[k] == (n[ip], n[ip] <= 3)
    assert [got[k] for k, _, t in rows if t is None] == [(None, False)]


def fed(spark, tmp_path, batches, schema, name, run):
    """Runs a stream over ``batches``, restarted from its checkpoint after each, and returns all that it gave."""
    at, out = tmp_path / name / "in", str(tmp_path / name / "out")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at))
        q = run(spark.readStream.schema(schema).parquet(str(at))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / name / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None, k
    return spark.read.parquet(out).collect()


def test_anchored_stream(spark, tmp_path):
    """Rows up to two hours out of order, over three restarts; a last row far away lets all other windows end."""
    inorder.needs(spark)
    rows = [(ip, t) for ip, t in requests(4, 300) if t is not None and t >= T and ip is not None]
    r = random.Random(1)
    late = sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=r.randrange(0, 110)))
    third = len(late) // 3
    batches = [late[:third], late[third : 2 * third], late[2 * third :], [(-1, T + dt.timedelta(days=300))], [(-2, T + dt.timedelta(days=301))]]
    got = fed(spark, tmp_path, batches, "ip long, ts timestamp", "limits", lambda s: limits.anchored_stream(s, "1 hour", "2 hours"))
    got = Counter({(x["ip"], x["window_start"]): x["requests"] for x in got if x["ip"] > 0})
    assert got == plain_windows(rows, dt.timedelta(hours=1))


def plain_machine(events):
    by = defaultdict(list)
    for s, e, t, n in events:
        if s is not None:
            by[s].append((t, n, e))
    out = {}
    for s, found in by.items():
        status, accepted = None, 0
        for t, _, e in sorted((x for x in found if x[0] is not None), key=lambda x: (x[0], x[1], x[2] or "")):
            to = submissions.MOVES.get(e, {}).get(status)
            if to is not None:
                status, accepted = to, accepted + 1
        out[s] = (status, accepted, len(found) - accepted)
    return out


def life(seed, n=150):
    r = random.Random(seed)
    kinds = ["PENDING", "AUDITING", "COMPLETE", "REJECTED", "ERROR", "NONSENSE"]
    rows = []
    for s in range(n):
        own = [r.choice(kinds) for _ in range(r.randrange(1, 9))] if s % 2 else ["PENDING", "AUDITING", r.choice(["COMPLETE", "REJECTED", "ERROR"]), *([r.choice(kinds)] * (s % 4))]
        rows += [(s, e, T + dt.timedelta(minutes=s + (k // 2) * 3), k) for k, e in enumerate(own)]
        rows += rows[-1:] * (s % 3 == 0)
    return rows


def test_submission_machine(spark, tmp_path):
    rows = life(1)
    schema = "submission_id long, event string, ts timestamp, seq long"
    odd = [(None, "PENDING", T, 1), (900, None, T, 1), (901, "PENDING", None, 1), (902, "ERROR", T, 1)]
    got = {r["submission_id"]: (r["status"], r["accepted"], r["refused"]) for r in submissions.current(spark.createDataFrame(rows + odd, schema)).collect()}
    assert got == plain_machine(rows + odd)
    assert submissions.current(spark.createDataFrame([], schema)).isEmpty()
    # the same log, shuffled within what the watermark allows, as a stream that is restarted twice
    inorder.needs(spark)
    r = random.Random(3)
    late = sorted(rows, key=lambda x: x[2] + dt.timedelta(minutes=r.randrange(0, 50)))
    half = len(late) // 2
    batches = [late[:half], late[half:], [(-1, "PENDING", T + dt.timedelta(days=9), 0)], [(-2, "PENDING", T + dt.timedelta(days=10), 0)]]
    told = [x for x in fed(spark, tmp_path, batches, schema, "life", lambda s: submissions.transitions(s, "1 hour")) if x["submission_id"] >= 0]
    assert len(told) == len(rows)
    last, counts = {}, Counter()
    for x in sorted(told, key=lambda x: (x["submission_id"], x["ts"], x["seq"], x["accepted"])):
        counts[x["submission_id"], x["accepted"]] += 1
        if x["accepted"]:
            assert x["before"] == last.get(x["submission_id"]) and submissions.MOVES[x["event"]][x["before"]] == x["status"]
            last[x["submission_id"]] = x["status"]
    assert {s: (last.get(s), counts[s, True], counts[s, False]) for s in got if s < 900} == {s: v for s, v in got.items() if s < 900}


def archive(path, text):
    with zipfile.ZipFile(f"{path}.part", "w") as z:
        z.writestr("SKILL.md", "# A fine name\n")
        z.writestr("main.py", text)
    shutil.move(f"{path}.part", path)


def test_intake_of_archives(spark, tmp_path):
    """Each archive is audited once over three restarts; a corrupt one is rejected alone; one that is replaced is audited again."""
    drop, where, cp = tmp_path / "drop", str(tmp_path / "registry"), str(tmp_path / "cp" / "audits")
    drop.mkdir()
    for k in range(5):
        archive(str(drop / f"a{k}.zip"), "eval(x)\n" if k % 2 else "x = 1\n")
    archives.audit_arrivals(spark, str(drop), where, cp)
    status = lambda: {r["id"]: r["status"] for r in registry.load(spark, where, "submissions").collect()}
    first = {f"a{k}": "REJECTED" if k % 2 else "COMPLETE" for k in range(5)}
    assert status() == first and registry.load(spark, where, "audit_reports").count() == 5
    found = registry.load(spark, where, "findings").count()
    archives.audit_arrivals(spark, str(drop), where, cp)  # nothing has arrived
    (drop / "b.zip").write_bytes(b"PK\x03\x04 no archive")
    archive(str(drop / "c.zip"), "x = 1\n")
    archives.audit_arrivals(spark, str(drop), where, cp)
    assert status() == first | {"b": "REJECTED", "c": "COMPLETE"}
    reports = registry.load(spark, where, "audit_reports")
    assert reports.count() == 6 and registry.repeated(reports, "submissionId").isEmpty() and registry.load(spark, where, "findings").count() == found
    # the last batch again, as after a failure before its end was noted
    commits = sorted((tmp_path / "cp" / "audits" / "query" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    archives.audit_arrivals(spark, str(drop), where, cp)
    assert registry.load(spark, where, "audit_reports").count() == 6 and status() == first | {"b": "REJECTED", "c": "COMPLETE"}


def test_arrivals(tmp_path):
    """Offsets are numbers of log entries: the same offsets name the same archives, in another process too."""
    drop = tmp_path / "in"
    drop.mkdir()
    options = {"path": str(drop), "arrivals": str(tmp_path / "log")}
    a = skilltree.SkillTreeStream(options)
    assert a.latestOffset() == a.initialOffset() == {"entries": 0}
    archive(str(drop / "x.zip"), "a")
    one = a.latestOffset()
    assert one == {"entries": 1} == a.latestOffset() == skilltree.SkillTreeStream(options).latestOffset()
    archive(str(drop / "y.zip"), "b")
    archive(str(drop / "x.zip"), "a longer text")
    two = skilltree.SkillTreeStream(options).latestOffset()
    paths = lambda s, e: sorted(w[0].rsplit("/", 1)[-1] for p in skilltree.SkillTreeStream(options).partitions(s, e) for w in p.work)
    assert two == {"entries": 2} and paths(a.initialOffset(), one) == ["x.zip"] and paths(one, two) == ["x.zip", "y.zip"] and paths(two, two) == []
    (tmp_path / "log" / "000000002.json.new").write_text("[[")  # a look that failed while it was writing
    archive(str(drop / "z.zip"), "c")
    assert skilltree.SkillTreeStream(options).latestOffset() == {"entries": 3} and paths(two, {"entries": 3}) == ["z.zip"]
    with pytest.raises(ValueError, match="arrivals"):
        skilltree.SkillTreeStream({"path": str(drop)})


def test_even_tasks(tmp_path):
    """Of many skills one has two fifths of all bytes: its files are shared out, and no task gets over 1.5 times the mean."""
    r = random.Random(2)
    small = 0
    for k in range(600):
        (tmp_path / f"s{k}").mkdir()
        n = r.randrange(100, 3000)
        (tmp_path / f"s{k}" / "f.txt").write_text("x" * n)
        small += n
    (tmp_path / "large").mkdir()
    for k in range(300):
        (tmp_path / "large" / f"f{k}.txt").write_text("y" * (small * 2 // 3 // 300))
    parts = skilltree.SkillTreeReader({"path": str(tmp_path), "skillspertask": "20"}).partitions()
    sizes = [sum(size + skilltree.ENTRY for _, entries, _, _ in p.work for *_, size in entries) for p in parts]
    assert len(parts) == 31 and max(sizes) <= 1.5 * sum(sizes) / len(sizes)
    rows = [(row[0], row[1]) for p in parts for row in skilltree.SkillTreeReader({"path": str(tmp_path)}).read(p)]
    assert len(rows) == len(set(rows)) == 601 + 900
