"""Dependency detector: six kinds of manifests and pip calls in code.  Quirks of the rules are kept on purpose.

Rule names and texts of findings are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import rules as R
from tracewarden.functions.text import any_of, cut, near, rx, strip
from tracewarden.operators.corpus import lines, readable
from tracewarden.operators.findings import exploded, finding

NAME = "dependency_scanner"


def _q(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def _malicious(pkg: Column, line: Column, shown: Column, where: str = "") -> Column:
    return F.when(pkg.isin(R.MALICIOUS), finding(NAME, "critical", "DEP_001", F.concat(F.lit(f"Known malicious package{where}: "), _q(shown)), line, shown))


def _similar(pkg: Column, line: Column, shown: Column, where: str = "", distance: bool = False) -> Column:
    """The first popular name within two edits; none if that is the name itself."""
    close = near(pkg, R.POPULAR)
    text = F.concat(F.lit("Package "), _q(shown), F.lit(f"{where} is suspiciously similar to "), _q(close))
    if distance:
        text = F.concat(text, F.lit(" (edit distance "), F.levenshtein(pkg, close).cast("string"), F.lit(")"))
    return F.when(close.isNotNull() & (close != pkg), finding(NAME, "high", "DEP_002", text, line, shown))


def requirements(files: DataFrame) -> DataFrame:
    """requirements.txt, line by line: direct URLs and other indexes end a line's checks, so does a malicious name."""
    rows = lines(readable(files).where("name = 'requirements.txt'"))
    s = strip(F.col("line"))
    rows = rows.withColumn("_s", s)
    s, no = F.col("_s"), F.col("line_no")
    url = s.startswith("git+") | s.startswith("http://") | s.startswith("https://")
    index = s.contains("--index-url") | s.contains("--extra-index-url")
    skip = s.startswith("#") | s.startswith("-")
    bare = F.regexp_replace(strip(F.get(F.split(s, "#"), F.lit(0))), rx(r"\[.*?\]"), "")
    pkg = F.lower(strip(F.get(F.split(bare, rx(r"[>=<!;,\s]")), F.lit(0))))
    rows = rows.withColumn("_stop", F.when(url, 5).when(index, 6).otherwise(0))
    rows = rows.withColumn("_pkg", F.when((F.col("_stop") == 0) & ~skip & (pkg != ""), pkg)).where("_stop > 0 or _pkg is not null")
    p = F.col("_pkg")
    good = p.isNotNull() & ~p.isin(R.MALICIOUS)
    pinned = F.get(F.split(F.col("line"), "#"), F.lit(0)).rlike("[>=<!]")
    found = F.array(
        F.when(F.col("_stop") == 5, finding(NAME, "high", "DEP_005", "Direct URL/git install bypasses PyPI security checks", no, cut(s))),
        F.when(F.col("_stop") == 6, finding(NAME, "high", "DEP_006", "Custom PyPI index URL — packages may not be from official PyPI", no, cut(s))),
        _malicious(p, no, p),
        F.when(good & ~pinned, finding(NAME, "low", "DEP_003", F.concat(F.lit("Unpinned dependency "), _q(p), F.lit(" — version not locked")), no, p)),
        F.when(good, _similar(p, no, p, distance=True)),
        F.when(good & any_of(p, [rx(x) for x in R.ODD_NAMES]), finding(NAME, "medium", "DEP_008", F.concat(F.lit("Suspicious package name pattern: "), _q(p)), no, p)),
    )
    return exploded(rows, found)


def npm(files: DataFrame) -> DataFrame:
    """package.json outside node_modules: three sections merged, later ones win, first places stay; lines are places in the merged map."""
    rows = readable(files).where("name = 'package.json'").where(~F.concat_ws("/", F.col("skill_id").cast("string"), "file_path").contains("node_modules"))
    sections = ", ".join(f"{k}: map<string,string>" for k in ("dependencies", "devDependencies", "optionalDependencies"))
    strict = {"allowSingleQuotes": "false"}
    # a parser stops after the first value; inside a list and inside an object, what follows it makes the text invalid
    listed = F.from_json(F.concat(F.lit("["), "content", F.lit("]")), f"array<struct<{sections}>>", strict)
    held = F.from_json(F.concat(F.lit('{"x":'), "content", F.lit("}")), f"struct<x: struct<{sections}>>", strict)
    parsed = F.when((F.size(listed) == 1) & held["x"].isNotNull(), listed[0])
    none = F.array().cast("array<struct<key:string,value:string>>")
    rows = rows.withColumn("_j", parsed)
    pairs = F.concat(*(F.coalesce(F.map_entries(F.col(f"_j.{k}")), none) for k in ("dependencies", "devDependencies", "optionalDependencies")))
    rows = rows.withColumn("_all", pairs)
    # names in the order of their first place, each with its last version
    keys = F.array_distinct(F.transform("_all", lambda e: e["key"]))
    rows = rows.withColumn("_keys", keys).select("skill_id", "file_path", "_all", F.posexplode("_keys").alias("_p", "_name"))
    version = F.element_at(F.filter("_all", lambda e: e["key"] == F.col("_name")), -1)["value"]
    rows = rows.withColumn("_v", F.coalesce(version, F.lit("None"))).withColumn("_pkg", F.lower(F.regexp_replace("_name", "^@[^/]+/", "")))
    no, name, p = F.col("_p") + 1, F.col("_name"), F.col("_pkg")
    bad = p.isin(R.MALICIOUS)
    found = F.array(
        _malicious(p, no, name),
        F.when(~bad & strip(F.col("_v")).isin("*", "latest", ""), finding(NAME, "medium", "DEP_004", F.concat(F.lit("Wildcard version for "), _q(name), F.lit(" — unpredictable installs")), no, F.concat(name, F.lit("@"), F.col("_v")))),
        F.when(~bad, _similar(p, no, name, distance=True)),
    )
    return exploded(rows, found)


def _both(rows: DataFrame, no: Column, where: str) -> DataFrame:
    p = F.col("_pkg")
    return exploded(rows.where("_pkg <> ''"), F.array(_malicious(p, no, p, f" in {where}"), _similar(p, no, p, f" in {where}")))


def setup_py(files: DataFrame) -> DataFrame:
    rows = readable(files).where("name = 'setup.py'")
    rows = rows.withColumn("_list", F.explode(F.regexp_extract_all("content", F.lit(rx(r"install_requires\s*=\s*\[(.*?)\]", dot_all=True)), F.lit(1))))
    rows = rows.withColumn("_raw", F.explode(F.regexp_extract_all("_list", F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))))
    return _both(rows.withColumn("_pkg", F.lower(strip(F.get(F.split("_raw", r"[>=<!;\[]"), F.lit(0))))), F.lit(0), "setup.py")


def pyproject(files: DataFrame) -> DataFrame:
    """name = ... lines inside dependency sections; a package counts once in a file."""
    rows = lines(readable(files).where("name = 'pyproject.toml'")).withColumn("_s", strip(F.col("line")))
    head = F.when(F.col("_s").isin(R.TOML_SECTIONS), F.lit(True)).when(F.col("_s").startswith("[") & F.col("_s").endswith("]"), F.lit(False))
    so_far = Window.partitionBy("skill_id", "file_path").orderBy("line_no")
    rows = rows.withColumn("_head", head).withColumn("_in", F.last("_head", ignorenulls=True).over(so_far)).where("_in and _head is null")
    rows = rows.withColumn("_pkg", F.lower(F.regexp_extract("_s", rx(r"^([a-zA-Z0-9_\-]+)\s*="), 1))).where("_pkg <> ''")
    once = Window.partitionBy("skill_id", "file_path", "_pkg").orderBy("line_no")
    return _both(rows.withColumn("_n", F.row_number().over(once)).where("_n = 1"), F.lit(0), "pyproject.toml")


def pipfile(files: DataFrame) -> DataFrame:
    rows = readable(files).where("name = 'Pipfile'")
    rows = rows.withColumn("_raw", F.explode(F.regexp_extract_all("content", F.lit(rx(r"^([a-zA-Z0-9_\-]+)\s*=", multiline=True)), F.lit(1))))
    rows = rows.withColumn("_pkg", F.lower("_raw"))
    return _both(rows.where(~F.col("_pkg").isin(R.PIPFILE_RESERVED)), F.lit(0), "Pipfile")


def conda(files: DataFrame) -> DataFrame:
    """environment.yml: every list item after a line ``dependencies:``."""
    rows = lines(readable(files).where("name = 'environment.yml'")).withColumn("_s", strip(F.col("line")))
    so_far = Window.partitionBy("skill_id", "file_path").orderBy("line_no")
    rows = rows.withColumn("_in", F.max(F.col("_s") == "dependencies:").over(so_far)).where("_in and _s like '-%'")
    item = F.regexp_replace("_s", "^[- ]+", "")
    rows = rows.withColumn("_pkg", F.lower(strip(F.get(F.split(item, "="), F.lit(0))))).where("_pkg not like '#%'")
    return _both(rows, F.col("line_no"), "conda environment")


def runtime_pip(files: DataFrame) -> DataFrame:
    rows = readable(files).where("name like '%.py' or name like '%.js'")
    text = "Runtime pip install — installs packages dynamically at execution time"
    hit = F.col("line").rlike(rx(R.RUNTIME_PIP))
    return exploded(lines(rows), F.array(F.when(hit, finding(NAME, "high", "DEP_007", text, F.col("line_no"), cut(strip(F.col("line")))))))


def dependencies(files: DataFrame) -> DataFrame:
    out = requirements(files)
    for part in (npm, setup_py, pyproject, pipfile, conda, runtime_pip):
        out = out.unionByName(part(files))
    return out
