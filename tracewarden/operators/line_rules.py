"""Detectors that judge lines: obfuscation, prompt injection, credentials, network destinations, exfiltration.

Each is one pass over the lines: an array of all its rules, exploded where something was found.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tracewarden.functions import rules as R
from tracewarden.functions.text import DIGITS, any_of, cut, first_match, literal, rx, strip
from tracewarden.operators.corpus import lines, readable
from tracewarden.operators.findings import COLUMNS, exploded, finding, first_of_each, no_findings
from tracewarden.session import ship

NO = "line_no"


def _patterns(rule: R.Rule) -> list[str]:
    return [rx(p, ignore_case=rule.ignore_case, dot_all=rule.dot_all) for p in rule.patterns]


def obfuscation_found() -> Column:
    """Every rule is tried on every line and emits the text of its first match."""
    found = []
    for r in R.OBFUSCATION:
        match, word = first_match(F.col("line"), _patterns(r)[0]), literal(r.patterns[0])
        if word:  # a plain search is far cheaper than the pattern, and nearly always enough
            match = F.when(F.col("line").contains(word), match)
        found.append(F.when(match.isNotNull(), finding("obfuscation_detector", r.severity, r.id, r.description, F.col(NO), match)))
    return F.array(*found)


def obfuscation_lines(rows: DataFrame) -> DataFrame:
    return exploded(rows, obfuscation_found())


def _calls(source: str) -> list[tuple[str, str, int, int]]:
    """(rule, name, line, column) of the telling calls in Python source; none where it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            called = node.func
            if isinstance(called, ast.Name) and called.id in ("eval", "exec", "__import__"):
                out.append(("OBFS_AST_002" if called.id == "__import__" else "OBFS_AST_001", called.id, node.lineno, node.col_offset))
            elif isinstance(called, ast.Attribute) and called.attr in ("b64decode", "decodebytes"):
                out.append(("OBFS_AST_003", called.attr, node.lineno, node.col_offset))
    return out


def ast_calls(files: DataFrame) -> DataFrame:
    """Telling calls found in the syntax trees of .py files.

    The only detector in Python: Spark has no parser for it.  Only source that names one of the calls is
    sent to the workers.
    """
    ship(files.sparkSession)
    kind = files.schema["skill_id"].dataType.simpleString()
    parse = _calls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, f, rule, name, line, col) for s, f, c in zip(pdf["skill_id"], pdf["file_path"], pdf["content"], strict=True) for rule, name, line, col in parse(c)]
            yield pd.DataFrame(rows, columns=["skill_id", "file_path", "rule_id", "name", "line_number", "col"])

    source = readable(files, [".py"]).where(F.col("content").rlike("eval|exec|__import__|b64decode|decodebytes"))
    return ast_findings(source.select("skill_id", "file_path", "content").mapInPandas(run, f"skill_id {kind}, file_path string, rule_id string, name string, line_number int, col int"))


@udtf(returnType="rule_id string, name string, line_number int, col int", useArrow=False)
class AstCalls:
    """``ast_calls(content)`` for SQL: the telling calls of Python source, a row each; none for null and for what doesn't parse.

    Row by row, since Spark refuses table functions with Arrow at the right of a lateral join; ``ast_calls`` above works on batches.
    """

    def eval(self, content: str) -> Iterator[tuple[str, str, int, int]]:
        parse = _calls
        if content is not None:
            yield from parse(content)


def register_ast_calls(spark: SparkSession) -> None:
    """Makes ``ast_calls`` known to SQL: ``select f.skill_id, f.file_path, a.* from files f, lateral ast_calls(f.content) a``."""
    ship(spark)
    spark.udtf.register("ast_calls", AstCalls)


def ast_findings(hits: DataFrame) -> DataFrame:
    """Findings from the calls (skill_id, file_path, rule_id, name, line_number, col) that ``ast_calls`` tells."""
    severity, text, shown = F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat("name", F.lit("(...)"))
    for rule, (s, d) in R.AST.items():
        severity = F.when(F.col("rule_id") == rule, s).otherwise(severity)
        text = F.when(F.col("rule_id") == rule, F.replace(F.lit(d), F.lit("{}"), F.col("name"))).otherwise(text)
    shown = F.when(F.col("rule_id") == "OBFS_AST_003", F.concat(F.lit("base64."), shown)).otherwise(shown)
    out = hits.withColumns({"detector": F.lit("obfuscation_detector"), "severity": severity, "description": text, "match": shown})
    return first_of_each(out, F.col("col")).select(*COLUMNS)


def obfuscation(files: DataFrame) -> DataFrame:
    return obfuscation_lines(lines(readable(files, R.TEXT_SUFFIXES))).unionByName(ast_calls(files))


def injection_found() -> Column:
    """In each group of patterns the first that occurs emits the stripped line."""
    shown = cut(strip(F.col("line")))
    return F.array(*(F.when(any_of(F.col("line"), _patterns(r)), finding("prompt_injection_detector", r.severity, r.id, r.description, F.col(NO), shown)) for r in R.INJECTION))


def injection_lines(rows: DataFrame) -> DataFrame:
    return exploded(rows, injection_found())


def injection_files(files: DataFrame) -> DataFrame:
    """Broad permissions declared anywhere in a file; a pattern may cross a line end, so the whole text is searched."""
    rule, severity, description, shown = R.FRONT_MATTER_RULE
    hit = any_of(F.col("content"), [rx(p, ignore_case=i, multiline=True) for p, i in R.FRONT_MATTER])
    rows = readable(files, R.PROSE_SUFFIXES)
    return exploded(rows, F.array(F.when(hit, finding("prompt_injection_detector", severity, rule, description, F.lit(1), shown))))


def injection(files: DataFrame) -> DataFrame:
    return injection_lines(lines(readable(files, R.PROSE_SUFFIXES))).unionByName(injection_files(files))


def credential_found() -> Column:
    """Tokens in the formats that their issuers document: an own detector, every rule emits its first match."""
    found = []
    for r in R.CREDENTIALS:
        match = F.coalesce(*(first_match(F.col("line"), p) for p in _patterns(r)))
        found.append(F.when(match.isNotNull(), finding("credential_detector", r.severity, r.id, r.description, F.col(NO), match)))
    return F.array(*found)


def credential_lines(rows: DataFrame) -> DataFrame:
    return exploded(rows, credential_found())


def credentials(files: DataFrame) -> DataFrame:
    return credential_lines(lines(readable(files, R.WIDE_SUFFIXES)))


def private_address(url: Column) -> Column:
    """Whether an http(s) URL with a dotted quad points to a private or loopback address."""
    part = [F.translate(F.regexp_extract(url, rx(R.RAW_IP), i), *DIGITS).try_cast("int") for i in (1, 2)]
    return (part[0] == 10) | (part[0] == 127) | ((part[0] == 172) & part[1].between(16, 31)) | ((part[0] == 192) & (part[1] == 168))


def raw_address_found() -> Column:
    """NET_001: the first public address of each line."""
    public = F.filter(F.regexp_extract_all("line", F.lit(rx(R.RAW_IP)), F.lit(0)), lambda u: ~private_address(u))
    text = "Raw public IP address in network call — suspicious hardcoded destination"
    return F.transform(F.slice(public, 1, 1), lambda u: finding("network_destination_analyzer", "high", "NET_001", text, F.col(NO), cut(u)))


def raw_addresses(rows: DataFrame) -> DataFrame:
    return exploded(rows, raw_address_found())


def endpoint_found() -> Column:
    """NET_002: the first pattern that occurs; if what it matches is a private address, later ones are not tried."""
    line = F.col("line")
    first = F.coalesce(*(F.when(line.rlike(rx(p)), F.regexp_extract(line, rx(p), 0)) for p in R.ENDPOINTS))
    told = F.filter(F.array(first), lambda u: u.isNotNull() & ~F.when(u.rlike(rx(R.RAW_IP)), private_address(u)).otherwise(F.lit(False)))
    return F.transform(told, lambda u: finding("network_destination_analyzer", "critical", "NET_002", "Known data exfiltration or tunneling endpoint detected", F.col(NO), cut(u)))


def endpoints(rows: DataFrame) -> DataFrame:
    return exploded(rows, endpoint_found())


def domain_found() -> Column:
    """NET_003: the first URL of each line to a high-risk domain or a domain below one, unless that is allowed."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, rx(R.URL), 1)), r"^www\.", "")

    def below(h: Column, names: list[str]) -> Column:
        labels = F.split(h, r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        return F.arrays_overlap(suffixes, F.array(*map(F.lit, names)))

    # a name that ends in a dot or begins with one isn't equal to any suffix of a listed name, as it should be
    urls = F.regexp_extract_all("line", F.lit(rx(R.URL)), F.lit(0))
    risky = F.filter(urls, lambda u: ~below(host(u), R.ALLOWED_DOMAINS) & below(host(u), R.RISKY_DOMAINS))
    text = lambda u: F.concat(F.lit("Network call to known high-risk domain: '"), host(u), F.lit("'"))
    return F.transform(F.slice(risky, 1, 1), lambda u: finding("network_destination_analyzer", "critical", "NET_003", text(u), F.col(NO), cut(u)))


def domains(rows: DataFrame) -> DataFrame:
    return exploded(rows, domain_found())


def network_found() -> Column:
    """All three network rules; lines without a URL are passed over."""
    found = F.concat(raw_address_found(), endpoint_found(), domain_found())
    return F.when(F.col("line").contains("http"), found).otherwise(no_findings())


def network(files: DataFrame) -> DataFrame:
    return exploded(lines(readable(files, R.WIDE_SUFFIXES)), network_found())


#: Detectors that judge each line by itself, with the suffixes of the files they read.
BY_LINE = {"credential_detector": (R.WIDE_SUFFIXES, credential_found), "obfuscation_detector": (R.TEXT_SUFFIXES, obfuscation_found), "network_destination_analyzer": (R.WIDE_SUFFIXES, network_found), "prompt_injection_detector": (R.PROSE_SUFFIXES, injection_found)}


def by_line(files: DataFrame) -> DataFrame:
    """What all detectors of BY_LINE find, in one pass over the files and their lines."""
    found = []
    for suffixes, rule in BY_LINE.values():
        found.append(F.when(F.col("suffix").isin(suffixes), rule()).otherwise(no_findings()))
    return exploded(lines(readable(files, R.WIDE_SUFFIXES)), F.concat(*found))


def exfiltration_lines(rows: DataFrame) -> DataFrame:
    """A line that reads, and the nearest line from it to 19 below that sends.  Only lines that do either are shuffled."""
    kind = F.lit(None).cast("string")
    for name, patterns in reversed(R.READS.items()):
        kind = F.when(any_of(F.col("line"), [rx(p) for p in patterns]), name).otherwise(kind)
    hits = rows.withColumn("_read", kind).withColumn("_send", any_of(F.col("line"), [rx(p) for p in R.SENDS])).where("_read is not null or _send")
    ahead = Window.partitionBy("skill_id", "file_path").orderBy("line_no").rangeBetween(0, R.LOOK_AHEAD - 1)
    hits = hits.withColumn("_to", F.min(F.when(F.col("_send"), F.col(NO))).over(ahead)).where("_read is not null and _to is not null")
    text = F.concat(F.lit("Potential data exfiltration — "), F.col("_read"), F.lit(" on line "), F.col(NO).cast("string"), F.lit(" followed by network send on line "), F.col("_to").cast("string"))
    return exploded(hits, F.array(finding("exfiltration_detector", "critical", "EXFIL_001", text, F.col(NO), cut(strip(F.col("line"))))))


def exfiltration(files: DataFrame) -> DataFrame:
    return exfiltration_lines(lines(readable(files, R.WIDE_SUFFIXES)))
