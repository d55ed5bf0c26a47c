"""SQL for the registered queries, to be run by another engine on the same tables."""

from __future__ import annotations

import re

from tracewarden.functions import rules as R
from tracewarden.functions import url
from tracewarden.plans import derived as D


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def _bools(values) -> str:
    return "[" + ", ".join("true" if x else "false" for x in values) + "]"


#: Windows of an hour anchored at each user's first request, followed one by one.
ANCHORED = """e as (select user_id as ip, ts, count(*) as n from events group by 1, 2),
nxt as (select a.ip, a.ts, min(b.ts) as nx from e a left join e b on a.ip = b.ip and a.ts + interval 1 hour <= b.ts group by 1, 2),
w as (select ip, min(ts) as s from e group by 1 union all select w.ip, nxt.nx from w join nxt on nxt.ip = w.ip and nxt.ts = w.s where nxt.nx is not null)"""


def _any(column: str, patterns, flags: str = "") -> str:
    return "(" + " or ".join(f"regexp_matches({column}, {q(p)}{', ' + q(flags) if flags else ''})" for p in patterns) + ")"


SUFFIX = "lower(regexp_extract(split_part(file_path, '/', -1), '^.+(\\.[^.]+)$', 1))"
CODE = f"""code as (
  select skill_id, file_path, row_number() over (partition by skill_id, file_path order by o_orderkey) as line_no, line, {SUFFIX} as suffix
  from (select o_orderkey, 's' || (o_custkey // {D.EACH}) as skill_id, {_list(D.PATHS)}[o_orderkey % {len(D.PATHS)} + 1] as file_path, {_list(D.SNIPPETS)}[(o_orderkey * 7 + o_custkey) % {len(D.SNIPPETS)} + 1] as line from orders)
)"""
_m = list(D.MANIFESTS.items())
MANIFEST = f"""manifest as (
  select skill_id, file_path, row_number() over (partition by skill_id, file_path order by o_orderkey) as line_no, line, trim(line) as s
  from (select o_orderkey, 's' || (o_custkey // {D.EACH}) as skill_id,
    case o_orderkey % {len(_m)} {' '.join(f'when {i} then {q(k)}' for i, (k, _) in enumerate(_m))} end as file_path,
    case o_orderkey % {len(_m)} {' '.join(f'when {i} then {_list(v)}[(o_orderkey * 3 + o_custkey) % {len(v)} + 1]' for i, (_, v) in enumerate(_m))} end as line from orders)
)"""
SKILLS = f"""skill as (select distinct c_custkey // {D.EACH} as k, 's' || (c_custkey // {D.EACH}) as skill_id from customer),
skill_md as (select skill_id, {_list(D.NAMES)}[(k * 3) % {len(D.NAMES)} + 1] as title, {_list(D.PHRASES)}[k % {len(D.PHRASES)} + 1] as phrase from skill where k % 10 <> 9)"""
#: Lines that are left of a file once its final line is empty: an empty last line is none.
WIDE, TEXT, PROSE = (f"suffix in {_in(x)}" for x in (R.WIDE_SUFFIXES, R.TEXT_SUFFIXES, R.PROSE_SUFFIXES))
NEAR = f"list_filter({_list(R.POPULAR)}, lambda p: levenshtein(pkg, p) <= 2)[1]"


def _obfuscation(rows: str) -> str:
    parts = []
    for r in R.OBFUSCATION:
        p = r.patterns[0]
        if r.id == "OBFS_024":  # no look-ahead in this engine: what follows the last call must not name a safe loader
            call = p[: p.index("(?!")]
            last = f"regexp_replace(line, {q('^.*' + call)}, '')"
            parts.append(f"select *, '{r.id}' as rule_id, '{r.severity}' as severity, regexp_extract(line, {q(call)}) as m from {rows} where regexp_matches(line, {q(call)}) and not regexp_matches({last}, {q('Loader\\s*=\\s*.*Safe')})")
        else:
            parts.append(f"select *, '{r.id}' as rule_id, '{r.severity}' as severity, regexp_extract(line, {q(p)}) as m from {rows} where regexp_matches(line, {q(p)})")
    return " union all ".join(parts)


def _short(source: str, match: str = "m", line: str = "line_no") -> str:
    return f"select skill_id, rule_id, severity, file_path, cast({line} as integer) as line_number, {match} as match from ({source})"


def _dep(pkg: str, source: str, where: str, line: str, shown: str = "pkg") -> str:
    """DEP_001 and DEP_002 of rows with ``pkg``."""
    rows = f"(select * from (select *, {pkg} as pkg from {source}) where {where})"
    return (
        f"select *, 'DEP_001' as rule_id, 'critical' as severity, {shown} as m, {line} as ln from {rows} where pkg in {_in(R.MALICIOUS)}"
        f" union all select *, 'DEP_002', 'high', {shown}, {line} from {rows} where {NEAR} <> pkg"
    )


def _private(u: str) -> str:
    one, two = (f"try_cast(regexp_extract({u}, {q(R.RAW_IP)}, {i}) as integer)" for i in (1, 2))
    return f"({one} in (10, 127) or ({one} = 172 and {two} between 16 and 31) or ({one} = 192 and {two} = 168))"


#: The lines of the corpus that parse as Python and call something that tells, with what is to be said of each, read off the rules by hand.
AST = ", ".join("({}, {}, {}, {})".format(*map(q, row)) for row in (
    ("result = eval (code)", "OBFS_AST_001", "critical", "eval(...)"),
    ("exec(code)", "OBFS_AST_001", "critical", "exec(...)"),
    ("exec(open(__file__).read())", "OBFS_AST_001", "critical", "exec(...)"),
    ("m = __import__('os')", "OBFS_AST_002", "high", "__import__(...)"),
    ("__import__('os').system('ls')", "OBFS_AST_002", "high", "__import__(...)"),
    ("base64 . b64decode(data)", "OBFS_AST_003", "high", "base64.b64decode(...)"),
))
PAGES = f"rows_ as (select skill_id, file_path, line_no, line from code where {WIDE} union all select 'p' || page_id, 'url.txt', 1, url from pages where url <> '')"


def _below(host: str, names: list[str]) -> str:
    return "(" + " or ".join(f"{host} = {q(n)} or ends_with({host}, {q('.' + n)})" for n in names) + ")"


FINDINGS = f"""found as (
  select l_suppkey % 50 as skill_id, {_list(R.DETECTORS)}[l_partkey % 5 + 1] as detector,
    case when l_returnflag = 'A' then 'critical' when l_returnflag = 'N' then 'high' when l_linestatus = 'F' then 'medium' else 'low' end as severity,
    'R' || (l_partkey % 5) as rule_id, 'f' || (l_partkey % 40) as file_path, cast(l_orderkey % 50 as integer) as line_number, l_orderkey || '/' || l_linenumber as match, l_orderkey, l_linenumber from lineitem),
fifty as (select distinct s_suppkey % 60 as skill_id from supplier)"""
LEVEL = lambda s: f"case when {s} = 0 then 'none' when {s} <= 10 then 'low' when {s} <= 30 then 'medium' when {s} <= 60 then 'high' else 'critical' end"
SCORE = "cast(floor(o_totalprice) as bigint) % 90"
REGISTRY = f"""rep as (select o_orderkey as id, o_custkey as skill, {SCORE} as score, {LEVEL(SCORE)} as level, o_orderstatus = 'F' as passed, o_orderdate as ts from orders where o_orderstatus <> 'O'),
newest as (select * from (select *, row_number() over (partition by skill order by ts desc, id desc) as n from rep) where n = 1),
sub as (select o_orderkey as id, o_custkey as skill, case o_orderstatus when 'F' then 'COMPLETE' when 'P' then 'REJECTED' else 'PENDING' end as status, o_orderdate as ts from orders),
last_sub as (select * from (select *, row_number() over (partition by skill order by ts desc, id desc) as n from sub) where n = 1),
fnd as (select l_orderkey as report, count(*) as n, string_agg(l_linenumber || l_returnflag, ',' order by l_linenumber, l_returnflag, l_linestatus) as rules from lineitem group by 1)"""


def _exfiltration() -> str:
    kind = " ".join(f"when {_any('line', p)} then {q(k)}" for k, p in R.READS.items())
    return f"""with {CODE}, hit as (select *, case {kind} end as rd, {_any('line', R.SENDS)} as snd from code where {WIDE})
select a.skill_id, a.file_path, cast(a.line_no as integer) as line_number, 'Potential data exfiltration — ' || a.rd || ' on line ' || a.line_no || ' followed by network send on line ' || min(b.line_no) as description, left(trim(a.line), 80) as match
from hit a join hit b on a.skill_id = b.skill_id and a.file_path = b.file_path and b.snd and b.line_no between a.line_no and a.line_no + {R.LOOK_AHEAD - 1}
where a.rd is not null group by a.skill_id, a.file_path, a.line_no, a.rd, a.line"""


def _injection(rows: str) -> str:
    return " union all ".join(f"select *, '{r.id}' as rule_id, '{r.severity}' as severity, left(trim(line), 80) as m from {rows} where {_any('line', r.patterns, 'i')}" for r in R.INJECTION)


def _credentials(rows: str) -> str:
    parts = []
    for r in R.CREDENTIALS:
        flag = ", 'i'" if r.ignore_case else ""
        first = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {q(p)}, 0{flag}), '')" for p in r.patterns) + ")"
        parts.append(f"select *, '{r.id}' as rule_id, '{r.severity}' as severity, left({first}, 80) as m from {rows} where {first} is not null")
    return " union all ".join(parts)


#: All lines of the whole corpus under the name of those of its code, each line of Python a file.
WHOLE = f"""code as (select *, {SUFFIX} as suffix from (with {CODE.replace('code as', 'own as', 1)}, {MANIFEST}, {SKILLS}
  select skill_id, case when suffix = '.py' then 'l' || line_no || '.py' else file_path end as file_path, case when suffix = '.py' then 1 else line_no end as line_no, line from own
  union all select skill_id, file_path, line_no, line from manifest
  union all select skill_id, 'package.json', 1, {_list(D.NPM)}[k % {len(D.NPM)} + 1] from skill
  union all select skill_id, 'setup.py', 1, {_list(D.SETUP)}[k % {len(D.SETUP)} + 1] from skill
  union all select skill_id, 'SKILL.md', n, case n when 1 then '---' when 3 then '# ' || title when 5 then phrase else '' end from skill_md, range(1, 6) r(n)))"""
#: Detectors that judge lines, by the queries that run them; the severity where a query doesn't tell it.
LINEWISE = {"regex_rules_obfs": "severity", "ast_calls": "severity", "first_pattern_wins": "severity", "whole_file_rule": "severity", "credential_lines": "severity", "dep_runtime": "severity", "network_raw_ip": "severity", "network_ordered": "severity", "network_domain": "'critical'", "exfil_lookahead": "'critical'"}


def _audit(sql: dict[str, str]) -> str:
    """The verdict on each skill: what the detectors' own SQL finds in the lines of the whole corpus, in its manifests and in names, added up."""
    found = [f"select skill_id, {severity} as severity from ({sql[k].replace(CODE, WHOLE, 1)}) where skill_id like 's%'" for k, severity in LINEWISE.items()]
    found += [f"select skill_id, severity from ({v})" for k, v in sql.items() if k.startswith("dep_") and k != "dep_runtime"]
    found.append(f"select skill_id, unnest(case rule_id when 'PERM_000' then ['high', 'medium'] else [severity] end) from ({sql['permission_violation']})")  # nor has such a skill a name
    found.append(f"select 's' || -skill_id, 'high' from ({sql['typosquat_names']}) where skill_id <= 0")
    weight = "case severity " + " ".join(f"when '{k}' then {v}" for k, v in R.WEIGHTS.items()) + " end"
    return f"""with f as ({' union all '.join(found)}), s as (select skill_id, cast(sum({weight}) as bigint) as sc, count(*) as n from f group by 1),
every as (with {WHOLE} select distinct skill_id from code)
select skill_id, n is null as passed, coalesce(sc, 0) as risk_score, {LEVEL('coalesce(sc, 0)')} as risk_level, coalesce(n, 0) as total_findings from every left join s using (skill_id)"""


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    return found | {"audit_reports": _audit(found)}


def _oracle_sql() -> dict[str, str]:
    perm = " union all ".join(f"select {q(k)} as permission, skill_id, file_path, line_no from all_lines where {_any('line', p)}" for k, p in R.BEHAVIOUR.items())
    said = " union all ".join(f"select skill_id, {q(k)} as permission from skill_md where " + " or ".join(f"contains(lower('---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || phrase || chr(10)), {q(p)})" for p in ps) for k, ps in R.RESTRICTIONS.items())
    manifest_text = f"select skill_id, file_path, line_no, line, {SUFFIX} as suffix from manifest"
    req = "(select *, lower(trim(regexp_split_to_array(regexp_replace(trim(split_part(s, '#', 1)), '\\[.*?\\]', '', 'g'), '[>=<!;,\\s]')[1])) as pkg, s like 'git+%' or s like 'http://%' or s like 'https://%' as url, contains(s, '--index-url') or contains(s, '--extra-index-url') as idx from manifest where file_path = 'requirements.txt')"
    ok = f"(select * from {req} where not url and not idx and not (s like '#%' or s like '-%') and pkg <> '')"
    good = f"(select * from {ok} where pkg not in {_in(R.MALICIOUS)})"
    requirements = " union all ".join([
        f"select *, 'DEP_005' as rule_id, 'high' as severity, left(s, 80) as m from {req} where url",
        f"select *, 'DEP_006', 'high', left(s, 80) from {req} where not url and idx",
        f"select *, 'DEP_001', 'critical', pkg from {ok} where pkg in {_in(R.MALICIOUS)}",
        f"select *, 'DEP_003', 'low', pkg from {good} where not regexp_matches(split_part(line, '#', 1), '[>=<!]')",
        f"select *, 'DEP_002', 'high', pkg from {good} where {NEAR} <> pkg",
        f"select *, 'DEP_008', 'medium', pkg from {good} where {_any('pkg', R.ODD_NAMES)}",
    ])
    toml_state = f"(select *, last_value(case when s in {_in(D.TOML[:0] + R.TOML_SECTIONS)} then true when s like '[%' and s like '%]' then false end ignore nulls) over (partition by skill_id, file_path order by line_no) as inside, s in {_in(R.TOML_SECTIONS)} or (s like '[%' and s like '%]') as head, lower(regexp_extract(s, '^([a-zA-Z0-9_\\-]+)\\s*=', 1)) as pkg0 from manifest where file_path = 'pyproject.toml')"
    toml = f"(select distinct skill_id, file_path, pkg0 from {toml_state} where inside and not head and pkg0 <> '')"
    pip = f"(select *, lower(regexp_extract(line, '^([a-zA-Z0-9_\\-]+)\\s*=', 1)) as pkg0 from manifest where file_path = 'Pipfile')"
    conda = "(select *, bool_or(s = 'dependencies:') over (partition by skill_id, file_path order by line_no) as inside from manifest where file_path = 'environment.yml')"
    setup = f"(select skill_id, 'setup.py' as file_path, unnest(regexp_extract_all(lst, '[''\"]([^''\"]+)[''\"]', 1)) as raw from (select skill_id, unnest(regexp_extract_all({_list(D.SETUP)}[k % {len(D.SETUP)} + 1], 'install_requires\\s*=\\s*\\[(.*?)\\]', 1)) as lst from skill))"
    names = f"""select p_partkey as skill_id, lower(replace(p_name, ' ', '-')) as skill_name from part union all
  select cast('-' || substr(skill_id, 2) as bigint), lower(replace(title, ' ', '-')) from skill_md"""
    forms = f"""select skill_id, skill_name, list_filter([skill_name, case when short <> skill_name and short <> '' then short end, case when letters <> skill_name then letters end], lambda x: x is not null) as forms from (
  select *, rtrim(regexp_replace(skill_name, {q(R.VERSION_SUFFIX)}, ''), '-_') as short, translate(skill_name, {q(R.DIGITS_AS_LETTERS[0])}, {q(R.DIGITS_AS_LETTERS[1])}) as letters from n)"""
    npm = f"""doc as (select skill_id, {_list(D.NPM)}[k % {len(D.NPM)} + 1] as j from skill), good as (select skill_id, j from doc where json_valid(j)),
pairs as (select skill_id, sec, pos, key, json_extract_string(j, '$.' || sec || '."' || key || '"') as v from (select skill_id, j, sec, unnest(json_keys(j, '$.' || sec)) as key, unnest(range(len(json_keys(j, '$.' || sec)))) as pos from good, (values ('dependencies'), ('devDependencies'), ('optionalDependencies')) t(sec))),
merged as (select skill_id, key, arg_max(v, (case sec when 'dependencies' then 0 when 'devDependencies' then 1 else 2 end) * 1000 + pos) as v, min((case sec when 'dependencies' then 0 when 'devDependencies' then 1 else 2 end) * 1000 + pos) as first from pairs group by 1, 2),
placed as (select *, 'package.json' as file_path, row_number() over (partition by skill_id order by first) as ln, lower(regexp_replace(key, '^@[^/]+/', '')) as pkg from merged)
select skill_id, rule_id, severity, file_path, cast(ln as integer) as line_number, m as match from (
  select *, 'DEP_001' as rule_id, 'critical' as severity, key as m from placed where pkg in {_in(R.MALICIOUS)}
  union all select *, 'DEP_004', 'medium', key || '@' || v from placed where pkg not in {_in(R.MALICIOUS)} and trim(v) in ('*', 'latest', '')
  union all select *, 'DEP_002', 'high', key from placed where pkg not in {_in(R.MALICIOUS)} and {NEAR} <> pkg)"""
    first_endpoint = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {q(p)}), '')" for p in R.ENDPOINTS) + ")"
    host = f"regexp_replace(lower(regexp_extract(u, {q(R.URL)}, 1)), '^www\\.', '')"
    return {
        "line_explode": "select doc_id, cast(i as bigint) as line_no, cast(length(l) as bigint) as n_chars, md5(l) as digest from (select doc_id, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as i from (select doc_id, case when p[-1] = '' then p[:-2] else p end as ls from (select doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') as p from documents)))",
        "regex_rules_obfs": f"with {CODE} " + _short(_obfuscation(f"(select * from code where {TEXT})"), "left(m, 80)"),
        "ast_calls": f"with {CODE}, told as (select * from (values {AST}) t(line, rule_id, severity, match)) select skill_id, rule_id, severity, 'l' || line_no || '.py' as file_path, cast(1 as integer) as line_number, match from code join told using (line) where suffix = '.py'",
        "first_pattern_wins": f"with {CODE}, rows_ as (select skill_id, file_path, line_no, line from code where {PROSE} union all select 'c' || conv_id, turn || '.md', i, l from (select conv_id, turn, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from conversations)) " + _short(_injection("rows_")),
        "whole_file_rule": f"with {CODE} select distinct skill_id, 'INJECT_005' as rule_id, 'high' as severity, file_path, 1 as line_number, {q(R.FRONT_MATTER_RULE[3])} as match from code where {PROSE} and (" + " or ".join(f"regexp_matches(line, {q(p)}{', ' + q('i') if i else ''})" for p, i in R.FRONT_MATTER) + ")",
        "exfil_lookahead": _exfiltration(),
        "network_raw_ip": f"with {CODE}, {PAGES} select skill_id, 'NET_001' as rule_id, 'high' as severity, file_path, cast(line_no as integer) as line_number, left(u[1], 80) as match from (select *, list_filter(regexp_extract_all(line, {q(R.RAW_IP)}), lambda x: not {_private('x')}) as u from rows_) where len(u) > 0",
        "network_ordered": f"with {CODE}, {PAGES} select skill_id, 'NET_002' as rule_id, 'critical' as severity, file_path, cast(line_no as integer) as line_number, left(f, 80) as match from (select *, {first_endpoint} as f from rows_) where f is not null and not (regexp_matches(f, {q(R.RAW_IP)}) and {_private('f')})",
        "network_domain": f"with {CODE}, {PAGES}, u as (select skill_id, file_path, line_no, unnest(us) as u, unnest(range(len(us))) as i from (select *, regexp_extract_all(line, {q(R.URL)}) as us from rows_)), h as (select *, {host} as host from u), r as (select *, row_number() over (partition by skill_id, file_path, line_no order by i) as n from h where {_below('host', R.RISKY_DOMAINS)} and not {_below('host', R.ALLOWED_DOMAINS)}) select skill_id, file_path, cast(line_no as integer) as line_number, 'Network call to known high-risk domain: ''' || host || '''' as description, left(u, 80) as match from r where n = 1",
        "permission_violation": f"with {CODE}, {MANIFEST}, {SKILLS}, all_lines as (select skill_id, file_path, line_no, line from code where {TEXT} union all select skill_id, file_path, line_no, line from ({manifest_text}) where {TEXT} union all select skill_id, 'setup.py', 1, {_list(D.SETUP)}[k % {len(D.SETUP)} + 1] from skill union all select skill_id, 'package.json', 1, {_list(D.NPM)}[k % {len(D.NPM)} + 1] from skill), use as ({perm}), said as ({said}) select skill_id, 'PERM_' || upper(left(permission, 3)) || '_001' as rule_id, 'critical' as severity, file_path, cast(line_no as integer) as line_number, 'undeclared ' || permission || ' usage' as match from use semi join said using (skill_id, permission) union all select skill_id, 'PERM_000', 'high', 'SKILL.md', 0, 'missing' from (select distinct skill_id from (select skill_id from code union all select skill_id from skill union all select skill_id from manifest) anti join skill_md using (skill_id))",
        "typosquat_names": f"with {SKILLS}, n as ({names}), f as ({forms}), k as (select unnest({_list(R.KNOWN_SKILLS)}) as known) select skill_id, skill_name, known, list_filter(list_transform(forms, lambda x: levenshtein(x, known)), lambda x: x between 1 and 2)[1] as distance from f, k where not list_contains(forms, known) and len(list_filter(forms, lambda x: levenshtein(x, known) between 1 and 2)) > 0",
        "dep_requirements": f"with {MANIFEST} " + _short(requirements),
        "dep_npm": f"with {SKILLS}, {npm}",
        "dep_setup": f"with {SKILLS} " + _short(_dep("lower(trim(regexp_split_to_array(raw, '[>=<!;\\[]')[1]))", setup, "pkg <> ''", "0"), line="ln"),
        "dep_pyproject": f"with {MANIFEST} " + _short(_dep("pkg0", toml, "true", "0"), line="ln"),
        "dep_pipfile": f"with {MANIFEST} " + _short(_dep("pkg0", pip, f"pkg <> '' and pkg not in {_in(R.PIPFILE_RESERVED)}", "0"), line="ln"),
        "dep_conda": f"with {MANIFEST} " + _short(_dep("lower(trim(split_part(ltrim(s, '- '), '=', 1)))", conda, "inside and s like '-%' and pkg <> '' and pkg not like '#%'", "line_no"), line="ln"),
        "dep_runtime": f"with {CODE} select skill_id, 'DEP_007' as rule_id, 'high' as severity, file_path, cast(line_no as integer) as line_number, left(trim(line), 80) as match from code where (file_path like '%.py' or file_path like '%.js') and regexp_matches(line, {q(R.RUNTIME_PIP)})",
        "credential_lines": f"with {CODE}, rows_ as (select skill_id, file_path, line_no, line from code where {WIDE} union all select 'd' || doc_id, 'a.txt', i, l from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)) " + _short(_credentials("rows_")),
        "preflight": f"""with e as (select 's' || (o_custkey // {D.EACH}) as skill_id, repeat('d/', cast(o_orderkey % 14 as bigint)) || 'f' || o_orderkey as file_path, o_orderkey % 14 + 1 as depth, o_orderkey % 11 = 0 as link, o_custkey // {D.EACH} % 8 = 7 as folder, o_orderkey from orders)
select skill_id, 'RUN_001' as rule_id, 'high' as severity, file_path, 'Symlink detected — potential path traversal risk' as description, '/t/' || o_orderkey as match from e where link
union all select skill_id, 'RUN_002', 'medium', '.', 'Skill directory contains no scannable files', 'empty' from e group by skill_id having not bool_or(not link and not folder)
union all select skill_id, 'RUN_003', 'low', min(file_path), 'Excessive directory nesting depth (' || arg_min(depth, file_path) || ' levels) — potential zip bomb', cast(arg_min(depth, file_path) as varchar) from e where depth > 10 group by skill_id""",
        "dedupe_first": f"with {FINDINGS} select skill_id, file_path, line_number, rule_id, match from (select *, row_number() over (partition by skill_id, file_path, line_number, rule_id order by l_orderkey, l_linenumber) as n from found) where n = 1",
        "risk_score": f"with {FINDINGS}, s as (select skill_id, cast(sum(case severity when 'critical' then 40 when 'high' then 20 when 'medium' then 10 else 5 end) as bigint) as sc, count(*) as n from found group by 1) select skill_id, coalesce(n, 0) = 0 as passed, coalesce(sc, 0) as risk_score, {LEVEL('coalesce(sc, 0)')} as risk_level, coalesce(n, 0) as total_findings from fifty left join s using (skill_id)",
        "risk_level": f"select distinct o_orderkey % 71 as score, {LEVEL('o_orderkey % 71')} as risk_level from orders",
        "summary_by_detector": f"with {FINDINGS}, d as (select unnest({_list(R.DETECTORS)}) as detector) select s.skill_id, d.detector, count(f.severity) = 0 as passed, count(f.severity) as findings, " + ", ".join(f"count(*) filter (where f.severity = '{x}') as {x}" for x in R.WEIGHTS) + " from fifty s cross join d left join found f on f.skill_id = s.skill_id and f.detector = d.detector group by 1, 2",
        "severity_pivot": f"with {FINDINGS} select skill_id, " + ", ".join(f"count(*) filter (where severity = '{x}') as {x}" for x in R.WEIGHTS) + " from found group by 1",
        "latest_report": f'with {REGISTRY} select skill as "skillId", id, score as "riskScore", level as "riskLevel", passed from newest',
        "directory_listing": f'with {REGISTRY} select c_custkey as id, c_name as name, score as "riskScore", level as "riskLevel", passed from customer left join newest on skill = c_custkey',
        "skill_detail": f"with {REGISTRY} select c_custkey as id, c_name as name, r.id as report_id, r.score as risk_score, coalesce(f.n, 0) as n_findings, f.rules, s.status from customer left join newest r on r.skill = c_custkey left join fnd f on f.report = r.id left join last_sub s on s.skill = c_custkey",
        "badge": f"with {REGISTRY} select c_custkey as id, case when passed then 'verified' else coalesce(level, 'unknown') end as label, case when passed then '#22c55e' else '#ef4444' end as color from customer left join newest on skill = c_custkey",
        "directory_totals": f"with {REGISTRY} select count(*) as skills, count(*) filter (where passed) as verified from customer left join newest on skill = c_custkey",
        "risk_badges": f"with {REGISTRY} select id, case when passed then 'VERIFIED' else upper(level) end as text, case when passed then 'verified' when level in ('critical', 'high', 'medium') then level else 'low' end as style from rep",
        "detector_labels": f"with {FINDINGS} select case detector when 'credential_detector' then 'cred' when 'obfuscation_detector' then 'obfs' when 'permission_scanner' then 'perm' when 'typosquat_checker' then 'typo' when 'dependency_scanner' then 'deps' else detector end as label, count(*) as findings from found group by 1",
        "submission_status": f'with {REGISTRY} select s.id, s.status, r.level as "riskLevel", r.passed, case when r.id is null then 0 else coalesce(f.n, 0) end as n_findings from sub s left join rep r on r.id = s.id left join fnd f on f.report = r.id',
        "validate_submission": """select id, case when length(trim(coalesce(name, ''))) < 2 then 'name must be at least 2 characters' when length(trim(description)) < 10 then 'description must be at least 10 characters' when length(author) < 2 then 'author must be at least 2 characters'
 when url is null then 'repositoryUrl is required' when url = 'nothing' then 'repositoryUrl must be a valid URL' when lower(url) not like 'http%' then 'repositoryUrl must be a valid http or https URL' end as error from (
 select c_custkey as id, ['  a ', 'a skill', ' ok ', null][c_custkey % 4 + 1] as name, ['too short', 'long enough text', '   spaces    '][c_custkey % 3 + 1] as description, ['x', 'an author'][c_custkey % 2 + 1] as author, ['https://x.example/y', 'ftp://x', 'nothing', null, 'HTTP://X.EXAMPLE'][c_custkey % 5 + 1] as url from customer)""",
        "uuid_filter": "select c_custkey, case when c_custkey % 3 = 0 then upper(u) else u end as uuid from (select c_custkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) as u from (select c_custkey, md5(c_name) as m from customer)) where c_custkey % 3 <> 1",
        "rate_limit_window": "select user_id as ip, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as requests, count(*) > 5 as over from events group by 1, 2",
        "rate_limit_all": "select 'all' as ip, strftime(time_bucket(interval '15 minutes', ts - to_days(cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer))), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as requests, count(*) > 100 as over from events group by 2",
        "validate_urls": f"select c_custkey as id, {_bools(ok for _, ok in url.EXAMPLES)}[c_custkey % {len(url.EXAMPLES)} + 1] as valid, {_bools(re.match('https?:', u.strip().replace(chr(9), '').replace(chr(10), ''), re.I) for u, _ in url.EXAMPLES)}[c_custkey % {len(url.EXAMPLES)} + 1] as http from customer",
        "rate_limit_anchored": f"with recursive {ANCHORED} select ip, strftime(s, '%Y-%m-%d %H:%M:%S.%f') as window_start, cast(n as bigint) as requests, cast(greatest(n - 5, 0) as bigint) as refused from (select w.ip, w.s, sum(e.n) as n from w join e on e.ip = w.ip and e.ts >= w.s and e.ts < w.s + interval 1 hour group by 1, 2)",
        "rate_limit_decisions": f"with recursive {ANCHORED} select event_id, nth, nth <= 5 as allowed from (select event_id, row_number() over (partition by v.user_id, w.s order by v.ts, event_id) as nth from events v join w on v.user_id = w.ip and v.ts >= w.s and v.ts < w.s + interval 1 hour)",
        "submission_machine": f"""with recursive e as (select user_id * 100 + event_id % 17 as sub, {_list(['PENDING', 'AUDITING', 'COMPLETE', 'REJECTED', 'AUDITING', 'PENDING', 'ERROR'])}[event_id * 5 % 7 + 1] as event, row_number() over (partition by user_id * 100 + event_id % 17 order by ts, event_id) as n from events),
r as (select distinct sub, cast(0 as bigint) as n, cast(null as varchar) as st, cast(0 as bigint) as acc from e
  union all select sub, n, coalesce(nx, st), acc + (nx is not null)::int from (select r.sub, e.n, r.st, r.acc, case when r.st is null and event = 'PENDING' then 'PENDING' when r.st = 'PENDING' and event = 'AUDITING' then 'AUDITING' when r.st = 'AUDITING' and event in ('COMPLETE', 'REJECTED') then event when r.st in ('PENDING', 'AUDITING') and event = 'ERROR' then 'REJECTED' end as nx from r join e on e.sub = r.sub and e.n = r.n + 1))
select sub as submission_id, arg_max_null(st, n) as status, max(acc) as accepted, max(n) - max(acc) as refused from r group by sub""",
        "name_neighbours": "with n as (select distinct lower(replace(p_name, ' ', '-')) || '-' || substr(md5(cast(p_partkey as varchar)), 1, 4) as name from part) select a.name, b.name as known, levenshtein(a.name, b.name) as distance from n a, n b where a.name <> b.name and abs(length(a.name) - length(b.name)) <= 2 and levenshtein(a.name, b.name) <= 2",
        "findings_rollup": f"with {FINDINGS} select case grouping(detector, severity) when 0 then 'severity' when 1 then 'detector' else 'all' end as level, detector, severity, count(*) as findings, count(distinct skill_id) as skills, cast(sum(case severity when 'critical' then 40 when 'high' then 20 when 'medium' then 10 else 5 end) as bigint) as weight from found group by rollup(detector, severity)",
        "ast_calls_lateral": f"with {CODE}, told as (select * from (values {AST}) t(line, rule_id, severity, match)) select skill_id, rule_id, severity, 'l' || line_no || '.py' as file_path, cast(1 as integer) as line_number, match from code join told using (line) where suffix = '.py'",
        "status_log": "select user_id as submission_id, arg_max(['PENDING', 'AUDITING', 'COMPLETE', 'REJECTED'][event_id % 4 + 1], (ts, event_id)) as status from events group by 1",
    }
