"""Detectors that judge a skill as a whole: the tree itself, declared permissions, its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import rules as R
from tracewarden.functions.text import any_of, lines as text_lines, rx, strip
from tracewarden.operators import similar_names
from tracewarden.operators.corpus import lines, readable, root_manifest, skills
from tracewarden.operators.findings import exploded, finding


def pre_flight(files: DataFrame) -> DataFrame:
    """RUN_001 each symbolic link, RUN_002 no regular file, RUN_003 the smallest path more than ten levels deep."""
    zero = F.lit(0)
    links = files.where("is_symlink")
    links = exploded(links, F.array(finding("runner", "high", "RUN_001", "Symlink detected — potential path traversal risk", zero, F.coalesce("symlink_target", F.lit("")))))
    regular = files.where("is_file and not is_symlink").select("skill_id").distinct()
    empty = skills(files).join(regular, "skill_id", "left_anti").withColumn("file_path", F.lit("."))
    empty = exploded(empty, F.array(finding("runner", "medium", "RUN_002", "Skill directory contains no scannable files", zero, "empty")))
    deep = files.where("depth > 10").groupBy("skill_id").agg(F.min(F.struct("file_path", "depth")).alias("d"))
    deep = deep.select("skill_id", "d.file_path", F.col("d.depth").cast("string").alias("depth"))
    text = F.concat(F.lit("Excessive directory nesting depth ("), F.col("depth"), F.lit(" levels) — potential zip bomb"))
    deep = exploded(deep, F.array(finding("runner", "low", "RUN_003", text, zero, F.col("depth"))))
    return links.unionByName(empty).unionByName(deep)


def restrictions(files: DataFrame) -> DataFrame:
    """(skill_id, permission): what a root SKILL.md says the skill doesn't use."""
    text = F.lower(F.coalesce("content", F.lit("")))

    def said(phrases: list[str]) -> Column:
        hit = F.contains(text, F.lit(phrases[0]))
        for p in phrases[1:]:
            hit = hit | F.contains(text, F.lit(p))
        return hit

    found = F.array_compact(F.array(*(F.when(said(p), F.lit(k)) for k, p in R.RESTRICTIONS.items())))
    return root_manifest(files).select("skill_id", F.explode(found).alias("permission"))


def behaviour(files: DataFrame) -> DataFrame:
    """(skill_id, permission, file_path, line_no): lines of code that use a permission."""
    rows = lines(readable(files, R.TEXT_SUFFIXES).where("name <> 'SKILL.md'"))
    used = F.array_compact(F.array(*(F.when(any_of(F.col("line"), [rx(p) for p in ps]), F.lit(k)) for k, ps in R.BEHAVIOUR.items())))
    return rows.select("skill_id", F.explode(used).alias("permission"), "file_path", "line_no")


def permissions(files: DataFrame) -> DataFrame:
    none = skills(files).join(root_manifest(files).select("skill_id"), "skill_id", "left_anti").withColumn("file_path", F.lit("SKILL.md"))
    none = exploded(none, F.array(finding("permission_scanner", "high", "PERM_000", "SKILL.md not found — cannot verify declared permissions", F.lit(0), "missing")))
    broken = behaviour(files).join(restrictions(files), ["skill_id", "permission"], "left_semi")
    p = F.col("permission")
    rule = F.concat(F.lit("PERM_"), F.upper(F.substring(p, 1, 3)), F.lit("_001"))
    text = F.concat(F.lit("Skill declares no "), p, F.lit(" access but code exhibits "), p, F.lit(" behavior"))
    broken = exploded(broken, F.array(finding("permission_scanner", "critical", rule, text, F.col("line_no"), F.concat(F.lit("undeclared "), p, F.lit(" usage")))))
    return none.unionByName(broken)


def skill_names(files: DataFrame) -> DataFrame:
    """(skill_id, skill_name): the first heading of the root SKILL.md, else the folder's name; null without a readable SKILL.md."""
    heads = F.filter(F.transform(text_lines(F.col("content")), strip), lambda x: x.startswith("#"))
    head = F.get(heads, F.lit(0))
    head = F.replace(F.lower(strip(F.regexp_replace(head, "^#+", ""))), F.lit(" "), F.lit("-"))
    folder = F.lower(F.element_at(F.split(F.col("skill_id").cast("string"), "/"), -1))
    names = root_manifest(files).where("content is not null").select("skill_id", F.coalesce(head, folder).alias("skill_name"))
    return skills(files).join(names, "skill_id", "left")


def candidates(name: Column) -> Column:
    """Forms of a name to compare, in order: look-alike letters replaced; its version cut off; digits read as letters."""
    plain = F.translate(F.lower(name), *R.LOOK_ALIKES)
    short = F.regexp_replace(F.regexp_replace(plain, rx(R.VERSION_SUFFIX), ""), "[-_]+$", "")
    letters = F.translate(plain, *R.DIGITS_AS_LETTERS)
    return F.array_compact(F.array(plain, F.when((short != plain) & (short != ""), short), F.when(letters != plain, letters)))


def look_alikes(names: DataFrame) -> DataFrame:
    """(skill_id, skill_name, known, distance) for each known name that a form of the skill's name is one or two edits from.

    A known name that one of the forms equals is passed over.  The known names are a fixed list, so they
    are an array beside each name, not a join.
    """
    rows = names.where("skill_name is not null").withColumn("_forms", candidates(F.col("skill_name")))
    rows = rows.withColumn("known", F.explode(F.array(*map(F.lit, R.KNOWN_SKILLS)))).where(~F.array_contains("_forms", F.col("known")))
    far = F.filter(F.transform("_forms", lambda c: F.levenshtein(c, F.col("known"), 2)), lambda d: d.between(1, 2))
    rows = rows.withColumn("distance", F.get(far, F.lit(0))).where("distance is not null")
    return rows.select("skill_id", "skill_name", "known", "distance")


def look_alikes_among(names: DataFrame, known: DataFrame, most: int = similar_names.MOST) -> DataFrame:
    """``look_alikes`` of a list ``known`` (known) that may be as long as the registry: forms of names meet it by variants, not one by one."""
    forms = names.where("skill_name is not null").distinct().withColumn("_forms", candidates(F.col("skill_name")))
    forms = forms.select("skill_id", "skill_name", F.posexplode("_forms").alias("at", "form"))
    near = similar_names.neighbours(forms.select(F.col("form").alias("name")), known, most).withColumnRenamed("name", "form")
    near = forms.join(near, "form").groupBy("skill_id", "skill_name", "known").agg(F.min_by("distance", "at").alias("distance"))
    same = forms.join(known.select(F.col("known").alias("form")).distinct(), "form").select("skill_id", "skill_name", F.col("form").alias("known"))
    return near.join(same, ["skill_id", "skill_name", "known"], "left_anti").select("skill_id", "skill_name", "known", "distance")


def names(files: DataFrame) -> DataFrame:
    all_ = skill_names(files)
    root = F.lit("SKILL.md").alias("file_path")
    none = all_.where("skill_name is null").select("skill_id", root)
    none = exploded(none, F.array(finding("typosquat_checker", "medium", "TYPO_000", "Could not determine skill name — SKILL.md missing or has no heading", F.lit(0), "unknown")))
    near = look_alikes(all_).withColumn("file_path", root)
    text = F.concat(F.lit("Skill name '"), F.col("skill_name"), F.lit("' is suspiciously similar to known skill '"), F.col("known"), F.lit("' (edit distance "), F.col("distance").cast("string"), F.lit(")"))
    return none.unionByName(exploded(near, F.array(finding("typosquat_checker", "high", "TYPO_001", text, F.lit(1), F.col("skill_name")))))
