"""What every detector reads: files of skills, their lines, and the gates that choose files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import text

#: One row for each entry of a skill's tree; an empty tree still has its root, path ".".
FILES = "skill_id string, file_path string, name string, suffix string, depth int, is_file boolean, is_symlink boolean, symlink_target string, content string"


def from_texts(rows: DataFrame) -> DataFrame:
    """Files from (skill_id, file_path, content); skill_id keeps its type."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return rows.select(
        "skill_id", "file_path", name.alias("name"), text.suffix(name).alias("suffix"), F.size(F.split("file_path", "/")).alias("depth"),
        F.lit(True).alias("is_file"), F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("symlink_target"),
        F.regexp_replace("content", r"\r\n?", "\n").alias("content"),
    )


def skills(files: DataFrame) -> DataFrame:
    return files.select("skill_id").distinct()


def readable(files: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    rows = files.where("is_file and content is not null")
    return rows.where(F.col("suffix").isin(suffixes)) if suffixes else rows


def lines(files: DataFrame) -> DataFrame:
    """(skill_id, file_path, name, suffix, line_no, line), numbered from 1."""
    return files.select("skill_id", "file_path", "name", "suffix", F.posexplode(text.lines(F.col("content"))).alias("_p", "line")).select(
        "skill_id", "file_path", "name", "suffix", (F.col("_p") + 1).alias("line_no"), "line"
    )


def root_manifest(files: DataFrame) -> DataFrame:
    """(skill_id, content) of the SKILL.md at the root of each skill."""
    return files.where("file_path = 'SKILL.md' and is_file").select("skill_id", "content")
