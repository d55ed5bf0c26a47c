"""Helpers shared by the training-text operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.session import ship

__all__ = ["NOT_WORD", "at_most", "materialize", "new_path", "packed", "release", "setting", "shared_dir", "shingles", "ship", "table", "words"]

#: Fixed value: lower-cased runs of letters and digits are the words of every operator on shingles.
NOT_WORD = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and has no other machine (local tests) a temporary folder becomes that setting.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tracewarden-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone by now; the files are then left to the folder's owner
            return


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet, with the writer's ``options``, to the shared folder and read back: cuts the lineage, survives lost executors.

    Spark deletes the shuffle files of the query once it has ended, since nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries that run inside; another thread's queries in the same session would see it too."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(*dfs: DataFrame) -> None:
    """Removes the files of ``materialize``d tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "stored_at", None)
        if path:
            _remove(df.sparkSession, path)


def at_most(df: DataFrame, step: Column, most: int, size: Column | None = None, room: int = 0) -> DataFrame:
    """The rows of the highest steps, at most ``most`` and, if there is a ``size``, at most ``room`` in all; rows of one step are in or out together.

    The driver sees one count for each step; a limit with an order would send it ``most`` rows from every task.
    """
    least, n, filled = None, 0, 0
    per = df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if size is None else size).alias("size"))
    for r in sorted(per.collect(), key=lambda r: -r["step"]):
        n, filled = n + r["n"], filled + r["size"]
        if n > most or filled > room > 0:
            break
        least = r["step"]
    return df.where(F.lit(False)) if least is None else df.where(step >= least)


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no column that is added beside it can clash with one of theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def words(text: Column) -> Column:
    """Array of the lower-cased words of a text; null and blank texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def shingles(ws: Column, n: int) -> Column:
    """Array of the n-word shingles (words joined by a blank) of an array of words; fewer than n words have none."""
    return F.when(
        F.size(ws) >= n,
        F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))
