"""Connected components of a growing set of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import materialize, release

ROOTS = "node long, root long"


def no_roots(spark) -> DataFrame:
    return spark.createDataFrame([], ROOTS)


def rooted(rows: DataFrame, node: str, roots: DataFrame, out: str) -> DataFrame:
    """Adds ``out``, the root of the component of ``node``; a node that is not in ``roots`` is its own."""
    r = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(r, node, "left").withColumn(out, F.coalesce("_root", node)).drop("_root")


def merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root; only nodes that are not their own root) after the components that ``links`` (a, b) join are one.

    Each turn hangs every root that has a link to a smaller root under the smallest of these and shortens
    the chains by pointer doubling; turns go on until no link joins two roots, about log(n) times.  Both
    sides of every join are read from files, so a node with very many links is split among tasks.
    """
    while True:
        ends = rooted(rooted(links.select("a", "b"), "a", roots, "ra"), "b", roots, "rb").where("ra <> rb")
        hung = ends.select(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        table = materialize(hung, "hung")
        hung = table
        if hung.isEmpty():
            release(table)
            return roots
        while True:
            up = hung.select(F.col("node").alias("root"), F.col("root").alias("up"))
            next_ = materialize(hung.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "hung")
            release(table)
            table, hung = next_, next_.select("node", "root")
            if next_.where("moved").isEmpty():
                break
        kept = rooted(roots.withColumnRenamed("root", "at"), "at", hung, "root").select("node", "root")
        old, roots = roots, materialize(kept.unionByName(hung), "roots")
        release(table, old)
