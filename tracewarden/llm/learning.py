"""What the trained operators share: the split of labelled rows and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import at_most

#: A row is held out of training if the CRC-32 of its doc_id, as text, leaves this remainder by FOLDS.
FOLDS, HELD_OUT = 5, 0


def held_out(doc_id: Column) -> Column:
    """True for rows that no model learns from; a null doc_id is held out, since it can't have a label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


#: Characters of all texts of one label in a training sample, and of a text that may be in one.
ROOM, LONGEST = 1 << 25, 1 << 20


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, room: int = ROOM, longest: int = LONGEST) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` documents and ``room`` characters of either label, in an order that only their doc_ids set.

    Only rows that aren't held out count, and no texts of more than ``longest`` characters.  A doc_id with several
    labels has the largest, one with several texts the smallest; null labels count for nothing.  The sample is chosen
    among doc_ids and lengths alone; then the texts of those chosen, which ``room`` bounds, are fetched.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(column).isin(0, 1)).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    lengths = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).groupBy("doc_id").agg(F.max("chars").alias("chars"))
    known = known.join(lengths, "doc_id").where(F.col("chars") <= longest).withColumn("h", F.xxhash64("doc_id", F.lit("sample")))
    step = F.floor(-F.log2((F.shiftrightunsigned("h", 1) + 1) / F.lit(2.0**63)) * 16)  # small hashes first
    chosen = [r for y in (0, 1) for r in at_most(known.where(F.col("y") == y), step, most, F.col("chars"), room).collect()]
    if not chosen:
        return []
    wanted = spark.createDataFrame([(r["doc_id"], r["y"], r["h"]) for r in chosen], known.select("doc_id", "y", "h").schema)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id", "h", "y").agg(F.min("text").alias("text")).select("h", "text", "y").collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["h"])]
