"""Benchmark decontamination: short test items found inside long documents.

Containment MinHash: only the small set, the item, is sketched; the large one is probed.  Items are
partitioned by their number of shingles.  A document that holds a share t of an item's n shingles misses
at most (1 - t) n of them, so one of the floor((1 - t) u) + 1 smallest-hashed shingles of the item must be
in the document, where u >= n is the upper bound of the item's size partition.  Those shingles are the
item's sketch: no pair is lost, at any document length, and most documents meet no sketch at all.
Candidates are then verified by exact containment of the shingles themselves, not their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import materialize, packed, shingles, words

WORDS, SHARE = 5, 0.8
#: Sketch rows up to which they are broadcast (16 bytes each); larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def hashed(ws: Column, n: int) -> Column:
    """64-bit hashes of the n-word shingles of an array of words."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n))))


def sketches(items: DataFrame, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """(hash, _item): the sketch of each item, of a size that its partition sets."""
    each = items.select("_item", F.explode(F.array_distinct(hashed(F.col("_words"), n))).alias("hash"))
    order = Window.partitionBy("_item").orderBy(F.xxhash64("hash", F.lit("sketch")), "hash")
    each = each.withColumn("_rank", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_item")))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("_n")))
    return each.where(F.col("_rank") <= F.floor((1 - share) * upper) + 1).select("hash", "_item")


def find(docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): documents that hold at least ``share`` of an item's distinct shingles.

    docs has doc_id and text, items item_id and text; other columns are ignored, whatever their names.
    Words are lower-cased runs of letters and digits.  Null texts, and texts of fewer than ``n`` words, hold
    and match nothing.  Repeated rows (same id and text) count once; rows that share an id, null or not, but
    differ in text are judged one by one.  Empty tables give an empty result.
    """
    items = items.select("item_id", "text").distinct().withColumn("_item", F.xxhash64("item_id", "text")).withColumn("_words", words(F.col("text")))
    sketch = materialize(sketches(items, n, share), "sketches")
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    docs = docs.select("doc_id", "text").withColumn("_doc", F.xxhash64("doc_id", "text"))
    # the words are a column of their own: inside the lambda of the shingles their expression would run for every shingle
    probed = docs.select("_doc", words(F.col("text")).alias("_words")).select("_doc", F.explode(hashed(F.col("_words"), n)).alias("hash"))
    pairs = materialize(probed.join(sketch, "hash").select("_doc", "_item").distinct(), "leak-candidates")

    wanted = docs.join(pairs.select("_doc").distinct(), "_doc", "left_semi")
    held = wanted.select("_doc", "doc_id", words(F.col("text")).alias("_words"))
    held = held.select("_doc", "doc_id", F.explode(F.array_distinct(shingles(F.col("_words"), n))).alias("shingle"))
    asked = items.select("_item", "item_id", F.array_distinct(shingles(F.col("_words"), n)).alias("_all"))
    asked = asked.select("_item", "item_id", F.size("_all").alias("n_shingles"), F.explode("_all").alias("shingle"))
    asked = pairs.join(asked, "_item")
    shared = held.distinct().join(asked, ["_doc", "shingle"]).groupBy("_doc", "_item").agg(
        F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("n_shingles").cast("long").alias("n_shingles"), F.count(F.lit(1)).alias("n_shared")
    )
    shared = shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return shared.where(F.col("containment") >= share).select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def clean(docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """``docs`` without the rows that hold an item, as ``find`` judges them; all columns and other rows stay."""
    keyed = docs.select(packed(docs).alias("d"), F.xxhash64("doc_id", "text").alias("_doc"))
    found = find(keyed.select(F.col("_doc").alias("doc_id"), "d.text"), items, n, share)
    return keyed.join(found.select(F.col("doc_id").alias("_doc")).distinct(), "_doc", "left_anti").select("d.*")


ORACLE = r"""
with w as (
  select doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from (select distinct doc_id, text from documents)
), iw as (
  select item_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from (select distinct item_id, text from benchmark)
), i as (
  select distinct item_id, text, unnest(list_transform(range(1, len(ws) - 3), lambda k: list_aggregate(ws[k:k+4], 'string_agg', ' '))) as s from iw
), n as (
  select item_id, text, count(*) as n_shingles from i group by all
), d as (
  select distinct doc_id, text, unnest(list_transform(range(1, len(ws) - 3), lambda k: list_aggregate(ws[k:k+4], 'string_agg', ' '))) as s from w
), c as (
  select d.doc_id, d.text as dt, i.item_id, i.text, count(*) as n_shared from d join i using (s) group by all
)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment
from c join n using (item_id, text) where n_shared / n_shingles >= 0.8
"""
