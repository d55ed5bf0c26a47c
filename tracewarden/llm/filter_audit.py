"""How five filters of documents interact in every order in which they can be applied.

Each document's failures are a mask of five bits, made by native expressions.  The last filter fails texts that a smaller
doc_id has already: a grouping of the texts, by SHA-256, supplies the smallest doc_id of each, and what doesn't hold it fails.
Documents are then counted by part and mask, so a part is at most 32 cells whatever its size; what any filter removes
at any step of any order is a sum over cells.  Nothing is collected, and no order is ever applied to documents.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import materialize

#: Fixed values of the contract: the filters, and what they measure.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, r"[#$%&*|]"
_ORDERS = len(list(permutations(FILTERS)))
_LINE_ENDS = "\t\n\x0b\x0c\r"
_CELL = ("n", "good", "toxic")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _parts(text: Column) -> Column:
    """The words of a text."""
    blank = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), _LINE_ENDS, text)
    return F.array_remove(F.split(blank, " "), "")


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): the failures of A to D of each row of ``docs`` (doc_id, text, source), and a digest of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"), _parts(text).alias("w"))
    rows = rows.select("doc_id", "part", "t", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct"))
    fails = {
        "A": F.col("words") < LEAST_WORDS,
        "B": 100 * F.col("distinct") < DISTINCT_PERCENT * F.col("words"),
        "C": 100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long") > CAPITAL_PERCENT * F.length("t").cast("long"),
        "D": F.col("t").rlike(SIGNS),
    }
    mask = reduce(Column.__add__, (F.when(fail, _bit(k)).otherwise(0) for k, fail in fails.items()))
    return rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those labelled good and those labelled toxic, by part and mask of all five failures."""
    rows = materialize(masked(docs), "masked")
    # (text, smallest doc_id) meets the rows by both, so neither a frequent text nor a frequent source is one key
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(copy, _bit("E")).otherwise(0)
    return rows.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(c) for c in _CELL[1:]))


def _sum(over: Column, of: str, wanted) -> Column:
    return F.aggregate(over, F.lit(0).cast("long"), lambda s, c: s + F.when(wanted(c["mask"]), c[of]).otherwise(0))


def orders(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from ``cells``: 600 rows a part."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *_CELL)).alias("cells"))  # at most 32
    every = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    rows = parts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = {k: F.instr("filter_order", k) for k in FILTERS}
    own = reduce(Column.__add__, (F.when(at[k] == F.col("step"), _bit(k)).otherwise(0) for k in FILTERS))
    before = reduce(Column.__add__, (F.when(at[k] < F.col("step"), _bit(k)).otherwise(0) for k in FILTERS))
    rows = rows.select("*", own.alias("own"), before.alias("before"))
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # of the orders of all filters, each of a document's k failures comes first in one of k
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(fails(c["mask"]), c["n"] * F.floor(_ORDERS / F.bit_count(c["mask"]))).otherwise(0))
    return rows.select(
        "part",
        "filter_order",
        "step",
        _sum(F.col("cells"), "n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        _sum(F.col("cells"), "n", removed).alias("removed"),
        _sum(F.col("cells"), "n", lambda m: fails(m) & gone(m)).alias("redundant"),
        _sum(F.col("cells"), "n", lambda m: m == F.col("own")).alias("unique_fails"),
        _sum(F.col("cells"), "good", removed).alias("good_lost"),
        _sum(F.col("cells"), "toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``orders`` of the ``cells`` of ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic); other columns are ignored.

    A null text is an empty one, a null source the part ''.  Repeated rows with one doc_id and text are copies of no smaller
    doc_id; a row without a doc_id is a copy of none, and none of it.  A doc_id with several labels is good, or toxic, if
    any says so; labels of other doc_ids or of none, and null labels, count for nothing.  An empty table has no parts.
    """
    return orders(cells(docs, labels))


def oracle() -> str:
    """The audit in SQL that applies each order to the documents."""
    order = "select " + " || ".join(f"x{i}.f" for i in range(5)) + " as o from " + ", ".join(f"fs x{i}" for i in range(5)) + " where " + " and ".join(f"x{i}.f <> x{j}.f" for i in range(5) for j in range(i))
    return rf"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
     m as (select t, min(doc_id) as least from d group by t),
     l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
     v as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                  (case when len(w) < 50 then 'A' else '' end)
                  || (case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end)
                  || (case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) then 'C' else '' end)
                  || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
                  || (case when d.doc_id > least then 'E' else '' end) as fails
           from d join m using (t) left join l using (doc_id)),
     fs as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
     os as ({order}),
     s as (select o, cast(unnest(range(1, 6)) as int) as step from os),
     p as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from v group by part, fails),
     a as (select part, o as filter_order, step, n, good, toxic, fails,
                  contains(fails, substr(o, step, 1)) as own,
                  translate(fails, substr(o, 1, step - 1), '') <> fails as gone
           from p, s),
     r as (select part, filter_order, step, substr(filter_order, step, 1) as f,
                  sum(case when not own and not gone then n else 0 end) as kept,
                  sum(case when own and not gone then n else 0 end) as removed,
                  sum(case when own and gone then n else 0 end) as redundant,
                  sum(case when own and length(fails) = 1 then n else 0 end) as unique_fails,
                  sum(case when own and not gone then good else 0 end) as good_lost,
                  sum(case when own and not gone then toxic else 0 end) as toxic_lost
           from a group by part, filter_order, step)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from r"""
