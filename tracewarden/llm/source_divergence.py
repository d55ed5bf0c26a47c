"""How far the vocabularies of sources diverge: sharded counts and pair sums in DuckDB, merged and ranked by Spark.

First pass.  Each task counts the terms of its documents in SQL, in a table of its own that is emitted and emptied when it
is full, so that a frequent term is one row for each language, source and table before anything is shuffled.  The rows are
dealt to shards by hash of (lang, term); a shard adds them up and keeps the terms that enough documents of the
language hold.  Spark adds up the sizes of groups and languages.

Second pass.  Each count carries the sizes that its probability needs.  A shard has all groups' counts of its terms, so
one SQL join gives the partial sum of each pair of sources over them, another query the shard's first terms of each group.

Kept terms that a group doesn't hold have a probability too.  The sum over all kept terms of f(p, q) is therefore taken
apart: V f(p0, q0) as if neither group held any, plus f(p, q0) - f(p0, q0) for each term of the one group, which depends on the
term's count alone and is summed over a histogram of counts, the same for the other group, and for the terms that both hold
f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), which are the shards' partial sums.  All of it is integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import materialize, release, ship

#: Fixed values of the contract: a term, the letters that are lower-cased, documents of a language that keep a term, the scale of probabilities, ranks of terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, SCALE, RANKS = 10, 1_000_000_000, 10
#: Bytes of text counted at once; rows of a task's table before it is emitted, of a shard's before it is added up; pairs of sources summed at once.
SLICE, FULL, MERGED, PAIRS = 8 << 20, 300_000, 500_000, 500_000
#: Groups up to which their sizes are broadcast (some 100 bytes each); more are joined by shuffling.
GROUPS = 50_000
_COUNTS = "lang string, source string, term string, n long, docs long"


def _duck():
    """A database in the task's memory, which keeps nothing on disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": "", "preserve_insertion_order": False})


def _batches(db, query: str, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    yield from (b for b in db.sql(query).to_arrow_reader(size) if b.num_rows)


def _by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``most`` bytes together, or of one row."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), "i8"))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def term_counts(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, source, term, n, total, first): counts of kept terms, with those of the language; ``first`` marks one source of each term."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _duck()
        create = "create or replace table held (lang varchar, source varchar, term varchar, n bigint, docs bigint)"
        db.execute(create)
        for batch in batches:
            for part in _by_bytes(batch, 2, SLICE):
                db.register("texts", pa.Table.from_arrays([*part.columns, pa.array(range(part.num_rows), pa.int32())], ["lang", "source", "text", "row"]))
                db.execute(f"""
                    insert into held with words as (select row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from texts)
                    select lang, source, term, sum(n), count(*) from (select row, lang, source, term, count(*) as n from words group by all) group by lang, source, term""")
                if db.execute("select count(*) from held").fetchall()[0][0] > FULL:
                    yield from emit(db)
                    db.execute(create)
        yield from emit(db)
        db.close()

    def emit(db) -> Iterator[pa.RecordBatch]:
        return _batches(db, "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held group by lang, source, term")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, rows = _duck(), 0
        total = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held group by lang, source, term"
        db.execute("create table held (lang varchar, source varchar, term varchar, n bigint, docs bigint)")
        most = MERGED
        for batch in batches:
            db.register("part", pa.Table.from_batches([batch]))
            db.execute("insert into held select lang, source, term, n, docs from part")
            rows += batch.num_rows
            if rows > most:
                db.execute(f"create or replace table held as {total}")
                rows = db.execute("select count(*) from held").fetchall()[0][0]
                most = max(MERGED, 2 * rows)
        yield from _batches(db, f"""
            with added as ({total}), kept as (select lang, term, sum(n) as total, min(source) as least from added group by lang, term having sum(docs) >= {LEAST_DOCS})
            select lang, source, term, n, total::bigint as total, source = least as first from added join kept using (lang, term)""")
        db.close()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*text).mapInArrow(count, _COUNTS)
    return counted.repartition(shards, "lang", "term").mapInArrow(add, "lang string, source string, term string, n long, total long, first boolean")


def _price(n: Column, size: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (size + 2 kept)), in whole numbers of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    rows = {"n": wide(n) + 2, "of": wide(size) + wide(kept) * 2}
    return F.when(kept > 0, F.call_function("div", rows["n"] * F.lit(SCALE).cast("decimal(10,0)"), rows["of"]) + 1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _joined(rows: DataFrame, groups: DataFrame, on: list[str], few: bool) -> DataFrame:
    """``rows`` with what ``groups`` tells of each: sent to all tasks if they are few, else met by shuffling, where frequent keys are split."""
    return rows.join(F.broadcast(groups) if few else groups.hint("merge"), on)


def group_sizes(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, size, all, kept): occurrences of kept terms in each group of ``docs`` and in its language, and how many terms it keeps."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("first").alias("terms"))
    of_lang = own.groupBy("lang").agg(F.sum("size").alias("all"), F.sum("terms").alias("kept"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return named.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("size"), zero("all"), zero("kept"))


def shard_sums(priced: DataFrame, shards: int) -> DataFrame:
    """(part, lang, source, item, value) of each shard of ``priced``: its terms' share in each pair of sources, and its first terms of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _duck()
        db.execute("create table held (lang varchar, source varchar, term varchar, p bigint, p0 bigint, q bigint)")
        for batch in batches:
            db.register("part", pa.Table.from_batches([batch]))
            db.execute("insert into held select lang, source, term, p, p0, q from part")
        apart = lambda p, q: f"((({p}) - ({q})) * (({p}) - ({q}))) // (({p}) + ({q}))"
        yield from _batches(db, f"""
            select 'term' as part, lang, source, term as item, value from (
                select lang, source, term, value, row_number() over (partition by lang, source order by value desc, term) as rank
                from (select lang, source, term, {apart("p", "q")} as value from held where p > q)) where rank <= {RANKS}""")
        sources = db.execute("select lang, source, count(*) over (partition by lang) from (select distinct lang, source from held) order by lang, source").fetchall()
        while sources:
            # as many sources at once as make up to PAIRS pairs
            some, room = [], PAIRS
            while sources and (not some or room > 0):
                lang, source, others = sources.pop()
                some.append((lang, source))
                room -= others
            db.register("own", pa.table({"lang": [x for x, _ in some], "source": [x for _, x in some]}))
            yield from _batches(db, f"""
                select 'pair' as part, a.lang, a.source, b.source as item, sum({apart("a.p", "b.p")} - {apart("a.p", "b.p0")} - {apart("a.p0", "b.p")} + {apart("a.p0", "b.p0")})::bigint as value
                from (select * from held semi join own using (lang, source)) a join held b on a.lang = b.lang and a.term = b.term and a.source < b.source group by a.lang, a.source, b.source""")
        db.close()

    rows = priced.select("lang", "source", "term", "p", "p0", "q").repartition(shards, "lang", "term")
    return rows.mapInArrow(run, "part string, lang string, source string, item string, value long")


def divergence(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source; other columns are ignored).

    part 'pair': each other source of the language by the divergence of its vocabulary; part 'term': up to RANKS terms that the group
    holds more often than its language does.  Ranks follow value, larger first, then the bytes of item.  A null text,
    language or source is ''.  Texts without terms, and a language that keeps none, give pairs of value 0; a language with one
    source has no pairs.  Repeated rows are documents of their own.  An empty table gives none.

    Terms are dealt to ``shards``, by default as many as the session shuffles to.  A shard's memory is one row for each
    group and kept term in it, and PAIRS sums or one source's; the result itself holds all pairs of a language's sources.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(term_counts(docs, shards), "term-counts")
    groups = materialize(group_sizes(docs, counts), "groups")
    few = groups.count() <= GROUPS
    groups = groups.select("*", _price(F.lit(0), F.col("size"), F.col("kept")).alias("p0"))
    priced = _joined(counts, groups, ["lang", "source"], few)
    priced = priced.select("*", _price(F.col("n"), F.col("size"), F.col("kept")).alias("p"), _price(F.col("total"), F.col("all"), F.col("kept")).alias("q"))
    sums = materialize(shard_sums(priced, shards), "shard-sums")
    # what a group's own counts add to its pair with each other source, and all kept terms as if neither held any
    held = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"))
    held = _joined(held, groups.select("lang", "source", "size", "kept", "p0"), ["lang", "source"], few)
    held = held.select("lang", "source", "p0", "terms", F.lit(1).alias("ways"), _price(F.col("n"), F.col("size"), F.col("kept")).alias("p"))
    none = groups.select("lang", "source", "p0", F.col("kept").alias("terms"), F.lit(0).alias("ways"), F.col("p0").alias("p"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = _joined(held.unionByName(none), others, ["lang"], few).where("source <> item")
    base = _apart(F.col("p0"), F.col("q0"))
    value = F.when(F.col("ways") == 1, F.col("terms") * (_apart(F.col("p"), F.col("q0")) - base)).otherwise(F.col("terms") * F.coalesce(base, F.lit(0)))
    met = met.select("lang", "source", "item", "ways", value.alias("value")).groupBy("lang", "source", "item", "ways").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    shared = sums.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))  # of all shards, before each is turned
    turned = lambda rows, ways: rows.select("lang", F.explode(ways).alias("e"), "value").select("lang", "e.source", "e.item", "value")
    pairs = turned(met, F.when(F.col("ways") == 1, both).otherwise(F.slice(both, 1, 1))).unionByName(turned(shared, both))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    ranked = pairs.unionByName(sums.where("part = 'term'"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(f"part = 'pair' or rank <= {RANKS}")
    out = materialize(ranked.select("lang", "source", "part", "item", "value", "rank"), "divergence")
    release(counts, groups, sums)
    return out


ORACLE = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
     w as (select r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) as term from d),
     k as (select lang, term from w group by lang, term having count(distinct r) >= 10),
     v as (select lang, count(*) as v from k group by lang),
     c as (select w.lang, source, w.term, count(*) as n from w join k using (lang, term) group by all),
     g as (select distinct lang, source from d),
     e as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
     p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v)::hugeint as p from e join v using (lang)),
     l as (select lang, term, sum(n) as n from p group by lang, term),
     q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v)::hugeint as q from l join v using (lang)),
     s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
           from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
     pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
               from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
     terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q)) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q),
     both_ as (select * from pairs union all select * from terms),
     ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10
"""
