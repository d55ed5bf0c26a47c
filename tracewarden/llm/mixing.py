"""Mixing sources to target weights by drawing fixed-length blocks of words.

Every source's texts, in a pseudorandom order, form one stream of words that is cut into blocks of
``block_words``.  The mix is a row of output shards of ``shard_slots`` slots each.  How many slots of a shard a
source gets is drawn: its expected number, rounded down, and for the slots that leaves over a multinomial draw with the
fractions that were cut off (a residual multinomial draw: its mean is that of a plain one, and a source's total over n
shards strays by about the root of n, not of all slots).  The numbers drawn are a table (shard, source, n); the j-th
slot of a source, counted over shards, takes the block that a permutation of the source's block indexes, another for
each pass, gives for j.  Slots and blocks meet in an equi-join on (source, index).  Everything is DataFrame code; no row
is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import materialize, packed

#: Fixed values of the contract: what parts words, the weights of sources in order, the most passes over a source.
GAP = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3

#: Words in a block; slots in an output shard; shards generated by one row; groups into which a source's rows are dealt.
BLOCK_WORDS, SHARD_SLOTS, CHUNK, BUCKETS, ROUNDS = 64, 1024, 256, 2048, 10


def count_words(text: Column) -> Column:
    """Number of runs of characters other than blank, tab and the four line ends; 0 for null."""
    parts = F.split(text, GAP)
    n = F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")
    return F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("long")


def permuted(df: DataFrame, x: str, n: str, out: str, *key: Column) -> DataFrame:
    """Adds ``out``: the image of ``x`` (0 <= x < n) under a permutation of [0, n) that ``key`` chooses (swap-or-not shuffle).

    The rounds are one fold over their numbers: as nested expressions they would grow threefold a round.
    """

    def swapped(at: Column, r: Column) -> Column:
        twin = F.pmod(F.pmod(F.xxhash64(*key, r), F.col(n)) - at, F.col(n))
        swap = F.xxhash64(F.greatest(at, twin), *key, -1 - r).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, twin).otherwise(at)

    return df.withColumn(out, F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.col(x), swapped))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, _src, _size): one narrow row for each document.  _src is a never-null form of the source."""
    return docs.select(
        "doc_id",
        F.xxhash64("text").alias("_text_hash"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("_src"),
        count_words(F.col("text")).alias("_size"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each source: source_size, target, blocks, slots, first slot, all slots.

    Targets are shares of all words by weight, stopped at ``most`` times the source's size; what that
    leaves over goes to the others by weight until none is above (the water level of sorted caps).  The
    windows without keys hold one row per source.
    """
    src = sizes.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy((F.col("_src") == "n"), "_src")
    src = src.withColumn("_rank", F.row_number().over(by_name))
    src = src.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1)))
    src = src.withColumn("_cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    total = F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    capped = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    src = src.withColumn("_level", (total - capped) / rest)
    holds = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))
    src = src.withColumn("_at", F.first(holds, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cap = F.col("_cap").cast("double")
    src = src.withColumn("target", F.coalesce(F.least(F.col("_at") * F.col("_w"), cap), cap))
    src = src.withColumn("_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    slots = F.round(F.col("target") * F.col("_blocks") / F.when(F.col("source_size") > 0, F.col("source_size"))).cast("long")
    src = src.withColumn("_slots", F.coalesce(F.least(slots, F.col("_blocks") * most), F.lit(0).cast("long")))
    every = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return src.withColumn("_all", F.sum("_slots").over(every)).select("_src", "_rank", "source_size", "target", "_blocks", "_slots", "_all")


def draw_counts(src: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The draw: (_src, shard, n), a row for each source that gets slots of a shard.

    All shards but the last have ``shard_slots`` slots.  A source's expected number in a shard is its share of all
    slots; whole slots are certain, what is left over of a shard is drawn slot by slot, a source with the
    fraction that it is short of.
    """
    by_rank = Window.orderBy("_rank")
    src = src.where("_slots > 0").withColumn("_shards", F.expr(f"(_all - 1) div {shard_slots} + 1"))
    src = src.withColumn("_last", F.col("_all") - (F.col("_shards") - 1) * shard_slots)
    for kind, size in (("f", F.lit(shard_slots)), ("l", F.col("_last"))):  # full shards, and the last
        src = src.withColumn(f"_sure_{kind}", F.expr(f"({shard_slots if kind == 'f' else '_last'} * _slots) div _all"))
        src = src.withColumn(f"_part_{kind}", size * F.col("_slots") - F.col(f"_sure_{kind}") * F.col("_all"))
        src = src.withColumn(f"_to_{kind}", F.sum(f"_part_{kind}").over(by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        src = src.withColumn(f"_left_{kind}", F.sum(f"_part_{kind}").over(by_rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    chunks = src.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_shards - 1) div {CHUNK})")))
    tasks = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(tasks, "_src", "_chunk")  # a number, or the few rows that stand for all shards would be coalesced into one task
    rows = chunks.withColumn("shard", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(_chunk * {CHUNK} + {CHUNK}, _shards) - 1)")))
    full = F.col("shard") < F.col("_shards") - 1
    sure, part, to, left = (F.when(full, F.col(f"_{x}_f")).otherwise(F.col(f"_{x}_l")) for x in ("sure", "part", "to", "left"))
    rows = rows.select("_src", "shard", "_all", sure.alias("_sure"), (to - part).alias("_from"), to.alias("_to"), left.alias("_left"))
    at = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", k), F.col("_left"))
    hits = F.size(F.filter(F.sequence(F.lit(1).cast("long"), F.expr("_left div _all")), lambda k: (at(k) >= F.col("_from")) & (at(k) < F.col("_to"))))
    n = F.col("_sure") + F.when(F.col("_left") > 0, hits).otherwise(F.lit(0))
    return rows.select("_src", "shard", n.cast("long").alias("n")).where("n > 0")


def draw_slots(src: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0, most: int = MOST) -> DataFrame:
    """The mix: (shard, slot, _src, _block, pass), a row for each slot; slot is a pseudorandom number, by which a shard's slots are in order.

    A source that is held at ``most`` times its size may have drawn a few slots more than its blocks can fill; those stay empty.
    """
    counts = materialize(draw_counts(src, shard_slots, seed), "mix-draw")
    # where a source's slots of a shard begin: prefix sums over runs of shards, then inside runs
    counts = counts.withColumn("_run", F.expr("shard div 4096"))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, 0)
    runs = counts.groupBy("_src", "_run").agg(F.sum("n").alias("_n"))
    runs = runs.select("_src", "_run", (F.sum("_n").over(upto("_src", "_run")) - F.col("_n")).alias("_base"))
    counts = counts.withColumn("_in", F.sum("n").over(upto("_src", "_run", "shard")) - F.col("n"))
    counts = counts.join(runs.hint("shuffle_hash"), ["_src", "_run"]).select("_src", "shard", "n", (F.col("_base") + F.col("_in")).alias("_begin"))
    slots = counts.join(src.select("_src", "_blocks"), "_src")
    tasks = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = slots.repartition(tasks, "_src", "shard").withColumn("_j", F.explode(F.expr("sequence(_begin, _begin + n - 1)")))
    slots = slots.where(F.col("_j") < F.col("_blocks") * most).withColumn("pass", F.expr("_j div _blocks")).withColumn("_i", F.expr("_j % _blocks"))
    slots = permuted(slots, "_i", "_blocks", "_block", F.col("_src"), F.col("pass"), F.lit(seed))
    return slots.select("shard", F.xxhash64(F.lit(seed), F.lit("order"), "_src", "_j").alias("slot"), "_src", "_block", "pass")


def placed(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """Adds _start, the words of the same source before each row's, and (_bucket, _rn), which with _src names a row.

    Rows are dealt into many buckets for each source, so a source with a third of all rows is no hot
    group; the buckets' bases come from prefix sums over the buckets' totals.
    """
    dealt = sizes.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_text_hash", F.lit(seed)), F.lit(BUCKETS)).cast("int"))
    totals = dealt.groupBy("_src", "_bucket").agg(F.sum("_size").alias("_n"))
    ordered = Window.partitionBy("_src").orderBy("_bucket")
    bases = totals.select("_src", "_bucket", (F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("_src", "_bucket").orderBy("doc_id", "_text_hash", "_size")
    upto = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    rows = dealt.withColumn("_rn", F.row_number().over(inside)).withColumn("_in", upto)
    return rows.join(bases, ["_src", "_bucket"]).withColumn("_start", F.col("_base") + F.col("_in")).drop("_base", "_in")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row the parts [_lo, _hi) of its words that lie in one block; a row without words has none."""
    parts = rows.where("_size > 0").withColumn("_block", F.explode(F.expr(f"sequence(_start div {block_words}, (_start + _size - 1) div {block_words})")))
    parts = parts.withColumn("_lo", F.greatest(F.col("_block") * block_words - F.col("_start"), F.lit(0)))
    return parts.withColumn("_hi", F.least((F.col("_block") + 1) * block_words - F.col("_start"), F.col("_size")))


def drawn(docs: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, rows, mix): the targets; ``placed`` rows; and the parts of rows that fill the slots of shards."""
    sizes = materialize(sized(docs), "mix-sizes")
    src = materialize(source_targets(sizes), "mix-sources")
    rows = materialize(placed(sizes, seed), "mix-rows")
    return src, rows, pieces(rows).join(draw_slots(src, shard_slots, seed).hint("merge"), ["_src", "_block"])


def mix_report(docs: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard, last_shard) for each row of ``docs`` (doc_id, text, source; other columns are ignored).

    first_shard and last_shard are the output shards between which a row's words lie, null if none is taken.
    Null texts and texts without words have size 0 and are never taken; a null source is a source of its
    own, last in order; repeated rows each count and are each mixed; rows that tie in everything are
    interchangeable; an empty table gives an empty result.
    """
    src, rows, mix = drawn(docs, seed, shard_slots)
    key = ["_src", "_bucket", "_rn"]
    taken = mix.groupBy(*key).agg(F.sum(F.col("_hi") - F.col("_lo")).alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    out = rows.join(taken, key, "left").join(src.select("_src", "source_size", "target"), "_src")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_shard", "last_shard")


def _rows_of(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """Joins rows of ``docs``, as struct d, with what ``cut`` (_src, _bucket, _rn, doc_id, _text_hash, _size, ...) says of each; equal rows are interchangeable."""
    alike = Window.partitionBy("d.doc_id", "_text_hash", "_src").orderBy(F.lit(0))
    src_key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    keyed = docs.select(packed(docs).alias("d"), F.xxhash64("text").alias("_text_hash"), src_key.alias("_src"))
    twins = Window.partitionBy("doc_id", "_text_hash", "_src").orderBy("_bucket", "_rn")
    cut = cut.withColumn("_twin", F.row_number().over(twins)).drop("_bucket", "_rn")
    a, b = keyed.withColumn("_twin", F.row_number().over(alike)).alias("a"), cut.alias("b")
    same = F.col("a.d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._text_hash") == F.col("b._text_hash")) & (F.col("a._src") == F.col("b._src")) & (F.col("a._twin") == F.col("b._twin"))
    return a.join(b, same).select("a.d", "b._parts", "b._size")


def _words_of(parts: Column) -> Column:
    """The words of parts [_lo, _hi) of the array _words, joined by a blank."""
    return F.array_join(F.flatten(F.transform(parts, lambda p: F.slice("_words", p["_lo"].cast("int") + 1, (p["_hi"] - p["_lo"]).cast("int")))), " ")


def mixed_blocks(docs: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as output shards: (shard, slot, part, source, doc_id, text), the pieces of the block in each slot of each shard in order.

    A shard's slots are in the order of slot, a block's pieces in that of part; sorting by shard, slot, part gives the mix.
    """
    _, _, mix = drawn(docs, seed, shard_slots)
    key = ["_src", "_bucket", "_rn", "doc_id", "_text_hash", "_size"]
    cut = mix.groupBy(*key).agg(F.collect_list(F.struct("shard", "slot", F.greatest(F.col("_start") + F.col("_lo"), F.lit(0)).alias("part"), "_lo", "_hi")).alias("_parts"))
    both = _rows_of(docs, cut).withColumn("_words", F.filter(F.split("d.text", GAP), lambda w: w != "")).withColumn("_p", F.explode("_parts"))
    return both.select("_p.shard", "_p.slot", "_p.part", F.col("d.source").alias("source"), F.col("d.doc_id").alias("doc_id"), _words_of(F.array("_p")).alias("text"))


def mixed_documents(docs: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents: a row for each document and pass in which any of its words is taken, with the columns of ``docs``.

    A document whose words are all taken in a pass keeps its text unchanged; of others the taken parts
    remain, joined by a blank.  ``n_chars``, where there is such a column, is counted anew.
    """
    _, _, mix = drawn(docs, seed, shard_slots)
    key = ["_src", "_bucket", "_rn", "doc_id", "_text_hash", "_size"]
    cut = mix.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pass", "_lo", "_hi"))).alias("_parts"))
    both = _rows_of(docs, cut)
    both = both.withColumn("_pass", F.explode(F.array_distinct(F.transform("_parts", lambda p: p["pass"]))))
    both = both.withColumn("_now", F.filter("_parts", lambda p: p["pass"] == F.col("_pass")))
    whole = F.aggregate("_now", F.lit(0).cast("long"), lambda s, p: s + p["_hi"] - p["_lo"]) == F.col("_size")
    both = both.withColumn("_words", F.filter(F.split("d.text", GAP), lambda w: w != ""))
    both = both.withColumn("_text", F.when(whole, F.col("d.text")).otherwise(_words_of(F.col("_now"))))
    anew = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        anew["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return both.select(*(anew.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))
