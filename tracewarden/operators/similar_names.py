"""Names within two edits of one another, without comparing every name with every other.

Two names are at most k edits apart only if some text can be made of both by leaving out at most k letters of each.
Names meet in equi-joins on hashes of such texts, and are then compared.  Two names share many such texts, but they
are taken for a pair at one of them only, so pairs are neither shuffled nor made distinct.  Which one follows from
where the names begin to differ and where they cease to: nothing before and after that is edited, and with two edits
the first must be where they begin to differ and the second where they cease to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2


def variants(name: Column, most: int = MOST) -> Column:
    """Hashes of a name and of what is left of it without any one letter, any two, and so on."""

    def shorter(s: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s))))

    level, all_ = F.array(name), [F.array(name)]
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        all_.append(level)
    return F.array_distinct(F.transform(F.concat(*all_), lambda v: F.xxhash64(v)))


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def _cut(s: Column, first: Column, last: Column) -> Column:
    return F.substring(s, first, last - first + 1)


def _parts(s: Column, i: Column, j: Column) -> list[Column]:
    """What is before the letter i, between the letters i and j, and after the letter j."""
    return [_cut(s, F.lit(1), i - 1), _cut(s, i + 1, j - 1), F.substring(s, j + 1, F.length(s))]


def _both(x: Column, y: Column) -> Column:
    """Two numbers as one."""
    return F.shiftleft(x.cast("long"), 32) + y


def _first(b: Column) -> Column:
    return F.shiftright(b, 32).cast("int")


def _second(b: Column) -> Column:
    return b.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _pairs_of_places(texts: DataFrame) -> DataFrame:
    """(s, i, j) for each two places i < j of each text."""
    each = texts.select("s", F.explode(F.when(F.length("s") >= 2, F.sequence(F.lit(1), F.length("s") - 1))).alias("i"))
    return each.select("s", "i", F.explode(F.sequence(F.col("i") + 1, F.length("s"))).alias("j"))


def _masked(texts: DataFrame, side: str) -> DataFrame:
    """Each text with two letters masked: a hash, the text, what is left, the two places and the two letters."""
    s, i, j = F.col("s"), F.col("i"), F.col("j")
    left, letters = F.concat(*_parts(s, i, j)), _both(F.ascii(_at(s, i)), F.ascii(_at(s, j)))
    return _pairs_of_places(texts).select(F.xxhash64(i, j, left).alias("v"), s.alias(side), left.alias(f"{side}_left"), _both(i, j).alias(f"{side}_at"), letters.alias(f"{side}_letters"))


def _without_one(texts: DataFrame, side: str) -> DataFrame:
    """Each text whole (its place is 0) and without one letter: a hash, the text, what is left, the place and the letter.

    The letter is its code times four, and two if a run of it begins there, and one if a run of it ends there.
    """
    s, i = F.col("s"), F.col("i")
    left = F.when(i == 0, s).otherwise(F.concat(_cut(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    begins, ends = (i == 1) | (_at(s, i) != _at(s, i - 1)), _at(s, i) != _at(s, i + 1)
    letter = F.when(i == 0, 0).otherwise(F.ascii(_at(s, i)) * 4 + begins.cast("int") * 2 + ends.cast("int"))
    each = texts.select("s", F.explode(F.sequence(F.lit(0), F.length("s"))).alias("i"))
    return each.select(F.xxhash64(left).alias("v"), s.alias(side), left.alias(f"{side}_left"), i.alias(f"{side}_i"), letter.alias(f"{side}_letter"))


def _without_two(texts: DataFrame, side: str) -> DataFrame:
    """Each text without two letters: a hash, the text and the places; not those where neither can be an end of an edit, as both are inside of runs of one letter."""
    s, i, j = F.col("s"), F.col("i"), F.col("j")
    ends = (j == i + 1) | (_at(s, j) != _at(s, j - 1)) | (_at(s, i) != _at(s, i + 1))
    return _pairs_of_places(texts).where(ends).select(F.xxhash64(F.concat(*_parts(s, i, j))).alias("v"), s.alias(side), _both(i, j).alias(f"{side}_at"))


# In the joins below what is left is compared beside its hash, inside of a ``when``: of an equality in the open Spark would make a key and sort by it.


def _changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Texts of one length that differ at two places: both are masked there."""
    met = _masked(a, "a").join(_masked(b, "b").hint("merge"), "v")
    letters = F.col("a_letters").bitwiseXOR(F.col("b_letters"))
    near = (F.col("a_at").bitwiseXOR(F.col("b_at")) == 0) & (_first(letters) != 0) & (_second(letters) != 0)
    return met.where(F.when(near, F.col("a_left") == F.col("b_left"))).select("a", "b", F.lit(2).alias("distance"))


def _moved(a: DataFrame, b: DataFrame) -> DataFrame:
    """Texts with one letter left out of one or both, but for those that differ at two places."""
    met = _without_one(a, "a").join(_without_one(b, "b").hint("merge"), "v")
    s, t, i, j, x, y = map(F.col, ["a", "b", "a_i", "b_i", "a_letter", "b_letter"])

    def begins(letter: Column) -> Column:
        return letter.bitwiseAND(F.lit(2)) != 0

    def ends(letter: Column) -> Column:
        return letter.bitwiseAND(F.lit(1)) != 0

    # one letter left out earlier in one text than in the other: from there on each letter of the one is the next one's in the other
    earlier = ends(x) & begins(y) & (j > i + 1) & (_cut(s, i + 1, j - 1) != _cut(t, i + 1, j - 1))
    later = begins(x) & ends(y) & (i > j + 1) & (_cut(s, j + 1, i - 1) != _cut(t, j + 1, i - 1)) & (_cut(s, j + 1, i) != _cut(t, j, i - 1))
    near = F.when(i == j, F.shiftright(x, 2) != F.shiftright(y, 2)).when(j == 0, ends(x)).when(i == 0, ends(y)).when(i < j, earlier).otherwise(later)
    kept = met.where(F.when(near, F.col("a_left") == F.col("b_left")))
    return kept.select("a", "b", F.when((i == j) | (i == 0) | (j == 0), 1).otherwise(2).alias("distance"))


def _shortened(a: DataFrame, b: DataFrame) -> DataFrame:
    """Texts ``a`` and what is left of them without two letters, or without one and with another one replaced."""
    met = _without_two(a, "a").join(_without_one(b, "b").hint("merge"), "v")
    s, t, i, j, k, y = F.col("a"), F.col("b"), _first(F.col("a_at")), _second(F.col("a_at")), F.col("b_i"), F.shiftright("b_letter", 2)
    none = F.when(j == i + 1, _at(s, i) != _at(s, i + 2)).otherwise((_at(s, i) != _at(s, i + 1)) & (_at(s, j) != _at(s, j - 1)))
    first = (F.ascii(_at(s, i)) != y) & (_at(s, j) != _at(t, j - 1))
    second = (_at(s, i) != _at(t, i)) & (F.ascii(_at(s, j)) != y) & (_cut(s, i + 1, j - 1) != _cut(t, i + 1, j - 1))
    near = F.when(k == 0, none).when(k == i, first).when(k == j - 1, second)
    return met.where(F.when(near, F.concat(*_parts(s, i, j)) == F.col("b_left"))).select("a", "b", F.lit(2).alias("distance"))


def neighbours(names: DataFrame, known: DataFrame, most: int = MOST) -> DataFrame:
    """(name, known, distance) for all different texts of ``names`` (name) and ``known`` (known) that are at most ``most`` edits apart.

    Null names have no neighbours, repeated ones count once; equal names aren't neighbours.  Both sides may grow: each name is as many
    rows as it has pairs of letters, about half the square of their number.  These rows are sorted, never broadcast (Spark takes them to be
    as few as the names), and made once if both sides are the same.  With more than two edits pairs are made distinct instead.
    """
    tasks = 4 * names.sparkSession.sparkContext.defaultParallelism  # a number, or the few names would be coalesced into one task that makes all rows

    def texts(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(F.col(column).alias("s")).repartition(tasks, "s").distinct()

    a, b = texts(names, "name"), texts(known, "known")
    if most > 2:
        met = a.select(F.col("s").alias("a"), F.explode(variants(F.col("s"), most)).alias("v")).join(b.select(F.col("s").alias("b"), F.explode(variants(F.col("s"), most)).alias("v")).hint("merge"), "v")
        met = met.where("a <> b").where(F.abs(F.length("a") - F.length("b")) <= most).select("a", "b").distinct().withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 1")
    else:
        met = _moved(a, b)
        if most == 2:
            met = met.unionByName(_changed(a, b)).unionByName(_shortened(a, b)).unionByName(_shortened(b, a).select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    return met.where(F.col("distance") <= most).select(F.col("a").alias("name"), F.col("b").alias("known"), "distance")
