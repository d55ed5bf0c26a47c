"""Stupid-backoff scores of documents under the n-gram counts of the corpus they are in.

S(w | v) = c-(v w) / c(v) where the bigram v w occurs in another document too, else BACKOFF c(w) / N; the first word of
a document has c(w) / N.  c counts a word in all documents, N all words, and c- a bigram in all documents but the one
that is scored: with its own counts in, a text would vouch for itself and no score would ever back off.  A document's
score is the sum of the logarithms, all bigrams backed off, corrected for those that aren't:

    sum of ln c(w) - n ln N + (n - 1) ln BACKOFF  +  sum over bigrams found of ln c-(v w) - ln c(v) - ln c(w) + ln N - ln BACKOFF

N-grams are exploded with their numbers in each document and partitioned by hash; there the table of counts is an
aggregate over the n-grams of a partition, joined back to them on the n-gram, and sums by document leave.  The counts
of the most frequent words, a list of bounded length, are broadcast; pairs of the first of them are written as one number.
Other words are n-grams of order one in the same tables; as parts of bigrams that were found their counts are joined
from the table of words.  A document has one row for an n-gram however often it holds it, so no n-gram has more rows
than there are documents, and bigrams of a frequent word are spread by both words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import at_most, materialize, setting, ship
from tracewarden.llm.near_duplicates import _WORD

BACKOFF = 0.4
#: Bits of a top word's number; words whose counts are broadcast, the top words among them; distinct words that a counting task holds before it emits them; documents whose n-grams are exploded together.
TOP_BITS, BROADCAST, HELD, TOGETHER = 16, 1 << 18, 300_000, 256
KEPT = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], "u8")
#: First words of what is no bigram: a word by itself, and a document, whose number of words and sum over top words it carries.
WORD, DOCUMENT = -1, -2


def word_key(word: str) -> int:
    """63 bits of a word's hash, with the highest bit set in numpy's unsigned form: negative as a long, so no top word's number."""
    return xxhash.xxh64_intdigest(word) | 1 << 63


class _Keys(dict):
    """(key, logarithm of the count) of a word: a top word's key is its number, another's its hash; words whose counts aren't broadcast have None."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray, bits: int):
        self.numbers = 1 << bits
        self.known = dict(zip(hashes.tolist(), range(len(hashes)), strict=True))
        self.logs = logs

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > KEPT:
            self.clear()
        k = word_key(word) - (1 << 64)
        i = self.known.get(k)
        self[word] = out = (k, np.nan) if i is None else (i if i < self.numbers else k, self.logs[i])
        return out


def unigrams(docs: DataFrame) -> DataFrame:
    """(word, c): counts of all words by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            keys = np.fromiter(map(word_key, seen), "u8", len(seen)).view("i8")
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(seen.values(), "i8", len(seen)))], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in _WORD.findall((text or "").lower()):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > HELD:
                    yield emit()
        yield emit()

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def top_words(words: DataFrame, most: int | None = None) -> list:
    """The most frequent words, at most ``most`` (BROADCAST), in the order of their counts; nearly equal counts are in or out together.

    More than ``most`` words are as frequent as any that is left out, so it has at most one in ``most`` of all
    occurrences.
    """
    return sorted(at_most(words, F.floor(F.log2("c") * 16), most or BROADCAST).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))


_PACKED = "part int, bases array<long>, rows array<tinyint>, times array<int>, pairs array<int>, firsts array<long>, seconds array<long>, sums array<double>"


def _once(doc: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, v, w, times): distinct n-grams of each document, in the order of documents."""
    order = np.lexsort((w, v, doc))
    doc, v, w = doc[order], v[order], w[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(first)
    return doc[at], v[at], w[at], np.diff(np.append(at, len(doc)))


def _packed(rows: DataFrame, hashes: np.ndarray, logs: np.ndarray, parts: int) -> DataFrame:
    """The n-grams of ``rows`` (row, text), those of several documents for one partition in one row: number in document, and two top words as one number or first and second word.

    A document is named by a base, the same all along a row, and one byte; its n-gram of DOCUMENT holds its row.  The base is an array like the
    others, which compresses to nothing: a column beside them would be pruned from the table of counts, and the shuffle not be used twice.
    """
    shared = rows.sparkSession.sparkContext.broadcast((hashes, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys(*shared.value, TOP_BITS)
        made_so_far = TaskContext.get().partitionId() << 36
        lists = [pa.list_(t) for t in (pa.int8(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())]
        names = ["part", "bases", "rows", "times", "pairs", "firsts", "seconds", "sums"]
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part, base = batch.slice(lo, TOGETHER), made_so_far
                made_so_far += 256
                row = part.column(0).to_numpy()
                found = [_WORD.findall((t or "").lower()) for t in part.column(1).to_pylist()]
                n = np.array([len(f) for f in found], "i8")
                both = np.array([k for f in found for k in map(keys.__getitem__, f)], [("key", "i8"), ("log", "f8")])
                w, logs = both["key"].copy(), both["log"].copy()
                doc = np.repeat(np.arange(len(n)), n)
                common = ~np.isnan(logs)
                sums = np.bincount(doc[common], logs[common], len(n))
                second = np.ones(len(w), bool)
                second[(np.cumsum(n) - n)[n > 0]] = False
                at = np.flatnonzero(second)
                some = np.flatnonzero(n)
                made = [(*_once(doc[at], w[at - 1], w[at]), None)]
                d, v, x, times = _once(doc[~common], np.full((~common).sum(), WORD), w[~common])
                made.append((d, v, x, times, None))
                made.append((some, np.full(len(some), DOCUMENT), row[some], n[some], sums[some]))
                for d, v, x, times, more in made:
                    two = (v >= 0) & (x >= 0)
                    h = (v.view("u8") * _ODD[0] ^ x.view("u8")) * _ODD[1]
                    goes = ((h >> np.uint64(33)) % np.uint64(parts)).astype("i4")
                    for kind in (True, False):
                        pick = np.flatnonzero(two == kind)
                        if not len(pick):
                            continue
                        pick = pick[np.argsort(goes[pick], kind="stable")]
                        g = goes[pick]
                        cut = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g)).astype("i4")
                        column = lambda x, t, cut=cut: pa.ListArray.from_arrays(pa.array(cut), pa.array(x, t.value_type))
                        empty = lambda t, cut=cut: pa.ListArray.from_arrays(pa.array(np.zeros_like(cut)), pa.array([], t.value_type))
                        pairs = column((v[pick] << TOP_BITS | x[pick]).astype("u4").view("i4"), lists[2]) if kind else empty(lists[2])
                        firsts, seconds = (empty(t) if kind else column(y[pick], t) for y, t in ((v, lists[3]), (x, lists[4])))
                        value = empty(lists[5]) if more is None else column(more[pick], lists[5])
                        yield pa.RecordBatch.from_arrays([pa.array(g[cut[:-1]]), column(np.full(len(pick), base), lists[3]), column(d[pick].astype("u1").view("i1"), lists[0]), column(times[pick], lists[1]), pairs, firsts, seconds, value], names)

    return rows.select("row", "text").mapInArrow(run, _PACKED)


def exploded(packed: DataFrame) -> DataFrame:
    """(part, row, times, v, w, sum): an n-gram of a document a row; row is the document's base and byte."""
    each = packed.select("part", F.inline(F.arrays_zip("bases", "rows", "times", "pairs", "firsts", "seconds", "sums")))
    two = F.col("pairs").isNotNull()
    v = F.when(two, F.shiftrightunsigned("pairs", TOP_BITS).cast("long")).otherwise(F.col("firsts"))
    w = F.when(two, F.col("pairs").bitwiseAND(F.lit((1 << TOP_BITS) - 1)).cast("long")).otherwise(F.col("seconds"))
    return each.select("part", (F.col("bases") + F.col("rows").cast("int").bitwiseAND(F.lit(255))).alias("row"), "times", v.alias("v"), w.alias("w"), F.col("sums").alias("sum"))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are lower-cased runs of letters and digits, counted over all rows, repeated ones each time: a row that
    is repeated is another document to its copies.  A bigram that only one row holds is backed off there, however
    often it does.  Null texts and texts without words have 0 words, a score of 0 and a null mean.  Null doc_ids each
    give a row; an empty table gives none.  Scores are rounded to six places.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    words = materialize(unigrams(docs), "unigrams")
    total = words.agg(F.sum("c")).first()[0] or 1
    best = top_words(words)
    hashes, logs = np.array([r["word"] for r in best], "i8"), np.log(np.array([r["c"] for r in best], "f8"))
    packed = _packed(rows, hashes, logs, parts).repartitionById(parts, "part")
    grams = exploded(packed)
    table = grams.groupBy("part", "v", "w").agg(F.sum("times").alias("c"), F.count(F.lit(1)).alias("held"))
    # nothing is asked of bigrams that only one document holds
    table = table.where((F.col("held") > 1) | F.col("v").isin(WORD, DOCUMENT))
    asked = grams.join(table.hint("shuffle_hash"), ["part", "v", "w"])
    keys = np.where(np.arange(len(best)) < 1 << TOP_BITS, np.arange(len(best)), hashes)
    numbers = materialize(spark.createDataFrame(list(zip(keys.tolist(), logs.tolist(), strict=True)), "word long, ln double"), "lm-top")
    for k in ("v", "w"):
        asked = asked.join(F.broadcast(numbers.select(F.col("word").alias(k), F.col("ln").alias(f"ln_{k}"))), k, "left")
    is_word, is_doc, found = F.col("v") == WORD, F.col("v") == DOCUMENT, F.col("c") > F.col("times")
    gain = F.log(F.col("c") - F.col("times")) - F.coalesce("ln_v", F.lit(0.0)) - F.coalesce("ln_w", F.lit(0.0)) + float(np.log(total) - np.log(BACKOFF))
    base = F.col("sum") - F.col("times") * float(np.log(total)) + (F.col("times") - 1) * float(np.log(BACKOFF))
    value = F.when(is_doc, base).when(is_word, F.col("times") * F.log("c")).when(found, F.col("times") * gain)
    # words of bigrams that were found whose counts aren't broadcast: a document owes their logarithms
    owed = F.when(~is_doc & ~is_word & found, F.array_compact(F.array(F.when(F.col("ln_v").isNull(), F.col("v")), F.when(F.col("ln_w").isNull(), F.col("w")))))
    said = asked.select("row", "times", F.when(is_doc, F.col("w")).alias("of"), value.alias("score"), F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(owed, F.array().cast("array<long>")))).alias("word"))
    here = F.col("word").isNull()
    # times: the words of a document, or how often it owes a word
    said = said.groupBy("row", "word").agg(F.max("of").alias("of"), F.sum(F.when(~here | F.col("of").isNotNull(), F.col("times"))).alias("times"), F.sum(F.when(here, F.col("score"))).alias("score"))
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # rows of a part are together, and so are those of an n-gram
        said = materialize(said, "lm-sums")
    debts = said.where("word is not null").select("row", "word", "times").join(words, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("c")).alias("debt"))
    per = said.where("word is null").select("row", "of", F.col("times").alias("n"), "score").join(debts, "row", "left")
    per = per.groupBy(F.col("of").alias("row")).agg(F.count(F.lit(1)).alias("docs"), *(F.sum(c).alias(c) for c in ("n", "score", "debt")))
    out = rows.select("doc_id", "row").join(per, "row", "left")
    n = F.coalesce(F.expr("n div nullif(docs, 0)"), F.lit(0)).cast("long")
    s = F.coalesce((F.col("score") - F.coalesce("debt", F.lit(0.0))) / F.nullif(F.col("docs"), F.lit(0)), F.lit(0.0))
    return out.select("doc_id", n.alias("n_words"), F.round(s, 6).alias("log_score"), F.when(n > 0, F.round(s / n, 6)).alias("mean_log_score"))


ORACLE = rf"""
with r as (
  select row_number() over () as row, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ws from documents
), w as (select row, unnest(ws) as w, unnest(range(len(ws))) as i from r
), c1 as (select w, count(*) as c from w group by 1
), b as (select row, i, w, lag(w) over (partition by row order by i) as v from w
), own as (select row, v, w, count(*) as n from b where v is not null group by all
), c2 as (select v, w, sum(n) as c from own group by all
), s as (
  select b.row, count(*) as n, sum(case when c2.c > own.n then ln(c2.c - own.n) - ln(cv.c) else ln(cw.c) - ln((select count(*) from w)) + case when b.v is null then 0 else ln({BACKOFF}) end end) as s
  from b join c1 cw on cw.w = b.w left join c1 cv on cv.w = b.v left join own on own.row = b.row and own.v = b.v and own.w = b.w left join c2 on c2.v = b.v and c2.w = b.w group by 1
)
select doc_id, coalesce(n, 0) as n_words, round(coalesce(s, 0), 6) as log_score, round(s / n, 6) as mean_log_score from r left join s using (row)
"""
