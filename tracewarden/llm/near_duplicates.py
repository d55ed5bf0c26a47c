"""Near-duplicate documents by Order MinHash and banded alignment.

Words are lower-cased runs of letters and digits.  Texts with the same words form one class, so copies cost
one comparison together.  The sketch of a class has ``SKETCHES`` values; each comes from the ``MINIMA``
smallest-hashed k-mers of ``K`` words, labelled with their occurrence number and kept in text order, so that
two texts share a value with a probability that follows their edit similarity rather than their sets alone.

Classes that share a value meet in a bucket.  Its members are held against one anchor, then, where they are of other
components, against a second, in buckets of up to four also against a third, which ends them.  Other members of buckets that are mixed even
then, as where many unlike texts share a passage, meet by their rare pairs of words: two texts within the distance of a link have in
common some of the rarest pairs of each, one more than the distance can have changed (prefix filtering, exact for any order of pairs), and
a passage that many share is not rare.  Texts of whose rarest pairs as many are frequent as two must have in common go on with single words,
and those of which that is true again are compared bucket by bucket, in pairs of blocks.  So every pair that shares a value is compared, can't be similar,
or is in one component already.  A pair is linked if its edit distance in words is at most 1 - ``SIMILAR`` of the longer text, by an
alignment confined to the band of that width.  Components of links are the groups.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm import graph
from tracewarden.llm.common import materialize, packed, release, ship

K, MINIMA, SIMILAR = 5, 2, 0.8
#: Values of a sketch.  Of pairs with one word in five replaced at random places, 94 in 100 share one of 96 (65 one of 32).
SKETCHES = 96
#: Rounds of comparison with anchors, before the rest is compared in blocks: the first with the smallest member of a bucket, others with a pseudorandom one; columns that hold them.
ROUNDS = 3
ANCHORS = [f"anchor_{turn}" for turn in range(ROUNDS)]
#: Words in a row of which a rare token is made; common tokens that are asked for at least, and one more for so many that may have changed;
#: texts from which a token is frequent; cells of the histogram that orders tokens, and slices in which it is added up.
GRAMS, COMMON, MORE, FREQUENT, CELLS, SLICES = (2, 1), 3, 8, 48, 1 << 20, 256
#: Members and words of a block in which the rest is compared; numbers to which a text's words are folded before.
MEMBERS, HEAVY, FOLD = 512, 1 << 21, 256
#: Words of a text up to which an alignment has one mask of all rows for each word.
MASKED = 4096
#: Words whose hashes one worker keeps; k-mers hashed at once.
KEPT, BLOCK = 500_000, 1 << 14

_WORD = re.compile(r"[^\W_]+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SEEDS = np.array([xxhash.xxh64_intdigest(f"sketch {j}") for j in range(SKETCHES)], "u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    x ^= x >> np.uint64(32)
    x *= _ODD[1]
    x ^= x >> np.uint64(29)
    return x


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, found), "u8", len(found))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers in text order, each labelled with the number of earlier occurrences; a text of fewer than K words is one k-mer."""
    if len(words) < K:
        return np.array([xxhash.xxh64_intdigest(words.tobytes())], "u8") if len(words) else words
    h = words[: len(words) - K + 1] * _ODD[0]
    for j in range(1, K):
        h = _mix(h + words[j : len(words) - K + 1 + j] * _ODD[j])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if same.any():
        at = np.arange(len(s))
        begin = np.maximum.accumulate(np.where(same, 0, at))
        h[order] = np.where(same, _mix(s + (at - begin).astype("u8") * _ODD[3]), s)  # a first occurrence keeps its hash in every text
    return h


def sketch(words: np.ndarray) -> np.ndarray:
    """The SKETCHES values of a text; none for a text without words."""
    h = kmers(words)
    if not len(h):
        return np.empty(0, "i8")
    best = np.empty((SKETCHES, 0), "u8")
    where = np.empty((SKETCHES, 0), "i8")
    for lo in range(0, len(h), BLOCK):
        m = _mix(h[None, lo : lo + BLOCK] ^ _SEEDS[:, None])
        for _ in range(min(MINIMA, m.shape[1])):
            i = m.argmin(axis=1)[:, None]
            best = np.concatenate([best, np.take_along_axis(m, i, 1)], 1)
            where = np.concatenate([where, i + lo], 1)
            np.put_along_axis(m, i, np.uint64(0xFFFFFFFFFFFFFFFF), 1)
    if best.shape[1] > MINIMA:
        where = np.take_along_axis(where, np.argsort(best, axis=1, kind="stable")[:, :MINIMA], 1)
    where.sort(axis=1)  # in text order
    value = _mix(_SEEDS)
    for c in range(where.shape[1]):
        value = _mix(value * _ODD[2] + h[where[:, c]])
    return value.view("i8")


def _masks(a: np.ndarray, top: int, mask: int) -> Callable[[int, int], int]:
    """Where a word is in rows s to s + top, as bits: from one mask of all rows for each word, whose sizes grow with the square of the text."""
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i

    def at(w: int, s: int) -> int:
        x = places.get(w, 0)
        return (x >> s if s >= 0 else x << -s) & mask

    return at


def _windows(a: np.ndarray, top: int) -> Callable[[int, int], int]:
    """The same from sorted rows of each word, for long texts: memory in proportion to the text."""
    order = np.argsort(a, kind="stable")
    words, begin = np.unique(a[order], return_index=True)
    ends = np.append(begin[1:], len(a))
    rows = {w: order[i:k] for w, i, k in zip(words.tolist(), begin.tolist(), ends.tolist(), strict=True)}

    def at(w: int, s: int) -> int:
        r = rows.get(w)
        if r is None:
            return 0
        r = r[np.searchsorted(r, s) : np.searchsorted(r, s + top, "right")] - s
        if len(r) <= 8:
            return sum(1 << i for i in r.tolist())
        bits = np.zeros(top + 1, "u1")
        bits[r] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    return at


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance in words if at most ``most``, else ``most + 1``: bit-parallel alignment of the band of diagonals -most .. most."""
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    top = 2 * most
    mask = (1 << top + 1) - 1
    at_row = _masks(a, top, mask) if m <= MASKED else _windows(a, top)
    up, down = mask ^ ((1 << most) - 1), 0  # where the column goes up or down from row to row
    at = min(most, m)
    for j, w in enumerate(b.tolist(), 1):
        x = at_row(w, j - most - 1)
        diag = ((((x & up) + up) ^ up) | x | down) & mask
        right, left = (down | ~(diag | up)) & mask, diag & up
        if j + most <= m:
            at += not diag >> top & 1
        else:
            row = m - j + most
            at += (right >> row & 1) - (left >> row & 1)
        diag >>= 1
        up, down = (left | ~(diag | right)) & mask, diag & right
    return min(at, most + 1)


def one_shift(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the edit distance: words held against each other from the start up to a place and from the end after it, the best place taken."""
    m = min(len(a), len(b))
    if not m:
        return max(len(a), len(b))
    left = np.cumsum(a[:m] != b[:m])  # mismatches of the first k words, k from 1
    right = np.cumsum((a[len(a) - m :] != b[len(b) - m :])[::-1])[::-1]  # of the last m - k words, k from 0
    best = min(int(left[-1]), int(right[0]), int((left[:-1] + right[1:]).min()) if m > 1 else m)
    return best + abs(len(a) - len(b))


def similar(a: np.ndarray, b: np.ndarray, share: float = SIMILAR) -> bool:
    """Whether the edit similarity 1 - distance / longer length is at least ``share``."""
    longer = max(len(a), len(b))
    most = int(np.floor((1 - share) * longer + 1e-9))
    if abs(len(a) - len(b)) > most:
        return False
    # words that one text has more often than the other must each be edited: a lower bound of the distance
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    s = both[order]
    sign = np.where(order < len(a), 1, -1)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, int)
    extra = np.add.reduceat(sign, starts) if len(s) else sign
    if max(extra[extra > 0].sum(), -extra[extra < 0].sum()) > most:
        return False
    return one_shift(a, b) <= most or distance(a, b, most) <= most


def worded(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, words) for each row: node stands for the word sequence, words are packed 32-bit hashes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                nodes, packed = [], []
                for text in part.column(2).to_pylist():
                    w = word_hashes(text)
                    nodes.append(xxhash.xxh64_intdigest(w.tobytes(), 7) - (1 << 63))
                    packed.append(w.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "text_hash", "node", "words"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, node long, words binary")


def sketched(classes: DataFrame) -> DataFrame:
    """(bucket, node): a row for each sketch value of each of ``classes`` (node, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                values = [sketch(np.frombuffer(w.as_buffer(), "<u4").astype("u8")) for w in part.column(1)]
                nodes = np.repeat(part.column(0).to_numpy(), [len(v) for v in values])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(nodes)], ["bucket", "node"])

    return classes.select("node", "words").mapInArrow(run, "bucket long, node long")


def _anchored(slots: DataFrame) -> DataFrame:
    """The rows of ``slots`` (bucket, node) in buckets of several members (n), with ROUNDS different members of the bucket as anchors, null where it has fewer.

    The first is the smallest, others follow from the members alone, so that buckets of the same members have the same and a pair isn't made for each.
    """
    by_bucket = Window.partitionBy("bucket")
    out = slots.withColumn("n", F.count(F.lit(1)).over(by_bucket)).withColumn(ANCHORS[0], F.min("node").over(by_bucket)).where("n > 1")
    for turn in range(1, ROUNDS):
        other = ~F.col("node").isin(*(F.col(a) for a in ANCHORS[:turn]))
        first = F.min(F.when(other, F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node"))).over(by_bucket)
        out = out.withColumn(ANCHORS[turn], first["node"])
    return out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, wb = batch.column(2), batch.column(3)
            keep = [i for i in range(batch.num_rows) if similar(np.frombuffer(wa[i].as_buffer(), "<u4"), np.frombuffer(wb[i].as_buffer(), "<u4"))]
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    a = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    b = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    rows = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "wa", "wb")
    return rows.mapInArrow(run, "a long, b long")


def _links_within(node: np.ndarray, root: np.ndarray, block: np.ndarray, words: list[np.ndarray], earlier: list[list[int]]) -> list[tuple[int, int]]:
    """Links that join all similar pairs whose roots differ, those within a block only if there is but one.

    Pairs that share an ``earlier`` bucket are compared there.
    """
    shared: dict[int, int] = {}
    for i, own in enumerate(earlier):
        for b in own:
            shared[b] = shared.get(b, 0) | 1 << i
    root, one = root.copy(), (block == block[0]).all()
    size = np.array([len(w) for w in words], "i8")
    folded = np.stack([np.bincount(w % FOLD, minlength=FOLD) for w in words]).astype("i4")
    out = []
    for i in range(len(node) - 1):
        rest = slice(i + 1, None)
        most = np.floor((1 - SIMILAR) * np.maximum(size[i], size[rest]) + 1e-9)
        met = 0
        for b in earlier[i]:
            met |= shared[b]
        new = np.unpackbits(np.frombuffer(met.to_bytes(len(node) // 8 + 1, "little"), "u1"), bitorder="little")[i + 1 : len(node)] == 0
        at = np.flatnonzero(new & (root[rest] != root[i]) & (np.abs(size[rest] - size[i]) <= most) & (one | (block[rest] != block[i])))
        if not len(at):
            continue
        # an edit changes the number of at most two folded words by one
        at = at[np.abs(folded[rest][at] - folded[i]).sum(axis=1) <= 2 * most[at]] + i + 1
        for k in at.tolist():
            if root[k] != root[i] and similar(words[i], words[k]):
                out.append((int(node[i]), int(node[k])))
                root[root == root[k]] = root[i]
    return out


def tokens(words: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, kind) for each ``gram`` words in a row: kind stands for the words, token for them and their occurrence number."""
    w = words.astype("u8")
    kind = _mix(w[: len(w) - gram + 1] + _ODD[gram])
    for j in range(1, gram):
        kind = _mix(kind * _ODD[2] + w[j : len(w) - gram + 1 + j])
    order = np.argsort(kind, kind="stable")
    s = kind[order]
    at = np.arange(len(s))
    begin = np.maximum.accumulate(np.where(np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else at, 0, at))
    token = np.empty_like(kind)
    token[order] = _mix(s + (at - begin).astype("u8") * _ODD[3])
    return token, kind


def asked(size: int, gram: int) -> tuple[int, int]:
    """(changed, common): how many tokens of a text of ``size`` words a link may change, and how many of the rarest are asked for; both grow with size."""
    changed = int(np.floor((1 - SIMILAR) * gram * size + 1e-9))
    return changed, max(1, min(max(COMMON, changed // MORE), size - gram + 1 - changed))


def least_asked(size: int, gram: int) -> int:
    """The fewest common tokens that are asked for between a text of ``size`` words and a similar one, which may be a fifth shorter."""
    return asked(int(np.ceil(SIMILAR * size - 1e-6)), gram)[1]


def rarest(words: np.ndarray, gram: int, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest tokens of a text, and how many of them it has in common with any text that is similar.

    One edit changes at most ``gram`` of them, so of all but a fifth times ``gram`` of its length are common; of the n
    smallest common ones, in any order of tokens, each is among the first n more than that.  Long texts have many rare tokens
    of which unlike ones share a few by chance, so n grows with them.
    """
    token, kind = tokens(words, gram)
    changed, common = asked(len(words), gram)
    if len(token) <= changed + common:
        return token, common
    order = np.lexsort((token, seen[kind % np.uint64(len(seen))]))
    return token[order[: changed + common]], common


def _histogram(members: DataFrame, gram: int) -> np.ndarray:
    """How often tokens of each cell occur in the texts of ``members``: as many numbers as there are cells, whatever the members.

    A task gives the cells that it has seen in one row for each slice, so its rows don't grow with its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, "i8")
        for batch in batches:
            for w in batch.column(0):
                kind = tokens(np.frombuffer(w.as_buffer(), "<u4"), gram)[1]
                np.add.at(n, (kind % np.uint64(CELLS)).astype("i8"), 1)
        at = np.flatnonzero(n)
        if len(at):
            part = at * SLICES // CELLS
            cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(at)).astype("i4")
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x, pa.int64())) for x in (at, n[at])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int32()), *lists], ["slice", "cells", "times"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        low = lambda k: -(-k * CELLS // SLICES)  # noqa: E731  the first cell of a slice
        for batch in batches:
            for k, cells, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                mine = sums.setdefault(k, np.zeros(low(k + 1) - low(k), "i8"))
                mine[cells.values.to_numpy() - low(k)] += times.values.to_numpy()
        if sums:
            packed = [np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array([low(k) for k in sums], pa.int64()), pa.array(packed, pa.binary())], ["low", "sums"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("words").mapInArrow(run, "slice int, cells array<long>, times array<long>")
    seen = np.zeros(CELLS, "u4")
    for r in rows.repartition(parts, "slice").mapInArrow(added, "low long, sums binary").collect():
        seen[r["low"] : r["low"] + len(r["sums"]) // 4] = np.frombuffer(r["sums"], "<u4")
    return seen


def _by_rare_tokens(members: DataFrame, texts: DataFrame, gram: int) -> tuple[DataFrame, DataFrame]:
    """(links, rest) among ``members`` (node, root, size, words): all links but those of two members that both are in ``rest`` (node)."""
    sent = members.sparkSession.sparkContext.broadcast(_histogram(members, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [rarest(np.frombuffer(w.as_buffer(), "<u4"), gram, sent.value) for w in part.column(3)]
                n = [len(t) for t, _ in found]
                if sum(n):
                    own = [pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in range(3)]
                    asks = [[c for _, c in found], [least_asked(k, gram) for k in part.column(2).to_pylist()]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t for t, _ in found]).view("i8")), *own, *(pa.array(np.repeat(x, n), pa.int32()) for x in asks)], ["token", "node", "root", "size", "common", "low"])

    posted = materialize(members.select("node", "root", "size", "words").mapInArrow(run, "token long, node long, root long, size long, common int, low int"), "posted")
    frequent = _frequent(posted)
    marked = _marked(posted, frequent)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = posted.drop("common", "low").join(frequent, "token", "left_anti").join(marked, "node").select("token", "node", "root", "size", "common")
    met = materialize(rare.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(_met, "a long, b long, least int, token long, root long"), "met")
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least")).where("n >= least").select("a", "b")
    pairs = materialize(pairs, "pairs")
    links = materialize(_verified(pairs, texts), "links")
    rest = materialize(marked.where("common < 0").select("node"), "rest-nodes")
    release(posted, frequent, marked, met, pairs)
    return links, rest


def _frequent(posted: DataFrame) -> DataFrame:
    """(token, mixed): the tokens of ``posted`` that more than FREQUENT texts have, and whether these are of several components."""
    per = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("mixed"))
    return materialize(per.where(F.col("n") > FREQUENT).select("token", "mixed"), "frequent")


def _marked(posted: DataFrame, frequent: DataFrame) -> DataFrame:
    """(node, common): how many rare tokens each text of ``posted`` is to have in common with a similar one, below zero for texts that are left over.

    Two similar texts have as many tokens in common as each asks for at least (low).  A text with fewer frequent ones of several components
    meets every similar text by rare ones, then; only two texts that are both left over may have none in common.
    """
    own = posted.join(frequent, "token", "left").groupBy("node").agg(F.count(F.when(F.col("mixed"), 1)).alias("n"), F.min("common").alias("common"), F.min("low").alias("low"))
    common = F.when(F.col("n") == 0, F.col("common")).when(F.col("n") < F.col("low"), F.col("low") - F.col("n")).otherwise(-F.col("common"))
    return materialize(own.select("node", common.cast("int").alias("common")), "marked")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, node, root, size, common) in the order of tokens: the pairs that can be linked of each token that few have, but those of two texts that are left over (common is below zero), and (a, -, -, token, root) for each text that has a frequent one."""
    names = ["a", "b", "least", "token", "root"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    held, frequent = None, None

    def told(*columns: np.ndarray | None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def paired(rows: list[np.ndarray], first: np.ndarray, n: int) -> pa.RecordBatch | None:
        """Pairs of the tokens that have ``n`` rows each, the first of them at ``first``."""
        _, node, root, size, common = rows
        i, j = np.triu_indices(n, 1)
        x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
        ok = (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= SIMILAR * np.maximum(size[x], size[y]) - 1e-6)
        ok &= (common[x] > 0) | (common[y] > 0)
        x, y = x[ok], y[ok]
        return told(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.minimum(abs(common[x]), abs(common[y])), None, None) if len(x) else None

    def finish(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token = rows[0]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.append(first, len(token)))
        for k in np.unique(n[(n > 1) & (n <= FREQUENT)]).tolist():
            found = paired(rows, first[n == k], k)
            if found is not None:
                yield found
        many = np.repeat(n > FREQUENT, n)
        if many.any():
            yield told(rows[1][many], None, None, token[many], rows[2][many])

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in range(5)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        token = rows[0]
        if frequent is not None:  # a frequent token goes on
            to = int(np.searchsorted(token, frequent, "right")) if token[0] == frequent else 0
            if to:
                yield told(rows[1][:to], None, None, token[:to], rows[2][:to])
                rows = [x[to:] for x in rows]
                token = rows[0]
            if not len(token):
                held = None
                continue
            frequent = None
        # the last token may go on in the next batch
        at = int(np.searchsorted(token, token[-1]))
        if len(token) - at > FREQUENT:
            yield told(rows[1][at:], None, None, token[at:], rows[2][at:])
            frequent, held = token[-1], None
        else:
            held = [x[at:] for x in rows]
        if at:
            yield from finish([x[:at] for x in rows])
    if held is not None:
        yield from finish(held)


def _compared(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """The links among all members of different components in each bucket of ``rest`` (bucket, node, root); buckets of one component have none.

    The largest component of a bucket, which may be nearly all of it, is not held against itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                node, root, block, own, words = zip(*rows, strict=True)
                earlier = [[b for b in o if b < now[0]] for o in own]
                links = _links_within(np.array(node), np.array(root), np.array(block), [np.frombuffer(w.as_buffer(), "<u4") for w in words], earlier)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            for key, *row in zip(keys, *(batch.column(c).to_pylist() for c in (3, 4, 5, 6)), batch.column(7), strict=True):
                if key != now:
                    yield from finish()
                    now, rows = key, []
                rows.append(row)
        yield from finish()

    rest = materialize(rest.join(classes.select("node", "size").hint("merge"), "node"), "rest")
    per = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = per.groupBy("bucket").agg(F.max(F.struct("n", "root", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / MEMBERS), F.ceil(size / HEAVY), F.lit(1)).cast("int")
    many, others = blocks(F.col("main.n"), F.col("main.size")), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    sizes = materialize(sizes.where("n > main.n").select("bucket", F.col("main.root").alias("main"), many.alias("many"), others.alias("others")), "blocks")
    rest = materialize(rest.join(sizes.hint("merge"), "bucket"), "rest-blocks")
    own = rest.groupBy("node").agg(F.collect_set("bucket").alias("own"))  # at most SKETCHES
    # blocks below zero are of the largest component; each of them meets those of the others, which meet one another too
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rest = rest.withColumn("block", F.when(F.col("root") == F.col("main"), -1 - at(F.col("many"))).otherwise(at(F.col("others"))))
    rest = rest.withColumn("k", F.explode(F.when(F.col("block") < 0, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("many"), F.col("others") - 1))))
    rest = rest.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
    texts = materialize(own.join(classes.select("node", "words").hint("merge"), "node"), "rest-texts")
    rest = rest.join(texts.hint("merge"), "node").select("bucket", "i", "j", "node", "root", "block", "own", "words")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rest.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def _rest_joined(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` after all links of members (bucket, node) of buckets that are still mixed."""
    of = lambda rows: materialize(graph.rooted(rows, "node", roots, "root"), "held")
    held = of(members)
    mixed = materialize(held.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket"), "mixed")
    wanted = held.join(mixed.hint("merge"), "bucket", "left_semi").select("node").distinct()
    for gram in GRAMS:
        texts = materialize(classes.join(wanted.hint("merge"), "node", "left_semi"), "wanted")
        if texts.isEmpty():
            release(texts, held, mixed)
            return roots
        links, wanted = _by_rare_tokens(graph.rooted(texts, "node", roots, "root"), texts, gram)
        roots = graph.merge(roots, links)
        release(texts, links)
    # of the rest all buckets are gone through, with the components that there are now
    release(held, mixed)
    rest = of(members.join(wanted.hint("merge"), "node", "left_semi"))
    links = materialize(_compared(rest, classes), "links")
    roots = graph.merge(roots, links)
    release(rest, links)
    return roots


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class_id, kept): a row for each row of ``docs`` (doc_id, text; other columns are ignored).

    class_id is the smallest doc_id of the group, null where all are null; kept marks its row or, where
    several rows have that doc_id, those of them with the smallest text hash: repeated rows are all
    marked.  Null texts and texts without words form one group.  Texts of fewer than K words are one
    k-mer, so only equal ones group.  An empty table gives an empty result.
    """
    rows = materialize(worded(docs), "worded")
    classes = rows.groupBy("node").agg(F.min_by("words", "text_hash").alias("words"))
    classes = materialize(classes.withColumn("size", (F.octet_length("words") / 4).cast("long")), "classes")
    worded_rows, rows = rows, materialize(rows.select("doc_id", "text_hash", "node"), "rows")  # from here on classes hold the words
    release(worded_rows)
    members = materialize(_anchored(sketched(classes)), "members")
    roots = graph.no_roots(docs.sparkSession)
    # the last anchor is for buckets that it ends; in larger ones it would be held against nearly all members again, with few links
    ended = F.col("n") <= ROUNDS + 1
    for turn in range(ROUNDS):
        # those that were anchors before have been held against all others of the bucket
        pairs = (members if turn < ROUNDS - 1 else members.where(ended)).where(~F.col("node").isin(*(F.col(a) for a in ANCHORS[: turn + 1]))).select("node", F.col(ANCHORS[turn]).alias("anchor"))
        pairs = pairs.select(F.greatest("node", "anchor").alias("a"), F.least("node", "anchor").alias("b")).distinct()
        if turn:
            pairs = graph.rooted(graph.rooted(pairs, "a", roots, "ra"), "b", roots, "rb").where("ra <> rb").select("a", "b")
        pairs = materialize(pairs, "pairs")
        links = materialize(_verified(pairs, classes), "links")
        roots = graph.merge(roots, links)
        release(pairs, links)
    anchor = F.when(ended, F.col("node").isin(*map(F.col, ANCHORS))).otherwise(F.col("node").isin(*map(F.col, ANCHORS[:-1])))
    left = materialize(members.where(~anchor).select("bucket", "node"), "left")
    release(members)
    members = left
    roots = _rest_joined(members, classes, roots)
    release(members, classes)
    out = materialize(graph.rooted(rows, "node", roots, "root").select("doc_id", "text_hash", "root"), "rooted")
    release(rows, roots)
    best = materialize(out.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("best")), "best")
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return out.join(best.hint("merge"), "root").select("doc_id", "text_hash", F.col("best.doc_id").alias("class_id"), chosen.alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, with all columns."""
    found = groups(docs).where("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_times"))
    kept = materialize(found, "kept").alias("k")
    d = docs.select(packed(docs).alias("d"), F.xxhash64("text").alias("_hash"))
    rows = d.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("_hash") == F.col("k.text_hash"))).select("d", "_hash", "_times")
    repeated = rows.where("_times > 1").withColumn("_rn", F.row_number().over(Window.partitionBy("d.doc_id", "_hash").orderBy(F.lit(0)))).where("_rn = 1")
    return rows.where("_times = 1").select("d.*").unionByName(repeated.select("d.*"))
