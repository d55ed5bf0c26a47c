"""Packing of token ids into sequences of bounded length, as few as possible.

Documents are encoded where they are read and cut into pieces; what packs them is the histogram of the pieces' lengths, which has
at most as many rows as a sequence has tokens, however many pieces there are.  A configuration is a way to fill one sequence: how
many pieces of each length.  The configuration linear program asks for the fewest sequences, counted by configuration, that hold
all pieces.  It is solved by multiplicative weights: the worth of a length starts at its share of a sequence, which is the dual solution
of the bound by volume, with a small premium for long ones, so that short ones are left to fill gaps, and falls exponentially with the share of its pieces that is covered.  Each turn prices a configuration by a
knapsack dynamic program, takes it as often as its scarcest length allows, in whole sequences, and lowers the worth of what it holds.
The knapsack chooses among CANDIDATES lengths, of each stretch of lengths the one that is covered least.

Rounding: the pieces that the whole sequences of the program leave are packed by best fit, longest first, still as counts of lengths.
It is tried at several shares of coverage, and the fewest sequences are kept.  The last worths give a lower bound of any packing, by one
knapsack over all lengths.

The plan is a table of slots: the n-th piece of a length, counted over all tasks by prefix sums, has its sequence and offset from it.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import materialize, ship

#: Tokens of a sequence.
SIZE = 4096
#: Lengths among which a turn chooses; how fast a worth falls; what a whole sequence's length is worth beyond its share; shares of coverage from which the rest is tried by best fit.
CANDIDATES, FALL, PREMIUM, SHARES = 160, 0.1, 0.01, (0.5, 0.7, 0.8, 0.9, 1.0)
#: Characters of segments, and of words, that one worker remembers (some 20 bytes each with their ids); longest of them; bytes of text encoded at once.
KEPT, LONGEST, SLICE = 9_000_000, 64, 1 << 21


def _missing(lists: list[list[str]], known: dict[str, bytes]) -> set[str]:
    return set().union(*lists).difference(known)


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without cyclic collections, which would look at every list of segments again and again and find nothing."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them for a file of byte-level merges with word ends that drops white space.

    Nothing in such a file reaches over white space, so the ids of a text are those of its segments, and one that was seen
    before costs one look-up.  Characters below U+0300 are in normal form already and have settled classes, so new segments of
    these are parted by the file's pattern here, and only words that are new go to the library, many at once; others go there whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.parts = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, end = self.library.get_vocab(), told["model"]["end_of_word_suffix"]
        self.kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.ends = np.zeros(len(vocabulary), bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        self.odd = re.compile("[\x1c-\x1f\u0300-\U0010ffff]|<\\|")
        self.gap = re.compile("[ \t\r\n]+")
        self.known: dict[str, bytes] = {}
        self.spelled: dict[str, bytes] = {}
        self.known_chars = self.spelled_chars = 0

    def _spell(self, words: list[str]) -> None:
        """Adds the ids of words, each of which ends with the only token that ends a word."""
        for lo in range(0, len(words), 2000):
            some = words[lo : lo + 2000]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts, data = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist(), ids.tobytes()
            self.spelled.update((w, data[a:b]) for w, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True))

    def _learn(self, new: set[str]) -> None:
        """Adds the ids of segments."""
        odd = list(filter(self.odd.search, new))
        plain = list(new.difference(odd))
        lower = list(map(str.lower, plain))
        # a segment of letters is one word, and one with another character at its end is two; the rest is parted by the pattern
        word = list(map(str.isalpha, lower))
        rest = [(s, (x[:-1], x[-1]) if x[:-1].isalpha() and not x[-1].isspace() else self.parts(x)) for s, x, w in zip(plain, lower, word, strict=True) if not w]
        words = set(compress(lower, word)).union(*(c for _, c in rest)).difference(self.spelled)
        if self.spelled_chars > KEPT:
            self.spelled, self.spelled_chars = {}, 0
            words = set(compress(lower, word)).union(*(c for _, c in rest))
        self._spell(sorted(words))
        get = self.spelled.__getitem__
        self.known.update(zip(compress(plain, word), map(get, compress(lower, word)), strict=True))
        self.known.update((s, b"".join(map(get, c))) for s, c in rest)
        if odd:
            self.known.update((s, np.array(e.ids, self.kind).tobytes()) for s, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False), strict=True))
        self.known_chars += sum(map(len, new))
        self.spelled_chars += sum(map(len, words))
        for w in words:
            if len(w) > LONGEST:  # of use once
                del self.spelled[w]
                self.spelled_chars -= len(w)

    def _cut(self, text: str) -> list[str]:
        return self.gap.split(text) if self.odd.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.known_chars > KEPT:
            self.known, self.known_chars = {}, 0
        with _uncollected():
            cut = list(map(self._cut, texts))
            new = _missing(cut, self.known)
            self._learn(new)
            out = [np.frombuffer(b"".join(map(self.known.__getitem__, c)), self.kind) for c in cut]
        for s in new:
            if len(s) > LONGEST:  # of use once
                del self.known[s]
                self.known_chars -= len(s)
        return out

    def stretches(self, text: str, most: int = SLICE) -> Iterator[str]:
        """A long text, cut at blanks or line ends."""
        at = 0
        while len(text) - at > most:
            m = self.gap.search(text, at + most)
            if not m:
                break
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        if max(map(len, texts), default=0) <= SLICE:
            return self.encode(texts)
        return [np.concatenate([self.encode([x])[0] for x in self.stretches(t)]) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): the documents' ids in pieces of at most ``size``, written once.

    ids are unsigned little-endian 32-bit integers; start counts the document's ids before a piece; nth counts the pieces of
    one length that the same task has written before.  A null text counts as empty: its ids are the end id alone; without an end
    id it has no piece.  Repeated rows and null doc_ids are rows like others; an empty table has no pieces; other columns are ignored.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, nth = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, "i8")
        end = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1)), "i8")
            for lo, hi in _slices(sizes, SLICE):
                rows, number, start, length, ids, order = [], [], [], [], [], []
                for i, found in enumerate(enc.ids(batch.column(1).slice(lo, hi - lo).to_pylist()), lo):
                    all_ = np.concatenate([found.astype("<u4"), end])
                    for k, at in enumerate(range(0, len(all_), size)):
                        own = all_[at : at + size]
                        rows.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(len(own))
                        ids.append(own.tobytes())
                        order.append(int(nth[len(own)]))
                        nth[len(own)] += 1
                if rows:
                    columns = [batch.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(rows), pa.int64()), pa.array(order, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary, task long, nth long"), "pieces", compression="zstd")


Config = dict[int, int]


def knapsack(lengths: list[int], most: list[int], worth: list[float], size: int) -> tuple[Config, float]:
    """The configuration of the most worth, and that worth: of each length up to ``most``, in lots of 1, 2, 4, ... pieces."""
    lots = []
    for length, n, w in zip(lengths, most, worth, strict=True):
        n, k = min(n, size // length), 1
        while n > 0:
            k = min(k, n)
            lots.append((length, k, k * w))
            n, k = n - k, 2 * k
    best, new = np.zeros(size + 1, "f4"), np.empty(size + 1, "f4")
    took = np.empty((len(lots), size + 1), bool)
    for i, (length, k, w) in enumerate(lots):
        old = best[length * k :]
        with_ = np.add(best[: len(old)], np.float32(w), out=new[: len(old)])
        np.greater(with_, old, out=took[i, length * k :])
        np.maximum(old, with_, out=old)
    at, config = size, {}
    for i in range(len(lots) - 1, -1, -1):
        length, k, _ = lots[i]
        if at >= length * k and took[i, at]:
            config[length] = config.get(length, 0) + k
            at -= length * k
    return config, float(best[size])


def best_fit(left: np.ndarray) -> list[tuple[Config, int]]:
    """Best fit, longest first, of as many pieces of each length as ``left`` counts: configurations and how often each is taken."""
    size = len(left) - 1
    free: list[list[list]] = [[] for _ in range(size + 1)]
    room = np.zeros(size + 1, bool)

    def put(config: Config, n: int) -> None:
        f = size - sum(k * c for k, c in config.items())
        free[f].append([config, n])
        room[f] = True

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            f = length + int(room[length:].argmax())
            if not room[f]:
                full, rest = divmod(n, size // length)
                if full:
                    put({length: size // length}, full)
                if rest:
                    put({length: rest}, 1)
                break
            config, held = free[f][-1]
            each = min(n, held)
            if each == held:
                free[f].pop()
                room[f] = bool(free[f])
            else:
                free[f][-1][1] -= each
            put(config | {length: config.get(length, 0) + 1}, each)
            n -= each
    return [(c, n) for rows in free for c, n in rows]


def volume_bound(count: np.ndarray) -> int:
    """Sequences that any packing takes: no two pieces of over half a sequence share one, and where those of less than k are left out, none goes with one of more than the rest."""
    size = len(count) - 1
    number, volume = (np.concatenate([[0], np.cumsum(x)]) for x in (count, count * np.arange(size + 1)))  # of pieces shorter than each length
    k, half = np.arange(size // 2 + 1), size // 2 + 1
    middle = number[size - k + 1] - number[half]
    room = middle * size - (volume[size - k + 1] - volume[half])
    small = np.maximum(0, -((room - (volume[half] - volume[k])) // size))
    return int((number[-1] - number[half] + small).max())


class Plan(NamedTuple):
    """Configurations and how often each is taken; the sequences in all; a lower bound for any packing."""

    configs: list[tuple[Config, int]]
    sequences: int
    bound: int


def plan(histogram: dict[int, int], size: int = SIZE, candidates: int = CANDIDATES, fall: float = FALL, premium: float = PREMIUM) -> Plan:
    """The configuration program of a histogram of lengths, solved and rounded; the same histogram always gives the same plan."""
    count = np.zeros(size + 1, "i8")
    for length, n in histogram.items():
        count[length] = n
    left, lengths = count.copy(), np.flatnonzero(count)
    if not len(lengths):
        return Plan([], 0, 0)
    tokens = int((count * np.arange(size + 1)).sum())
    todo, taken, best = tokens, [], None
    for share in SHARES:
        while todo > (1 - share) * tokens:
            lengths = lengths[left[lengths] > 0]
            open_ = left[lengths] / count[lengths]
            pick = np.arange(len(lengths))
            if len(lengths) > candidates:
                stretch = pick * candidates // len(lengths)
                order = np.lexsort((-open_, stretch))
                pick = order[np.concatenate([[True], stretch[order][1:] != stretch[order][:-1]])]
            some = lengths[pick]
            config, _ = knapsack(some.tolist(), left[some].tolist(), (some / size * (1 + premium * some / size) * np.exp(fall * (open_[pick] - 1))).tolist(), size)
            times = min(int(left[k]) // c for k, c in config.items())
            for k, c in config.items():
                left[k] -= c * times
                todo -= c * times * k
            taken.append((config, times))
        rest = best_fit(left)
        n = sum(t for _, t in taken) + sum(t for _, t in rest)
        if best is None or n < best[1]:
            best = [*taken, *rest], n
    all_ = np.flatnonzero(count)
    worth = all_ / size * np.exp(-fall * (1 - left[all_] / count[all_]))
    _, most = knapsack(all_.tolist(), count[all_].tolist(), worth.tolist(), size)
    dual = float((worth * count[all_]).sum()) / max(most * (1 + 1e-4), 1e-9)
    return Plan(best[0], best[1], max(volume_bound(count), int(np.ceil(dual - 1e-6))))


class Slots(NamedTuple):
    """Rows in ascending order of (length, lo): the pieces lo, lo + 1, ... of a length are at ``offset`` of the sequences from ``sequence`` on."""

    length: np.ndarray
    lo: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def slots(configs: list[tuple[Config, int]]) -> Slots:
    rows, first, held = [], 0, {}
    for config, times in configs:
        at = 0
        for length in sorted(config, reverse=True):
            for _ in range(config[length]):
                lo = held.get(length, 0)
                held[length] = lo + times
                rows.append((length, lo, first, at))
                at += length
        first += times
    table = np.array(sorted(rows), "i8").reshape(-1, 4)
    return Slots(*(np.ascontiguousarray(c) for c in table.T))


def placed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of ``pieces`` (their ids may be left out or replaced) with sequence_id and offset, without task and nth.

    A length that very many pieces share is no hot key: its pieces are numbered by task.  The driver sees the
    histogram, at most ``size`` rows; the slots of the plan go to all tasks, some rows for each length that there is.
    """
    spark = cut.sparkSession
    held = materialize(cut.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("_base"))
    made = plan({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    sent = spark.sparkContext.broadcast(slots(made.configs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        begin = np.searchsorted(table.length, np.arange(size + 2))
        key = table.lo + (table.length << 44)
        for batch in batches:
            length, nth = (np.asarray(batch.column(c), "i8") for c in ("length", "_nth"))
            at = np.searchsorted(key, nth + (length << 44), "right") - 1
            assert (at >= begin[length]).all()
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table.sequence[at] + nth - table.lo[at]), pa.array(table.offset[at])], [*kept, "sequence_id", "offset"])

    kept = [c for c in cut.columns if c not in ("task", "nth")]
    rows = cut.join(bases, ["task", "length"]).select(*kept, (F.col("_base") + F.col("nth")).alias("_nth"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*kept).schema)
    return rows.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): all documents' ids, packed; odd rows as ``pieces`` says."""
    return placed(pieces(docs, tokenizer, end_id, size), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, bounds): the packed sequences themselves; bounds are where each piece begins, in ascending order."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))  # at most as many as a sequence has tokens
    return rows.select("sequence_id", "length", F.aggregate("p", F.to_binary(F.lit(""), F.lit("hex")), lambda s, x: F.concat(s, x["ids"])).alias("ids"), F.col("p.offset").alias("bounds"))


def pack_digests(docs: DataFrame, tokenizer: str, end_id: int | None = None, size: int = SIZE) -> DataFrame:
    """What ``pack`` gives, with the CRC-32 of each piece's ids in place of them, so that no shuffle moves ids."""
    cut = pieces(docs, tokenizer, end_id, size)
    return placed(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth"), size)
