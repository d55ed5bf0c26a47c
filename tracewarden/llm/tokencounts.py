"""Token counts from a finite-state machine compiled from a vocabulary's merges, without keeping any ids.

The machine is a deterministic transducer over the bytes of a word, the last of them marked as such.  Merging pairs
by rank has two properties that make it one: every beginning of a word has one encoding of its own, and a row of
tokens is an encoding if every two neighbours are the encoding of their bytes.  So what can still follow depends on
the places where a token may have begun that isn't finished: for each of them the node of the trie of tokens that was
reached, the token before, and how many tokens there were by then.  That set is a state.  A byte moves every place on
in the trie; the one token that ends there and agrees with the token before it ends the new beginning's encoding.  Its
number of tokens less the old one's, which may be negative, is what the transition emits; what is emitted from the first
byte of a word to its last adds up to the word's tokens.  States and transitions are made when a text first needs them.

Normal form, lower case, and the pattern that parts words follow the vocabulary file.  None of them reaches over a
blank, tab or line end, so the machine is in its first state at each of these.  A chunk of a text is then the map
(head, emitted, tail) from the state before it to the state after it and the tokens emitted between; a state is named by
the unfinished segment that leads to it: whatever comes in is completed by the head, and the tail comes out.  Maps
compose associatively: long texts are dealt to many tasks chunk by chunk, and their maps composed in runs, then runs of runs.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import ship

#: Characters in a chunk; bytes from which a text is dealt in chunks; maps composed in one run.
CHUNK, LONG, RUN = 1 << 15, 1 << 16, 256
#: Characters of segments, and states, that one worker remembers before it starts anew.
KEPT, STATES = 6_000_000, 300_000
#: Fixed value: white space other than blank, tab and line ends, as the patterns of vocabulary files mean it.
_SPACE = regex.compile("[\x0b\x0c\x85\xa0  -     　]")
_MARK, _NEVER = 256, 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others numbered from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = dict(zip(shown, map(chr, shown), strict=True))
    letters |= {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return [letters[b] for b in range(256)]


def _newer(category: str) -> set[str]:
    """Characters that belong to a category, but not in the library's tables, which may be older than those of ``regex``."""
    from tokenizers import Regex, pre_tokenizers

    new = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    new = "".join(regex.findall(rf"\p{{{category}}}", new))
    old = {c for t, _ in pre_tokenizers.Split(Regex(rf"[^\p{{{category}}}]+"), "removed").pre_tokenize_str(new) for c in t}
    return set(new) - old


def _lower() -> dict[int, str]:
    """Lower case of characters for which the library's tables, which may be newer than Python's, have another."""
    from tokenizers import normalizers

    all_ = [chr(c) for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000]
    return {ord(c): x for c, x in zip(all_, normalizers.Lowercase().normalize_str("\n".join(all_)).split("\n"), strict=True) if x != c.lower()}


def _starts() -> str:
    """Marks that no mark moves over in the library's normal form, since its tables don't have them yet."""
    from tokenizers import normalizers

    marks = [c for c in map(chr, range(0x20000)) if unicodedata.combining(c) > 1]
    return "".join(c for c in marks if normalizers.NFC().normalize_str(f"b{c}\u0334") == f"b{c}\u0334")


class Machine:
    """The transducer of the merges of one vocabulary file: words to numbers of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, end = told["model"], told["model"]["end_of_word_suffix"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        names: dict[tuple[int, ...], int] = {}

        def spelled(token: str) -> tuple[int, ...]:
            last = token.endswith(end) and token != end
            s = [byte[c] for c in (token[: -len(end)] if last else token)]
            return (*s[:-1], s[-1] + _MARK) if last else tuple(s)

        for token in model["vocab"]:
            if token.removesuffix(end) and set(token.removesuffix(end)) <= byte.keys():
                names.setdefault(spelled(token), len(names))
        #: the rank of each pair that merges; the pair and rank that make each token, None for bytes
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, int] | None] = [None] * len(names)
        for rank, (a, b) in enumerate(model["merges"]):
            s, t = spelled(a), spelled(b)
            pair = names[s], names[t]
            self.merges[pair] = rank
            self.made[names[s + t]] = (*pair, rank)
        #: trie of tokens: (node, byte) to node; the token that ends at a node
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner = {0}
        for s, n in names.items():
            made = self.made[n]
            at = 0
            for b in s:
                self.inner.add(at)
                key = at << 9 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                at = self.child[key]
            self.token[at] = n
        self.agree: dict[tuple[int, int], bool] = {}
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        # sets with exceptions are slow, so they are for segments that need them
        self.newer, self.lower = set(), _lower()
        starts = _starts()
        self.starts = regex.compile(f"(?=[{starts}])" if starts else "(?!)", regex.V1)
        for category in "LN":
            newer = _newer(category)
            self.newer |= newer
            pattern = pattern.replace(rf"\p{{{category}}}", rf"[\p{{{category}}}--[{''.join(sorted(newer))}]]" if newer else rf"\p{{{category}}}")
        self.exact = regex.compile(pattern, regex.V1)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in told["added_tokens"]) or "(?!)")
        self._begin()

    def _begin(self) -> None:
        """A state is a set of (node, token before, tokens until then); state 0 is the begin of a word."""
        first = ((0, -1, 0),)
        self.states: list[tuple[tuple[int, int, int], ...]] = [first]
        self.numbers = {first: 0}
        self.go: dict[int, tuple[int, int]] = {}
        self.counted: dict[str, int] = {"": 0}
        self.chars = 0

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that uses it up) of the tokens at one side of a token's merge tree, first the byte, last the token itself."""
        out = [(token, _NEVER)]
        while (pair := self.made[out[-1][0]]) is not None:
            out.append((pair[side], pair[2]))
        return out[::-1]

    def _agree(self, a: int, b: int) -> bool:
        """Whether two tokens on end are the encoding of their bytes: no pair that lay at their border by some rank merged there."""
        if a < 0:
            return True
        known = self.agree.get((a, b))
        if known is None:
            left, right = self._spine(a, 1), self._spine(b, 0)
            i = j = 0
            while True:
                (x, until), (y, till) = left[i], right[j]
                rank = self.merges.get((x, y), _NEVER)
                # of equal pairs the leftmost merges first
                if rank < until and rank <= till and rank < _NEVER:
                    known = False
                    break
                if until == till == _NEVER:
                    known = True
                    break
                i, j = (i + 1, j) if until <= till else (i, j + 1)
            self.agree[a, b] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Makes the transition of a state by a byte: (state, emitted)."""
        open_, ended = [], None
        for node, before, n in self.states[state]:
            to = self.child.get(node << 9 | byte)
            if to is None:
                continue
            if self.token[to] >= 0 and ended is None and self._agree(before, self.token[to]):
                ended = (self.token[to], n + 1)
            if to in self.inner:
                open_.append((to, before, n))
        token, n = ended
        if byte >= _MARK:
            made = (0, n)
        else:
            places = tuple(sorted((node, before, m - n) for node, before, m in open_)) + ((0, token, 0),)
            number = self.numbers.setdefault(places, len(self.states))
            if number == len(self.states):
                self.states.append(places)
            made = (number, n)
        self.go[state << 9 | byte] = made
        return made

    def word(self, word: str) -> int:
        """Tokens emitted from the first byte of a word to its last."""
        data, state, n, go = word.encode("utf-8", "replace"), 0, 0, self.go
        for b in data[:-1]:
            key = state << 9 | b
            state, d = go[key] if key in go else self._step(state, b)
            n += d
        key = state << 9 | data[-1] + _MARK
        return n + (go[key] if key in go else self._step(state, data[-1] + _MARK))[1]

    def _segment(self, segment: str) -> int:
        if "<|" in segment and self.special.search(segment):
            return self._parts(segment)
        pattern = self.pattern
        if not segment.isascii():
            segment = "".join(unicodedata.normalize("NFC", x) for x in self.starts.split(segment)) if self.starts.search(segment) else unicodedata.normalize("NFC", segment)
            segment = _SPACE.sub(" ", segment).replace("\u03a3", "\u03c3").translate(self.lower)
            if not self.newer.isdisjoint(segment):
                pattern = self.exact
        elif "\x0b" in segment or "\x0c" in segment:
            segment = segment.replace("\x0b", " ").replace("\x0c", " ")
        return sum(map(self.word, pattern.findall(segment.lower())))

    def _parts(self, segment: str) -> int:
        """A segment with special tokens: one token each, and what stands between them."""
        return sum(map(self._segment, self.special.split(segment))) + len(self.special.findall(segment))

    def learn(self, segments: set[str]) -> None:
        """Runs the machine over segments that it hasn't seen; their totals are kept as transitions over whole segments."""
        if len(self.states) > STATES:
            self._begin()
        elif self.chars > KEPT:
            self.counted, self.chars = {"": 0}, 0
        counted = self.counted
        for s in segments:
            if s not in counted:
                counted[s] = self._segment(s)
                self.chars += len(s) + 8

    def total(self, segments: list[str]) -> int:
        return sum(map(self.counted.__getitem__, segments))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts."""
        cut = [_segments(t or "") for t in texts]
        self.learn(set().union(*cut))
        return [self.total(c) for c in cut]


def _segments(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class ChunkMap(NamedTuple):
    """head and tail are the unfinished segments at the ends; a chunk without white space has only a head and ``whole`` set."""

    head: str
    emitted: int
    tail: str
    whole: bool


def chunk_maps(m: Machine, chunks: list[str]) -> list[ChunkMap]:
    cut = [_segments(c) for c in chunks]
    m.learn(set().union(*(x[1:-1] for x in cut)))
    return [ChunkMap(x[0], 0, "", True) if len(x) == 1 else ChunkMap(x[0], m.total(x[1:-1]), x[-1], False) for x in cut]


def composed(m: Machine, maps: list[ChunkMap]) -> ChunkMap:
    """The map of chunks that follow one another; the tail of each but the last is completed by heads."""
    head, emitted, tail, met = [], 0, [], False
    for x in maps:
        (tail if met else head).append(x.head)
        if not x.whole:
            if met:
                between = "".join(tail)
                m.learn({between})
                emitted += m.counted[between]
            emitted, tail, met = emitted + x.emitted, [x.tail], True
    return ChunkMap("".join(head), emitted, "".join(tail), not met)


def finished(m: Machine, x: ChunkMap) -> int:
    """Tokens of a whole text, from the first state to the end of the text."""
    m.learn({x.head, x.tail})
    return m.counted[x.head] + x.emitted + m.counted[x.tail]


_machines: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    """One machine for each worker process."""
    if path not in _machines:
        _machines[path] = Machine(path)
    return _machines[path]


def _long_counts(rows: DataFrame, tokenizer: str, chunk: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of ``rows`` (doc_id, n_bytes, text), dealt chunk by chunk."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    kept = "doc_id", "n_bytes", "row"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                at = range(0, max(1, len(text)), chunk)
                same = [pa.array([batch.column(c)[i].as_py()] * len(at), batch.column(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(at)), pa.int64()), pa.array([text[a : a + chunk] for a in at], pa.string())], [*kept, "at", "chunk"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                made = pa.array(map(ChunkMap._asdict, chunk_maps(m, part.column("chunk").to_pylist())), pa.struct([("head", pa.string()), ("emitted", pa.int64()), ("tail", pa.string()), ("whole", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*kept, "at")), *made.flatten()], [*kept, "at", *ChunkMap._fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # equal rows have equal chunks: each is composed once
        pdf = pdf.sort_values("at", kind="stable")
        once = pdf.drop_duplicates("at")
        x = composed(machine(tokenizer), [ChunkMap(*r) for r in once[list(ChunkMap._fields)].itertuples(index=False)])
        first = pdf.iloc[:1]
        return first.assign(at=first["at"] // RUN, times=(pdf["at"] == first["at"].iat[0]).sum(), **x._asdict())

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        x = ChunkMap(*next(out[list(ChunkMap._fields)].itertuples(index=False)))
        return out.assign(n_tokens=finished(machine(tokenizer), x), times=pdf["times"].iat[0])[["doc_id", "n_bytes", "times", "n_tokens"]]

    same = f"doc_id {kind}, n_bytes long, row long"
    map_ = "at long, head string, emitted long, tail string, whole boolean"
    named = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    chunks = named.mapInArrow(cut, f"{same}, at long, chunk string")
    made = chunks.repartition("row", "at").mapInArrow(maps, f"{same}, {map_}")
    runs = made.groupBy("doc_id", "n_bytes", "row", F.expr(f"at div {RUN}").alias("run")).applyInPandas(run, f"{same}, {map_}, times long")
    counts = runs.groupBy("doc_id", "n_bytes", "row").applyInPandas(last, f"doc_id {kind}, n_bytes long, times long, n_tokens long")
    return counts.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null doc_ids each give a row; an
    empty table gives none.  Texts of up to ``long`` bytes are counted where they are read, others in chunks of ``chunk``
    characters.  ``tokenizer`` is a vocabulary file of byte-level merges with an end-of-word suffix whose
    pattern drops white space.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(m.counts(part.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = rows.where(F.col("n_bytes") <= long).mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    counted = short.unionByName(_long_counts(rows.where(F.col("n_bytes") > long), tokenizer, chunk))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
