"""Toxic spans by a linear-chain conditional random field over words.

Labels are known for documents only.  Labelled tokens are derived from them: in a toxic training document
the words that carry a mark (the word itself, or its first letters) which is common in toxic documents and
all but absent from others.  The field has two states for each word, clean and toxic, with weights for the
hashed marks of the word and for the step from state to state; it is fitted by gradient ascent on the
likelihood of windows of labelled tokens.  Whole texts are then tagged by forward-backward; a document's
score is the largest marginal of its words, and words with a marginal of one half or more are its spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import ship
from tracewarden.llm.learning import held_out, labelled

#: Rows of either label in the training sample; bits of a mark's hash; lengths of first letters that are marks.
SAMPLE, BITS, LETTERS = 3000, 18, (4, 5, 6)
#: A mark tells if so many toxic documents of the sample hold it, it is so many times as likely in one as in another document,
#: and the chance that any mark looks like that by accident is at most CHANCE.
LEAST, TIMES, CHANCE = 5, 60.0, 0.01
#: Hashes by which copies of a document are known to be such.
ORIGINS = 3
#: Words in a training window; windows of a text; passes; step size; weight decay.
WINDOW, PER_TEXT, STEPS, RATE, DECAY = 24, 2, 80, 0.3, 1e-5
KEPT, BLOCK = 500_000, 64

_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "u8")


def lowered(text: str | None) -> str:
    """Lower case, character by character, so that places are those of the text itself."""
    return (text or "").replace("\u0130", "i").lower()


class Field(NamedTuple):
    """weights of marks and bias for the toxic state; log weights of steps [from, to]; log weights of the first state."""

    marks: np.ndarray
    bias: float
    step: np.ndarray
    first: np.ndarray


def marks(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in LETTERS if len(word) >= n]


def slots(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(m) >> (64 - BITS) for m in marks(word)]


class Sample:
    """The words of labelled texts as numbers, and the hashes of each word's marks (0 where it has fewer)."""

    def __init__(self, sample: list[tuple[str, int]]):
        number: dict[str, int] = {}
        self.texts = [np.array([number.setdefault(w, len(number)) for w in _WORD.findall(lowered(t))], "i4") for t, _ in sample]
        self.toxic = np.array([y for _, y in sample], bool)
        self.marks = np.zeros((len(number), 1 + len(LETTERS)), "u8")
        for i, w in enumerate(number):
            h = [xxhash.xxh64_intdigest(m) for m in marks(w)]
            self.marks[i, : len(h)] = h

    def origins(self, which: np.ndarray) -> np.ndarray:
        """(ORIGINS, texts): for each text the smallest hash of its runs of three words under several hashes; most copies of a text agree in one."""
        out = np.zeros((ORIGINS, len(which)), "u8")
        for j, i in enumerate(which):
            t = self.texts[i].astype("u8")
            h = (t[:-2] * _MIX[0] + t[1:-1] * _MIX[1] + t[2:]) * _MIX[2] if len(t) > 2 else t
            for k in range(ORIGINS):
                x = (h ^ _MIX[k] ^ (h >> np.uint64(29))) * _MIX[(k + 1) % 3]
                out[k, j] = (x ^ (x >> np.uint64(32))).min() if len(x) else 0
        return out

    def telling(self) -> np.ndarray:
        """The marks that tell toxic documents from others, sorted: by the documents that hold them, copies counted once."""
        bad, good = np.flatnonzero(self.toxic), np.flatnonzero(~self.toxic)
        origin = self.origins(bad)
        n1, n0 = min(len(np.unique(o)) for o in origin), len(good)
        found, support = [], []
        for c in range(self.marks.shape[1]):
            held = [np.unique(self.marks[np.unique(self.texts[i]), c]) for i in bad]
            mark, doc = np.concatenate(held), np.repeat(np.arange(len(bad)), [len(h) for h in held])
            m, at, n = np.unique(mark, return_inverse=True, return_counts=True)
            keep = ((n >= LEAST) & (m > 0))[at]
            mark, doc = mark[keep], doc[keep]
            least = None
            for o in origin:
                _, first = np.unique(mark * _MIX[2] ^ o[doc], return_index=True)
                names, n = np.unique(mark[first], return_counts=True)
                least = n if least is None else np.minimum(least, n)
            found.append(names[least >= LEAST])
            support.append(least[least >= LEAST])
        found, support = np.concatenate(found), np.concatenate(support)
        found, at = np.unique(found, return_index=True)
        support, elsewhere = support[at], np.zeros(len(found), "i8")
        for i in good if len(found) else ():
            m = np.unique(self.marks[np.unique(self.texts[i])])
            at = np.minimum(np.searchsorted(found, m), len(found) - 1)
            elsewhere[at[found[at] == m]] += 1
        # a bound of the chance that a mark which is as likely in other documents is so rare in them, times the marks tried
        both, share = support + elsewhere, n0 / max(1, n0 + n1)
        at = elsewhere / both if len(found) else elsewhere
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = both * (np.where(at > 0, at * np.log(at / share), 0) + (1 - at) * np.log((1 - at) / (1 - share)))
        return found[(support * n0 >= TIMES * elsewhere * n1) & (odds >= np.log(max(1, len(found)) / CHANCE))]


def _forward_backward(e: np.ndarray, live: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (windows, words) of the toxic state, and (windows, 2, 2) expected steps, of padded windows with log weights ``e``."""
    n, k = e.shape
    t, psi = np.exp(step), np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
    alpha, beta = np.empty((n, k, 2)), np.ones((n, k, 2))
    alpha[:, 0] = np.exp(first) * psi[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for j in range(1, k):
        a = (alpha[:, j - 1] @ t) * psi[:, j]
        alpha[:, j] = np.where(live[:, j, None], a / a.sum(1, keepdims=True), alpha[:, j - 1])
    for j in range(k - 2, -1, -1):
        b = (psi[:, j + 1] * beta[:, j + 1]) @ t.T
        beta[:, j] = np.where(live[:, j + 1, None], b / b.sum(1, keepdims=True), 1.0)
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * t * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return m[:, :, 1], (pair * live[:, 1:, None, None]).sum(1)


def train(sample: list[tuple[str, int]]) -> Field | None:
    """None without rows of both labels."""
    if len({y for _, y in sample}) < 2:
        return None
    data = Sample(sample)
    if not any(len(t) for t, y in zip(data.texts, data.toxic, strict=True) if y):
        return None
    known = data.telling()
    toxic = np.isin(data.marks, known).any(1)
    alike = np.isin(data.marks, np.setdiff1d(data.marks[toxic], [0])).any(1)
    windows = []
    for i, (text, y) in enumerate(zip(data.texts, data.toxic, strict=True)):
        if not len(text):
            continue
        tags = toxic[text] if y else np.zeros(len(text), bool)
        # around toxic words, in other documents around words that share a mark with one, else anywhere
        at = np.flatnonzero(tags if y else alike[text])[:PER_TEXT].tolist() or [i * 7919 % len(text)]
        for j in at:
            lo = max(0, j - WINDOW // 2)
            windows.append((text[lo : lo + WINDOW], tags[lo : lo + WINDOW]))
    n, width = len(windows), 1 + len(LETTERS)
    idx = np.full((n, WINDOW, width), 1 << BITS, "i4")
    gold, live = np.zeros((n, WINDOW)), np.zeros((n, WINDOW), bool)
    slot = np.where(data.marks > 0, data.marks >> np.uint64(64 - BITS), np.uint64(1 << BITS)).astype("i4")
    for i, (text, tags) in enumerate(windows):
        live[i, : len(text)], gold[i, : len(text)], idx[i, : len(text)] = True, tags, slot[text]
    w, bias = np.zeros((1 << BITS) + 1), -3.0
    step, first = np.zeros((2, 2)), np.zeros(2)
    seen = [(gold[:, :-1] == a) & (gold[:, 1:] == b) & live[:, 1:] for a in (0, 1) for b in (0, 1)]
    seen = np.array([x.sum() for x in seen], "f8").reshape(2, 2)
    start = np.array([(gold[:, 0] == 0).sum(), (gold[:, 0] == 1).sum()], "f8")
    sq, sb, st, sf = np.full_like(w, 1e-8), 1e-8, np.full((2, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(STEPS):
        e = w[idx].sum(2) + bias
        p, pairs = _forward_backward(e, live, step, first)
        r = np.where(live, gold - p, 0.0)
        g = np.bincount(idx.ravel(), np.repeat(r.ravel(), width), minlength=len(w)) - DECAY * w * n
        g[-1] = 0
        gb, gt, gf = r.sum(), seen - pairs.sum(0), start - np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()])
        sq, sb, st, sf = sq + g * g, sb + gb * gb, st + gt * gt, sf + gf * gf
        w, bias = w + RATE * g / np.sqrt(sq), bias + RATE * gb / np.sqrt(sb)
        step, first = step + RATE * gt / np.sqrt(st), first + RATE * gf / np.sqrt(sf)
    return Field(w[:-1], float(bias), step, first)


class Tagger:
    """Applies a field to many whole texts at once; the weight of a word is worked out once."""

    def __init__(self, field: Field):
        self.field = field
        self.weights: dict[str, float] = {}

    def _weights(self, found: list[list[str]]) -> np.ndarray:
        if len(self.weights) > KEPT:
            self.weights.clear()
        for w in set().union(*found) - self.weights.keys():
            self.weights[w] = float(self.field.marks[slots(w)].sum()) + self.field.bias
        get = self.weights.__getitem__
        return np.fromiter((x for f in found for x in map(get, f)), "f8", sum(map(len, found)))

    def marginals(self, found: list[list[str]]) -> np.ndarray:
        """The toxic state's marginal of every word of all texts, on end.

        All texts form one chain: the step into the first word of a text doesn't depend on the word
        before, so texts don't touch.  The chain is cut into blocks; products of the blocks' step
        matrices give the state before and after each, then all blocks are run side by side.
        """
        e = self._weights(found)
        n = len(e)
        if not n:
            return e
        blocks = -(-n // BLOCK)
        pad = blocks * BLOCK - n
        psi = np.exp(np.clip(np.append(e, np.zeros(pad)), -30, 30)).reshape(blocks, BLOCK).T
        begins = np.cumsum([0] + [len(f) for f in found])[:-1]
        new = np.zeros(blocks * BLOCK + 1, bool)
        new[begins] = True
        new = new[:-1].reshape(blocks, BLOCK).T
        t, s = np.exp(self.field.step), np.exp(self.field.first)
        m00, m10 = np.where(new, s[0], t[0, 0]), np.where(new, s[0], t[1, 0])
        m01, m11 = np.where(new, s[1], t[0, 1]) * psi, np.where(new, s[1], t[1, 1]) * psi
        p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
        for k in range(BLOCK):
            p00, p01, p10, p11 = p00 * m00[k] + p01 * m10[k], p00 * m01[k] + p01 * m11[k], p10 * m00[k] + p11 * m10[k], p10 * m01[k] + p11 * m11[k]
            scale = 1 / (p00 + p01 + p10 + p11)
            p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
        enter, leave = np.empty((2, blocks)), np.empty((2, blocks))
        a, b = 0.5, 0.5
        rows = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True))
        for i, (x00, x01, x10, x11) in enumerate(rows):
            enter[:, i] = a, b
            a, b = a * x00 + b * x10, a * x01 + b * x11
            a, b = a / (a + b), b / (a + b)
        a, b = 0.5, 0.5
        for i in range(blocks - 1, -1, -1):
            x00, x01, x10, x11 = rows[i]
            leave[:, i] = a, b
            a, b = x00 * a + x01 * b, x10 * a + x11 * b
            a, b = a / (a + b), b / (a + b)
        alpha = np.empty((2, BLOCK, blocks))
        a, b = enter
        for k in range(BLOCK):
            a, b = a * m00[k] + b * m10[k], a * m01[k] + b * m11[k]
            scale = 1 / (a + b)
            a, b = a * scale, b * scale
            alpha[0, k], alpha[1, k] = a, b
        out = np.empty((BLOCK, blocks))
        a, b = leave
        for k in range(BLOCK - 1, -1, -1):
            clean, toxic = alpha[0, k] * a, alpha[1, k] * b
            out[k] = toxic / (clean + toxic)
            a, b = m00[k] * a + m01[k] * b, m10[k] * a + m11[k] * b
            scale = 1 / (a + b)
            a, b = a * scale, b * scale
        return out.T.ravel()[:n]

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """(scores, spans) of whole texts."""
        found = [_WORD.findall(lowered(t)) for t in texts]
        p = self.marginals(found)
        sizes = np.array([len(f) for f in found], "i8")
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        score = np.zeros(len(texts))
        if len(some):
            score[some] = np.maximum.reduceat(p, (ends - sizes)[some])
        spans = []
        for i, text in enumerate(texts):
            hit = np.flatnonzero(p[ends[i] - sizes[i] : ends[i]] >= 0.5) if score[i] >= 0.5 else ()
            at = [m.span() for m in _WORD.finditer(lowered(text))] if len(hit) else []
            spans.append([{"start": at[k][0], "end": at[k][1]} for k in hit])
        return score, spans


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE, keep_text_hash: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of ``docs`` (doc_id, text; other columns are never read).

    The field learns ``column`` of ``labels`` from at most ``sample`` rows of either label that are not held
    out.  Texts without words, null ones too, score 0 and have no spans; so do all if there are no labels
    of both kinds.  spans are character offsets in the text; row_hash, if asked for, is
    xxhash64 of doc_id and text.  Repeated rows and null doc_ids
    each give a row; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    field = spark.sparkContext.broadcast(train(labelled(docs, labels, column, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        tagger = Tagger(field.value) if field.value else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(2).to_pylist()
                s, spans = tagger.tag(texts) if tagger else (np.zeros(len(texts)), [[] for _ in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array(spans, kind), part.column(3)], ["doc_id", "held_out", "score", "spans", "row_hash"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, spans array<struct<start:int,end:int>>, row_hash long")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans", *["row_hash"] * keep_text_hash)
