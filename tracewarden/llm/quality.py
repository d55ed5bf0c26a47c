"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import ship
from tracewarden.llm.learning import held_out, labelled

#: Bits of a feature's hash; rows of either label in the training sample; passes over it.
BITS, SAMPLE, PASSES = 20, 3000, 3
#: Step size and regularisation of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
KEPT = 500_000

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(xxhash.xxh64_intdigest("the word before, again"))


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > KEPT:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h


_hashes = _Hashes()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, begins): hashed unigrams and bigrams of all texts on end, and where each text's begin.

    Tokens are lower-cased words and runs of signs; a token that repeats the one before it becomes one
    fixed token.  Every text also has the bias feature 0, so none is empty.
    """
    found = [_TOKEN.findall((t or "").lower()) for t in texts]
    sizes = np.array([len(f) for f in found], "i8")
    h = np.fromiter((x for f in found for x in map(_hashes.__getitem__, f)), "u8", int(sizes.sum()))
    ends = np.cumsum(sizes)
    first = np.zeros(len(h) + 1, bool)
    first[ends - sizes] = True
    first = first[:-1]
    before = np.roll(h, 1)
    h = np.where((h == before) & ~first, _SAME, h)
    pair = (np.roll(h, 1) * _ODD + h) * _ODD
    pair ^= pair >> np.uint64(31)
    shift = np.uint64(64 - BITS)
    begins = 2 * (ends - sizes) + np.arange(len(sizes))
    out = np.zeros(2 * len(h) + len(sizes), "i8")
    at = np.arange(len(h)) * 2 + np.repeat(np.arange(len(sizes)), sizes) + 1
    out[at] = (h * _ODD) >> shift
    out[at + 1] = np.where(first, 0, pair >> shift).astype("i8")
    return out, begins


def train(sample: list[tuple[str, int]]) -> np.ndarray:
    """Weights; without rows of both labels they are zero but for a bias towards the label there is."""
    n = 1 << BITS
    z, g2, w = np.zeros(n), np.zeros(n), np.zeros(n, "f4")
    rows = []
    for text, y in sample:
        idx, _ = features([text])
        at, times = np.unique(idx, return_counts=True)
        rows.append((at.astype("i4"), (times / np.sqrt(len(idx))).astype("f4"), y))
    for _ in range(PASSES):
        for at, x, y in rows:
            za, ga = z[at], g2[at]
            wa = np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za) / ((BETA + np.sqrt(ga)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wa @ x, -35, 35))) - y) * x
            step = (np.sqrt(ga + g * g) - np.sqrt(ga)) / ALPHA
            z[at] = za + g - step * wa
            g2[at] = ga + g * g
    hit = np.abs(z) > L1
    w[hit] = ((np.sign(z) * L1 - z) / ((BETA + np.sqrt(g2)) / ALPHA + L2))[hit]
    return w


def scores(texts: list[str | None], w: np.ndarray) -> np.ndarray:
    """Probability of label 1: the sparse dot product of a text's n-grams, over the root of their number."""
    idx, begins = features(texts)
    sums = np.add.reduceat(w[idx].astype("f8"), begins)
    return 1 / (1 + np.exp(-np.clip(sums / np.sqrt(np.diff(np.append(begins, len(idx)))), -35, 35)))


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; other columns are never read).

    The model learns ``column`` of ``labels`` from at most ``sample`` rows of either label that are not
    held out; all texts are scored whole.  Null and empty texts have the score of the bias alone.  Repeated
    rows and null doc_ids each give a row; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(train(labelled(docs, labels, column, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores(part.column(2).to_pylist(), weights.value), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
