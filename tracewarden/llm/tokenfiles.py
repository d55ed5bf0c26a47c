"""Flat files of token ids with 64-bit document offsets.

A data set is a folder of parts, in ascending order of (doc_id, hash of the text), null doc_ids first:

* ``part-NNNNNN-*.ids``: the ids of all the part's documents on end, unsigned little-endian integers of 2
  bytes where the vocabulary fits them, else 4;
* ``part-NNNNNN-*.off``: one unsigned 64-bit offset more than documents, counted in ids from the part's begin;
* ``part-NNNNNN-*.doc``: the doc_ids as signed 64-bit integers, then one byte each, 1 for a null doc_id;
* ``parts/``: Parquet with part, file, docs, tokens, base; file is the name of the part's files without their endings,
  base, the ids in all earlier parts, is their prefix sum.

Every attempt of a task writes files of its own; those that ``parts`` names are the data set, so lost and repeated tasks
do no harm and nothing is renamed.  The folder must be one that driver and executors share; where it is mounted, parts
are memory-mapped.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import materialize, new_path, ship

#: Characters of pieces kept between batches by one worker; a fuller cache is emptied, so its memory is bounded.
CACHED = 20_000_000
#: The white space that, next to other white space or other than blank and line feed, sends a text to the library whole.
_WHOLE = ("  ", " \n", "\n ", "\n\n", *map(chr, (1, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file with the usual pattern.

    That pattern begins a token at every single blank that a letter, digit or sign follows, and at both
    sides of a single line feed.  So the ids of a text are those of its pieces between such places, and a
    piece that was seen before costs one look-up.  New pieces go to the library many at once, a line each.
    Texts with other white space go to the library whole.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else "<u4"
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        self.line = self._ids("\n")
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, new: list[str]) -> None:
        width = self.line.itemsize
        for lo in range(0, len(new), 2000):
            lines = [p for p in new[lo : lo + 2000] if p != "\n"]
            ids = self._ids("\n".join(lines))
            cuts = np.flatnonzero(ids == self.line[0]) * width
            packed = ids.tobytes()
            for p, a, b in zip(lines, [0, *(cuts + width).tolist()], [*cuts.tolist(), len(packed)], strict=True):
                self.known[p] = packed[a:b]
                self.chars += len(p) + 8
        self.known["\n"] = self.line.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.chars > CACHED:
            self.known, self.chars = {}, 0
        get, parts, gaps = self.known.get, [], []
        for t in texts:
            t = t or ""
            if any(w in t for w in _WHOLE):
                parts.append([self._ids(t).tobytes()])
                continue
            pieces = t.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")
            ids = list(map(get, pieces))
            i = -1
            for _ in range(ids.count(None)):
                i = ids.index(None, i + 1)
                gaps.append((ids, i, pieces[i]))
            parts.append(ids)
        self._learn(list({p for _, _, p in gaps}))
        for ids, i, p in gaps:
            ids[i] = self.known[p]
        return [b"".join(ids) + self.end for ids in parts]


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder for each worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _slots(docs: DataFrame, n: int) -> tuple[list[int], bool]:
    """n - 1 bounds that part rows evenly by doc_id, a frequent doc_id as often as its rows fill parts, and whether any is null."""
    at = [i / n for i in range(1, n)] or [0.5]
    row = docs.agg(F.percentile_approx("doc_id", at, 20 * n).alias("b"), F.bool_or(F.col("doc_id").isNull()).alias("nulls")).first()
    return sorted(row["b"] or [])[: max(0, n - 1)], bool(row["nulls"])


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id long, text) into a new data set at ``folder`` and returns its parts table.

    A null text counts as empty (its ids are the end id alone); rows with the same doc_id follow one
    another by the hash of their texts, over several parts if they are many; an empty table gives a data set without parts; other columns are
    ignored.  Texts are encoded where they are read; one shuffle deals their packed ids to the parts,
    whose bounds are quantiles of doc_id (null doc_ids are dealt by hash, to parts of their own).
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, nulls = _slots(docs, n)
    first = n if nulls else 0
    edges = np.array(bounds, "i8")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, tie = part.column(0), part.column(2).to_numpy(zero_copy_only=False)
                known = np.array(ids.is_valid())
                place = (tie.astype("i8").view("u8") ^ np.uint64(1 << 63)) / 2.0**64  # of the text among all, by its hash
                at = np.array(ids.fill_null(0))
                low, high = np.searchsorted(edges, at, "left"), np.searchsorted(edges, at, "right")
                slot = np.where(known, first + low + np.minimum((place * (high - low + 1)).astype("i8"), high - low), np.minimum((place * n).astype("i8"), n - 1))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype("i4")), ids, part.column(2), pa.array(enc.encode(part.column(1).to_pylist()), pa.binary())], ["part", "doc_id", "tie", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        width = np.dtype(encoder(tokenizer, end_id).kind).itemsize
        now, out, file, sizes, names, empty, done = None, None, "", [], [], [], []

        def close() -> None:
            if now is None:
                return
            out.close()
            offsets = np.concatenate([[0], np.cumsum(np.array(sizes, "u8"))]).astype("<u8")
            for kind, data in (("off", offsets.tobytes()), ("doc", np.array(names, "<i8").tobytes() + np.array(empty, "u1").tobytes())):
                with fs.open_output_stream(f"{root}/{file}.{kind}") as f:
                    f.write(data)
            done.append((now, file, len(sizes), int(offsets[-1])))

        for batch in batches:
            for part, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if part != now:
                    close()
                    now, sizes, names, empty = part, [], [], []
                    file = f"part-{part:06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{root}/{file}.ids")
                out.write(ids)
                sizes.append(len(ids) // width)
                names.append(doc or 0)
                empty.append(doc is None)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "docs", "tokens"])

    # the folder exists before any task writes to it
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    rows = docs.select("doc_id", F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    packed = rows.mapInArrow(encode, "part int, doc_id long, tie long, ids binary")
    dealt = packed.repartitionById(n + first, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    parts = materialize(dealt.mapInArrow(store, "part int, file string, docs long, tokens long"), "token-parts")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts.withColumn("base", F.sum("tokens").over(order) - F.col("tokens")).write.parquet(f"{folder}/parts")
    return spark.read.parquet(f"{folder}/parts")


def part_arrays(folder: str, file: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc_ids, null flags) of one part: memory-mapped where the folder is mounted, else read."""
    fs, root = _open(folder)

    def raw(name: str, dtype: str) -> np.ndarray:
        at = f"{root}/{file}.{name}"
        size = fs.get_file_info(at).size
        if not size:
            return np.empty(0, dtype)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(at, dtype, "r")
        with fs.open_input_file(at) as f:
            return np.frombuffer(f.read(), dtype)

    docs = raw("doc", "u1")
    n = len(docs) // 9
    return raw("ids", kind), raw("off", "<u8"), docs[: 8 * n].view("<i8"), docs[8 * n :]


def read_digests(spark: SparkSession, folder: str, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """From the files: (doc_id, start, n_tokens, ids_crc32) for each document; start counts the ids of all documents before it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    ship(spark)
    parts = spark.read.parquet(f"{folder}/parts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer, end_id).kind
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, off, names, null = part_arrays(folder, file, kind)
                for lo in range(0, len(names), 4096):
                    hi = min(lo + 4096, len(names))
                    cut = off[lo : hi + 1].astype("i8")
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
                    doc = pa.array(np.array(names[lo:hi]), pa.int64(), mask=np.array(null[lo:hi], bool))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("part", "file", "base").repartitionById(n, "part").mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Writes ``docs`` to a data set in the shared folder and returns ``read_digests`` of it."""
    folder = new_path(docs.sparkSession, "token-files")
    write(docs, folder, tokenizer, end_id)
    return read_digests(docs.sparkSession, folder, tokenizer, end_id)
