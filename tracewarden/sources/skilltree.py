"""A data source for trees of skills: folders and ZIP archives of skills, entries that file sources hide included.

``spark.read.format("skilltree").load(path)``: every folder and every .zip directly below ``path`` is a skill
(with option ``single`` = true, ``path`` itself is one).  Links are reported and not followed.  Members of archives with
absolute or ``..`` paths are left out; the folders that members lie in are entries.

A skill that can't be read whole is an error of its own, and no other's: its row for the path "." says in ``error``
what is wrong, and it has no other rows.  Errors are archives that are corrupt, encrypted or larger than ``maxZip``
(50 MB), folders that can't be listed, files of more than ``maxFile`` bytes (1 GB, what a row can hold) and archives that
unpack to more than ``maxTotal`` (4 GB).  A file of a folder that can't be opened has null content.

The driver lists the folders; tasks get about ``bytesPerTask`` (32 MB) each, and no more than ``skillsPerTask`` (8) skills on average.
The files of a large folder are shared out among tasks; an archive is one task's.

``spark.readStream.format("skilltree").load(path)`` reads archives as they are dropped into ``path`` (moved there whole, since an archive
that is still being written is a corrupt one).  What has arrived is logged in the folder ``arrivals``, which is required and belongs to
one query: an offset is a number of log entries, so a batch that is run again has the archives that it had.  An archive that is replaced
by another of the same name arrives again.
"""

from __future__ import annotations

import heapq
import json
import os
import stat
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "skill_id string, file_path string, name string, suffix string, depth int, is_file boolean, is_symlink boolean, symlink_target string, content string, error string"


def _suffix(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if 0 < at < len(name) - 1 else ""


def _text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def _row(skill: str, path: str, is_file: bool, target: str | None = None, raw: bytes | None = None, error: str | None = None) -> tuple:
    name = path.rsplit("/", 1)[-1]
    return (skill, path, name, _suffix(name), 0 if path == "." else len(path.split("/")), is_file, target is not None, target, _text(raw), error)


class Part(InputPartition):
    """Skills to read: (path of a skill, the entries of a folder that are this task's or None for an archive, what is wrong with it, whether its row for "." is this task's)."""

    def __init__(self, work: list[tuple[str, list[tuple] | None, str | None, bool]]):
        self.work = work


class TooLarge(Exception):
    pass


UNREADABLE = (OSError, zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error, TooLarge)
#: Bytes of an archive's contents that are kept from the pass that looks for errors; a larger one is read again.
HELD = 64 << 20
#: What an entry costs beside its bytes; how many folders are listed at once.
ENTRY, LISTERS = 512, 16


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def even(items: list[tuple[int, tuple]], n: int) -> list[list[tuple]]:
    """Items with weights in ``n`` lots of about the same weight: the heaviest first, each to the lightest lot."""
    lots = [(0, k, []) for k in range(n)]
    for weight, item in sorted(items, key=lambda x: (-x[0], x[1][0])):
        total, k, lot = heapq.heappop(lots)
        lot.append(item)
        heapq.heappush(lots, (total + weight, k, lot))
    return [lot for _, _, lot in sorted(lots, key=lambda x: x[1]) if lot]


class SkillTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.single = str(options.get("single", "false")).lower() == "true"
        self.max_zip = int(options.get("maxzip", 50 << 20))
        self.max_file = int(options.get("maxfile", 1 << 30))
        self.max_total = int(options.get("maxtotal", 4 << 30))
        self.per_task = int(options.get("skillspertask", 8))
        self.bytes = int(options.get("bytespertask", 32 << 20))

    def partitions(self) -> list[Part]:
        if self.single:
            return self.parts([self.path])
        with os.scandir(self.path) as found:
            return self.parts(sorted(e.path for e in found if e.is_dir(follow_symlinks=False) or e.name.endswith(".zip")))

    def parts(self, paths: list[str]) -> list[Part]:
        """Tasks of about the same size, for skills at ``paths``."""

        def listed(path: str) -> tuple[str, list[tuple] | None, str | None, int]:
            try:
                if path.endswith(".zip") and os.path.isfile(path):
                    return path, None, None, 3 * os.path.getsize(path)  # unpacked it is some three times as large
                entries = list(self._tree(path))
                return path, entries, None, sum(size for *_, size in entries)
            except UNREADABLE as e:
                return path, [], _said(e), 0

        with ThreadPoolExecutor(LISTERS) as pool:
            found = list(pool.map(listed, paths))
        total = sum(size + ENTRY * (1 + len(entries or ())) for _, entries, _, size in found)
        n = max(-(-total // self.bytes), -(-len(paths) // self.per_task), 1)
        most = max(ENTRY, total // n // 2)
        items = []
        for path, entries, error, size in found:
            if entries is None or error:
                items.append((size + ENTRY, (path, entries, error, True)))
                continue
            lot, weight, first = [], 0, True
            for e in entries:
                if lot and weight + e[-1] + ENTRY > most:
                    items.append((weight, (path, lot, None, first)))
                    lot, weight, first = [], 0, False
                lot.append(e)
                weight += e[-1] + ENTRY
            if lot or first:
                items.append((weight, (path, lot, None, first)))
        return [Part(lot) for lot in even(items, n)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, entries, error, first in partition.work:
            if entries is None:
                yield from self._whole(path)
                continue
            if first:
                yield _row(path, ".", False, error=error)
            for name, is_file, target, _ in entries:
                yield _row(path, name, is_file, target, self._read(f"{path}/{name}") if is_file else None)

    def _whole(self, path: str) -> Iterator[tuple]:
        """The rows of an archive, or its error alone: nothing is told before all of it has been unpacked once."""
        skill, held, size = path.removesuffix(".zip"), [], 0
        try:
            for row in self._archive(path, skill):
                size += len(row[8] or "") + ENTRY
                if size <= HELD:
                    held.append(row)
        except UNREADABLE as e:
            yield _row(skill, ".", False, error=_said(e))
            return
        yield _row(skill, ".", False)
        yield from held if size <= HELD else self._archive(path, skill)

    def _tree(self, root: str) -> Iterator[tuple[str, bool, str | None, int]]:
        """(path, is_file, target of a link, bytes) of the entries of a folder."""
        todo = [root]
        while todo:
            with os.scandir(todo.pop()) as found:
                entries = sorted(found, key=lambda e: e.name)
            for e in entries:
                path = os.path.relpath(e.path, root).replace(os.sep, "/")
                if e.is_symlink():
                    yield path, False, os.path.realpath(e.path), 0
                elif e.is_dir():
                    yield path, False, None, 0
                    todo.append(e.path)
                else:
                    size = e.stat().st_size
                    if size > self.max_file:
                        raise TooLarge(f"{path} is larger than {self.max_file} bytes")
                    yield path, True, None, size

    def _read(self, path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except OSError:
            return None

    def _archive(self, at: str, skill: str) -> Iterator[tuple]:
        if os.path.getsize(at) > self.max_zip:
            raise TooLarge(f"archive is larger than {self.max_zip} bytes")
        left, folders = self.max_total, set()
        with zipfile.ZipFile(at) as z:
            for m in z.infolist():
                path = PurePosixPath(m.filename)
                if path.is_absolute() or ".." in path.parts or not path.parts:
                    continue
                for above in [*reversed(path.parents), *([path] if m.is_dir() else [])]:
                    if above.parts and above not in folders:
                        folders.add(above)
                        yield _row(skill, str(above), False)
                if m.is_dir():
                    continue
                left -= m.file_size
                if m.file_size > self.max_file or left < 0:
                    raise TooLarge(f"{path} unpacks to more than the limit")
                if stat.S_ISLNK(m.external_attr >> 16):
                    yield _row(skill, str(path), False, z.read(m).decode("utf-8", "replace"))
                else:
                    with z.open(m) as f:  # reads all, so that a bad check sum shows at once
                        raw = f.read(m.file_size + 1)
                    yield _row(skill, str(path), True, None, raw)


def failed(files: DataFrame) -> DataFrame:
    """(skill_id, error): the skills that couldn't be read."""
    return files.where("error is not null").select("skill_id", "error")


class SkillTreeStream(DataSourceStreamReader):
    """Archives in the order in which they were first seen; the log has one file for each look that found new ones."""

    def __init__(self, options: dict):
        self.tree = SkillTreeReader(options)
        if "arrivals" not in options:
            raise ValueError("option arrivals must name a folder for the log of arrivals")
        self.log = options["arrivals"].removeprefix("file://")
        os.makedirs(self.log, exist_ok=True)
        self.seen: set[tuple] = set()
        self.entries = 0

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def _entry(self, k: int) -> str:
        return f"{self.log}/{k:09d}.json"

    def _catch_up(self) -> None:
        while os.path.exists(self._entry(self.entries)):
            with open(self._entry(self.entries), encoding="utf-8") as f:
                self.seen.update(map(tuple, json.load(f)))
            self.entries += 1

    def latestOffset(self) -> dict:
        self._catch_up()
        with os.scandir(self.tree.path) as found:
            now = [(e.name, e.stat()) for e in found if e.name.endswith(".zip") and e.is_file(follow_symlinks=False)]
        new = sorted({(name, s.st_size, s.st_mtime_ns) for name, s in now} - self.seen)
        if new:
            at = self._entry(self.entries)
            with open(f"{at}.new", "w", encoding="utf-8") as f:
                json.dump(new, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(f"{at}.new", at)  # the whole entry or none
            self._catch_up()
        return {"entries": self.entries}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        paths = set()
        for k in range(start["entries"], end["entries"]):
            with open(self._entry(k), encoding="utf-8") as f:
                paths.update(f"{self.tree.path.rstrip('/')}/{name}" for name, _, _ in json.load(f))
        return self.tree.parts(sorted(paths)) if paths else []

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the log stays, so that nothing arrives twice."""


class SkillTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skilltree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SkillTreeReader:
        return SkillTreeReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> SkillTreeStream:
        return SkillTreeStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SkillTree)
