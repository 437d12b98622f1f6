"""A data source of trees of text files: spark.read.format("file_tree") and spark.readStream.format("file_tree").

Batch: one partition a folder; a task lists its folder and reads the files in it. Stream: an offset is the number of a listing of the tree
(name, length and time of every file), kept beside the query's checkpoint; a batch is what differs between two listings, so files that are
gone are rows like those that came or changed. A tree that has not changed gives no batch.

A listing lies in parts by the hash of a name: one for a small tree, _PARTS for others. The driver goes through the tree and holds no more of
it than the entries of one folder (of one file on a local disk) and sums of hashes that tell whether a part has changed; tasks read the two
listings' parts and find what differs.

Options: path (the root), pattern (of file names, "*.md"), content ("true": texts as well; a stream gives names only unless asked), state (a
folder that outlives the query, for a stream). All folders must be reachable from driver and executors. Rows: path, change (there, came,
changed, gone) and content (null for gone files). node_modules and .git are passed over. Files that vanish between listing and reading are
left out of a batch read; in a stream they come with a null content, and as gone in the next batch.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallyweave.sources.sinks import _store

_OUT = {"node_modules", ".git"}
_SMALL, _PARTS = 10_000, 256  # files of a listing that is one part; parts of a larger one
_BUFFER = 1 << 16  # bytes of a part that wait to be written


def _folders(root: str) -> list[str]:
    """All folders below root, itself included, as paths on its file system."""
    from pyarrow import fs

    store, at = _store(root)
    found, todo = [], [at]
    while todo:
        here = todo.pop()
        found.append(here)
        todo += [x.path for x in store.get_file_info(fs.FileSelector(here, allow_not_found=True)) if x.type == fs.FileType.Directory and x.base_name not in _OUT]
    return sorted(found)


def _files(root: str, folder: str, pattern: str) -> list:
    from pyarrow import fs

    store, _ = _store(root)
    return sorted((x for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern)), key=lambda x: x.path)


def _marks(root: str, pattern: str) -> Iterator[tuple[str, str]]:
    """Path, and length and time, of all files of a tree, folder by folder."""
    from pyarrow import fs

    store, at = _store(root)
    if not isinstance(store, fs.LocalFileSystem):
        for folder in _folders(root):
            yield from ((x.path, f"{x.size}:{x.mtime_ns}") for x in _files(root, folder, pattern))
        return
    todo = [at or "/"]
    while todo:
        here = todo.pop()
        try:
            inside = os.scandir(here)
        except (FileNotFoundError, NotADirectoryError):
            continue
        with inside:
            for x in inside:
                try:
                    if x.is_dir():
                        todo += [posixpath.join(here, x.name)] if x.name not in _OUT else []
                    elif x.is_file() and fnmatch.fnmatch(x.name, pattern):
                        seen = x.stat()
                        yield posixpath.join(here, x.name), f"{seen.st_size}:{seen.st_mtime_ns}"
                except FileNotFoundError:
                    continue


def _part(path: str, parts: int) -> int:
    return zlib.crc32(path.encode("utf-8", "surrogateescape")) % parts


def _hash(path: str, mark: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{mark}".encode("utf-8", "surrogateescape"), digest_size=16).digest(), "big")


class _Sums:
    """Of each part the number of its files and the sum of their hashes, whatever their order."""

    def __init__(self):
        self.files, self.sums = [0] * _PARTS, [0] * _PARTS

    def add(self, path: str, mark: str) -> None:
        k = _part(path, _PARTS)
        self.files[k] += 1
        self.sums[k] = (self.sums[k] + _hash(path, mark)) % (1 << 128)

    def of(self) -> list[str]:
        return [f"{n}:{x:032x}" for n, x in zip(self.files, self.sums, strict=True)]


def _text(root: str, path: str) -> str | None:
    store, _ = _store(root)
    try:
        with store.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


@dataclass
class _Folder(InputPartition):
    folder: str


@dataclass
class _Changes(InputPartition):
    start: int
    end: int
    part: int
    parts: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.md")
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Folder(f) for f in _folders(self.root)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for x in _files(self.root, partition.folder, self.pattern):
            text = _text(self.root, x.path) if self.content else None
            if text is not None or not self.content:
                yield x.path, "there", text


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "state" not in options:
            raise ValueError("a stream of a tree needs the option state: a folder for its listings")
        self.root, self.state, self.pattern = options["path"], options["state"].rstrip("/"), options.get("pattern", "*.md")
        self.content = options.get("content", "false").lower() == "true"

    def _listing(self, number: int) -> dict:
        """parts (how many) and sums (of all _PARTS parts) of a listing. One of earlier versions is a map of all files, that is one part."""
        if number <= 0:
            return {"parts": 0, "sums": _Sums().of()}
        store, at = _store(self.state)
        with store.open_input_stream(f"{at}/{number}.json") as f:
            found = json.loads(f.read())
        if isinstance(found.get("parts"), int):
            return found
        sums = _Sums()
        for path, mark in found.items():
            sums.add(path, mark)
        return {"parts": 1, "sums": sums.of(), "files": found}

    def _entries(self, number: int, part: int, parts: int) -> dict[str, str]:
        """The files of one of `parts` parts of a listing, which may have fewer."""
        listing = self._listing(number)
        if not listing["parts"]:
            return {}
        if (found := listing.get("files")) is None:
            store, at = _store(self.state)
            with store.open_input_stream(f"{at}/{number}/{part % listing['parts']}.jsonl") as f:
                found = dict(json.loads(x) for x in f.read().splitlines())
        return found if listing["parts"] == parts else {p: m for p, m in found.items() if _part(p, parts) == part}

    def _write(self, number: int) -> None:
        """A listing of the tree as it is: its parts, and then the file that names it."""
        store, at = _store(self.state)
        store.create_dir(f"{at}/{number}", recursive=True)
        sums, held, out, files = _Sums(), [bytearray()], [], 0
        try:
            for path, mark in _marks(self.root, self.pattern):
                sums.add(path, mark)
                files += 1
                line = json.dumps([path, mark]).encode() + b"\n"
                if files > _SMALL and not out:  # too many for one part: what waits is dealt again
                    out = [store.open_output_stream(f"{at}/{number}/{k}.jsonl") for k in range(_PARTS)]
                    waiting, held = held[0], [bytearray() for _ in range(_PARTS)]
                    for x in waiting.splitlines(keepends=True):
                        held[_part(json.loads(x)[0], _PARTS)] += x
                k = _part(path, _PARTS) if out else 0
                held[k] += line
                if out and len(held[k]) > _BUFFER:
                    out[k].write(bytes(held[k]))
                    held[k].clear()
            out = out or [store.open_output_stream(f"{at}/{number}/0.jsonl")]
            for f, left in zip(out, held, strict=True):
                f.write(bytes(left))
        finally:
            for f in out:
                f.close()
        with store.open_output_stream(f"{at}/{number}.part") as f:
            f.write(json.dumps({"parts": len(out), "sums": sums.of()}).encode())
        store.move(f"{at}/{number}.part", f"{at}/{number}.json")

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        store, at = _store(self.state)
        return sorted(int(x.base_name[:-5]) for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.base_name.endswith(".json") and x.base_name[:-5].isdigit())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last listing's number, or that of a new one where the tree is not as it was. A listing is written before it is named."""
        last = max(self._numbers(), default=0)
        now = _Sums()
        for path, mark in _marks(self.root, self.pattern):
            now.add(path, mark)
        if now.of() == self._listing(last)["sums"]:
            return {"listing": last}
        self._write(last + 1)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._listing(start["listing"]), self._listing(end["listing"])
        parts = max(old["parts"], new["parts"])
        moved = [k for k in range(_PARTS) if old["sums"][k] != new["sums"][k]]
        return [_Changes(start["listing"], end["listing"], k, parts) for k in (moved if parts == _PARTS else [0] if moved else [])]

    def read(self, partition: _Changes) -> Iterator[tuple]:
        old, new = (self._entries(n, partition.part, partition.parts) for n in (partition.start, partition.end))
        found = [(p, "came" if p not in old else "changed") for p, mark in new.items() if old.get(p) != mark] + [(p, "gone") for p in old if p not in new]
        for path, change in sorted(found):
            yield path, change, _text(self.root, path) if self.content and change != "gone" else None

    def commit(self, end: dict) -> None:
        """Listings before the one that is done are no longer needed."""
        from pyarrow import fs

        store, at = _store(self.state)
        for n in self._numbers():
            if n < end["listing"]:
                store.delete_file(f"{at}/{n}.json")
                if store.get_file_info(f"{at}/{n}").type == fs.FileType.Directory:  # earlier versions have none
                    store.delete_dir(f"{at}/{n}")


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, change string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)
