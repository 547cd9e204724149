"""Versions of documents from a repository, read by tasks over ranges of commits.

A version is a commit that gives a file other content than all of its parents do. Commits are listed by the driver (each is
some hundred bytes); trees and files are read in tasks, from loose objects and packs. The folder of the
repository must be where every executor finds it.
"""

from __future__ import annotations

import datetime
import heapq
import mmap
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .frontmatter import is_document, split_front_matter

SCHEMA = "path string, commit string, position long, version_date date, current boolean, raw string"
#: Commits of a partition.
COMMITS = 256
# Fixed values of the format: kinds of objects in a pack, those that are changes to another one, and the mode of a folder.
KINDS, OFFSET_DELTA, NAME_DELTA, FOLDER = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}, 6, 7, b"40000"


def _delta(base: bytes, change: bytes) -> bytes:
    """``base`` with a change: copies of its parts and literal bytes."""
    at = 0

    def size() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value, more = value | (change[at] & 127) << shift, change[at] & 128
            at, shift = at + 1, shift + 7
            if not more:
                return value

    size(), size()
    out = bytearray()
    while at < len(change):
        how = change[at]
        at += 1
        if not how & 128:
            out += change[at : at + how]
            at += how
            continue
        numbers = []
        for bits, width in ((how & 15, 4), (how >> 4 & 7, 3)):
            value = 0
            for n in range(width):
                if bits >> n & 1:
                    value |= change[at] << 8 * n
                    at += 1
            numbers.append(value)
        out += base[numbers[0] : numbers[0] + (numbers[1] or 0x10000)]
    return bytes(out)


class _Pack:
    """A pack and its index of the second format."""

    def __init__(self, index: str):
        with open(index, "rb") as one, open(index[:-3] + "pack", "rb") as two:
            self.index, self.data = mmap.mmap(one.fileno(), 0, access=mmap.ACCESS_READ), mmap.mmap(two.fileno(), 0, access=mmap.ACCESS_READ)
        if self.index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{index} is no index of the second format")
        self.count = self._number(8 + 255 * 4)

    def _number(self, at: int, width: int = 4) -> int:
        return int.from_bytes(self.index[at : at + width], "big")

    def offset(self, name: bytes) -> int | None:
        low, high = self._number(8 + (name[0] - 1) * 4) if name[0] else 0, self._number(8 + name[0] * 4)
        names = 8 + 256 * 4
        while low < high:
            middle = (low + high) // 2
            held = self.index[names + 20 * middle : names + 20 * middle + 20]
            if held == name:
                small = names + 24 * self.count
                at = self._number(small + 4 * middle)
                return self._number(small + 4 * self.count + 8 * (at & 0x7FFFFFFF), 8) if at >> 31 else at
            low, high = (middle + 1, high) if held < name else (low, middle)
        return None

    def read(self, at: int, objects: Objects) -> tuple[str, bytes]:
        start, first = at, self.data[at]
        at += 1
        while self.data[at - 1] & 128:
            at += 1
        kind = first >> 4 & 7
        base = None
        if kind == OFFSET_DELTA:
            back = self.data[at] & 127
            while self.data[at] & 128:
                at += 1
                back = back + 1 << 7 | self.data[at] & 127
            at += 1
            base = self.read(start - back, objects)
        elif kind == NAME_DELTA:
            base = objects.read(self.data[at : at + 20].hex())
            at += 20
        content = zlib.decompressobj().decompress(memoryview(self.data)[at:])
        return (KINDS[kind], content) if base is None else (base[0], _delta(base[1], content))


class Objects:
    """Objects of a repository by name, loose or in packs."""

    def __init__(self, folder: str):
        inner = os.path.join(folder, ".git")
        self.folder = inner if os.path.isdir(inner) else folder
        packs = os.path.join(self.folder, "objects", "pack")
        self.packs = [_Pack(os.path.join(packs, n)) for n in sorted(os.listdir(packs)) if n.endswith(".idx")] if os.path.isdir(packs) else []
        self.tree = lru_cache(4096)(self._tree)

    def read(self, name: str) -> tuple[str, bytes]:
        loose = os.path.join(self.folder, "objects", name[:2], name[2:])
        if os.path.exists(loose):
            with open(loose, "rb") as f:
                head, content = zlib.decompress(f.read()).split(b"\0", 1)
            return head.split(b" ")[0].decode(), content
        for pack in self.packs:
            if (at := pack.offset(bytes.fromhex(name))) is not None:
                return pack.read(at, self)
        raise KeyError(f"no object {name}")

    def resolve(self, ref: str = "HEAD") -> str | None:
        """The commit that a name stands for; None where there is none yet."""
        for name in (ref, f"refs/heads/{ref}", f"refs/tags/{ref}"):
            path = os.path.join(self.folder, name)
            if os.path.isfile(path):
                with open(path) as f:
                    found = f.read().strip()
                return self.resolve(found[5:]) if found.startswith("ref: ") else found
            packed = os.path.join(self.folder, "packed-refs")
            if os.path.exists(packed):
                with open(packed) as f:
                    held = dict(reversed(line.split(None, 1)) for line in f.read().splitlines() if line and line[0] not in "#^")
                if name in held:
                    return held[name]
        return ref if len(ref) == 40 else None

    def _tree(self, name: str) -> dict[str, tuple[bool, str]]:
        """Entries of a folder: whether each is a folder, and its object."""
        content, at, out = self.read(name)[1], 0, {}
        while at < len(content):
            end = content.index(b"\0", at)
            mode, entry = content[at:end].split(b" ", 1)
            out[entry.decode("utf-8", "replace")] = (mode == FOLDER, content[end + 1 : end + 21].hex())
            at = end + 21
        return out

    def commit(self, name: str) -> Commit:
        lines = self.read(name)[1].decode("utf-8", "replace").split("\n\n", 1)[0].split("\n")
        held = [line.split(" ", 1) for line in lines if " " in line]
        field = lambda key: [v for k, v in held if k == key]
        seconds, zone = field("author")[0].rsplit(" ", 2)[1:]
        shift = (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[3:]))
        day = datetime.datetime.fromtimestamp(int(seconds) + 60 * shift, datetime.timezone.utc).date()
        return Commit(name, field("tree")[0], tuple(field("parent")), int(field("committer")[0].rsplit(" ", 2)[1]), day)

    def at(self, tree: str, path: str) -> str | None:
        """The object of a file under a tree."""
        for n, part in enumerate(parts := path.split("/")):
            folder, tree = self.tree(tree).get(part, (None, ""))
            if folder is None or folder != (n < len(parts) - 1):
                return None
        return tree

    def changed(self, tree: str, others: list[str], prefix: str = "") -> Iterator[tuple[str, str]]:
        """Files under a tree that differ from those of the same path in all ``others``; folders that one of these shares are passed over."""
        held = [self.tree(o) for o in others]
        for name, (folder, own) in self.tree(tree).items():
            before = [h.get(name) for h in held]
            if (folder, own) in before:
                continue
            if folder:
                if all(b and b[0] for b in before) or not before:
                    yield from self.changed(own, [b[1] for b in before], f"{prefix}{name}/")
                else:  # it is new to one of them at least
                    yield from self.changed(own, [b[1] for b in before if b and b[0]], f"{prefix}{name}/")
            else:
                yield f"{prefix}{name}", own


@dataclass(frozen=True)
class Commit:
    name: str
    tree: str
    parents: tuple[str, ...]
    time: int
    day: datetime.date


def ordered_commits(objects: Objects, head: str) -> list[Commit]:
    """All commits that ``head`` reaches, parents first, else the earlier first."""
    found, todo = {}, [head]
    while todo:
        name = todo.pop()
        if name not in found:
            found[name] = objects.commit(name)
            todo += found[name].parents
    left, children = {n: len(set(c.parents)) for n, c in found.items()}, {}
    for n, c in found.items():
        for p in set(c.parents):
            children.setdefault(p, []).append(n)
    ready, out = [(found[n].time, n) for n, count in left.items() if not count], []
    heapq.heapify(ready)
    while ready:
        _, name = heapq.heappop(ready)
        out.append(found[name])
        for child in children.get(name, ()):
            left[child] -= 1
            if not left[child]:
                heapq.heappush(ready, (found[child].time, child))
    return out


class RepositorySource(DataSource):
    """Format ``repository``: every version of every file that ends as ``suffix`` (``.md``) says, of the commits that ``ref`` (``HEAD``) reaches.

    position counts commits, the oldest first; version_date is the author's day; current says that ``ref`` still has the path. A commit that deletes a file is no version of it.
    """

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:  # noqa: ANN001
        return RepositoryReader(self.options["path"], self.options.get("ref", "HEAD"), self.options.get("suffix", ".md"))


@dataclass
class CommitRange(InputPartition):
    """Commits with the place of the first, and the trees of their parents."""

    first: int
    commits: list[Commit]
    parents: dict[str, str]
    head: str


class RepositoryReader(DataSourceReader):
    def __init__(self, path: str, ref: str, suffix: str):
        self.path, self.ref, self.suffix = path, ref, suffix

    def partitions(self) -> list[CommitRange]:
        objects = Objects(self.path)
        head = objects.resolve(self.ref)
        commits = ordered_commits(objects, head) if head else []
        trees = {c.name: c.tree for c in commits}
        parts = [commits[n : n + COMMITS] for n in range(0, len(commits), COMMITS)] or [[]]
        return [CommitRange(n * COMMITS, own, {p: trees[p] for c in own for p in c.parents}, trees.get(head, "")) for n, own in enumerate(parts)]

    def read(self, partition: CommitRange) -> Iterator[tuple]:
        objects = Objects(self.path)
        for n, commit in enumerate(partition.commits, partition.first):
            for path, name in sorted(objects.changed(commit.tree, [partition.parents[p] for p in commit.parents])):
                if path.endswith(self.suffix):
                    yield path, commit.name, n, commit.day, objects.at(partition.head, path) is not None, objects.read(name)[1].decode("utf-8", "replace")


def read_repository(spark: SparkSession, path: str, ref: str = "HEAD", current: bool = True) -> DataFrame:
    """path, commit, version_seq (from 1), version_date, meta and body of every version of every document, by default of those that are there still."""
    spark.dataSource.register(RepositorySource)
    rows = spark.read.format("repository").option("path", path).option("ref", ref).load().where(is_document(F.col("path")))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("position"))
    found = rows.where("current") if current else rows
    return found.withColumn("version_seq", seq).withColumn("f", split_front_matter(F.col("raw"))).select("path", "commit", "version_seq", "version_date", "f.meta", "f.body")
