"""`symbol_project`: a batch and streaming data source of the files of a source tree, found and hashed on executors.

    spark.dataSource.register(SymbolProjectSource)
    spark.read.format("symbol_project").load("/src")            # or an URI that Arrow's file systems know
    spark.readStream.format("symbol_project").load("/src")

A row is a file: what scan() tells of it, and the role that discover() gives it. The driver
lists folders until there are PARTS of them and reads the solution, if the root has one; a
task walks the folders of its partition and hashes their files in pieces. Filters on path
and role are taken over: a prefix or value of path rules out folders before they are walked.

As a stream its offsets are moments: a batch has the files whose modification lies after
the one before and not after its own, which is `settle` seconds ago, so a restart from a
checkpoint goes on where it stopped and reads no file twice. A file that is put in place
with an older time than that is not seen.

Options: path; tests (false) keeps test projects in role; parts (64); settle (2).
"""

from __future__ import annotations

import datetime
import hashlib
import os
import posixpath
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .files import TEST_PROJECT, projects_of_solution

SCHEMA = "path string, role string, sha256 string, length long, modified timestamp"
PARTS, SETTLE = 64, 2.0
PIECE = 1 << 20
#: Roles of files; others have none.
SOLUTION, PROJECT, XML_DOC = "solution", "project", "xml_doc"


@dataclass
class Folders(InputPartition):
    """Folders to walk (name, whether what lies below them belongs to the partition), and the moments that bound the files' times."""

    folders: list
    projects: list | None
    solution: str | None
    after: int = -1
    until: int = 1 << 62


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        system, at = pafs.FileSystem.from_uri(path)
        return system, at.rstrip("/")
    return pafs.LocalFileSystem(), os.path.abspath(path)


def suffix(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def micros(info: pafs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1000


class Tree:
    """A source tree: what the batch and the streaming reader share."""

    def __init__(self, options: dict, filters: list[Filter] | None = None):
        if not options.get("path"):
            raise ValueError("symbol_project needs a path")
        self.path = options["path"]
        self.tests = str(options.get("tests", "false")).lower() == "true"
        self.parts = int(options.get("parts", PARTS))
        self.settle = float(options.get("settle", SETTLE))
        self.filters = filters or []

    def may_hold(self, folder: str) -> bool:
        """Whether files below a folder can pass the filters on path."""
        inside = folder.rstrip("/") + "/"
        for f in self.filters:
            if f.attribute != ("path",):
                continue
            values = [f.value] if not isinstance(f, In) else list(f.value)
            if isinstance(f, StringStartsWith):
                if not any(inside.startswith(v) or v.startswith(inside) for v in values):
                    return False
            elif not any(v is not None and v.startswith(inside) for v in values):
                return False
        return True

    def passes(self, path: str, role: str | None) -> bool:
        of = {("path",): path, ("role",): role}
        for f in self.filters:
            value = of[f.attribute]
            if value is None:
                return False
            if isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
            if isinstance(f, EqualTo) and value != f.value:
                return False
            if isinstance(f, In) and value not in f.value:
                return False
        return True

    def listed(self, after: int = -1, until: int = 1 << 62) -> list[Folders]:
        """Partitions: folders are opened, widest first, until there are `parts` of them to walk."""
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder: {self.path}")
        flat, deep = [], [root]
        while deep and len(deep) < self.parts:
            folder = deep.pop(0)
            flat.append(folder)
            deep += [i.path for i in system.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.Directory and self.may_hold(i.path)]
            if len(flat) > 16 * self.parts:  # a long thin tree
                break
        solutions = [i.path for i in system.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and suffix(i.path) == ".sln"]
        if len(solutions) > 1:
            raise ValueError("several solutions; name one: " + ", ".join(sorted(solutions)))
        projects = None
        if solutions:
            with system.open_input_stream(solutions[0]) as f:
                names = projects_of_solution(f.read().decode("utf-8-sig"), root)
            projects = [n for n in names if self.tests or not TEST_PROJECT.search(stem(n))]
        whole = [(f, False) for f in flat] + [(f, True) for f in deep]
        n = max(1, min(self.parts, len(whole)))
        return [Folders(whole[i::n], projects, solutions[0] if solutions else None, after, until) for i in range(n)]

    def role(self, system: pafs.FileSystem, root: str, path: str, part: Folders) -> str | None:
        if path == part.solution:
            return SOLUTION
        kind = suffix(path)
        named = lambda p: p in part.projects if part.projects is not None else suffix(p) == ".csproj" and (self.tests or not TEST_PROJECT.search(stem(p)))
        if named(path):
            return PROJECT
        if kind == ".xml":
            # documentation of a project of its name, which lies in its folder or above
            folder = posixpath.dirname(path)
            while len(folder) >= len(root):
                candidates = [posixpath.join(folder, stem(path) + s) for s in (".csproj", ".fsproj", ".vbproj")]
                found = [c for c in candidates if named(c)]
                if found and any(i.type == pafs.FileType.File for i in system.get_file_info(found)):
                    return XML_DOC
                folder = posixpath.dirname(folder) if folder != posixpath.dirname(folder) else ""
        return None

    def rows(self, part: Folders) -> Iterator[tuple]:
        system, root = opened(self.path)
        todo = [tuple(f) for f in part.folders]
        while todo:
            folder, below = todo.pop()
            for info in sorted(system.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
                if info.type == pafs.FileType.Directory:
                    if below and self.may_hold(info.path):
                        todo.append((info.path, True))
                    continue
                if info.type != pafs.FileType.File or not part.after < micros(info) <= part.until:
                    continue
                role = self.role(system, root, info.path, part)
                if self.passes(info.path, role):
                    digest = hashlib.sha256()
                    with system.open_input_stream(info.path) as f:
                        while piece := f.read(PIECE):
                            digest.update(piece)
                    yield info.path, role, digest.hexdigest(), info.size, datetime.datetime.fromtimestamp(micros(info) / 1e6, datetime.timezone.utc)


class ProjectReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.filters = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes over equality, membership and prefixes of path and role; gives back the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("path",), ("role",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return Tree(self.options, self.filters).listed()

    def read(self, partition: Folders) -> Iterator[tuple]:
        return Tree(self.options, self.filters).rows(partition)


class ProjectStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": int((time.time() - Tree(self.options).settle) * 1e6)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return Tree(self.options).listed(start["until"], end["until"])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return Tree(self.options).rows(partition)


class SymbolProjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "symbol_project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ProjectReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ProjectStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it take over filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SymbolProjectSource)
