"""File sources: hashing scans on the executors, and discovery of projects on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_test_file
from ..operators.govern import glob_pattern

TEST_PROJECT = re.compile(r"\.(tests|test|specs)$", re.I)


def scan(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, sha256, length, modified) of the files of a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", F.col("modificationTime").alias("modified"))


def texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, text) of the files of a folder, for parsers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("content").cast("string").alias("text"))


def typescript_files(files: DataFrame) -> DataFrame:
    """Sources (.ts, .tsx), tsconfig and lock files outside node_modules, by path."""
    plain = F.translate("path", "\\", "/")
    wanted = F.lower(plain).rlike(r"\.tsx?$|/(tsconfig|package-lock)\.json$") & ~plain.contains("/node_modules/")
    return files.where(wanted).orderBy("path")


def source_files(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, tests: bool = False) -> DataFrame:
    """Files that pass the include globs (all by default) and no exclude glob, without test files unless wanted."""
    plain = F.translate("path", "\\", "/")
    keep = F.lit(not include)
    for glob in include or []:
        keep = keep | plain.rlike(glob_pattern(glob))
    for glob in exclude or []:
        keep = keep & ~plain.rlike(glob_pattern(glob))
    return files.where(keep & (F.lit(tests) | ~is_test_file(F.col("path"))))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row (fingerprint): a hash over path, length and time of every file, in any order of rows.

    Files are hashed apart and their hashes summed piece by piece, so nothing is gathered.
    """
    line = F.sha2(F.concat_ws(":", "path", F.col("length").cast("string"), F.unix_micros("modified").cast("string")), 256)
    sums = (F.coalesce(F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(8))
    return files.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("fingerprint"))


@dataclass
class Inventory:
    """What discovery has found below a root."""

    root: str
    solutions: list[str] = field(default_factory=list)
    projects: list[str] = field(default_factory=list)
    xml_docs: list[str] = field(default_factory=list)


def common_parent(paths: list[str]) -> str:
    return os.path.commonpath(paths) if paths else ""


def xml_docs(projects: list[str]) -> list[str]:
    """{project}.xml anywhere below each project, each once, case aside."""
    found = {}
    for p in map(Path, projects):
        for x in sorted(p.parent.rglob("*.xml")):
            if x.stem.lower() == p.stem.lower():
                found.setdefault(str(x).lower(), str(x))
    return list(found.values())


def projects_of_solution(text: str, folder: str) -> list[str]:
    """Project files that a solution names, in either of its formats."""
    named = re.findall(r'"([^"]+\.(?:cs|fs|vb)proj)"', text, re.I)
    return [os.path.normpath(os.path.join(folder, n.replace("\\", "/"))) for n in dict.fromkeys(named)]


def discover(path: str, tests: bool = False) -> Inventory:
    """Projects of a solution, of a list of project files (;) or of a folder with one solution at most.

    Test projects are left out of solutions and folders unless wanted. Raises
    FileNotFoundError for a missing file and ValueError for anything else that names no
    project, or a folder with several solutions.
    """
    ordinary = lambda names: [n for n in names if tests or not TEST_PROJECT.search(Path(n).stem)]
    if path.lower().endswith(".csproj"):
        names = [os.path.abspath(p.strip()) for p in path.split(";") if p.strip()]
        for n in names:
            if not os.path.isfile(n):
                raise FileNotFoundError(f"Project file not found: {n}")
        return Inventory(common_parent([os.path.dirname(n) for n in names]), [], names, xml_docs(names))
    if path.lower().endswith((".sln", ".slnx")):
        at = os.path.abspath(path)
        if not os.path.isfile(at):
            raise FileNotFoundError(f"Solution file not found: {at}")
        names = ordinary(projects_of_solution(Path(at).read_text(encoding="utf-8-sig"), os.path.dirname(at)))
        return Inventory(os.path.dirname(at), [at], names, xml_docs(names))
    if os.path.isdir(path):
        at = Path(os.path.abspath(path))
        solutions = sorted(at.glob("*.sln"))
        if len(solutions) > 1:
            raise ValueError("several solutions; name one: " + ", ".join(map(str, solutions)))
        if solutions:
            return discover(str(solutions[0]), tests)
        names = ordinary(sorted(map(str, at.rglob("*.csproj"))))
        return Inventory(str(at), [], names, xml_docs(names))
    raise ValueError(f"neither a solution, a project nor a folder: {path}")


def tool_files(start: str) -> list[str]:
    """The nearest tool manifest at or above a folder, then all .targets and .props files below it."""
    here = Path(os.path.abspath(start))
    manifest = next((p for d in (here, *here.parents) if (p := d / ".config" / "dotnet-tools.json").is_file()), None)
    return [*([str(manifest)] if manifest else []), *(str(p) for suffix in ("targets", "props") for p in sorted(here.rglob(f"*.{suffix}")))]


def typescript_projects(folder: str) -> list[str]:
    """Every tsconfig.json below a folder and outside node_modules."""
    return sorted(str(p) for p in Path(folder).rglob("tsconfig.json") if "node_modules" not in p.parts)
