"""The parsers as table functions of SQL.

    register(spark)
    SELECT f.path, r.* FROM files f, LATERAL parse_dockerfile(f.path, f.text, '/repo') r
    SELECT * FROM parse_files(TABLE(SELECT path, text, project FROM files) PARTITION BY (project), '/repo')

There is a function for each parser, one that goes by the file's name (parse_file), one for
doc comments (parse_xml_doc), and parse_files, which takes a table. Its analysis looks at
the table's columns and keeps those that are not path, text or parser in the result; in a
partition a file that was read before (same path and text) is read once.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..model import DOCS
from . import parsers

COLUMNS = [c.split()[0] for c in parsers.ROWS.split(", ")]
#: Names that parse_files() reads and does not hand on.
READ = ("path", "text", "parser")


def name_of_parser(path: str) -> str | None:
    """What parsers.parser_for() says of one path."""
    file = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    if file == "dotnet-tools.json":
        return "dotnet_tools"
    if file.startswith("dockerfile"):
        return "dockerfile"
    for ends, name in (((".targets", ".props"), "msbuild"), ((".sh", ".bash"), "shell"), ((".ps1",), "powershell"), ((".dockerfile",), "dockerfile"), ((".yml", ".yaml"), "workflow")):
        if file.endswith(ends):
            return name
    return None


def rows_of(name: str | None, path: str | None, text: str | None, base: str | None):
    """Rows as parsers.ROWS names them; a path of no parser has none."""
    if name not in parsers.PARSERS or path is None:
        return
    for r in parsers.PARSERS[name](path, text or "", base):
        node = isinstance(r, parsers.Node)
        row = dict.fromkeys(COLUMNS) | r._asdict() | {"row": "node" if node else "edge"} | ({"file_path": path} if node else {})
        yield tuple(row[c] for c in COLUMNS)


def of_parser(name: str | None):
    """The table function (path, text[, base]) of one parser, or of the file's name."""

    class Parse:
        def eval(self, path: str, text: str, base: str = None):  # noqa: RUF013
            yield from rows_of(name or name_of_parser(path), path, text, base)

    return F.udtf(Parse, returnType=parsers.ROWS)


class ParseXmlDoc:
    """One row of a doc comment's fields; none for a blank one."""

    def eval(self, xml: str):
        found = parsers.xml_doc(xml)
        if found:
            yield tuple(found[f] for f in ("summary", "remarks", "params", "type_params", "returns")) + (found["examples"], [tuple(e[k] for k in ("type", "description")) for e in found["exceptions"]], found["see_also"])


@dataclasses.dataclass
class Analysed(AnalyzeResult):
    """What an analysis tells the readers of a table: the columns to hand on."""

    kept: list = dataclasses.field(default_factory=list)


class ParseFiles:
    def __init__(self, analysed: Analysed):
        self.kept, self.seen = analysed.kept, set()

    @staticmethod
    def analyze(files: AnalyzeArgument, base: AnalyzeArgument = None) -> Analysed:  # noqa: RUF013
        if not files.isTable:
            raise ValueError("parse_files takes a table: parse_files(TABLE(files))")
        fields = {f.name.lower(): f for f in files.dataType.fields}
        for name in ("path", "text"):
            if name not in fields or fields[name].dataType != StringType():
                raise ValueError(f"parse_files needs a string column {name}")
        made = {c.lower() for c in COLUMNS}
        kept = [f for f in files.dataType.fields if f.name.lower() not in READ]
        if clash := [f.name for f in kept if f.name.lower() in made]:
            raise ValueError(f"parse_files makes columns of these names itself: {', '.join(clash)}")
        rows = [StructField(c.split()[0], IntegerType() if c.endswith(" int") else StringType()) for c in parsers.ROWS.split(", ")]
        return Analysed(StructType([*kept, *rows]), kept=[f.name for f in kept])

    def eval(self, row, base: str = None):  # noqa: RUF013
        of = row.asDict()
        low = {k.lower(): v for k, v in of.items()}
        if (key := (low["path"], low["text"])) in self.seen:
            return
        self.seen.add(key)
        kept = tuple(of[c] for c in self.kept)
        for made in rows_of(low.get("parser") or name_of_parser(low["path"]), low["path"], low["text"], base):
            yield kept + made


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; their names."""
    made = {f"parse_{n}": of_parser(n) for n in parsers.PARSERS} | {"parse_pipeline": of_parser("workflow"), "parse_file": of_parser(None)}
    made |= {"parse_xml_doc": F.udtf(ParseXmlDoc, returnType=DOCS), "parse_files": F.udtf(ParseFiles)}
    for name, f in made.items():
        spark.udtf.register(name, f)
    return sorted(made)
