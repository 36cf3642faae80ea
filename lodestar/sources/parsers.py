"""Parsers from artifact files to graph rows, and the Spark operators around them.

A parser is a generator over one file's path and text that yields node and edge tuples;
`parse` runs one over a table of files with mapInPandas, so files are parsed in parallel
and nothing is gathered. Lines are counted from 1. A file that cannot be read yields no
rows.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import NamedTuple
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DOCS, normalised
from ..operators.graph import stored

ROWS = (
    "row string, id string, kind string, display_name string, fqn string, summary string, remarks string, file_path string, start_line int, end_line int, "
    "return_type string, parameter string, from_id string, to_id string"
)


class Node(NamedTuple):
    id: str
    kind: str
    display_name: str
    fqn: str
    start_line: int
    end_line: int
    summary: str | None = None
    remarks: str | None = None
    return_type: str | None = None
    parameter: str | None = None


class Edge(NamedTuple):
    from_id: str
    to_id: str
    kind: str


Parsed = Iterator[Node | Edge]


def name_of(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def relative(path: str, base: str | None) -> str:
    """path below base with forward slashes, or its file name outside of it or without one."""
    plain, root = path.replace("\\", "/"), (base or "").replace("\\", "/").rstrip("/") + "/"
    return plain[len(root) :] if base and plain.lower().startswith(root.lower()) else name_of(path)


def line_at(text: str, place: int) -> int:
    return text.count("\n", 0, place) + 1


def closing(text: str, place: int, pair: str) -> int:
    """Where the bracket at place closes; -1 if it does not."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, place):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return -1


def shortened(text: str, most: int = 60) -> str:
    return text if len(text) <= most else text[:most] + "..."


# -- XML documentation ---------------------------------------------------------------------------

WARNING = "[Parse warning]"


def element_text(element: ET.Element | None) -> str | None:
    """All text below an element with runs of white space as one space; null where there is none."""
    found = re.sub(r"\s+", " ", "".join(element.itertext())).strip() if element is not None else ""
    return found or None


def xml_doc(xml: str | None) -> dict | None:
    """A doc comment from XML; what only parses inside a wrapper is marked, and what does not is kept raw; blank gives none."""
    if not xml or not xml.strip():
        return None
    blank = {"summary": None, "remarks": None, "params": {}, "type_params": {}, "returns": None, "examples": [], "exceptions": [], "see_also": []}
    root, warned = None, False
    for text, warned in ((xml, False), (f"<doc>{xml}</doc>", True)):
        try:
            root = ET.fromstring(text)
            break
        except ET.ParseError:
            continue
    if root is None:
        return blank | {"summary": f"{WARNING} {xml}"}
    summary = element_text(root.find("summary"))
    named = lambda tag: {e.get("name"): element_text(e) or "" for e in root.findall(tag) if e.get("name") is not None}
    return {
        "summary": " ".join(filter(None, (WARNING, summary))) if warned else summary,
        "remarks": element_text(root.find("remarks")),
        "params": named("param"),
        "type_params": named("typeparam"),
        "returns": element_text(root.find("returns")),
        "examples": [element_text(e) or "" for e in root.findall("example")],
        "exceptions": [{"type": e.get("cref", ""), "description": element_text(e) or ""} for e in root.findall("exception")],
        "see_also": [e.get("cref") for e in root.findall("seealso") if e.get("cref")],
    }


def xml_docs(column: Column) -> Column:
    """Doc comments of a column of XML."""
    return F.pandas_udf(lambda s: pd.DataFrame([xml_doc(x) or dict.fromkeys(("summary", "remarks", "params", "type_params", "returns", "examples", "exceptions", "see_also")) for x in s]), DOCS)(column)


def inherited_from(xml: str | None) -> str | None:
    """The cref of a doc comment's inheritdoc element, empty without one; null where there is no such element."""
    if not xml or "inheritdoc" not in xml.lower():
        return None
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    found = next((e for e in root.iter() if e.tag.lower() == "inheritdoc"), None)
    return None if found is None else found.get("cref", "")


def resolve_inherited(docs: DataFrame, natural: DataFrame | None = None, depth: int = 10) -> DataFrame:
    """(id, xml) with the XML that inheritdoc leads to; null where it leads nowhere, round in a circle or too deep.

    Every round joins the symbols still looking to what they inherit from: a cref, or the
    natural base (id, base_id) for those without one, which counts as one place. A round is
    written to the checkpoint folder, and the rounds end when nobody looks any further.
    """
    cref = F.pandas_udf(lambda s: s.map(inherited_from), "string")
    table = docs.select("id", "xml")
    bases = table.toDF("target", "next_xml")
    going = table.select("id", F.col("xml").alias("at_xml"), F.array().cast("array<string>").alias("seen"))
    if natural is None:
        natural = docs.sparkSession.createDataFrame([], "id string, base_id string")
    done = None
    for _ in range(depth):
        asked = stored(going.withColumn("cref", cref("at_xml")))
        ended = asked.where("cref is null").select("id", F.col("at_xml").alias("xml"))
        done = ended if done is None else done.union(ended)
        looking = asked.where("cref is not null")
        if looking.isEmpty():
            break
        more = looking.where(~F.array_contains("seen", F.col("cref"))).join(natural, "id", "left")
        target = F.when(F.col("cref") == "", F.col("base_id")).otherwise(F.col("cref"))
        going = more.withColumn("target", target).join(bases, "target", "left").select("id", F.col("next_xml").alias("at_xml"), F.array_append("seen", F.col("cref")).alias("seen"))
    return table.select("id").join(done.dropDuplicates(["id"]), "id", "left")


def natural_bases(edges: DataFrame) -> DataFrame:
    """(id, base_id): what a member overrides, else what it implements."""
    rank = F.when(F.col("kind") == "Overrides", 0).otherwise(1)
    return edges.where("kind in ('Overrides', 'Implements')").groupBy(F.col("from_id").alias("id")).agg(F.min_by("to_id", F.struct(rank, "to_id")).alias("base_id"))


# -- tools and build files -----------------------------------------------------------------------

def dotnet_tools(path: str, text: str, base: str | None = None) -> Parsed:
    """A Tool for each entry of a tool manifest."""
    try:
        tools = json.loads(text).get("tools")
    except (ValueError, AttributeError):
        return
    lines = text.splitlines()
    for name, tool in tools.items() if isinstance(tools, dict) else ():
        tool = tool if isinstance(tool, dict) else {}
        version = tool.get("version") if isinstance(tool.get("version"), str) else "unknown"
        commands = ", ".join(c for c in tool.get("commands") or [] if isinstance(c, str)) or "(none)"
        line = next((i for i, x in enumerate(lines, 1) if f'"{name}"' in x), 1)
        yield Node(f"T:dotnet-tool/{name}", "Tool", name, f"dotnet-tool/{name}@{version}", line, line, f"dotnet tool v{version}; commands: {commands}")


class _Lines(ET.TreeBuilder):
    """A tree whose elements know their line."""

    def __init__(self, parser: expat.XMLParserType):
        super().__init__()
        self.parser, self.lines = parser, {}

    def start(self, tag, attributes):
        element = super().start(tag, attributes)
        self.lines[element] = self.parser.CurrentLineNumber
        return element


def xml_tree(text: str) -> tuple[ET.Element | None, dict]:
    reader = expat.ParserCreate(namespace_separator="}")
    builder = _Lines(reader)
    reader.StartElementHandler = builder.start
    reader.EndElementHandler = lambda tag: builder.end(tag)
    reader.CharacterDataHandler = builder.data
    try:
        reader.Parse(text, True)
        return builder.close(), builder.lines
    except (expat.ExpatError, AssertionError):
        return None, {}


def msbuild(path: str, text: str, base: str | None = None) -> Parsed:
    """Targets with what they depend on, properties and custom tasks of a build file."""
    root, lines = xml_tree(text.lstrip("﻿"))
    if root is None:
        return
    file, space = name_of(path), root.tag.rpartition("}")[0]
    tagged = lambda name: [e for e in root.iter() if e is not root and e.tag == (f"{space}}}{name}" if space else name)]
    made = lambda e, what, kind, name, summary: Node(f"T:{what}/{file}/{name}", kind, name, f"{what}/{file}/{name}", lines[e], lines[e], summary, f"Condition: {e.get('Condition')}" if e.get("Condition") is not None and what != "msbuild-task" else None)
    for e in tagged("Target"):
        if name := e.get("Name"):
            node = made(e, "msbuild-target", "BuildTarget", name, f"MSBuild target '{name}'")
            yield node
            for attribute in ("DependsOnTargets", "BeforeTargets", "AfterTargets"):
                for other in filter(None, map(str.strip, (e.get(attribute) or "").split(";"))):
                    yield Edge(node.id, f"T:msbuild-target/{file}/{other}", "DependsOn")
    for group in tagged("PropertyGroup"):
        for e in group:
            name, value = e.tag.rpartition("}")[2], "".join(e.itertext())
            yield made(e, "msbuild-prop", "BuildProperty", name, f"MSBuild property '{name}'" + (f" = {value}" if value.strip() else ""))
    for e in tagged("UsingTask"):
        if name := e.get("TaskName"):
            assembly = e.get("AssemblyFile", e.get("AssemblyName"))
            node = made(e, "msbuild-task", "BuildTask", name, f"MSBuild task '{name}'" + (f" from {assembly}" if assembly is not None else ""))
            yield node
            if assembly is not None:
                yield Edge(node.id, f"T:assembly/{assembly}", "References")


# -- scripts -------------------------------------------------------------------------------------

# Commands of the build tool that count, by kind of file.
SHELL_VERBS = ("run", "build", "test", "publish", "restore", "clean")
POWERSHELL_VERBS = ("build", "test", "run", "publish", "pack")
CI_VERBS = ("build", "test", "restore", "publish", "run", "pack", "clean", "format", "tool")
#: Words that may stand before parentheses in a shell script without naming a function.
SH_KEYWORDS = {"if", "while", "for", "until", "case", "select", "then", "else", "elif", "do", "done", "fi", "esac"}


def in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def word_end(text: str, place: int, more: str = "") -> int:
    """Where the run of word characters (and those in `more`) from place on ends."""
    while place < len(text) and (in_word(text[place]) or text[place] in more):
        place += 1
    return place


def after_space(text: str, place: int) -> int:
    while place < len(text) and text[place].isspace():
        place += 1
    return place


def is_name(text: str) -> bool:
    """An ASCII identifier."""
    return text.isascii() and text.isidentifier()


def tool_verbs(text: str, verbs: tuple[str, ...], any_case: bool = False) -> Iterator[str]:
    """The verbs, as written, that follow the word dotnet and white space."""
    plain, at = text.lower() if any_case else text, 0
    while (at := plain.find("dotnet", at)) >= 0:
        end = at + len("dotnet")
        start = after_space(plain, end)
        stop = word_end(plain, start)
        if start > end and not (at and in_word(plain[at - 1])) and plain[start:stop] in verbs:
            yield text[start:stop]
        at = end


def unquoted(word: str) -> str:
    """A word up to its closing quote, without the quotes."""
    return re.split("[\"']", word.lstrip("\"'"))[0]


def comment(line: str) -> str | None:
    """The text of a comment line, or null."""
    line = line.lstrip()
    return line[1:].lstrip() if line.startswith("#") else None


def is_shebang(line: str) -> bool:
    """Whether a line names a shell as the script's interpreter, on its own or through env."""
    if not line.startswith("#!"):
        return False
    words = line[2:].split()
    if words[:1] == ["/usr/bin/env"]:
        words = words[1:]
    return bool(words) and words[0] in ("bash", "sh", "/bin/bash", "/bin/sh", "/usr/bin/bash")


def sh_function(line: str) -> str | None:
    """The name of the function that a line begins to define."""
    words = line.split(None, 1)
    marked = len(words) == 2 and words[0] == "function"
    rest = words[1] if marked else line.lstrip()
    name = rest[: word_end(rest, 0)]
    if not is_name(name):
        return None
    tail = rest[len(name) :].lstrip()
    called = tail.startswith("(") and tail[1:].lstrip().startswith(")")
    return name if marked or called and name not in SH_KEYWORDS else None


def sh_source(line: str) -> str | None:
    """The file that a line reads in by `source` or a dot."""
    words = line.split()
    return (unquoted(words[1]) or None) if len(words) > 1 and words[0] in ("source", ".") else None


def sh_script(line: str) -> str | None:
    """The first script with a path from the working folder among a line's words."""
    for word in re.split(r"[\s;&|]", line):
        if word.startswith("./"):
            path = word[: next((i for i, c in enumerate(word) if not (c.isascii() and (c.isalnum() or c in "_-/."))), len(word))]
            end = path.rfind(".sh")
            if end > 2 and not (end + 3 < len(path) and path[end + 3].isalnum()):
                return path[: end + 3]
    return None


def shell(path: str, text: str, base: str | None = None) -> Parsed:
    """A shell script, its functions, and what it imports and invokes."""
    lines = text.splitlines()
    if not lines:
        return
    file = relative(path, base)
    script = f"T:script/sh/{file}"
    first = is_shebang(lines[0])
    header: list[str] = []
    for i, line in enumerate(lines[first:], int(first)):
        if (said := comment(line)) is not None and not is_shebang(line):
            header.append(said)
        elif line.strip() or not header or i >= 5:
            break
    yield Node(script, "Script", name_of(path), script[2:], 1, len(lines), "\n".join(header) if header else None, lines[0].lstrip() if first else None)
    folder = file.rpartition("/")[0]
    beside = lambda p: "/".join(filter(None, (folder, p.removeprefix("./")))).replace("\\", "/")
    joined, ends = "\n".join(lines), [0]
    for line in lines:
        ends.append(ends[-1] + len(line) + 1)
    for i, line in enumerate(lines):
        if found := sh_function(line):
            above: list[str] = []
            for before in reversed(lines[:i]):
                if (said := comment(before)) is None:
                    break
                above.insert(0, said)
            start = joined.find("{", ends[i])
            end = closing(joined, start, "{}") if start >= 0 else -1
            name = f"{script}::Function/{found}"
            yield Node(name, "ScriptFunction", f"{found}()", name[2:], i + 1, line_at(joined, end) if end >= 0 else i + 1, "\n".join(above) if above else None)
            yield Edge(script, name, "Contains")
        if read := sh_source(line):
            yield Edge(script, f"T:script/sh/{beside(read)}", "Imports")
        if verb := next(tool_verbs(line, SHELL_VERBS), None):
            yield Edge(script, f"T:tool/dotnet/{verb}", "Invokes")
        if run := sh_script(line):
            yield Edge(script, f"T:script/sh/{beside(run)}", "Invokes")


def powershell_help(text: str) -> str | None:
    """The synopsis of a script's block or line comments; a block without one is help as a whole."""
    tidy = lambda found: " ".join(filter(None, map(str.strip, found)))
    start = text.find("<#")
    stop = text.find("#>", start) if start >= 0 else -1
    if stop > 0:
        block = text[start + 2 : stop]
        lines = block.split("\n")
        at = next((i for i, x in enumerate(lines[:-1]) if x.rstrip().endswith(".SYNOPSIS")), None)
        if at is not None:
            body = "\n".join(lines[at + 1 :])
            # the next help keyword, a dot and a capital, ends it
            end = next((i for i, (c, d) in enumerate(zip(body, body[1:])) if c == "." and "A" <= d <= "Z"), len(body))
            return tidy(body[:end].split("\n"))
        if block.strip():
            return tidy(lines)
    said = [comment(x) for x in text.split("\n")]
    at = next((i for i, x in enumerate(said) if x is not None and x.strip() == ".SYNOPSIS"), None)
    if at is None:
        return None
    end = next((i for i in range(at + 1, len(said)) if said[i] is None), len(said))
    return tidy(x.lstrip("#") for x in said[at + 1 : end])


def ps_edges(text: str) -> Iterator[tuple[str, str]]:
    """(kind, target) of what a script requires, reads in, runs and refers to, kind by kind."""
    lines = text.splitlines()
    for line in lines:
        words = line.split()
        if len(words) > 2 and words[0] == "#Requires" and words[1] == "-Modules":
            yield "Imports", f"T:module/{words[2]}"
    for line in lines:
        words = line.split()
        if len(words) > 1 and words[0] == ".":
            read = unquoted(words[1]).replace("\\", "/")
            if read.startswith("./") and ".ps1" in read[3:]:
                yield "Imports", "T:script/ps1/" + read[: read.rindex(".ps1") + 4]
    for line in lines:
        command = line.lstrip().removeprefix("&").lstrip()
        if command.lower().startswith("dotnet") and (verb := next(tool_verbs(command, POWERSHELL_VERBS, True), None)) and command[len("dotnet") :].lstrip().startswith(verb):
            yield "Invokes", f"T:tool/dotnet/{verb.lower()}"
    at = 0
    while (at := text.find("[System.", at)) >= 0:
        end = word_end(text, at + 1, ".")
        rest = text[end : end + 1]
        inner = word_end(text, end + 1) if rest == "[" else end
        if (rest == "]" or rest == "[" and inner > end + 1 and text[inner : inner + 2] == "]]") and all(text[at + 1 : end].split(".")):
            yield "References", f"T:{text[at + 1 : end]}"
        at = end


def split_outside(text: str, mark: str = ",") -> list[str]:
    """text cut at each mark that is in no bracket and no quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == mark and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def ps_parameters(text: str) -> Iterator[tuple[bool, str | None, str]]:
    """(mandatory, type, name) of each entry of a parameter list."""
    for entry in split_outside(text):
        at, mandatory, type_ = after_space(entry, 0), False, None
        while entry[at : at + 1] == "[" and (end := closing(entry, at, "[]")) > 0:
            inside = entry[at + 1 : end]
            if inside.startswith("Parameter("):
                mandatory = mandatory or "mandatory=$true" in "".join(inside.split()).lower()
            elif inside and all(in_word(c) or c in ".[]" for c in inside):
                type_ = inside
            at = after_space(entry, end + 1)
        name = entry[at + 1 : word_end(entry, at + 1)] if entry[at : at + 1] == "$" else ""
        if is_name(name):
            yield mandatory, type_, name


def ps_functions(text: str) -> Iterator[tuple[int, str, str, int]]:
    """(place, name, parameters in its head, place of its opening brace) of each function or filter that begins a line."""
    start = 0
    for line in text.splitlines(keepends=True):
        at = after_space(text, start) if line.strip() else start
        end = word_end(text, at)
        name = after_space(text, end)
        stop = word_end(text, name, "-")
        if line.strip() and text[at:end].lower() in ("function", "filter") and end < name < stop:
            brace, head = after_space(text, stop), ""
            if text[brace : brace + 1] == "(" and (close := text.find(")", brace)) > 0:
                head, brace = text[brace + 1 : close], after_space(text, close + 1)
            if text[brace : brace + 1] == "{":
                yield start, text[name:stop], head, brace
        start += len(line)


def ps_param_block(body: str) -> str:
    """What stands between the parentheses of a body's param block; empty without one."""
    plain, at = body.lower(), 0
    while (at := plain.find("param", at)) >= 0:
        start = after_space(plain, at + len("param"))
        if not (at and in_word(plain[at - 1])) and plain[start : start + 1] == "(":
            end = closing(body, start, "()")
            return body[start + 1 : end] if end > 0 else ""
        at += 1
    return ""


def powershell(path: str, text: str, base: str | None = None) -> Parsed:
    """A PowerShell script, its functions and their parameters, and what it imports, invokes and refers to."""
    if not text.strip():
        return
    script = f"T:script/ps1/{relative(path, base)}"
    yield Node(script, "Script", name_of(path), script, 1, text.count("\n") + 1, powershell_help(text))
    yield from (Edge(script, target, kind) for kind, target in ps_edges(text))
    seen: set[str] = set()
    for start, name, head, brace in ps_functions(text):
        owner, line = f"{script}::Function/{name}", line_at(text, start)
        end = closing(text, brace, "{}")
        yield Node(owner, "ScriptFunction", name, owner, line, line_at(text, end) if end >= 0 else line)
        yield Edge(script, owner, "Contains")
        for entries, declared in ((ps_param_block(text[brace + 1 : end]) if end >= 0 else "", True), (head, False)):
            for mandatory, type_, parameter in ps_parameters(entries):
                id_ = f"{owner}::Param/{parameter}"
                if declared or id_ not in seen:
                    seen.add(id_)
                    yield Node(id_, "ScriptParameter", parameter, id_, line, line, "Mandatory parameter" if declared and mandatory else None, None, type_ or "object", parameter)
                    yield Edge(owner, id_, "Contains")


# -- containers and workflows --------------------------------------------------------------------

# The instructions that become nodes.
INSTRUCTIONS = ("RUN", "COPY", "EXPOSE", "ENTRYPOINT", "CMD", "WORKDIR")


def stage_head(line: str) -> tuple[bool, str | None]:
    """Whether a line begins a stage, and the name that it gives it."""
    words = line.split()
    begins = len(words) > 1 and words[0].upper() == "FROM"
    return begins, words[3] if begins and len(words) > 3 and words[2].upper() == "AS" else None


def logical_lines(text: str) -> tuple[list[tuple[int, str]], int]:
    """Lines with those that end in a backslash joined to the next, each with the number of its first, and how many there are."""
    raw, out = text.splitlines(), []
    for i, line in enumerate(raw, 1):
        if out and out[-1][1].rstrip().endswith("\\"):
            out[-1] = out[-1][0], out[-1][1].rstrip()[:-1] + " " + line.lstrip()
        else:
            out.append((i, line))
    return out, len(raw)


def dockerfile(path: str, text: str, base: str | None = None) -> Parsed:
    """Stages of a container file, their instructions, and what stages and commands lead to."""
    lines, total = logical_lines(text)
    root = f"docker/{relative(path, base)}::Stage/"
    heads = [(i, name) for i, line in lines for begins, name in (stage_head(line),) if begins]
    stages = [(i, name if name is not None else str(n)) for n, (i, name) in enumerate(heads)]
    for n, (i, name) in enumerate(stages):
        yield Node(f"T:{root}{name}", "DockerStage", f"Stage: {name}", f"{root}{name}", i, stages[n + 1][0] - 1 if n + 1 < len(stages) else total)
    known = {}
    for _, name in stages:
        known.setdefault(name.lower(), name)
    for i, line in lines:
        word, _, rest = line.lstrip().partition(next((c for c in line.lstrip() if c.isspace()), " "))
        stage = next((name for at, name in reversed(stages) if at <= i), None)
        word, rest = word.upper(), rest.strip()
        if word not in INSTRUCTIONS or stage is None:
            continue
        id_ = f"T:{root}{stage}::Instruction/{i}_{word}"
        yield Node(id_, "DockerInstruction", f"{word} {rest if word in ('EXPOSE', 'WORKDIR') else shortened(rest)}", id_[2:], i, i, f"COPY {rest}" if word == "COPY" else None)
        yield Edge(f"T:{root}{stage}", id_, "Contains")
        source = rest.split()[0] if rest else ""
        if word == "COPY" and source.lower().startswith("--from=") and (other := known.get(source[len("--from=") :].lower())):
            yield Edge(f"T:{root}{stage}", f"T:{root}{other}", "DependsOn")
        if word == "RUN":
            yield from (Edge(id_, f"T:tool/dotnet/{c}", "Invokes") for c in tool_verbs(rest, SHELL_VERBS))


def workflow_type(path: str, text: str) -> str | None:
    """github, azure or null, by path, file name and, for pipelines, content."""
    plain = path.replace("\\", "/")
    if ".github/workflows/" in plain and plain.lower().endswith((".yml", ".yaml")):
        return "github"
    if name_of(plain).lower() in ("azure-pipelines.yml", "azure-pipelines.yaml") or ("trigger:" in text and "pool:" in text):
        return "azure"
    return None


class _Map(list):
    """The entries of a YAML mapping: (key, value, line of the key), all scalars as written."""

    def of(self, key: str):
        return next((v for k, v, _ in self if k == key), None)

    def text(self, key: str) -> str | None:
        found = self.of(key)
        return found if isinstance(found, str) else None


def yaml_tree(text: str):
    """(tree, line of each mapping by identity) of _Map, list and str; (None, {}) for malformed text.

    Where workers have no YAML reader this fails, as a graph without its workflows would look whole.
    """
    import yaml

    lines: dict[int, int] = {}

    def plain(node):
        if isinstance(node, yaml.MappingNode):
            made = _Map((plain(k), plain(v), k.start_mark.line + 1) for k, v in node.value)
            lines[id(made)] = node.start_mark.line + 1
            return made
        return [plain(x) for x in node.value] if isinstance(node, yaml.SequenceNode) else node.value

    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return None, {}
    return (plain(root) if root is not None else None), lines


def words_of(value) -> list[str]:
    return [value] if isinstance(value, str) else [x for x in value if isinstance(x, str)] if isinstance(value, list) and not isinstance(value, _Map) else []


def workflow(path: str, text: str, base: str | None = None) -> Parsed:
    """A CI workflow, its jobs and steps, and what they depend on and invoke."""
    kind = workflow_type(path, text)
    root, lines = yaml_tree(text) if kind else (None, {})
    if not isinstance(root, _Map):
        return
    file = name_of(path)
    top = f"T:ci/{kind}/{file}"
    at = lambda m: lines[id(m)]
    trigger = root.of("trigger") if kind == "azure" else next((v for v in map(root.of, ("on", "true")) if v is not None), None)
    events = words_of(trigger) if not isinstance(trigger, _Map) else ["complex"] if kind == "azure" else [k for k, _, _ in trigger if isinstance(k, str)]
    node = lambda id_, what, label, line, summary=None, remarks=None: Node(id_, what, label, id_, line, line, summary, remarks)
    yield node(top, "CIWorkflow", root.text("name") or file, at(root), f"Triggers: {', '.join(events)}" if events else None)

    def steps(job: str, found, label: str, uses: str, target: str, scripts: tuple[str, ...]) -> Parsed:
        for i, step in enumerate(found if isinstance(found, list) and not isinstance(found, _Map) else ()):
            if not isinstance(step, _Map):
                continue
            used = step.text(uses)
            script = next((s for s in map(step.text, scripts) if s is not None), "")
            named = next((x for x in (step.text(label), used) if x is not None), f"step{i}")
            id_ = f"{top}::Job/{job}::Step/{i}_{re.sub(r'[ /:]|' + re.escape(chr(92)), '_', named)}"
            yield node(id_, "CIStep", named, at(step))
            yield Edge(f"{top}::Job/{job}", id_, "Contains")
            if used is not None:
                yield Edge(id_, f"T:ci/{target}/{used}", "Invokes")
            commands: dict[str, str] = {}
            for verb in tool_verbs(script, CI_VERBS, True):
                commands.setdefault(verb.lower(), verb)
            yield from (Edge(id_, f"T:ci/cmd/dotnet {verb}", "Invokes") for verb in commands.values())

    def job(name: str, parent: str, label: str, line: int, needs, remarks: str | None = None) -> Parsed:
        yield node(f"{top}::Job/{name}", "CIJob", label, line, None, remarks)
        yield Edge(parent, f"{top}::Job/{name}", "Contains")
        yield from (Edge(f"{top}::Job/{name}", f"{top}::Job/{n}", "DependsOn") for n in words_of(needs))

    azure_steps = lambda name, found: steps(name, found, "displayName", "task", "task", ("script", "bash", "powershell"))
    maps = lambda found: [x for x in found if isinstance(x, _Map)] if isinstance(found, list) and not isinstance(found, _Map) else []

    def azure_jobs(found, parent: str) -> Parsed:
        for j in maps(found):
            name = j.text("job") or "unknown"
            yield from job(name, parent, j.text("displayName") or name, at(j), j.of("dependsOn"))
            yield from azure_steps(name, j.of("steps"))

    if kind == "github":
        for name, body, line in root.of("jobs") if isinstance(root.of("jobs"), _Map) else ():
            if isinstance(name, str) and isinstance(body, _Map):
                runs = body.text("runs-on")
                yield from job(name, top, body.text("name") or name, line, body.of("needs"), f"runs-on: {runs}" if runs is not None else None)
                yield from steps(name, body.of("steps"), "name", "uses", "action", ("run",))
    elif isinstance(root.of("stages"), list):
        for s in maps(root.of("stages")):
            name = s.text("stage") or "unknown"
            yield from job(name, top, s.text("displayName") or name, at(s), s.of("dependsOn"))
            yield from azure_jobs(s.of("jobs"), f"{top}::Job/{name}")
    elif isinstance(root.of("jobs"), list):
        yield from azure_jobs(root.of("jobs"), top)
    elif isinstance(root.of("steps"), list):
        yield from job("default", top, "default", at(root), None)
        yield from azure_steps("default", root.of("steps"))


PARSERS: dict[str, Callable[..., Parsed]] = {"dotnet_tools": dotnet_tools, "msbuild": msbuild, "shell": shell, "powershell": powershell, "dockerfile": dockerfile, "workflow": workflow}


def parser_for(path: Column) -> Column:
    """The parser of a file by its name, or null."""
    file = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    return (
        F.when(file == "dotnet-tools.json", "dotnet_tools")
        .when(file.rlike(r"\.(targets|props)$"), "msbuild")
        .when(file.rlike(r"\.(sh|bash)$"), "shell")
        .when(file.endswith(".ps1"), "powershell")
        .when(file.rlike(r"^dockerfile|\.dockerfile$"), "dockerfile")
        .when(file.rlike(r"\.ya?ml$"), "workflow")
    )


def parse(files: DataFrame, base: str | None = None) -> DataFrame:
    """Tagged rows (row is node or edge) of files (path, text), each by the parser of its name or of a column `parser`."""
    if "parser" not in files.columns:
        files = files.withColumn("parser", parser_for(F.col("path")))
    columns = [c.split()[0] for c in ROWS.split(", ")]

    def run(frames):
        for frame in frames:
            out = []
            for path, text, name in zip(frame["path"], frame["text"], frame["parser"]):
                for r in PARSERS[name](path, text or "", base):
                    row = dict.fromkeys(columns) | r._asdict() | {"row": "node" if isinstance(r, Node) else "edge"}
                    out.append(row | ({"file_path": path} if isinstance(r, Node) else {}))
            yield pd.DataFrame(out, columns=columns, dtype="object").astype({"start_line": "Int32", "end_line": "Int32"})

    return files.where(F.col("parser").isin(*PARSERS)).select("path", "text", "parser").mapInPandas(run, ROWS)


def graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical nodes and edges of parse()'s rows."""
    text, texts, pairs = F.lit(None).cast("string"), F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    docs = F.struct(F.col("summary"), F.col("remarks"), pairs.alias("params"), pairs.alias("type_params"), text.alias("returns"), texts.alias("examples"), F.array().cast("array<struct<type:string,description:string>>").alias("exceptions"), texts.alias("see_also"))
    no = F.lit(False)
    parameter = F.struct(F.col("parameter").alias("name"), F.col("return_type").alias("type_name"), text.alias("default_value"), no.alias("is_params"), no.alias("is_ref"), no.alias("is_out"), no.alias("is_in"), no.alias("is_optional"))
    made = rows.where("row = 'node'").withColumns({
        "docs": F.when(F.col("summary").isNotNull() | F.col("remarks").isNotNull(), docs),
        "span": F.struct("file_path", "start_line", F.lit(0).alias("start_column"), "end_line", F.lit(0).alias("end_column")),
        "parameters": F.when(F.col("parameter").isNotNull(), F.array(parameter)),
        "accessibility": F.lit("Public"),
    })
    return normalised(made), rows.where("row = 'edge'").select("from_id", "to_id", "kind", F.lit("IntraProject").alias("scope"))
