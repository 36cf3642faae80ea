"""Doc comments of script sources: blocks between /** and */, their summary and their tags.

A block is read line by line without its leading stars. A tag begins with @ at the start of
a line outside braces, backticks and fences and goes on until the next one; braces nest, so an inline
{@link X} or a type {{a: {b: string}}} belongs to the text around it. Of tags that have one
place (returns, remarks, example, a name's param) the last one counts; see keeps all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DOCS

#: Names of tags that mean the same, and what throws without a type is filed under.
TYPE_PARAMETERS, RETURNS, THROWS, UNKNOWN = ("template", "typeparam"), ("returns", "return"), ("throws", "exception"), "unknown"


def blocks(source: str) -> Iterator[tuple[int, str]]:
    """(line, body) of each doc comment, lines from 1; strings, templates and other comments are passed over."""
    at, n = 0, len(source)
    while at < n:
        two = source[at : at + 2]
        if two == "//":
            at = source.find("\n", at)
            at = n if at < 0 else at
        elif two == "/*":
            end = source.find("*/", at + 2)
            end = n if end < 0 else end
            if source[at + 2 : at + 3] == "*" and end > at + 2 and end < n:
                yield source.count("\n", 0, at) + 1, source[at + 3 : end]
            at = end + 2
        elif source[at] in "\"'`":
            quote, at = source[at], at + 1
            while at < n and source[at] != quote and (quote == "`" or source[at] != "\n"):
                at += 2 if source[at] == "\\" else 1
            at += 1
        else:
            at += 1


def lines_of(body: str) -> list[str]:
    """The lines of a comment without the stars that lead them."""
    out = []
    for line in body.splitlines():
        bare = line.strip()
        out.append((bare[1:].removeprefix(" ") if bare.startswith("*") else bare).rstrip())
    return out


def balance(text: str, depth: int) -> int:
    """How many braces are open behind a text."""
    for c in text:
        depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
    return depth


def sections(body: str) -> list[tuple[str, str]]:
    """(tag, text) in order; the first has an empty tag and is the summary."""
    found: list[tuple[str, list[str]]] = [("", [])]
    depth, fenced = 0, False
    for line in lines_of(body):
        bare = line.lstrip()
        name = ""
        if bare.startswith("@") and not depth and not fenced:
            end = 1
            while end < len(bare) and (bare[end].isalnum() or bare[end] in "_-"):
                end += 1
            name = bare[1:end]
        if name:
            found.append((name, [bare[1 + len(name) :].strip()]))
            depth = balance(found[-1][1][0], 0)
        else:
            found[-1][1].append(line)
            depth = balance(line, depth) if not fenced else depth
        if bare.startswith("```"):
            fenced, depth = not fenced, 0
    return [(tag, "\n".join(text).strip()) for tag, text in found]


def braced(text: str) -> tuple[str, str]:
    """(what stands in a leading pair of braces, with them, the rest)."""
    if not text.startswith("{") or text.startswith("{@"):
        return "", text
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if not depth:
            return text[: i + 1], text[i + 1 :].lstrip()
    return "", text


def named(text: str) -> tuple[str, str] | None:
    """(first word, rest of its line)."""
    word = text.split(None, 1)
    if not word or text[:1].isspace():
        return None
    rest = text[len(word[0]) :].lstrip()
    return word[0], rest.split("\n", 1)[0]


def plain_name(name: str) -> str:
    """A parameter's name without what marks it as optional."""
    return name[1:].split("=", 1)[0].rstrip("]") if name.startswith("[") else name


def jsdoc(body: str | None) -> dict | None:
    """The doc comment of a block's body, with the members of DOCS; none for one without text and tags."""
    if body is None:
        return None
    (_, summary), *tags = sections(body)
    if not summary and not tags:
        return None
    out = {"summary": summary or None, "remarks": None, "params": {}, "type_params": {}, "returns": None, "examples": [], "exceptions": [], "see_also": []}
    thrown: dict[str, str] = {}
    for tag, text in tags:
        if tag == "param":
            if found := named(braced(text)[1]):
                # an optional name may have spaces in its default
                word = re.match(r"\[[^\]]*\]", braced(text)[1])
                rest = braced(text)[1][word.end() :].lstrip().split("\n", 1)[0] if word else found[1]
                out["params"][plain_name(word[0] if word else found[0])] = rest
        elif tag in TYPE_PARAMETERS:
            if found := named(braced(text)[1]):
                out["type_params"][found[0]] = found[1]
        elif tag in RETURNS:
            out["returns"] = braced(text)[1]
        elif tag == "remarks":
            out["remarks"] = text
        elif tag == "example":
            out["examples"] = [text]
        elif tag == "see":
            out["see_also"].append(text)
        elif tag in THROWS:
            kind, rest = braced(text)
            if kind:
                thrown[kind] = rest.split("\n", 1)[0]
            elif found := named(text):
                thrown[found[0]] = found[1]
            else:
                thrown[UNKNOWN] = text
    out["exceptions"] = [{"type": k, "description": v} for k, v in thrown.items()]
    return out


def jsdocs(column: Column) -> Column:
    """Doc comments of a column of comment bodies."""
    blank = dict.fromkeys(("summary", "remarks", "params", "type_params", "returns", "examples", "exceptions", "see_also"))
    return F.pandas_udf(lambda s: pd.DataFrame([jsdoc(x) or blank for x in s]), DOCS)(column)


def comments(source: Column) -> Column:
    """The doc comments of a column of sources: an array of (line, body)."""
    return F.pandas_udf(lambda s: s.map(lambda x: [{"line": n, "body": b} for n, b in blocks(x or "")]), "array<struct<line:int,body:string>>")(source)
