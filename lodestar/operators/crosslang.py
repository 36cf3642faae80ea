"""Edges between scripts and code: by project paths, by type names and by command lines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import EDGE_KEY

SCRIPTS = ["Script", "Tool", "BuildTarget"]
VERBS = {"build", "test", "run", "publish", "pack", "clean", "restore"}


def split_command(line: str) -> list[str]:
    """Words of a command line; quotes group and vanish."""
    words, word, quote = [], "", None
    for ch in line:
        if quote:
            quote, word = (None, word) if ch == quote else (quote, word + ch)
        elif ch in "\"'":
            quote = ch
        elif ch.isspace():
            words, word = (words + [word], "") if word else (words, "")
        else:
            word += ch
    return words + [word] if word else words


def parse_dotnet(line: str | None) -> dict | None:
    """verb, project, filter and other arguments of a dotnet command line; None for anything else."""
    if not line or not line.strip().lower().startswith("dotnet"):
        return None
    words = split_command(line.strip())
    if len(words) < 2 or words[1].lower() not in VERBS:
        return None
    out, rest = {"verb": words[1].lower(), "project": None, "filter": None, "arguments": []}, iter(words[2:])
    for word in rest:
        if word in ("--filter", "--project"):
            value = next(rest, None)
            if value is None:
                out["arguments"].append(word)
            else:
                out[word[2:]] = value.strip("\"'")
        elif not word.startswith("-") and out["project"] is None:
            out["project"] = word.strip("\"'")
        else:
            out["arguments"].append(word)
    return out


def parsed_lines(lines: pd.Series) -> pd.DataFrame:
    got = [parse_dotnet(x) or {} for x in lines]
    return pd.DataFrame({k: [g.get(k) for g in got] for k in ("verb", "project", "filter")}, dtype="object")


def command(line: Column) -> Column:
    """A parsed command line (verb, project, filter); all null where it is no dotnet command."""
    return F.pandas_udf(parsed_lines, "verb string, project string, filter string")(line)


def plain_path(path: Column) -> Column:
    return F.ltrim(F.translate(path, "\\", "/"), F.lit("./"))


def fragments(nodes: DataFrame) -> DataFrame:
    """(place, fragment, project_id): project names, and their project files where a source is known, each with a namespace of the project."""
    code = nodes.where(~F.col("kind").isin(SCRIPTS) & F.col("project_origin").isNotNull())
    spaces = code.where("kind = 'Namespace'").groupBy("project_origin").agg(F.min("id").alias("project_id"))
    sourced = code.where("span is not null").select("project_origin").distinct().withColumn("sourced", F.lit(True))
    both = spaces.join(sourced, "project_origin", "left")
    names = F.when(F.col("sourced"), F.array("project_origin", F.concat("project_origin", F.lit(".csproj")))).otherwise(F.array("project_origin"))
    return both.select("project_id", "project_origin", F.posexplode(names).alias("n", "fragment")).select(F.struct("project_origin", "n").alias("place"), F.lower("fragment").alias("fragment"), "project_id")


def lengths(df: DataFrame, column: str) -> list[int]:
    """The lengths that a column of names has: as many as the longest name is long, at most."""
    return sorted(r[0] for r in df.select(F.length(column)).distinct().collect() if r[0])


def pieces(text: Column, sizes: list[int], starts: Callable[[Column, int], Column]) -> Column:
    """Distinct substrings of the given sizes at the places that starts(text, size) gives."""
    def of(size: int) -> Column:
        inside = F.filter(starts(text, size), lambda i: (i > 0) & (i + size - 1 <= F.length(text)))
        return F.transform(inside, lambda i: F.substring(text, i, size))

    return F.array_distinct(F.concat(*map(of, sizes))) if sizes else F.array().cast("array<string>")


def anywhere(text: Column, size: int) -> Column:
    return F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))


def last_or_dotted(text: Column, size: int) -> Column:
    """The place of the last `size` characters, and each place after a dot."""
    dots = F.filter(F.sequence(F.lit(2), F.length(text) + 1), lambda i: F.substring(text, i - 1, 1) == ".")
    return F.array_append(dots, F.length(text) - size + 1)


def by_path(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Invokes edges from (from_id, path) to the first project, by name, whose fragment the path contains.

    Paths are cut into all their pieces of a fragment's length, so containment is a hash join.
    """
    known = fragments(nodes)
    cut = paths.withColumn("path", F.lower(plain_path(F.col("path"))))
    hits = cut.select("from_id", "path", F.explode(pieces(F.col("path"), lengths(known, "fragment"), anywhere)).alias("fragment")).join(known, "fragment")
    return hits.groupBy("from_id", "path").agg(F.min_by("project_id", "place").alias("to_id")).select("from_id", "to_id", F.lit("Invokes").alias("kind"))


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New (from_id, to_id, kind, scope) edges from scripts to code, each once, none that exists."""
    scripts = nodes.where(F.col("kind").isin(SCRIPTS))
    types = nodes.where("kind = 'Type' and fqn is not null").select(F.col("id").alias("to_id"), "fqn")
    own = edges.join(scripts.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    invoked = own.where("kind = 'Invokes' and instr(to_id, ':') > 0").select("from_id", F.expr("substring(to_id, instr(to_id, ':') + 1)").alias("path"))
    named = own.where("kind = 'References'").select("from_id", F.col("to_id").alias("fqn")).join(types, "fqn").select("from_id", "to_id", F.lit("References").alias("kind"))
    parsed = scripts.where("lower(ltrim(docs.summary)) like 'dotnet%'").select(F.col("id").alias("from_id"), command(F.col("docs.summary")).alias("c")).select("from_id", "c.*").where("verb is not null")
    wanted = parsed.where("instr(filter, '~') > 0").select("from_id", F.expr("substring(filter, instr(filter, '~') + 1)").alias("name")).select("from_id", F.btrim("name", F.lit("\"'")).alias("name"))
    # a type matches by its last characters, or by what follows a dot
    tails = types.select("to_id", F.explode(pieces(F.col("fqn"), lengths(wanted, "name"), last_or_dotted)).alias("name"))
    filtered = wanted.join(tails, "name").select("from_id", "to_id", F.lit("References").alias("kind"))
    targets = invoked.union(parsed.where("project is not null").select("from_id", F.col("project").alias("path")))
    found = by_path(targets, nodes).union(named).union(filtered).dropDuplicates(EDGE_KEY)
    return found.join(edges.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti").withColumn("scope", F.lit("CrossProject"))
