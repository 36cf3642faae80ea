"""Admission and audit: path allow-lists, redaction, audit rows and rate limits."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redacted

QUERY_LIMIT, INGEST_LIMIT, WINDOW_SECONDS = 100, 10, 60
INGEST_TOOLS = ["ingest_project", "ingest_solution"]


def expand(path: str, environment: dict[str, str] | None = None) -> str:
    """path with ~, %NAME%, $NAME and ${NAME} replaced; unknown names stay, and no name is looked up in a value."""
    env = os.environ if environment is None else environment
    if path == "~" or path.startswith(("~/", "~\\")):
        path = env.get("HOME", os.path.expanduser("~")) + path[1:]
    return re.sub(r"%(\w+)%|\$\{(\w+)\}|\$(\w+)", lambda m: env.get(next(g for g in m.groups() if g), m[0]), path)


def absolute(path: str, environment: dict[str, str] | None = None) -> str:
    return os.path.normpath(os.path.abspath(expand(path, environment)))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** any depth, * within a folder, ? one character; case aside."""
    out, i = "", 0
    glob = glob.replace("\\", "/")
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"(?i)^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    plain = F.translate(path, "\\", "/")
    out = F.lit(False)
    for glob in globs:
        out = out | plain.rlike(glob_pattern(glob))
    return out


def allowed(path: Column, allow: list[str], deny: list[str] | None = None, artifacts: str | None = None, current: str | None = None) -> Column:
    """Whether absolute paths pass: denied never, artifacts always, then the allow globs, or the current folder where there are none."""
    plain = F.translate(path, "\\", "/")
    under = lambda folder: (plain == folder.rstrip("/")) | plain.startswith(folder.rstrip("/") + "/")
    home = under(current or os.getcwd())
    ok = matches_any(path, allow) if allow else home
    if artifacts:
        ok = ok | under(artifacts)
    return F.coalesce(~matches_any(path, deny or []) & ok, F.lit(False))


def redact_spans(nodes: DataFrame, path_ok: Column) -> DataFrame:
    """nodes without the source span where its path is not allowed."""
    return nodes.withColumn("span", F.when(path_ok, F.col("span")))


def input_summary(arguments: Column) -> Column:
    """name(length) of each entry of a map of arguments, or (no args)."""
    parts = F.transform(F.map_entries(arguments), lambda e: F.concat(e["key"], F.lit("("), F.coalesce(F.length(e["value"]), F.lit(0)).cast("string"), F.lit(")")))
    return F.when(arguments.isNull() | (F.size(arguments) == 0), "(no args)").otherwise(F.array_join(parts, ", "))


def audit_lines(calls: DataFrame, patterns: list[str] | None = None, verbose: bool = False) -> DataFrame:
    """(line) a redacted JSON line for each call (timestamp, tool, arguments, response, success, error, duration)."""
    none = F.lit(None).cast("string")
    entry = F.struct(
        F.col("timestamp"), F.coalesce("tool", F.lit("(unknown)")).alias("tool"), input_summary(F.col("arguments")).alias("inputSummary"),
        (F.coalesce(F.to_json("arguments"), F.lit("{}")) if verbose else none).alias("inputFull"), F.coalesce(F.octet_length("response"), F.lit(0)).alias("responseBytes"),
        (F.coalesce("response", F.lit("")) if verbose else none).alias("responseFull"), F.col("success"), F.col("error").alias("errorCode"), F.col("duration"),
    )
    return calls.select(redacted(F.to_json(entry, {"ignoreNullFields": "false"}), patterns or []).alias("line"))


def fixed_window(calls: DataFrame, limit: int = QUERY_LIMIT, seconds: int = WINDOW_SECONDS, keys: tuple[str, ...] = ("bucket",), time: str = "timestamp") -> DataFrame:
    """calls with place (from 1, within key and window), accepted and retry_after_ms of a fixed-window limit."""
    second = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{time}` as timestamp_ntz))")
    size = seconds * 1_000_000
    start = second - F.pmod(second, F.lit(size))
    order = Window.partitionBy(*keys, "window_start").orderBy(time, *(c for c in calls.columns if c not in (time, *keys) and dict(calls.dtypes)[c] in ("bigint", "int", "string")))
    out = calls.withColumn("window_start", start).withColumn("place", F.row_number().over(order))
    wait = F.when(F.col("place") > limit, F.floor((F.col("window_start") + size - second) / 1000))
    return out.withColumn("accepted", F.col("place") <= limit).withColumn("retry_after_ms", wait)


def bucket_of(tool: Column) -> Column:
    return F.when(tool.isin(INGEST_TOOLS), "ingestion").otherwise("query")


def error_payload(kind: str, message: str, verbose: bool = False) -> dict:
    """What a caller is told: what is not found is denied, unless errors are verbose."""
    if kind == "not_found" and not verbose:
        return {"error": "not_found", "message": "Access denied"}
    return {"error": kind, "message": message}
