"""Output forms of small pages: JSON with camel-case names, Markdown tables, and schema-once rows.

Only pages are rendered: at most PAGE rows come to the driver.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Row

PAGE = 200
#: Columns of each schema-once shape, and their names in it.
SHAPES = {
    "search": (("id", "score", "kind", "display_name", "snippet"), ("id", "score", "kind", "displayName", "snippet")),
    "detail": (("id", "kind", "display_name", "fqn", "accessibility", "summary", "parent_id", "child_ids", "related_ids"), ("id", "kind", "displayName", "fqn", "accessibility", "summary", "parentId", "childIds", "relatedIds")),
    "references": (("from_id", "to_id", "kind"), ("fromId", "toId", "edgeKind")),
    "diff": (("id", "change", "summary"), ("id", "changeKind", "summary")),
    "review": (("id", "display_name", "severity", "category", "description", "remediation"), ("symbolId", "displayName", "severity", "category", "description", "remediation")),
    "breaking": (("id", "display_name", "change_type", "category", "description"), ("symbolId", "displayName", "changeType", "category", "description")),
    "explain": (("category", "severity", "description", "before", "after", "why_it_matters", "callers", "remediation"), ("category", "severity", "description", "before", "after", "whyItMatters", "callers", "remediation")),
}


def camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m[1].upper(), name)


def plain(value):
    if isinstance(value, Row):
        return {camel(k): plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool, dict)) else str(value)


def rows(page: DataFrame) -> list[Row]:
    return page.limit(PAGE).collect()


def to_json(page: DataFrame, **more) -> str:
    """{..., "items": [...]} with camel-case names."""
    return json.dumps({camel(k): v for k, v in more.items()} | {"items": [plain(r) for r in rows(page)]}, ensure_ascii=False, separators=(",", ":"))


def to_markdown(page: DataFrame, title: str | None = None) -> str:
    """A table; vertical bars and line feeds in cells are escaped."""
    cell = lambda v: "" if v is None else (", ".join(map(str, v)) if isinstance(v, list) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(page.columns) + " |", "|" + " --- |" * len(page.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows(page)])


def to_tron(page: DataFrame, shape: str) -> str:
    """{"$schema": [...], "data": [[...]]} of one of the SHAPES; scores keep four decimals, null texts are empty."""
    columns, names = SHAPES[shape]
    kept = page.select(*columns)
    nullable = {"before", "after"}
    cell = lambda c, v: round(v, 4) if c == "score" else v.lower() if shape == "review" and c == "severity" else "" if v is None and c not in nullable else plain(v)
    data = [[cell(c, v) for c, v in zip(columns, r)] for r in rows(kept)]
    return json.dumps({"$schema": list(names), "data": data}, ensure_ascii=False, separators=(",", ":"))
