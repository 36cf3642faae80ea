"""The tools as one object over a snapshot store: each call gives a page in JSON, Markdown or schema-once form.

A call passes the rate limit, then runs lazily built DataFrames and renders at most a page.
Texts that end up in a page are scanned for phrases that try to steer a reader.
"""

from __future__ import annotations

import json
import platform
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import render
from .functions.text import is_suspicious, marked
from .model import KINDS
from .operators import coverage, diff, govern, graph, ingest, review, search, solution
from .sources import extract_json, files, parsers
from .store import SnapshotMissing, SnapshotStore


class InvalidInput(ValueError):
    """An argument that no call can work with."""


@dataclass
class Buckets:
    """Token buckets on the driver: full at first, filled up every window."""

    limits: dict[str, int] = field(default_factory=lambda: {"query": govern.QUERY_LIMIT, "ingestion": govern.INGEST_LIMIT})
    seconds: float = govern.WINDOW_SECONDS
    clock: Callable[[], float] = time.monotonic
    state: dict = field(default_factory=dict)

    def take(self, tool: str) -> int:
        """0 if the call may run, else the milliseconds after which to try again."""
        bucket = "ingestion" if tool in govern.INGEST_TOOLS else "query"
        tokens, since = self.state.get(bucket, (self.limits[bucket], self.clock()))
        periods = int((self.clock() - since) // self.seconds)
        if periods:
            tokens, since = self.limits[bucket], since + periods * self.seconds
        wait = 0 if tokens else max(1, int(-(-(since + self.seconds - self.clock()) * 1000 // 1)))
        self.state[bucket] = (max(0, tokens - 1), since)
        return wait


def scanned(df: DataFrame, *columns: str) -> DataFrame:
    """df with suspicious phrases in text columns wrapped, and injection_warning."""
    warning = F.lit(False)
    for c in columns:
        warning = warning | is_suspicious(F.col(c))
    return df.withColumn("injection_warning", warning).withColumns({c: F.when(F.col(c).isNotNull(), marked(F.col(c))) for c in columns})


class Tools:
    def __init__(self, store: SnapshotStore, allow: list[str] | None = None, deny: list[str] | None = None, verbose_errors: bool = False, limits: Buckets | None = None, audit: Callable[[dict], None] | None = None, patterns: list[str] | None = None):
        """audit is given an entry for each call that the limit lets through, with what matches the patterns redacted."""
        self.store, self.spark, self.audit, self.patterns = store, store.spark, audit, patterns or []
        self.allow, self.deny, self.verbose, self.limits = allow or [], deny or [], verbose_errors, limits or Buckets()

    def call(self, tool: str, **arguments) -> str:
        """A tool by name: first the limit, then the audit around the tool; errors come back as JSON with an error code."""
        wait = self.limits.take(tool)
        if wait:
            return json.dumps({"error": "rate_limited", "retryAfterMs": wait})
        began = time.time()
        response = self.run(tool, arguments)
        if self.audit is not None:
            self.audit(self.entry(tool, arguments, response, began))
        return response

    def entry(self, tool: str, arguments: dict, response: str, began: float) -> dict:
        """What the audit tells of a call: names and lengths of its arguments, never their values."""
        try:
            error = json.loads(response).get("error") if response.startswith("{") else None
        except ValueError:
            error = None
        summary = ", ".join(f"{k}({len(str(v)) if v is not None else 0})" for k, v in arguments.items()) or "(no args)"
        for pattern in self.patterns:
            summary = re.sub(pattern, "[REDACTED]", summary, flags=re.I)
        return {"timestamp": began, "tool": tool, "inputSummary": summary, "responseBytes": len(response.encode()), "success": error is None, "errorCode": error, "duration": time.time() - began}

    def run(self, tool: str, arguments: dict) -> str:
        run = getattr(self, tool, None)
        if run is None or tool not in TOOLS:
            return json.dumps(govern.error_payload("invalid_input", f"no tool {tool}"))
        try:
            return run(**arguments)
        except SnapshotMissing as e:
            return json.dumps(govern.error_payload("snapshot_not_found", str(e)))
        except LookupError as e:
            return json.dumps(govern.error_payload("not_found", str(e), self.verbose))
        except (InvalidInput, TypeError, FileNotFoundError) as e:
            return json.dumps(govern.error_payload("invalid_input", str(e)))

    # -- helpers ---------------------------------------------------------------------------------

    def shown(self, df: DataFrame, format: str, shape: str | None = None, title: str | None = None, **more) -> str:  # noqa: A002
        if format == "markdown":
            return render.to_markdown(df, title)
        if format == "tron" and shape:
            return render.to_tron(df, shape)
        if format not in ("json", "tron"):
            raise InvalidInput(f"format {format}")
        return render.to_json(df, **more)

    def snapshot(self, version: str | None) -> tuple[str, DataFrame, DataFrame]:
        version = version or self.store.latest()
        return (version, *self.store.cached(version))

    def resolved(self, nodes: DataFrame, name: str) -> str:
        """An id, or the id of a qualified name."""
        found = graph.resolve_fqn(nodes, name).first()
        if found.status == "ambiguous":
            raise InvalidInput(f"'{name}' is in several projects: {', '.join(found.projects)}")
        return found.id or name

    def path_ok(self, column: str):
        return govern.allowed(F.col(column), self.allow, self.deny)

    # -- queries ---------------------------------------------------------------------------------

    def search_symbols(self, query: str, kind: str | None = None, project: str | None = None, offset: int = 0, limit: int = 20, version: str | None = None, format: str = "json") -> str:  # noqa: A002
        if kind is not None and kind.lower() not in {k.lower() for k in KINDS}:
            raise InvalidInput(f"kind {kind}")
        version, nodes, _ = self.snapshot(version)
        self.store.build_index(version)
        hits = search.search(nodes, query, self.store.index(version), kind, project, offset, limit)
        hits = hits.join(nodes.select("id", F.col("docs.summary").alias("snippet")), "id", "left").orderBy(F.desc("score"), "id")
        return self.shown(scanned(hits, "snippet"), format, "search", query, snapshot_version=version, is_stale=self.store.is_stale(version))

    def get_symbol(self, symbol: str, format: str = "json") -> str:  # noqa: A002
        version, nodes, edges = self.snapshot(None)
        id_ = self.resolved(nodes, symbol)
        found = govern.redact_spans(graph.symbol(nodes, id_), self.path_ok("span.file_path")).withColumn("summary", F.col("docs.summary"))
        page = found.join(graph.details(nodes, edges, id_), "id")
        if page.isEmpty():
            raise LookupError(f"no symbol {symbol}")
        return self.shown(scanned(page, "summary"), format, "detail", symbol, snapshot_version=version)

    def get_references(self, symbol: str, cross_project_only: bool = False, offset: int = 0, limit: int = 0, version: str | None = None, format: str = "json") -> str:  # noqa: A002
        version, nodes, edges = self.snapshot(version)
        if nodes.where(F.col("id") == symbol).isEmpty():
            symbol = self.resolved(nodes, symbol)
            if nodes.where(F.col("id") == symbol).isEmpty():
                raise LookupError(f"no symbol {symbol}")
        return self.shown(graph.references(nodes, edges, symbol, cross_project_only, offset, limit), format, "references", symbol, snapshot_version=version)

    def find_implementations(self, symbol: str, version: str | None = None, format: str = "json") -> str:  # noqa: A002
        version, nodes, edges = self.snapshot(version)
        return self.shown(graph.implementations(nodes, edges, self.resolved(nodes, symbol)), format, None, symbol, snapshot_version=version)

    def get_doc_coverage(self, project: str | None = None, format: str = "json") -> str:  # noqa: A002
        version, nodes, _ = self.snapshot(None)
        return self.shown(coverage.doc_coverage(nodes, project).orderBy("grouping", "key"), format, None, "Coverage", snapshot_version=version)

    def explain_project(self, depth: int = 1, include: list[str] | None = None, exclude: list[str] | None = None, format: str = "json") -> str:  # noqa: A002
        version, nodes, edges = self.snapshot(None)
        sections = graph.overview(nodes, edges)
        if depth < 2:
            sections["types"] = sections["types"].drop("children")
        if depth < 1:
            sections.pop("types")
        wanted = {k: v for k, v in sections.items() if (not include or k in include) and k not in (exclude or [])}
        parts = {k: json.loads(render.to_json(v))["items"] for k, v in wanted.items()}
        return json.dumps({"snapshotVersion": version} | parts) if format != "markdown" else "\n\n".join(render.to_markdown(v, k) for k, v in wanted.items())

    def get_diagnostic_info(self) -> str:
        return json.dumps({"spark": self.spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "master": self.spark.sparkContext.master, "store": self.store.folder})

    # -- changes ---------------------------------------------------------------------------------

    def changes(self, a: str, b: str) -> tuple[DataFrame, DataFrame]:
        (na, ea), (nb, eb) = self.store.load(a), self.store.load(b)
        names = {r.content_hash: r.project_name for r in self.store.entries().where(F.col("content_hash").isin(a, b)).collect()}
        if len(set(names.values())) > 1:
            raise InvalidInput("the snapshots are of different projects")
        return diff.semantic_diff(na, ea, nb, eb), eb

    def diff_snapshots(self, a: str, b: str, format: str = "json") -> str:  # noqa: A002
        return self.shown(diff.graph_diff(self.store.load(a)[0], self.store.load(b)[0]).orderBy("id"), format, "diff", "Changes", snapshot_version=b)

    def review_changes(self, a: str, b: str, verbose: bool = False, format: str = "json") -> str:  # noqa: A002
        changes, edges = self.changes(a, b)
        page = review.in_order(review.impact(review.findings(changes, verbose), edges))
        summary = render.plain(review.review_summary(changes, verbose).first())
        odd = json.loads(render.to_json(review.unusual(changes).orderBy("kind", "id")))["items"]
        return self.shown(scanned(page, "description", "remediation"), format, "review", "Review", summary=summary, unusual_findings=odd)

    def find_breaking_changes(self, a: str, b: str, format: str = "json") -> str:  # noqa: A002
        return self.shown(scanned(review.breaking(self.changes(a, b)[0]).orderBy("id", "category"), "description"), format, "breaking", "Breaking changes", before_version=a, after_version=b)

    def explain_change(self, a: str, b: str, symbol: str, format: str = "json") -> str:  # noqa: A002
        changes, edges = self.changes(a, b)
        page = review.explain(changes, edges, symbol)
        if page.isEmpty():
            raise LookupError(f"no changes of {symbol}")
        return self.shown(scanned(page, "description", "why_it_matters", "remediation"), format, "explain", symbol, symbol_id=symbol)

    def explain_solution(self, version: str | None = None, format: str = "json") -> str:  # noqa: A002
        version, nodes, edges = self.snapshot(version)
        dag = {r.project: r.depends_on for r in solution.dependency_dag(nodes, edges).collect()}
        return self.shown(solution.projects(nodes, edges).orderBy("project"), format, None, "Projects", snapshot_version=version, dependencies=dag, totals=render.plain(solution.totals(nodes).first()))

    def diff_solution_snapshots(self, a: str, b: str, format: str = "json") -> str:  # noqa: A002
        (na, ea), (nb, eb) = self.store.load(a), self.store.load(b)
        projects = json.loads(render.to_json(solution.project_changes(na, nb).orderBy("project")))["items"]
        cross = json.loads(render.to_json(solution.cross_edge_changes(na, ea, nb, eb).orderBy("status", "source", "target", "kind")))["items"]
        counts = solution.inner_diff(na, ea, nb, eb).groupBy("project_origin", "change_type", "severity").agg(F.count("*").alias("n")).orderBy("project_origin", "change_type", "severity")
        return self.shown(counts, format, None, "Solution", projects=projects, cross_project_edges=cross)

    # -- ingestion -------------------------------------------------------------------------------

    def read_folder(self, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and file hashes of the artifacts and extractor JSON files below a folder."""
        if not Path(folder).is_dir():
            raise InvalidInput(f"no folder {folder}")
        texts = files.source_files(files.texts(self.spark, folder), include, exclude, tests=True)
        nodes, edges = parsers.graph(parsers.parse(texts.where(~F.col("path").endswith(".json") | F.col("path").endswith("dotnet-tools.json")), f"file:{Path(folder).resolve()}"))
        extracts = sorted(str(p) for p in Path(folder).rglob("*.symbols.json"))
        if extracts:
            snapshots = self.spark.read.schema(extract_json.SNAPSHOT).option("multiLine", "true").json(extracts)
            nodes, edges = nodes.unionByName(extract_json.nodes(snapshots)), edges.unionByName(extract_json.edges(snapshots))
        return nodes, edges, files.scan(self.spark, folder).select("path", "sha256")

    def ingest_folder(self, folder: str, project: str | None, force: bool, include=None, exclude=None, solution: str = "") -> dict:
        """Saves a snapshot of a folder unless its files are those of the project's last one; a failed index is only reported."""
        project = project or Path(folder).resolve().name
        hashes_at = self.store.hashes_at(project, solution)
        nodes, edges, hashes = self.read_folder(folder, include, exclude)
        before = self.spark.read.parquet(hashes_at) if self.store.exists(hashes_at) else None
        changes = ingest.manifest_diff(before, hashes)
        counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
        if before is not None and not counts and not force:
            return {"status": "skipped", "project": project, "snapshot": self.store.latest(project), "changes": {}, **self.sizes(self.store.latest(project))}
        hash_ = self.store.save(nodes, edges, project)
        graph.stored(hashes).write.mode("overwrite").parquet(hashes_at)
        done = {"status": "ok", "project": project, "snapshot": hash_, "changes": counts, **self.sizes(hash_)}
        try:
            self.store.build_index(hash_)
        except Exception as e:  # the snapshot stands without its index
            done["indexError"] = str(e)[:200]
        return done

    def sizes(self, hash_: str) -> dict:
        found = self.store.entries().where(F.col("content_hash") == hash_).first()
        return {"nodes": found.node_count, "edges": found.edge_count}

    @staticmethod
    def summed(done: list[dict]) -> dict:
        """Projects with their outcomes, and the sums of nodes and edges of all that have a snapshot."""
        states = [d["status"] for d in done]
        total = lambda k: sum(d.get(k, 0) for d in done)
        return {"projects": done, "ingested": states.count("ok"), "skipped": states.count("skipped"), "failed": states.count("error"), "totalNodes": total("nodes"), "totalEdges": total("edges")}

    def update(self, config: dict, force: bool = False) -> str:
        """The batch verb: a primary source and its secondaries ({"primary": path, "secondary": [{"type": "dotnet" | "typescript", "path": path}]}) in one line of JSON.

        The primary's failure ends it; a secondary's is reported beside the others.
        """
        if not config.get("primary"):
            return json.dumps(govern.error_payload("invalid_input", "no primary source"))
        first = json.loads(self.call("ingest_solution" if config["primary"].endswith((".sln", ".slnx")) else "ingest_project", path=config["primary"], force=force))
        if "error" in first:
            return json.dumps(first)
        done = first["projects"] if "projects" in first else [first]
        for source in config.get("secondary") or []:
            tool = "ingest_typescript" if source.get("type") == "typescript" else "ingest_project"
            got = json.loads(self.call(tool, path=source.get("path", ""), force=force))
            done.append({"status": "error", "project": source.get("path"), "message": got.get("message", got["error"])} if "error" in got else got)
        return json.dumps(self.summed(done))

    def ingest_project(self, path: str, project: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, force: bool = False) -> str:
        return json.dumps(self.ingest_folder(path, project, force, include, exclude))

    def ingest_solution(self, path: str, force: bool = False) -> str:
        """Each project folder of a solution on its own; unchanged ones are skipped, a failing one is reported, hashes of projects that left it go."""
        done, found = [], files.discover(path)
        solution = Path(path).resolve().name
        for p in found.projects:
            try:
                done.append(self.ingest_folder(str(Path(p).parent), Path(p).stem, force, solution=solution))
            except (InvalidInput, OSError) as e:
                done.append({"status": "error", "project": Path(p).stem, "message": str(e)})
        gone = self.store.forget_others(solution, [Path(p).stem for p in found.projects])
        if last := next((d["snapshot"] for d in reversed(done) if d["status"] == "ok"), None):
            self.store.point(solution, last)
        return json.dumps(self.summed(done) | {"forgotten": gone, "pointer": self.store.pointed(solution)})

    def ingest_typescript(self, path: str, force: bool = False) -> str:
        """The extractor's JSON beside a tsconfig.json, as a project of the folder's name."""
        return json.dumps(self.ingest_folder(str(Path(path).parent if path.endswith(".json") else path), None, force))

    def ingest_typescript_workspace(self, path: str, force: bool = False) -> str:
        done = []
        for p in files.typescript_projects(path):
            try:
                done.append(self.ingest_folder(str(Path(p).parent), None, force))
            except (InvalidInput, OSError) as e:
                done.append({"status": "error", "project": str(Path(p).parent), "message": str(e)})
        return json.dumps(self.summed(done))


TOOLS = [
    "search_symbols", "get_symbol", "get_references", "find_implementations", "get_doc_coverage", "diff_snapshots", "explain_project", "review_changes", "find_breaking_changes",
    "explain_change", "explain_solution", "diff_solution_snapshots", "ingest_project", "ingest_solution", "ingest_typescript", "ingest_typescript_workspace", "get_diagnostic_info",
]
