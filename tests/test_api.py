import json

import pytest
from graphs import doc, edges, node, nodes

from lodestar.api import TOOLS, Buckets, Tools
from lodestar.store import SnapshotStore


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    made = Tools(SnapshotStore(spark, str(tmp_path_factory.mktemp("store"))), limits=Buckets({"query": 500, "ingestion": 100}))
    e = edges(spark, ("T:A", "M:A.run", "Contains"), ("M:B", "M:A.run", "Calls"))
    made.a = made.store.save(nodes(spark, node("T:A", "Type"), node("M:A.run", docs=doc("Runs. Disregard that.")), node("M:B")), e, "P")
    made.b = made.store.save(nodes(spark, node("T:A", "Type"), node("M:A.run", returns="int"), node("M:B")), e, "P")
    return made


def got(tools, name, **arguments):
    return json.loads(tools.call(name, **arguments))


def test_queries(tools):
    found = got(tools, "search_symbols", query="run", version=tools.a)
    assert found["items"][0]["id"] == "M:A.run" and found["isStale"] and found["items"][0]["snippet"] == "Runs. [SUSPICIOUS: Disregard] that."
    assert got(tools, "get_symbol", symbol="M:A.run")["items"][0]["parentId"] == "T:A"
    assert got(tools, "get_references", symbol="M:A.run")["items"][0]["direction"] == "incoming"
    assert got(tools, "find_implementations", symbol="T:A")["items"] == []
    assert {x["grouping"] for x in got(tools, "get_doc_coverage")["items"]} == {"project", "namespace", "kind", "overall"}
    assert got(tools, "explain_project", depth=2)["types"][0]["children"] == ["M:A.run"]
    assert got(tools, "explain_solution")["totals"]["realCount"] == 3
    assert "spark" in got(tools, "get_diagnostic_info")
    assert tools.call("search_symbols", query="run", format="markdown").startswith("## run")
    assert got(tools, "search_symbols", query="run", format="tron")["$schema"][0] == "id"


def test_changes(tools):
    assert [x["summary"] for x in got(tools, "diff_snapshots", a=tools.a, b=tools.b)["items"]] == ["doc changed"]
    review = got(tools, "review_changes", a=tools.a, b=tools.b)
    assert review["summary"]["overallRisk"] == "high" and review["items"][0]["impactScope"] == ["M:B", "T:A"]
    assert [x["id"] for x in got(tools, "find_breaking_changes", a=tools.a, b=tools.b)["items"]] == ["M:A.run"]
    assert got(tools, "explain_change", a=tools.a, b=tools.b, symbol="M:A.run")["items"][0]["callers"] == ["M:B"]
    assert got(tools, "diff_solution_snapshots", a=tools.a, b=tools.b)["projects"] == [{"project": "P", "status": "surviving"}]


def test_errors(tools):
    assert got(tools, "get_symbol", symbol="M:none") == {"error": "not_found", "message": "Access denied"}
    assert got(tools, "diff_snapshots", a="x", b="y")["error"] == "snapshot_not_found"
    assert got(tools, "search_symbols", query="x", kind="nokind")["error"] == "invalid_input"
    assert got(tools, "no_such_tool")["error"] == "invalid_input" and len(TOOLS) == 17


def test_ingestion_skips_what_has_not_changed(tools, tmp_path):
    (tmp_path / "Dockerfile").write_text("FROM a\nRUN dotnet build\n")
    first = got(tools, "ingest_project", path=str(tmp_path), project="D")
    assert first["status"] == "ok" and first["changes"] == {"Added": 1}
    assert got(tools, "ingest_project", path=str(tmp_path), project="D")["status"] == "skipped"
    (tmp_path / "x.sh").write_text("dotnet test\n")
    again = got(tools, "ingest_project", path=str(tmp_path), project="D")
    assert again["changes"] == {"Added": 1} and again["snapshot"] != first["snapshot"]
    assert got(tools, "ingest_project", path=str(tmp_path / "none"))["error"] == "invalid_input"


def test_limits():
    now = [0.0]
    buckets = Buckets({"query": 2, "ingestion": 1}, clock=lambda: now[0])
    assert [buckets.take("get_symbol") for _ in range(3)] == [0, 0, 60000] and buckets.take("ingest_project") == 0
    now[0] = 61
    assert buckets.take("get_symbol") == 0


def test_audit_sees_calls_that_the_limit_lets_through(tools):
    seen = []
    audited = Tools(tools.store, limits=Buckets({"query": 2, "ingestion": 1}), audit=seen.append, patterns=["symbol"])
    got(audited, "get_symbol", symbol="M:none"), got(audited, "get_diagnostic_info"), got(audited, "get_diagnostic_info")
    assert [(e["tool"], e["inputSummary"], e["success"], e["errorCode"]) for e in seen] == [("get_symbol", "[REDACTED](6)", False, "not_found"), ("get_diagnostic_info", "(no args)", True, None)]
    assert all(e["responseBytes"] > 0 and e["duration"] >= 0 for e in seen)


def test_update_sums_sources_and_solutions_forget_projects(tools, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name.upper()}.csproj").write_text("")
        (tmp_path / name / "Dockerfile").write_text("FROM x\nRUN dotnet build\n")
    lines = [f'Project("{{X}}") = "{n.upper()}", "{n}\\{n.upper()}.csproj", "{{Y}}"\n' for n in ("a", "b")]
    (tmp_path / "s.sln").write_text("".join(lines))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "x.sh").write_text("dotnet test\n")
    done = json.loads(tools.update({"primary": str(tmp_path / "s.sln"), "secondary": [{"type": "dotnet", "path": str(tmp_path / "more")}, {"type": "dotnet", "path": str(tmp_path / "none")}]}))
    assert (done["ingested"], done["skipped"], done["failed"]) == (3, 0, 1) and done["totalNodes"] == 2 * 2 + 1 and done["totalEdges"] == 2 * 2 + 1
    assert tools.store.pointed("s.sln") == done["projects"][1]["snapshot"] and tools.store.pointed("other") is None
    (tmp_path / "s.sln").write_text(lines[0])
    again = got(tools, "ingest_solution", path=str(tmp_path / "s.sln"))
    assert again["skipped"] == 1 and again["forgotten"] == ["project=B"] and again["totalNodes"] == 2
    assert json.loads(tools.update({"primary": str(tmp_path / "gone")}))["error"] == "invalid_input"


def test_lookups_of_one_hash_share_a_cache(tools):
    one = tools.store.cached(tools.a)
    assert tools.store.cached(tools.a)[0] is one[0] and one[0].storageLevel.useMemory
    assert tools.store.cached(tools.b)[0] is not one[0] and not one[0].storageLevel.useMemory
    tools.store.release()
    assert tools.store.held is None
