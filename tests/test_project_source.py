"""The data source against discovery and scans of the driver."""

import os
import time

import pytest

from lodestar.sources import files, project_source


@pytest.fixture
def tree(tmp_path):
    def put(path, text="x"):
        at = tmp_path / "src" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
        os.utime(at, (1_700_000_000, 1_700_000_000))

    for p in ("App/App.csproj", "App/bin/App.xml", "App/Main.cs", "App.Tests/App.Tests.csproj", "App.Tests/T.cs", "Lib/Lib.csproj", "Lib/deep/er/Lib.xml", "Lib/other.xml", "readme.md", "Lib/deep/a.cs", "z/y/x/w/v.cs"):
        put(p, f"text of {p}")
    return tmp_path / "src", put


def by_role(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.role, set()).add(r.path)
    return out


@pytest.mark.parametrize("parts", [1, 3, 64])
@pytest.mark.parametrize("solution", [False, True])
def test_rows_are_those_of_discover_and_scan(spark, tree, parts, solution):
    root, put = tree
    if solution:
        put("All.sln", 'Project("{1}") = "App", "App\\App.csproj", "{2}"\nProject("{1}") = "App.Tests", "App.Tests\\App.Tests.csproj", "{3}"\n')
    project_source.register(spark)
    df = spark.read.format("symbol_project").option("parts", parts).load(str(root))
    want = files.discover(str(root))
    roles = by_role(df)
    assert roles.get("project", set()) == set(want.projects)
    assert roles.get("solution", set()) == set(want.solutions)
    assert roles.get("xml_doc", set()) == set(want.xml_docs)
    scan = {(r.path.removeprefix("file:"), r.sha256, r.length, r.modified) for r in files.scan(spark, str(root)).collect()}
    assert {(r.path, r.sha256, r.length, r.modified) for r in df.collect()} == scan
    assert df.rdd.getNumPartitions() <= parts


def test_filters_are_taken_over(spark, tree):
    root, _ = tree
    project_source.register(spark)
    df = spark.read.format("symbol_project").load(str(root))
    below = df.where(df.path.startswith(f"{root}/Lib/deep"))
    assert {os.path.basename(r.path) for r in below.collect()} == {"a.cs", "Lib.xml"}
    assert df.where(df.path == f"{root}/readme.md").count() == 1
    assert df.where(df.path.isin(f"{root}/readme.md", f"{root}/App/Main.cs", "none")).count() == 2
    assert df.where("role = 'project'").count() == 2
    assert df.where("role is null").count() == df.count() - 4
    reader = project_source.ProjectReader({"path": str(root), "parts": "2"})
    assert list(reader.pushFilters([project_source.StringStartsWith(("path",), f"{root}/z/"), project_source.EqualTo(("length",), 3)])) == [project_source.EqualTo(("length",), 3)]
    walked = {f for p in reader.partitions() for f, _ in p.folders}
    assert walked and not any("Lib" in f or "App" in f for f in walked)


def test_missing_folders_and_several_solutions(spark, tree, tmp_path):
    root, put = tree
    put("A.sln"), put("B.sln")
    project_source.register(spark)
    for path, word in ((str(root), "several solutions"), (str(tmp_path / "none"), "no folder")):
        with pytest.raises(Exception, match=word):
            spark.read.format("symbol_project").load(path).count()


def test_stream_restarts_where_it_stopped(spark, tree, tmp_path):
    root, put = tree
    project_source.register(spark)

    def run():
        df = spark.readStream.format("symbol_project").option("settle", 0).load(str(root))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return [os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    first = run()
    assert sorted(first) == sorted(os.path.basename(r.path) for r in files.scan(spark, str(root)).collect())
    assert sorted(run()) == sorted(first)
    at = root / "Lib" / "deep" / "new.cs"
    at.write_text("new")
    time.sleep(0.05)
    assert sorted(run()) == sorted([*first, "new.cs"])
