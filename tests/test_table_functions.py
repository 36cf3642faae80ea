"""Parsers as table functions: equal to parse() on many texts."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.sources import parsers, table_functions


def texts():
    """A dozen files for each parser, of different shapes."""
    rng = random.Random(6)
    some = lambda *lines: "\n".join(x for x in lines if rng.random() < 0.75) + "\n"
    for i in range(12):
        yield f"/r/d{i}/Dockerfile{'.dev' * (i % 2)}", some("ARG V=1", f"FROM base:{i} AS a{i}", "# note", "WORKDIR /w", "RUN dotnet restore \\", "  && dotnet publish", f"FROM a{i}", "COPY --from=0 /x /y", "ENV A=b", "EXPOSE 80", 'CMD ["run"]')
        yield f"/r/s{i}/go{i}.sh", some("#!/bin/bash", f"# Does {i}.", "set -e", f"function f{i} {{", "  dotnet build p", "}", "g() { echo; }", ". ./lib.sh", "source a/b.sh", "./next.sh && dotnet test", "bash other.sh", "# end")
        yield f"/r/p{i}/go.ps1", some("<#", ".SYNOPSIS", f"Ships {i}", "#>", "param([string]$A, [int]$B = 2)", f"function Get-X{i} {{", "  param($Q)", "  & dotnet test", "}", ". .\\lib.ps1", "Import-Module Foo", "#Requires -Modules Bar")
        body = some('<PropertyGroup><A Condition="x">1</A><B>2</B></PropertyGroup>', f'<Target Name="T{i}" DependsOnTargets="A;B" />', '<Target Name="U" BeforeTargets="Build"><Exec Command="dotnet x"/></Target>', '<UsingTask TaskName="Z" AssemblyFile="z.dll" />', '<Import Project="other.props" />')
        yield f"/r/b{i}.{'targets' if i % 2 else 'props'}", f"<Project>{body}</Project>" if i % 5 else f"<Project>{body}"
        yield f"/r/t{i}/dotnet-tools.json", f'{{"version": {i}, "tools": {{' + ", ".join(f'"tool{j}": {{"version": "{j}.{i}", "commands": ["c{j}"]}}' for j in range(i % 4)) + ("}}" if i % 6 else "}")
        yield f"/r/.github/workflows/w{i}.yml", some(f"name: W{i}", "on: push") + "jobs:\n" + "".join(f"  j{j}:\n    runs-on: x\n    steps:\n    - run: dotnet build\n    - uses: a/b@v{j}\n" for j in range(1 + i % 3)) if i % 7 else "a: [b"
        yield f"/r/az{i}/azure-pipelines.yml", "trigger: [main]\n" + ("jobs:\n- job: A\n  steps:\n  - script: dotnet test\n- job: B\n  dependsOn: A\n" if i % 2 else f"steps:\n- script: echo {i}\n- task: T@{i}\n")
    yield "/r/readme.md", "none"


DOCS = [None, "", "<summary>a</summary>", "<member><summary>a b</summary><param name='x'>y</param></member>", "<member><returns>r</returns><typeparam name='T'>t</typeparam></member>", "<member><example>e</example><example/></member>", "<member><exception cref='E'>when</exception><seealso cref='S'/></member>", "<broken", "<member><remarks>see <see cref='T:A'/> now</remarks></member>", "plain", "<member/>", "<member><summary>  spaces\n here </summary></member>"]


@pytest.fixture(scope="module")
def files(spark):
    assert set(table_functions.register(spark)) >= {"parse_files", "parse_xml_doc", "parse_file", *(f"parse_{n}" for n in parsers.PARSERS)}
    df = spark.createDataFrame([(p, t, f"project{i % 5}") for i, (p, t) in enumerate(texts())], "path string, text string, project string").repartition(4)
    df.createOrReplaceTempView("some_files")
    return df


def sorted_rows(df):
    return sorted(map(repr, map(tuple, df.select(*table_functions.COLUMNS).collect())))


@pytest.mark.parametrize("name", sorted(parsers.PARSERS))
def test_each_parser_in_sql(spark, files, name):
    mine = files.where(parsers.parser_for(F.col("path")) == name)
    assert mine.select("text").distinct().count() >= 10
    want = sorted_rows(parsers.parse(mine, "/r"))
    got = spark.sql(f"SELECT r.* FROM {{files}} f, LATERAL parse_{name}(f.path, f.text, '/r') r", files=mine)
    assert sorted_rows(got) == want and want


def test_files_by_name_and_as_a_table(spark, files):
    want = sorted_rows(parsers.parse(files, "/r"))
    assert sorted_rows(spark.sql("SELECT r.* FROM some_files f, LATERAL parse_file(f.path, f.text, '/r') r")) == want
    got = spark.sql("SELECT * FROM parse_files(TABLE(SELECT * FROM some_files UNION ALL SELECT * FROM some_files) PARTITION BY (project), '/r')")
    assert got.columns == ["project", *table_functions.COLUMNS]
    assert sorted_rows(got) == want
    nulls = spark.sql("SELECT * FROM parse_files(TABLE(SELECT CAST(NULL AS string) AS path, CAST(NULL AS string) AS text, 'shell' AS parser))")
    assert nulls.count() == 0


@pytest.mark.parametrize(("table", "word"), [("SELECT path FROM some_files", "column text"), ("SELECT path, text, 1 AS kind FROM some_files", "names itself"), ("SELECT 1 AS path, text FROM some_files", "column path")])
def test_analysis_rejects_tables(spark, files, table, word):
    with pytest.raises(Exception, match=word):
        spark.sql(f"SELECT * FROM parse_files(TABLE({table}))")


def test_doc_comments(spark, files):
    df = spark.createDataFrame(list(enumerate(DOCS)), "k int, xml string")
    want = {r.k: r.d for r in df.select("k", parsers.xml_docs(F.col("xml")).alias("d")).collect() if r.d.summary is not None or r.d.params is not None}
    got = {r.k: r for r in spark.sql("SELECT f.k, r.* FROM {df} f, LATERAL parse_xml_doc(f.xml) r", df=df).collect()}
    assert set(got) == set(want) and len(got) >= 10
    assert all(tuple(got[k])[1:] == tuple(want[k]) for k in want)


def test_names_agree_with_the_column(spark, files):
    names = ["A/Dockerfile", "x.dockerfile", "dockerfile.dev", "a.SH", "b.bash", "c.ps1", "d.yaml", "e.yml", "f.props", "g.targets", "dotnet-tools.json", "x/dotnet-tools.json", "tools.json", "none", "", "a\\b\\Dockerfile"]
    df = spark.createDataFrame([(n,) for n in names], "path string").select("path", parsers.parser_for(F.col("path")).alias("p"))
    assert all(table_functions.name_of_parser(r.path) == r.p for r in df.collect())
