"""Doc comments of scripts, block by block."""

import pytest
from pyspark.sql import functions as F

from lodestar.sources import jsdoc


def parsed(body):
    return jsdoc.jsdoc(body)


def test_blocks_are_found_outside_strings_and_other_comments():
    source = "// /** no */\n/* no */\n/**/\n/** a */\nx = '/** no */' + \"/** \\\" no */\" + `/** ${1} \\` no\n*/`;\n/**\n * b\n */\n/** open"
    assert [(n, b.strip(" *\n")) for n, b in jsdoc.blocks(source)] == [(4, "a"), (7, "b")]
    assert list(jsdoc.blocks("")) == []


def test_tags():
    got = parsed("""
     * Summary with {@link
     * @notATag} inside.
     *
     * Second.
     * @param {{a: {b: string}}} first the first
     *   goes on
     * @param [second="x y"] the second
     * @param third
     * @typeParam U unused
     * @template T a type
     * @return first
     * @returns {string} last
     * @remarks a
     * @remarks b
     *   c
     * @example
     * one();
     * @example
     * ```ts
     * @decorator
     * two();
     * ```
     * @see A
     * @see {@link B}
     * @throws {TypeError} when
     * @exception Other then
     * @throws
     * @custom ignored
     """)
    assert got["summary"] == "Summary with {@link\n@notATag} inside.\n\nSecond."
    assert got["params"] == {"first": "the first", "second": "the second", "third": ""}
    assert got["type_params"] == {"T": "a type"}
    assert got["returns"] == "last" and got["remarks"] == "b\n  c"
    assert got["examples"] == ["```ts\n@decorator\ntwo();\n```"]
    assert got["see_also"] == ["A", "{@link B}"]
    assert got["exceptions"] == [{"type": "{TypeError}", "description": "when"}, {"type": "Other", "description": "then"}, {"type": "unknown", "description": ""}]


@pytest.mark.parametrize(("body", "want"), [(None, None), ("", None), ("  \n *\n ", None), (" a ", "a"), (" @internal", None), (" mail me@example.com ", "mail me@example.com"), (" unbalanced { brace\n * @returns x", "unbalanced { brace\n@returns x")])
def test_summaries(body, want):
    got = parsed(body)
    assert (got and got["summary"]) == want
    assert (got is None) == (body is None or not body.strip(" *\n"))


def test_columns(spark):
    df = spark.createDataFrame([(1, "/** A.\n * @param x y */ f(); /** B */"), (2, None), (3, "none")], "k int, source string")
    rows = df.select("k", F.explode(jsdoc.comments(F.col("source"))).alias("c")).select("k", "c.line", jsdoc.jsdocs(F.col("c.body")).alias("d")).collect()
    assert [(r.k, r.line, r.d.summary, r.d.params) for r in rows] == [(1, 1, "A.", {"x": "y"}), (1, 2, "B", {})]
