"""Extractor JSON whose shape is not fixed, as VARIANT values.

Files are parsed without a schema. Members of a doc comment are taken by path in whatever
form they have: throws as an object, a list of objects or texts, or one text; see and
example as a list, an object's values, or one text. Members that nobody knows are kept as
JSON. schema_of() aggregates the schema that the data have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a doc comment that have a place of their own.
KNOWN = ["summary", "remarks", "params", "typeParams", "returns", "example", "throws", "see"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc variant): a row for each JSON file; one that is no JSON has a null."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def schema_of(values: DataFrame, column: str = "doc") -> str:
    """The schema of a column's values taken together, as text."""
    return values.agg(F.schema_of_variant_agg(column).alias("s")).first().s


def text(v: Column, path: str) -> Column:
    """A text, number or truth value at a path, or another value as JSON; null where there is none."""
    return F.try_variant_get(v, path, "string")


def mapped(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def listed(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def texts(v: Column, path: str) -> Column:
    """What is at a path as a list of texts: a list's, an object's values, or one; nulls are left out."""
    plain = lambda x: F.try_variant_get(x, "$", "string")
    many = F.coalesce(F.transform(F.map_values(mapped(v, path)), plain), F.transform(listed(v, path), plain), F.array(text(v, path)))
    return F.filter(many, lambda t: t.isNotNull())


def word_and_rest(t: Column) -> Column:
    """A text's first word, without a colon behind it, as type and the rest as description."""
    first = F.regexp_extract(t, r"^\s*(\S+)", 1)
    return F.struct(F.regexp_replace(first, ":$", "").alias("type"), F.trim(F.substring(F.ltrim(t), F.length(first) + 1, F.length(t))).alias("description"))


def thrown(v: Column, path: str) -> Column:
    """(type, description) pairs at a path, whatever form they have."""
    blank = lambda t: F.coalesce(t, F.lit(""))
    pair = lambda kind, text_: F.struct(kind.alias("type"), blank(text_).alias("description"))
    of_object = F.transform(F.map_entries(mapped(v, path)), lambda e: pair(e["key"], F.try_variant_get(e["value"], "$", "string")))
    one = lambda e: F.when(mapped(e).isNotNull(), pair(F.coalesce(text(e, "$.type"), text(e, "$.name"), F.lit("unknown")), text(e, "$.description"))).otherwise(word_and_rest(text(e, "$")))
    of_list = F.transform(listed(v, path), one)
    of_text = F.when(text(v, path).isNotNull(), F.array(word_and_rest(text(v, path))))
    return F.coalesce(of_object, of_list, of_text, F.array().cast("array<struct<type:string,description:string>>"))


def pairs(v: Column, path: str) -> Column:
    """An object's members at a path as a map of texts; empty where there is no object."""
    return F.coalesce(F.transform_values(mapped(v, path), lambda _, x: F.try_variant_get(x, "$", "string")), F.create_map().cast("map<string,string>"))


def docs(v: Column) -> Column:
    """The doc comment of a variant in the shape of the model; null where it is no object."""
    made = F.struct(
        text(v, "$.summary").alias("summary"), text(v, "$.remarks").alias("remarks"), pairs(v, "$.params").alias("params"), pairs(v, "$.typeParams").alias("type_params"), text(v, "$.returns").alias("returns"),
        texts(v, "$.example").alias("examples"), thrown(v, "$.throws").alias("exceptions"), texts(v, "$.see").alias("see_also"),
    )
    return F.when(mapped(v).isNotNull(), made)


def unknown(v: Column) -> Column:
    """The members that have no place, as JSON; null where there are none."""
    rest = F.map_filter(mapped(v), lambda k, _: ~k.isin(KNOWN))
    return F.when(F.size(rest) > 0, F.to_json(rest))
