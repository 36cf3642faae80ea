"""Queries over vectors, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors
from . import demo_graph as g
from .registered import query


def embeddings(spark, d):
    return g.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def asked(spark, d):
    """The queries: every vector whose id is divisible by 100."""
    return embeddings(spark, d).where("id % 100 = 0").withColumnRenamed("id", "query")


def shown(found):
    return found.withColumn("distance", F.round("distance", 5))


@query()
def vector_search(spark, d):
    """The ten nearest by inverted lists and codes, re-ranked exactly; recall is held by a test."""
    return shown(vectors.search(vectors.build(embeddings(spark, d)), asked(spark, d), k=10))


NEAREST = """SELECT query, id, place, round(distance, 5) AS distance FROM (SELECT q.vec_id AS query, e.vec_id AS id, {0} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {0}, e.vec_id)::INTEGER AS place
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) WHERE place <= 10"""


@query(NEAREST.format("list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"), graph_sql=False)
def vector_search_exact(spark, d):
    """The ten nearest of all vectors: lists and codes that bounds rule out are not measured."""
    return shown(vectors.search(vectors.build(embeddings(spark, d)), asked(spark, d), k=10, exact=True))


@query("SELECT query, list_count AS found, label_hits FROM (SELECT n.query, count(*) AS list_count, count(*) FILTER (a.label = b.label) AS label_hits FROM (" + NEAREST.format("list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])") + ") n JOIN embeddings a ON n.query = a.vec_id JOIN embeddings b ON n.id = b.vec_id GROUP BY n.query)", graph_sql=False)
def vector_label_agreement(spark, d):
    """How many of a vector's ten nearest have its label: the index joined back to its table."""
    labels = g.table(spark, d, "embeddings").select("vec_id", "label")
    found = vectors.search(vectors.build(embeddings(spark, d)), asked(spark, d), k=10, exact=True)
    met = found.join(labels.toDF("query", "mine"), "query").join(labels.toDF("id", "theirs"), "id")
    return met.groupBy("query").agg(F.count("*").alias("found"), F.count_if(F.col("mine") == F.col("theirs")).alias("label_hits"))
