"""Queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decontaminate, filteraudit, infill, jaccardjoin, langid, linededup, mixing, prefixhash, repeats, simhash, suffixtree, toxicity
from .textops import table


def op1_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op3_lines(spark, sf_dir):
    report = linededup.dedup(table(spark, sf_dir, "documents"), threshold=0.8, report=True)
    return report.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op4_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_suffixtree(spark, sf_dir):
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op6_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op7_chat(spark, sf_dir):
    return chat.digest(chat.format_rows(chat.probe(table(spark, sf_dir, "conversations"))))


def op8_decontaminate(spark, sf_dir):
    labelled = decontaminate.label(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return labelled.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op9_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op10_prefixhash(spark, sf_dir):
    return prefixhash.fingerprints(table(spark, sf_dir, "documents"))


def op11_infill(spark, sf_dir):
    return infill.digest(table(spark, sf_dir, "documents"))


def op12_filteraudit(spark, sf_dir):
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_jaccardjoin(spark, sf_dir):
    return jaccardjoin.similar_documents(table(spark, sf_dir, "documents"), shingle=4, percent=85)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_lines, op4_language, op5_suffixtree, op6_repeats, op7_chat, op8_decontaminate, op9_mixing, op10_prefixhash, op11_infill, op12_filteraudit, op13_jaccardjoin)} | {"pipeline": corpus_pipeline.run}
ORACLE = {"op3_lines": linededup.ORACLE_SQL, "op7_chat": chat.ORACLE_SQL, "op8_decontaminate": decontaminate.oracle_sql(), "op9_mixing": mixing.ORACLE_SQL, "op11_infill": infill.ORACLE_SQL, "op12_filteraudit": filteraudit.ORACLE_SQL, "op13_jaccardjoin": jaccardjoin.ORACLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
