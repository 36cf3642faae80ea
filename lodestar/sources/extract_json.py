"""Graph rows from an extractor's JSON: ids and doc comments take their canonical shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import normalised

ID = "struct<value:string>"
DOC = "struct<summary:string,remarks:string,params:map<string,string>,typeParams:map<string,string>,returns:string,example:string,throws:map<string,string>,see:array<string>>"
PARAMETER = "struct<name:string,typeName:string,defaultValue:string,isParams:boolean,isRef:boolean,isOut:boolean,isIn:boolean,isOptional:boolean>"
NODE = (
    f"struct<id:{ID},kind:string,displayName:string,fullyQualifiedName:string,previousIds:array<{ID}>,accessibility:string,docComment:{DOC},"
    "span:struct<filePath:string,startLine:int,startColumn:int,endLine:int,endColumn:int>,returnType:string,"
    f"parameters:array<{PARAMETER}>,genericConstraints:array<struct<typeParameterName:string,constraints:array<string>>>,projectOrigin:string,nodeKind:string>"
)
EDGE = f"struct<sourceId:{ID},targetId:{ID},from:{ID},to:{ID},kind:string,scope:string>"
SNAPSHOT = f"schemaVersion string, projectName string, sourceFingerprint string, contentHash string, createdAt string, nodes array<{NODE}>, edges array<{EDGE}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots, one row for each JSON file, with an explicit schema."""
    return spark.read.schema(SNAPSHOT).option("multiLine", "true").json(path)


def docs(c: Column) -> Column:
    """A doc comment with example, throws and see as lists."""
    texts, pairs = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    made = F.struct(
        c["summary"].alias("summary"), c["remarks"].alias("remarks"), F.coalesce(c["params"], pairs).alias("params"), F.coalesce(c["typeParams"], pairs).alias("type_params"), c["returns"].alias("returns"),
        F.when(c["example"].isNotNull(), F.array(c["example"])).otherwise(texts).alias("examples"),
        F.coalesce(F.transform(F.map_entries(c["throws"]), lambda e: F.struct(e["key"].alias("type"), F.coalesce(e["value"], F.lit("")).alias("description"))), F.array().cast("array<struct<type:string,description:string>>")).alias("exceptions"),
        F.filter(F.coalesce(c["see"], texts), lambda s: s.isNotNull()).alias("see_also"),
    )
    return F.when(c.isNotNull(), made)


def nodes(snapshots: DataFrame) -> DataFrame:
    """Canonical nodes of snapshots; what the extractor leaves out gets its default, and the project is the snapshot's."""
    n = snapshots.select("projectName", F.explode("nodes").alias("n"))
    flag = lambda p, f: F.coalesce(p[f], F.lit(False))
    parameters = F.transform("n.parameters", lambda p: F.struct(p["name"].alias("name"), p["typeName"].alias("type_name"), p["defaultValue"].alias("default_value"), *(flag(p, f).alias(a) for f, a in (("isParams", "is_params"), ("isRef", "is_ref"), ("isOut", "is_out"), ("isIn", "is_in"), ("isOptional", "is_optional")))))
    span = F.when(F.col("n.span").isNotNull(), F.struct(*(F.col(f"n.span.{a}").alias(b) for a, b in (("filePath", "file_path"), ("startLine", "start_line"), ("startColumn", "start_column"), ("endLine", "end_line"), ("endColumn", "end_column")))))
    constraints = F.transform("n.genericConstraints", lambda g: F.struct(g["typeParameterName"].alias("type_parameter_name"), g["constraints"].alias("constraints")))
    return normalised(n.select(
        F.col("n.id.value").alias("id"), "n.kind", F.col("n.displayName").alias("display_name"), F.col("n.fullyQualifiedName").alias("fqn"), F.transform("n.previousIds", lambda p: p["value"]).alias("previous_ids"),
        "n.accessibility", docs(F.col("n.docComment")).alias("docs"), span.alias("span"), F.col("n.returnType").alias("return_type"), parameters.alias("parameters"), constraints.alias("generic_constraints"),
        F.coalesce("n.projectOrigin", "projectName").alias("project_origin"), F.col("n.nodeKind").alias("node_kind"),
    ))


def edges(snapshots: DataFrame) -> DataFrame:
    e = snapshots.select(F.explode("edges").alias("e"))
    return e.select(F.coalesce("e.sourceId.value", "e.from.value").alias("from_id"), F.coalesce("e.targetId.value", "e.to.value").alias("to_id"), "e.kind", F.coalesce("e.scope", F.lit("IntraProject")).alias("scope"))
