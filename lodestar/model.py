"""Schemas of a symbol graph, and the ordered enumerations of its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = (
    "struct<summary:string,remarks:string,params:map<string,string>,type_params:map<string,string>,returns:string,"
    "examples:array<string>,exceptions:array<struct<type:string,description:string>>,see_also:array<string>>"
)
SPAN = "struct<file_path:string,start_line:int,start_column:int,end_line:int,end_column:int>"
PARAMETERS = "array<struct<name:string,type_name:string,default_value:string,is_params:boolean,is_ref:boolean,is_out:boolean,is_in:boolean,is_optional:boolean>>"
CONSTRAINTS = "array<struct<type_parameter_name:string,constraints:array<string>>>"
NODES = (
    f"id string, kind string, display_name string, fqn string, previous_ids array<string>, accessibility string, docs {DOCS}, span {SPAN}, "
    f"return_type string, parameters {PARAMETERS}, generic_constraints {CONSTRAINTS}, project_origin string, node_kind string"
)
EDGES = "from_id string, to_id string, kind string, scope string"
SNAPSHOT = (
    "schema_version string, project_name string, source_fingerprint string, content_hash string, created_at timestamp, "
    "ingestion_metadata struct<run_id:string,started_at:timestamp,completed_at:timestamp,was_full:boolean,"
    "file_changes:array<struct<file_path:string,change_kind:string,affected_symbol_ids:array<string>>>>, solution_name string"
)
MANIFEST = "content_hash string, project_name string, git_commit_sha string, ingested_at timestamp, schema_version string, node_count int, edge_count int"
FILE_HASHES = "path string, sha256 string"
PROJECTS = "name string, path string, depends_on array<string>"
AUDIT = "timestamp timestamp, tool string, input_summary string, input_full string, response_bytes int, response_full string, success boolean, error_code string, duration string"

# The names and the order of the enumerations, as stored graphs have them.
KINDS = [
    "Namespace", "Type", "Method", "Property", "Field", "Event", "Parameter", "Constructor", "Delegate", "Indexer", "Operator",
    "Destructor", "EnumMember", "TypeParameter", "Tool", "BuildTarget", "BuildProperty", "BuildTask", "Script", "ScriptFunction",
    "ScriptParameter", "CIWorkflow", "CIJob", "CIStep", "DockerStage", "DockerInstruction",
]
ACCESSIBILITIES = ["Public", "Internal", "Protected", "Private", "ProtectedInternal", "PrivateProtected"]
EDGE_KINDS = ["Contains", "Inherits", "Implements", "Calls", "References", "Overrides", "Returns", "Invokes", "Configures", "DependsOn", "Triggers", "Imports"]
SCOPES = ["IntraProject", "CrossProject", "External"]
VISIBILITY = ["Private", "PrivateProtected", "Internal", "Protected", "ProtectedInternal", "Public"]
PUBLIC_SURFACE = ["Public", "Protected", "ProtectedInternal"]
DOC_KINDS = ["Type", "Method", "Property", "Constructor", "Delegate", "Event", "Field"]
CHANGE_CATEGORIES = ["Signature", "Nullability", "Constraint", "Accessibility", "Dependency", "DocComment"]


def rank(column: str | Column, names: list[str]) -> Column:
    """The place of a name in its enumeration, from 0; null for other names."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(column) if isinstance(column, str) else column), F.lit(0)) - 1


def empty_docs(summary: Column) -> Column:
    """A doc comment that has a summary and nothing else; null where the summary is null."""
    text, pairs = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    texts = F.array().cast("array<string>")
    made = F.struct(
        summary.alias("summary"), text.alias("remarks"), pairs.alias("params"), pairs.alias("type_params"), text.alias("returns"), texts.alias("examples"),
        F.array().cast("array<struct<type:string,description:string>>").alias("exceptions"), texts.alias("see_also"),
    )
    return F.when(summary.isNotNull(), made)


def normalised(nodes: DataFrame) -> DataFrame:
    """nodes in the canonical column order, with defaults for what is missing or null."""
    defaults = {
        "previous_ids": F.array().cast("array<string>"),
        "parameters": F.array().cast(PARAMETERS),
        "generic_constraints": F.array().cast(CONSTRAINTS),
        "node_kind": F.lit("Real"),
    }
    out = []
    for f in NODES_TYPE(nodes.sparkSession):
        value = F.col(f.name).cast(f.dataType) if f.name in nodes.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(value, defaults[f.name]) if f.name in defaults else value).alias(f.name))
    return nodes.select(*out)


def NODES_TYPE(spark: SparkSession):  # noqa: N802
    from pyspark.sql.types import StructType

    return StructType.fromDDL(NODES)
