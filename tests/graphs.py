"""Small hand-built graphs."""

from pyspark.sql import functions as F

from lodestar.model import EDGES, NODES

NAMES = [c.strip() for c in "id kind display_name fqn previous_ids accessibility docs span return_type parameters generic_constraints project_origin node_kind".split()]


def doc(summary=None, **more):
    return {"summary": summary, "remarks": None, "params": {}, "type_params": {}, "returns": None, "examples": [], "exceptions": [], "see_also": []} | more


def param(name, type_name, default=None):
    return {"name": name, "type_name": type_name, "default_value": default, "is_params": False, "is_ref": False, "is_out": False, "is_in": False, "is_optional": False}


def node(id_, kind="Method", access="Public", returns="string", params=(), limits=(), docs=None, project="P", node_kind="Real", previous=(), path=None, name=None, fqn=None):
    span = None if path is None else {"file_path": path, "start_line": 1, "start_column": 0, "end_line": 2, "end_column": 0}
    constraints = [{"type_parameter_name": t, "constraints": list(c)} for t, c in limits]
    return dict(zip(NAMES, (id_, kind, name or id_.split(".")[-1], fqn or id_, list(previous), access, docs, span, returns, list(params), constraints, project, node_kind)))


def nodes(spark, *rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "IntraProject")[:4] if len(r) == 3 else r for r in rows], EDGES)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(F.col(column)).collect())
