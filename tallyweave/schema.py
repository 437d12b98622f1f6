"""Schemas of the two relations and of document changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KEY = ["label", "name"]
EDGE_KEY = ["source_label", "source_name", "relation_type", "target_label", "target_name"]
#: Entity types and relation types: fixed values.
ENTITY_TYPES = ("Topic", "Technology", "Concept", "Tool", "Process", "Person", "Organization", "Document", "Question")
RELATION_TYPES = ("REFERENCES", "ANSWERED_BY")

NODES = T.StructType(
    [
        T.StructField("label", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("properties", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("embedding_source_hash", T.StringType()),
        T.StructField("extraction_method", T.StringType()),
    ]
)
RELATIONSHIPS = T.StructType([*(T.StructField(c, T.StringType(), False) for c in EDGE_KEY), T.StructField("properties", T.StringType()), T.StructField("created_at", T.TimestampNTZType())])
CHANGE_SQL = "path string, change_type string, reason string"
EXTRACTED_SQL = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,relation:string,target:string>>, summary string, success boolean, error string"

# ---------------------------------------------------------------- versions of the schema

#: What each version added: (version, relation, column, its value in rows of older versions as SQL). Only additions: a column that
#: is there stays.
STEPS = [
    (2, "nodes", "content_hash", "NULL"),
    (2, "nodes", "embedding_source_hash", "NULL"),
    (2, "nodes", "extraction_method", "'frontmatter'"),
]
VERSION = max(v for v, *_ in STEPS)
_WHOLE = {"nodes": NODES, "relationships": RELATIONSHIPS}


def as_of(relation: str, version: int) -> T.StructType:
    """A relation's columns in a version of the schema."""
    later = {c for v, r, c, _ in STEPS if r == relation and v > version}
    return T.StructType([f for f in _WHOLE[relation].fields if f.name not in later])


def version_of(relation: str, columns: list[str]) -> int:
    """The latest version all of whose columns are there, for data that does not say."""
    return max((v for v in range(1, VERSION + 1) if set(as_of(relation, v).names) <= set(columns)), default=1)


def migrated(df: DataFrame, relation: str, version: int) -> DataFrame:
    """df of an older version with the columns that were added since, in today's order."""
    added = {c: F.expr(value) for v, r, c, value in STEPS if r == relation and v > version}
    return shaped(df.withColumns(added) if added else df, _WHOLE[relation])


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema; missing ones are null."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
