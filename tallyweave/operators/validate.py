"""Checks of stored nodes: one scan, an array of failed checks per node, exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import field, has_field

_ISSUE = "struct<type:string,field:string,message:string,suggestion:string>"


def _issue(when: Column, kind: str, name: str, message: str, suggestion: str | Column) -> Column:
    s = F.lit(suggestion) if isinstance(suggestion, str) else suggestion
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(name).alias("field"), F.lit(message).alias("message"), s.alias("suggestion")))


def issues(nodes: DataFrame) -> DataFrame:
    """label, name, type (error, warning), field, message, suggestion. Broken or missing JSON is one error and ends a node's checks."""
    p = F.col("properties")
    broken = F.json_object_keys(p).isNull()
    double = _issue(has_field(p, "name"), "warning", "name", "Duplicate 'name' field in properties (already in column)", "Re-sync to remove duplicate")
    doc = [
        double,
        *(_issue(~has_field(p, f), "error", f, f"Missing required field: {f}", "Re-sync this document to populate required fields") for f in ("title", "contentHash")),
        *(_issue(~has_field(p, f), "warning", f, f"Missing recommended field: {f}", f"Add '{f}' to document frontmatter") for f in ("summary", "created", "updated", "status")),
    ]
    told = field(p, "description")
    falsy = told.isNull() | told.isin("", "0", "false")
    entity = [double, _issue(falsy, "error", "description", "Missing required field: description", F.concat(F.lit("Add description to "), F.col("label"), F.lit(" entity in frontmatter")))]
    bad = [_issue(F.lit(True), "error", "properties", "Invalid JSON in properties field", "Re-sync this document to fix corrupted data")]
    found = F.when(broken, F.array(*bad)).when(F.col("label") == "Document", F.array(*doc)).otherwise(F.array(*entity))
    return nodes.select("label", "name", F.explode(F.array_compact(found)).alias("i")).select("label", "name", "i.*")


def stats(nodes: DataFrame) -> DataFrame:
    """One row: total_nodes, documents_checked, entities_checked, errors_found, warnings_found, valid."""
    ok = F.json_object_keys("properties").isNotNull()
    totals = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(ok & (F.col("label") == "Document")).alias("documents_checked"), F.count_if(ok & (F.col("label") != "Document")).alias("entities_checked"))
    found = issues(nodes).agg(F.count_if(F.col("type") == "error").alias("errors_found"), F.count_if(F.col("type") == "warning").alias("warnings_found"))
    return totals.crossJoin(found).withColumn("valid", F.col("errors_found") == 0)  # one row each


def document(nodes: DataFrame, name: str) -> DataFrame:
    """The issues of one document; if there is none of that name, one error says so."""
    one = nodes.where((F.col("label") == "Document") & (F.col("name") == name))
    asked = nodes.sparkSession.range(1).select(F.lit("Document").alias("label"), F.lit(name).alias("name"))
    missing = asked.join(one.select("label", "name"), ["label", "name"], "left_anti").select("label", "name", F.lit("error").alias("type"), F.lit("node").alias("field"), F.lit("Document not found in graph").alias("message"), F.lit("Run sync to add this document").alias("suggestion"))
    return issues(one).unionByName(missing)
