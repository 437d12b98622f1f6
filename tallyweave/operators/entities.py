"""Extracted entities and relationships: folding, indexes, ontology, resolution, validation.

Inputs are exploded: entities (path, pos, type, name, description) and relationships (path, pos, source, relation, target),
where (path, pos) is the order in which they were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import present


def exploded(docs: DataFrame, field: str) -> DataFrame:
    """path, pos and the fields of an array of structs."""
    return docs.select("path", F.posexplode(field).alias("pos", "x")).select("path", "pos", "x.*")


def unique_entities(entities: DataFrame) -> DataFrame:
    """One row per (type, name): the longest description (of equals the first found; empty never wins) and the documents,
    in order and as often as they name it. max_by folds before the shuffle."""
    order = F.struct("path", "pos")
    rank = F.when(present(F.col("description")).isNotNull(), F.struct(F.length("description").alias("n"), F.lit(0).alias("z")))
    first = entities.groupBy("type", "name", "description").agg(F.min(order).alias("o"), F.collect_list(order).alias("ps"), F.max(rank).alias("r"))
    best = F.min_by("description", F.when(F.col("r").isNotNull(), F.struct((-F.col("r.n")).alias("n"), F.col("o"))))
    return first.groupBy("type", "name").agg(best.alias("description"), F.transform(F.array_sort(F.flatten(F.collect_list("ps"))), lambda x: x["path"]).alias("paths"))


def entity_index(entities: DataFrame) -> DataFrame:
    """name -> sorted documents that define it."""
    return entities.select("name", "path").distinct().groupBy("name").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def examples(entities: DataFrame) -> DataFrame:
    """Per name alone: the type found first, the documents in order, their number, and where it was found first."""
    order = F.struct("path", "pos")
    per = entities.groupBy("name", "path").agg(F.min("pos").alias("pos"), F.min_by("type", "pos").alias("type"))
    return per.groupBy("name").agg(F.min_by("type", order).alias("type"), F.array_sort(F.collect_list("path")).alias("paths"), F.count(F.lit(1)).alias("documents"), F.min(order).alias("first"))


def top_entities(entities: DataFrame, count: int = 10) -> DataFrame:
    """Most documents first; ties in the order of first finding."""
    per = entities.groupBy("name", "path").agg(F.min("pos").alias("pos"), F.min_by("type", "pos").alias("type"))
    order = F.struct("path", "pos")
    return per.groupBy("name").agg(F.min_by("type", order).alias("type"), F.count(F.lit(1)).alias("documents"), F.min(order).alias("first")).orderBy(F.desc("documents"), "first").limit(count).drop("first")


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("entities"))


def relation_counts(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("relation").agg(F.count(F.lit(1)).alias("relationships"))


def ontology(paths: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: sorted types, totals, documents with and without entities."""
    types = entities.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("entity_types"))
    relations = relationships.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.array_sort(F.collect_list("relation")), ",").alias("relationship_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_relationships"))
    names = entities.select("name").distinct().agg(F.count(F.lit(1)).alias("total_entities"))
    found = entities.select("path").distinct()
    docs = paths.select("path").distinct().join(found.withColumn("x", F.lit(1)), "path", "left").agg(F.count("x").alias("documents_with_entities"), F.count_if(F.col("x").isNull()).alias("documents_without_entities"))
    return types.crossJoin(relations).crossJoin(names).crossJoin(docs)  # one row each


def _types(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """Per document: name -> type, the last one found; the document itself is a Document unless an entity bears its path."""
    own = entities.groupBy("path", "name").agg(F.max_by("type", "pos").alias("type"))
    self_ = paths.select("path", F.col("path").alias("name"), F.lit("Document").alias("type"))
    return own.unionByName(self_.join(own.select("path", "name"), ["path", "name"], "left_anti"))


def provenance(path: Column) -> Column:
    return F.to_json(F.struct(path.alias("documentPath")))


def appears_in(entities: DataFrame) -> DataFrame:
    """An edge from every distinct entity of a document to it."""
    one = entities.select("path", "type", "name").distinct()
    return one.select(F.col("type").alias("source_label"), F.col("name").alias("source_name"), F.lit("APPEARS_IN").alias("relation_type"), F.lit("Document").alias("target_label"), F.col("path").alias("target_name"), provenance(F.col("path")).alias("properties"))


def resolve(paths: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges of declared relationships and, in column problem, why the others were dropped.

    A source this is the document and needs a known target; a target ending in .md is a document and needs a known source;
    else both ends must be known in the document.
    """
    known = _types(entities, paths)
    rels = relationships.withColumn("__this", F.col("source") == "this").withColumn("__md", ~F.col("__this") & F.col("target").endswith(".md"))
    a = known.select("path", F.col("name").alias("source"), F.col("type").alias("__st"))
    b = known.select("path", F.col("name").alias("target"), F.col("type").alias("__tt"))
    both = rels.join(a, ["path", "source"], "left").join(b, ["path", "target"], "left")
    source_ok, target_ok = F.col("__this") | F.col("__st").isNotNull(), F.col("__md") | F.col("__tt").isNotNull()
    problem = F.when(~source_ok, F.concat(F.lit('Unknown source entity "'), F.col("source"), F.lit('"'))).when(~target_ok, F.concat(F.lit('Unknown target entity "'), F.col("target"), F.lit('"')))
    return both.select(
        "path",
        F.when(F.col("__this"), "Document").otherwise(F.col("__st")).alias("source_label"),
        F.when(F.col("__this"), F.col("path")).otherwise(F.col("source")).alias("source_name"),
        F.col("relation").alias("relation_type"),
        F.when(F.col("__md"), "Document").otherwise(F.col("__tt")).alias("target_label"),
        F.col("target").alias("target_name"),
        provenance(F.col("path")).alias("properties"),
        problem.alias("problem"),
    )


#: Fields a document must have; title and summary must not be blank either.
REQUIRED = ("title", "summary", "created", "updated", "status")


def document_errors(docs: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """path, error: missing fields, and relationship ends that no document defines (paths and own path allowed)."""
    missing = lambda f: F.coalesce(F.trim(f) if f in ("title", "summary") else F.col(f), F.lit("")) == ""
    fields = docs.select("path", F.explode(F.array_compact(F.array(*(F.when(missing(f), F.lit(f"Missing required field: {f}")) for f in REQUIRED)))).alias("error"))
    names = entities.select("name").distinct()
    bad_source = relationships.where("source != path").join(names.withColumnRenamed("name", "source"), "source", "left_anti").select("path", F.concat(F.lit('Relationship source "'), F.col("source"), F.lit('" not found in any document')).alias("error"))
    bad_target = relationships.where("target != path AND NOT endswith(target, '.md')").join(names.withColumnRenamed("name", "target"), "target", "left_anti").select("path", F.concat(F.lit('Relationship target "'), F.col("target"), F.lit('" not found as entity')).alias("error"))
    return fields.unionByName(bad_source).unionByName(bad_target)


def extraction_errors(entities: Column, relationships: Column, *, this_as_target: bool = False) -> Column:
    """array<string>: ends of a result's relationships that its entities don't name; this may be a source (and, if asked, a target)."""
    names = F.transform(entities, lambda e: e["name"])
    source = lambda r: F.when((r["source"] != "this") & ~F.array_contains(names, r["source"]), F.concat(F.lit('Relationship source "'), r["source"], F.lit('" not found in extracted entities')))
    ok = lambda r: F.array_contains(names, r["target"]) | ((r["target"] == "this") if this_as_target else F.lit(False))
    target = lambda r: F.when(~ok(r), F.concat(F.lit('Relationship target "'), r["target"], F.lit('" not found in extracted entities')))
    return F.array_compact(F.flatten(F.transform(F.coalesce(relationships, F.array().cast(_REL)), lambda r: F.array(source(r), target(r)))))


_REL = "array<struct<source:string,relation:string,target:string>>"


def this_to_path(relationships: Column, path: Column) -> Column:
    """Relationships whose source this is replaced by the document's path."""
    return F.transform(relationships, lambda r: F.struct(F.when(r["source"] == "this", path).otherwise(r["source"]).alias("source"), r["relation"].alias("relation"), r["target"].alias("target")))
