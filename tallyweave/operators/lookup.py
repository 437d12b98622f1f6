"""Reads of the graph: by label, by key, neighbours, hops, affected documents, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import field


def by_label(nodes: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """name and properties of a label's nodes, by name; no limit for None or 0."""
    out = nodes.where(F.col("label") == label).select("name", "properties").orderBy("name")
    return out.limit(limit) if limit else out


def node(nodes: DataFrame, label: str, name: str) -> DataFrame:
    return nodes.where((F.col("label") == label) & (F.col("name") == name))


def document_hashes(nodes: DataFrame) -> DataFrame:
    """path, content_hash of the documents that a sync has stored."""
    return nodes.where("label = 'Document' AND content_hash IS NOT NULL").select(F.col("name").alias("path"), "content_hash")


def neighbours(edges: DataFrame, name: str, label: str | None = None) -> DataFrame:
    """relation_type and the other end of every edge at a name (of any label unless one is given); a loop gives itself."""
    out, into = F.col("source_name") == name, F.col("target_name") == name
    if label:
        out, into = out & (F.col("source_label") == label), into & (F.col("target_label") == label)
    return edges.where(out | into).select("relation_type", F.when(out, F.col("target_label")).otherwise(F.col("source_label")).alias("label"), F.when(out, F.col("target_name")).otherwise(F.col("source_name")).alias("name"))


def hops(edges: DataFrame, count: int) -> DataFrame:
    """Paths of `count` directed edges as (start, end): equi-joins on both key columns."""
    step = edges.select(F.struct("source_label", "source_name").alias("a"), F.struct("target_label", "target_name").alias("b"))
    out = step
    for k in range(count - 1):
        out = out.select("a", F.col("b").alias("m")).join(step.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
    return out.select(F.col("a.source_label").alias("start_label"), F.col("a.source_name").alias("start_name"), F.col("b.target_label").alias("end_label"), F.col("b.target_name").alias("end_name"))


def reachable(edges: DataFrame) -> DataFrame:
    """Distinct (start, end) pairs over one or more directed edges, until a round adds none: every path is followed to its
    end. Only new pairs are joined again; rounds are checkpointed, so a long search keeps a short plan."""
    step = edges.select(F.concat_ws("\x1f", "source_label", "source_name").alias("a"), F.concat_ws("\x1f", "target_label", "target_name").alias("b")).distinct()
    seen = new = step
    while True:
        new = new.select(F.col("b").alias("m"), F.col("a").alias("s")).join(step.select(F.col("a").alias("m"), "b"), "m").select(F.col("s").alias("a"), "b").distinct().join(seen, ["a", "b"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        seen = seen.union(new)
    part = lambda c, k: F.element_at(F.split(c, "\x1f"), k)
    return seen.select(part("a", 1).alias("start_label"), part("a", 2).alias("start_name"), part("b", 1).alias("end_label"), part("b", 2).alias("end_name"))


def affected_documents(nodes: DataFrame, edges: DataFrame, entities: DataFrame, *, with_relation: bool = False) -> DataFrame:
    """Documents that entities (column entity) point to: entity, path, title; with_relation adds relation_type, one row each."""
    docs = nodes.where("label = 'Document'").select(F.col("label").alias("target_label"), F.col("name").alias("target_name"), field(F.col("properties"), "title").alias("title"))
    hit = edges.join(entities.select(F.col("entity").alias("source_name")).distinct(), "source_name")
    return hit.join(docs, ["target_label", "target_name"]).select(F.col("source_name").alias("entity"), F.col("target_name").alias("path"), "title", *(["relation_type"] if with_relation else [])).distinct()


def linking_documents(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with an edge to a target (column target, by name): target, path, relation_type."""
    docs = nodes.where("label = 'Document'").select(F.col("label").alias("source_label"), F.col("name").alias("source_name"))
    hit = edges.join(targets.select(F.col("target").alias("target_name")).distinct(), "target_name")
    return hit.join(docs, ["source_label", "source_name"]).select(F.col("target_name").alias("target"), F.col("source_name").alias("path"), "relation_type").distinct()


def asked_at(properties: Column, created_at: Column) -> Column:
    return F.coalesce(field(properties, "createdAt"), created_at.cast("string"))


def unanswered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Questions without an ANSWERED_BY edge, the latest first."""
    done = edges.where("source_label = 'Question' AND relation_type = 'ANSWERED_BY'").select(F.col("source_name").alias("name"))
    left = nodes.where("label = 'Question'").join(done, "name", "left_anti")
    return left.select(F.col("name").alias("question"), field(F.col("properties"), "createdAt").alias("created_at"), F.col("created_at").alias("db_created_at"), asked_at(F.col("properties"), F.col("created_at")).alias("asked_at")).orderBy(F.col("asked_at").desc_nulls_last(), "question")


def question(text: Column, created: Column) -> Column:
    """The properties of a question node."""
    return F.to_json(F.struct(text.alias("text"), created.alias("createdAt")))


def answered(pairs: DataFrame) -> DataFrame:
    """ANSWERED_BY edges of (question, document)."""
    return pairs.select(F.lit("Question").alias("source_label"), F.col("question").alias("source_name"), F.lit("ANSWERED_BY").alias("relation_type"), F.lit("Document").alias("target_label"), F.col("document").alias("target_name"), F.lit("{}").alias("properties"))


def link_answers(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """ANSWERED_BY edges of (question, document); a document that isn't a node fails the job."""
    docs = nodes.where("label = 'Document'").select(F.col("name").alias("document"), F.lit(True).alias("__ok"))
    both = pairs.join(docs, "document", "left")
    target = F.when(F.col("__ok").isNull(), F.raise_error(F.concat(F.lit("Document not found: "), F.col("document")))).otherwise(F.col("document"))
    return answered(both.select("question", target.alias("document")))
