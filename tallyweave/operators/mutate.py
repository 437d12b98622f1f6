"""Keyed changes of nodes and relationships as joins over whole snapshots; the store swaps snapshots.

Nodes are joined on (label, name), relationships on their five-column key; both sides hash to the same key, so the upsert
of a batch costs one shuffle of each side. Batches must be unique by key: latest() folds a change feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import field
from tallyweave.schema import EDGE_KEY, NODE_KEY


def latest(feed: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key by `order`: one aggregation, combined before the shuffle."""
    rest = [c for c in feed.columns if c not in key]
    return feed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*key, *(F.col(f"__last.{c}").alias(c) for c in rest))


def near_nodes(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The nodes that keys (label, name) name: the slice of a graph that a change of them touches."""
    return nodes.join(keys.select(*NODE_KEY).distinct(), NODE_KEY, "left_semi").select(*nodes.columns)


def near_edges(edges: DataFrame, *, keys: DataFrame | None = None, documents: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """The edges that a change touches: those with one of the keys, those that documents (name) gave rise to, and those at an
    end (label, name). Each once. Edges are read once a kind and met by semi joins; only what was found goes on."""
    found = []
    if keys is not None:
        found.append(edges.join(keys.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_semi").select(*edges.columns))
    if documents is not None:
        found.append(_with_path(edges).join(documents.select(F.col("name").alias("__path")).distinct(), "__path", "left_semi").select(*edges.columns))
    if ends is not None:
        for end in ("source", "target"):
            own = ends.select(F.col("label").alias(f"{end}_label"), F.col("name").alias(f"{end}_name")).distinct()
            found.append(edges.join(own, [f"{end}_label", f"{end}_name"], "left_semi").select(*edges.columns))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(EDGE_KEY)


def upsert_nodes(nodes: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """batch: label, name, properties. Properties are replaced whole and updated_at moves; embedding, hashes and created_at
    survive. A null or empty name fails the job."""
    new = batch.select("label", F.when(F.nullif("name", F.lit("")).isNull(), F.raise_error("Node must have a name")).otherwise(F.col("name")).alias("name"), F.col("properties").alias("__new"), F.lit(True).alias("__in"))
    both = nodes.join(new, NODE_KEY, "full_outer")
    hit = F.coalesce("__in", F.lit(False))
    values = {"properties": F.when(hit, F.col("__new")).otherwise(F.col("properties")), "created_at": F.when(F.col("created_at").isNull() & hit, now).otherwise(F.col("created_at")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return both.select(*(values[c].alias(c) if c in values else F.col(c) for c in nodes.columns))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct (label, name) of both ends."""
    a = edges.select(F.col("source_label").alias("label"), F.col("source_name").alias("name"))
    return a.union(edges.select("target_label", "target_name")).distinct()


def stub_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, name) of ends that aren't nodes yet."""
    return endpoints(edges).join(nodes.select(*NODE_KEY), NODE_KEY, "left_anti")


def upsert_relationships(nodes: DataFrame, edges: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes with stubs ({}), and edges with the batch's properties in; created_at survives."""
    stubs = stub_nodes(nodes, batch).select("label", "name", F.lit("{}").alias("properties"), now.alias("created_at"), now.alias("updated_at"))
    grown = nodes.unionByName(stubs, allowMissingColumns=True)
    new = batch.select(*EDGE_KEY, F.col("properties").alias("__new"), F.lit(True).alias("__in"))
    both = edges.join(new, EDGE_KEY, "full_outer")
    hit = F.coalesce("__in", F.lit(False))
    values = {"properties": F.when(hit, F.col("__new")).otherwise(F.col("properties")), "created_at": F.when(F.col("created_at").isNull() & hit, now).otherwise(F.col("created_at"))}
    return grown, both.select(*(values[c].alias(c) if c in values else F.col(c) for c in edges.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes named by keys (label, name) and every edge that touches one; unknown keys change nothing."""
    keys = keys.select(*NODE_KEY).distinct()
    for end in ("source", "target"):
        gone = keys.select(F.col("label").alias(f"{end}_label"), F.col("name").alias(f"{end}_name"))
        edges = edges.join(gone, [f"{end}_label", f"{end}_name"], "left_anti")
    return nodes.join(keys, NODE_KEY, "left_anti").select(*nodes.columns), edges.select(*[c for c in edges.columns])


def delete_by_document(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the edges that a document (paths: name) gave rise to; edges without a documentPath stay.

    The path is a column before the join: a sort by an expression would parse the JSON again for every two rows it compares.
    Edges without a path are dealt by their own key, or all of them would meet in one task."""
    deal = lambda *c: F.pmod(F.xxhash64(*c), F.lit(256)).cast("int")
    gone = paths.where("name IS NOT NULL").select(F.col("name").alias("__path")).distinct().withColumn("__deal", deal("__path"))
    own = _with_path(edges).withColumn("__deal", F.when(F.col("__path").isNull(), deal(*EDGE_KEY)).otherwise(deal("__path")))
    return own.join(gone, ["__path", "__deal"], "left_anti").select(*edges.columns)


def _with_path(edges: DataFrame) -> DataFrame:
    return edges.withColumn("__path", field(F.col("properties"), "documentPath"))


def remove_documents(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provenance first, then the documents themselves; entities stay."""
    return delete_nodes(nodes, delete_by_document(edges, paths), paths.select(F.lit("Document").alias("label"), "name"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no edge touches."""
    return nodes.where("label != 'Document'").join(endpoints(edges), NODE_KEY, "left_anti")


def set_embeddings(nodes: DataFrame, batch: DataFrame, dim: int) -> DataFrame:
    """batch: label, name, embedding. Wrong lengths fail the job; updated_at stays; unknown keys change nothing."""
    checked = F.when(F.size("embedding") == dim, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit(f"embedding must have {dim} elements")).cast("array<float>"))
    new = batch.select(*NODE_KEY, checked.alias("__e"))
    both = nodes.join(new, NODE_KEY, "left")
    return both.select(*(F.coalesce("__e", "embedding").alias(c) if c == "embedding" else F.col(c) for c in nodes.columns))


def set_hashes(nodes: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """batch: name, content_hash, embedding_source_hash (null: leave). Documents only, one join for all."""
    new = batch.select(F.lit("Document").alias("label"), "name", F.col("content_hash").alias("__c"), F.col("embedding_source_hash").alias("__e"), F.lit(True).alias("__in"))
    both = nodes.join(new, NODE_KEY, "left")
    hit = F.coalesce("__in", F.lit(False))
    values = {"content_hash": F.when(hit, F.col("__c")).otherwise(F.col("content_hash")), "embedding_source_hash": F.coalesce("__e", "embedding_source_hash"), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return both.select(*(values[c].alias(c) if c in values else F.col(c) for c in nodes.columns))
