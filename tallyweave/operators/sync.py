"""One sync as one program: scan, detect, extract, fold, upsert, embed, commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text as t
from tallyweave.operators import cascade, changes, entities, lookup, mutate
from tallyweave.schema import EDGE_KEY
from tallyweave.sources import markdown
from tallyweave.sources.embedding import embedded
from tallyweave.sources.extraction import Extractor, filled
from tallyweave.sources.store import Store


def document_nodes(docs: DataFrame) -> DataFrame:
    """label, name, properties of documents; optional fields only where they aren't empty."""
    graph = lambda f: t.present(F.col(f"graph.{f}"))
    body = F.struct(F.col("title"), F.col("content_hash").alias("contentHash"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), *(t.present(F.col(c)).alias(c) for c in ("summary", "created", "updated", "status", "topic")), graph("importance").alias("importance"), graph("domain").alias("domain"))
    return docs.select(F.lit("Document").alias("label"), F.col("path").alias("name"), F.to_json(body).alias("properties"))


@dataclass
class Result:
    """counts by change type, changes, problems (path, error), impact rows, and the committed version (None: dry run)."""

    counts: dict[str, int]
    changes: DataFrame
    problems: DataFrame
    impact: DataFrame
    version: str | None = None
    nodes: DataFrame | None = dc_field(default=None, repr=False)
    relationships: DataFrame | None = dc_field(default=None, repr=False)


def _few(df: DataFrame) -> DataFrame:
    """A scan of many small files in a few tasks a core, so that what is written of it isn't as many files again."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def sync(
    spark: SparkSession, store: Store, root: str, *, embed: Callable[[DataFrame], DataFrame] | None = None, dim: int = 512, only: DataFrame | None = None, removed: DataFrame | None = None,
    force: bool = False, dry_run: bool = False, now: Column | None = None, extract: Extractor | None = None,
) -> Result:
    """Bring the graph up to the tree below root. Broken files become problem rows; the others go on. Deleted documents
    take their edges along; entities stay. A document whose previous version named other entities or relationships, or that
    is gone, is analysed for impact.

    All files are hashed; only those whose hash differs from the stored one are parsed. only: the paths to look at, then
    nothing counts as deleted but what removed names. extract: finds entities where a header names none.
    """
    now = F.lit(None).cast("timestamp_ntz") if now is None else now
    now = F.coalesce(now, F.localtimestamp())
    if removed is not None and only is not None:
        only = only.select("path").unionByName(removed.select("path")).distinct()  # one that is still there is looked at like the others
    hashed = store.staged(_few(markdown.scan(spark, root, only)).select("path", t.content_hash(F.col("content")).alias("content_hash")))
    nodes, edges = store.nodes(), store.relationships()
    tracked = lookup.document_hashes(nodes)
    found = changes.detect(hashed, tracked, only=only, force=force)
    if removed is not None:
        lost = removed.select("path").distinct().join(tracked.select("path"), "path", "left_semi").join(hashed.select("path"), "path", "left_anti")
        found = found.join(lost, "path", "left_anti").unionByName(changes.reasoned(lost.withColumn("change_type", F.lit("deleted"))))
    found = store.staged(found)
    parsed = store.staged(markdown.parsed(_few(markdown.scan(spark, root, found.where("change_type IN ('new', 'updated')")))))
    broken = markdown.errors(parsed)
    # a file that can't be read counts as new, whatever was stored of it
    found = store.staged(changes.reasoned(found.join(broken.select("path", F.lit(True).alias("__bad")), "path", "left").select("path", F.when(F.col("__bad"), "new").otherwise(F.col("change_type")).alias("change_type"))))
    work = markdown.documents(parsed)
    if extract is not None:
        work = store.staged(filled(work, extract))
    mentioned = entities.exploded(work, "entities").where("name IS NOT NULL AND type IS NOT NULL")
    declared = entities.exploded(work, "relationships")
    folded = entities.unique_entities(mentioned)
    entity_rows = folded.select(F.col("type").alias("label"), "name", F.to_json(F.struct(t.present(F.col("description")).alias("description"))).alias("properties"))
    resolved = entities.resolve(work.select("path"), mentioned, declared)
    linked = resolved.where("problem IS NULL")
    # what the last version said of the documents at hand
    before = edges.withColumn("path", t.field(F.col("properties"), "documentPath")).join(work.select("path"), "path", "left_semi")
    named = before.where("relation_type = 'APPEARS_IN'")
    old = named.select("path", F.row_number().over(_by("path", "source_label", "source_name")).alias("pos"), F.col("source_label").alias("type"), F.col("source_name").alias("name"))
    rel = lambda df: df.where("relation_type != 'APPEARS_IN'").select("path", F.col("source_name").alias("source"), F.col("relation_type").alias("relation"), F.col("target_name").alias("target"))
    gone = found.where("change_type = 'deleted'").select(F.col("path").alias("name"))
    again = named.select("path").distinct()  # documents that were there before
    impact = cascade.report(old, mentioned.select("path", "pos", "type", "name"), nodes, edges, relationships=(rel(before), rel(linked).join(again, "path", "left_semi")), gone=gone.select(F.col("name").alias("path")))
    impact = store.staged(impact)
    fresh = document_nodes(work).unionByName(entity_rows)
    batch = entities.appears_in(mentioned).unionByName(linked.drop("path", "problem")).dropDuplicates(["source_label", "source_name", "relation_type", "target_label", "target_name"])
    # the slice of the graph that all this touches, before and after
    paths, lost = work.select(F.col("path").alias("name")), gone if only is None or removed is not None else gone.limit(0)
    lost_nodes = lost.select(F.lit("Document").alias("label"), "name")
    touched = store.staged(fresh.select("label", "name").union(mutate.endpoints(batch)).union(lost_nodes).distinct())
    near, near_edges = store.staged(mutate.near_nodes(nodes, touched)), store.staged(mutate.near_edges(edges, keys=batch, documents=paths.union(lost), ends=lost_nodes))
    new_nodes = mutate.upsert_nodes(near, fresh, now)
    new_nodes = mutate.set_hashes(new_nodes, work.select(F.col("path").alias("name"), "content_hash", F.lit(None).cast("string").alias("embedding_source_hash")), now)
    new_nodes, new_edges = mutate.upsert_relationships(new_nodes, mutate.delete_by_document(near_edges, paths), batch, now)
    new_nodes, new_edges = mutate.remove_documents(new_nodes, new_edges, lost)
    failed = None
    if embed is not None:
        names = F.coalesce(F.transform("entities", lambda e: e["name"]), F.array().cast("array<string>"))
        doc_text = t.document_text(F.col("title"), F.col("topic"), F.coalesce("tags", F.array().cast("array<string>")), names, F.col("summary"), F.col("content"))
        texts = work.select(F.lit("Document").alias("label"), F.col("path").alias("name"), doc_text.alias("text")).unionByName(folded.select(F.col("type").alias("label"), "name", t.entity_text(F.col("type"), F.col("name"), F.col("description")).alias("text")))
        vectors = store.staged(embedded(texts, embed))  # a service is asked once
        if "embedding_error" in vectors.columns:
            # these keep what they had, and as their source hash stays as well they are asked for again
            failed = vectors.where("embedding_error IS NOT NULL").select(F.col("name").alias("path"), F.concat(F.lit("embedding: "), "embedding_error").alias("error"))
            vectors = vectors.where("embedding IS NOT NULL")
        new_nodes = mutate.set_embeddings(new_nodes, vectors.select("label", "name", "embedding"), dim)
        done = texts.join(vectors.select("label", "name"), ["label", "name"], "left_semi") if failed is not None else texts
        sources = done.where("label = 'Document'").select("name", F.sha2("text", 256).alias("__h"), F.lit("Document").alias("label"))
        new_nodes = new_nodes.join(sources, ["label", "name"], "left").withColumn("embedding_source_hash", F.coalesce("__h", "embedding_source_hash")).drop("__h")
    problems = broken.unionByName(resolved.where("problem IS NOT NULL").select("path", F.col("problem").alias("error")))
    problems = problems if failed is None else problems.unionByName(failed)
    counts = {r.change_type: r.documents for r in changes.summary(found).collect()}
    new_nodes, new_edges = store.staged(new_nodes), store.staged(new_edges)
    version = None if dry_run else store.apply((near, new_nodes), (near_edges, new_edges))
    whole = nodes.join(touched, ["label", "name"], "left_anti").select(*nodes.columns).unionByName(new_nodes, allowMissingColumns=True)
    rest = edges.join(near_edges.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*edges.columns)
    return Result(counts, found, problems, impact, version, whole, rest.unionByName(new_edges, allowMissingColumns=True))


def sync_in_parts(spark: SparkSession, store: Store, root: str, documents: int = 100_000, **options) -> list[Result]:
    """A large sync as commits of about `documents` changed files each: what is committed is not done again after a failure.
    The last part also removes what is gone."""
    hashed = store.staged(_few(markdown.scan(spark, root)).select("path", t.content_hash(F.col("content")).alias("content_hash")))
    tracked = lookup.document_hashes(store.nodes())
    todo = store.staged(changes.detect(hashed, tracked).where("change_type IN ('new', 'updated')").select("path"))
    parts = -(-todo.count() // documents)
    done = [sync(spark, store, root, only=todo.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k), **options) for k in range(parts - 1)]
    return [*done, sync(spark, store, root, **options)]


def _by(part: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(*order)
