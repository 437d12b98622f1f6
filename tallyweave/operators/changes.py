"""Change detection between documents at hand and stored hashes: one full outer join on the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons shown for a change: fixed values.
REASONS = {"new": "New document", "updated": "Content or frontmatter changed", "deleted": "File no longer exists", "unchanged": "No changes detected"}


def reasoned(df: DataFrame) -> DataFrame:
    reason = F.lit(None).cast("string")
    for kind, text in REASONS.items():
        reason = F.when(F.col("change_type") == kind, text).otherwise(reason)
    return df.withColumn("reason", reason)


def detect(current: DataFrame, stored: DataFrame, *, only: DataFrame | None = None, force: bool = False) -> DataFrame:
    """current: path, content_hash (null: unreadable); stored: path, content_hash. Gives path, change_type, reason.

    No stored row: new; a null stored hash: updated; only (column path) restricts to those paths and then finds no
    deletions; force forgets what is stored for the paths at hand. An unreadable document counts as new.
    """
    if only is not None:
        current = current.join(only.select("path").distinct(), "path", "left_semi")
    old = stored.select("path", F.col("content_hash").alias("__old"), F.lit(True).alias("__stored"))
    if force:
        old = old.join(current.select("path"), "path", "left_anti")
    now = current.select("path", F.col("content_hash").alias("__new"), F.lit(True).alias("__here"))
    both = now.join(old, "path", "left" if only is not None else "full_outer")
    kind = (
        F.when(F.col("__here").isNull(), "deleted")
        .when(F.col("__stored").isNull() | F.col("__new").isNull(), "new")
        .when(F.col("__old").isNull() | (F.col("__old") != F.col("__new")), "updated")
        .otherwise("unchanged")
    )
    return reasoned(both.select("path", kind.alias("change_type")))


def detect_by_manifest(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """As detect, but a document is unchanged only if content_hash and frontmatter_hash both are."""
    pair = lambda df: df.select("path", F.sha2(F.concat_ws("\x1f", F.coalesce("content_hash", F.lit("")), F.coalesce("frontmatter_hash", F.lit(""))), 256).alias("content_hash"))
    return detect(pair(current), pair(manifest))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("documents"))


def stale_embeddings(nodes: DataFrame) -> DataFrame:
    """Documents whose embedding is missing or was made from other content: name, needs."""
    docs = nodes.where("label = 'Document'")
    needs = F.when(F.col("embedding_source_hash").isNull(), "missing").when(~F.col("embedding_source_hash").eqNullSafe(F.col("content_hash")), "stale")
    return docs.select("name", needs.alias("needs")).where("needs IS NOT NULL")
