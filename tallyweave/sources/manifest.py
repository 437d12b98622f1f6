"""The manifest of an earlier kind of sync: per path the hashes and counts of its last version, as rows.

A manifest is read from one JSON document (version, lastSync, documents by path) or from the rows that `save` writes, one
JSON object a line, so that it can have as many entries as there are documents. A missing or broken one is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import file_system, kept

_ENTRY = "contentHash string, frontmatterHash string, lastSynced string, entityCount int, relationshipCount int"
ROWS = "path string, content_hash string, frontmatter_hash string, last_synced string, entity_count int, relationship_count int"


def load(spark: SparkSession, path: str) -> DataFrame:
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], ROWS)
    if fs.getFileStatus(p).isDirectory():
        return spark.read.schema(ROWS).json(path)
    kind = ", ".join(f"{x.split()[0]}:{x.split()[1]}" for x in _ENTRY.split(", "))
    whole = spark.read.schema(f"version string, lastSync string, documents map<string,struct<{kind}>>, _corrupt_record string").json(path, multiLine=True)
    rows = kept(whole, "manifest").where("_corrupt_record IS NULL AND version IS NOT NULL AND lastSync IS NOT NULL").select(F.explode("documents").alias("path", "d"))
    return rows.select("path", *(F.col(f"d.{a.split()[0]}").alias(b.split()[0]) for a, b in zip(_ENTRY.split(", "), ROWS.split(", ")[1:], strict=True)))


def save(entries: DataFrame, path: str) -> None:
    """Replace what stands at path; entries may have been read from there."""
    kept(entries, "manifest").write.mode("overwrite").json(path)


def document(entries: DataFrame, now: Column) -> DataFrame:
    """The manifest as one JSON document, for tools that read that form: one row, so for small trees only."""
    entry = F.struct(*(F.col(b.split()[0]).alias(a.split()[0]) for a, b in zip(_ENTRY.split(", "), ROWS.split(", ")[1:], strict=True)))
    both = entries.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", entry)))).alias("documents"))
    return both.select(F.to_json(F.struct(F.lit("1.0").alias("version"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("lastSync"), "documents")).alias("json"))


def updated(entries: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """entries with those of docs (path, hashes, counts) added or replaced."""
    rest = entries.join(docs.select("path"), "path", "left_anti")
    return rest.unionByName(docs.select("path", "content_hash", "frontmatter_hash", now.cast("string").alias("last_synced"), F.col("entity_count").cast("int").alias("entity_count"), F.col("relationship_count").cast("int").alias("relationship_count")))


def removed(entries: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """entries without those of paths; without any if none are named."""
    return entries.limit(0) if paths is None else entries.join(paths.select("path"), "path", "left_anti")
