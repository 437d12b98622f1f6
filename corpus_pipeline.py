"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents (doc_id, text, lang, source, n_chars and any
further ones), and returns a DataFrame; all but the last return those columns again. Stages judge rows, not ids, so
repeated ids keep each row's own verdict. run() writes every stage into the shared folder and reads it back, so a lost
executor costs one stage at most.

Decisions: rows that quality rules reject go; of each near-duplicate component one document stays (its least doc_id,
then its least text hash); documents with an occurrence of a benchmark window go; spans
that look like live or shared secrets are replaced by their kind in brackets and n_chars follows; widely copied examples
stay; mixing returns the selected documents with the passes they belong to. Null texts have no words and so fail the
quality rules. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import _base, decontaminate, mixing, neardup, quality, secrets


def _safe(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., and where each name went: no name of an operator's own can clash."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), {c: f"c{k}" for k, c in enumerate(docs.columns)}


def _named(df: DataFrame, names: dict[str, str], **changed: Column) -> DataFrame:
    return df.select(*(changed.get(c, F.col(k)).alias(c) for c, k in names.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither base rules nor certified cutoffs reject; the verdict rides along with its own row."""
    own, names = _safe(docs)
    judged = quality.judged(own, _base.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", names["doc_id"]), doc_id=names["doc_id"], text=names["text"], stratum=names["lang"], keep=tuple(names.values()))
    return _named(judged.where("kept"), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, similarity 0.8)."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        gone = neardup.near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids repeat: rows get ids of their own, so that each has its own links; of a component the least doc_id, then text, stays
    own, names = _safe(docs)
    own = _base.staged(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    i, t = (F.col(names[c]) for c in ("doc_id", "text"))
    found = neardup.near_duplicates(own.where(i.isNotNull()), doc_id="row", text=names["text"], size=5, percent=80)
    order = own.select("row", i.alias("i"), F.xxhash64(t).alias("h"))
    first = found.join(order.withColumnRenamed("row", "doc_id"), "doc_id").groupBy("component_id").agg(F.min(F.struct("i", "h", "doc_id")).alias("m"))
    kept = first.select(F.col("m.doc_id").alias("row"))
    return _named(own.where(i.isNull()).unionByName(own.join(kept, "row", "left_semi")), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return decontaminate.uncontaminated(docs, _base.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live and shared secrets replaced by [kind]."""
    own, names = _safe(docs)
    found = secrets.secret_spans(own, text=names["text"], keep=tuple(names.values()), owner=names["source"], repository=names["doc_id"])
    found = found.withColumn("drop", F.expr("filter(spans, x -> x.verdict != 'example')"))
    text = F.when(F.size("drop") == 0, F.col(names["text"])).otherwise(F.expr(secrets.redacted(names["text"], "drop")))
    changed = {"text": text}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.size("drop") == 0, F.col(names["n_chars"])).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return _named(found, names, **changed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected for 60 percent of what is left, with epochs and n_taken."""
    return mixing.mixed(docs, mixing.WEIGHTS, domain=F.expr(mixing.DOMAIN_SQL), fraction=0.6, max_epochs=4, seed=17, keep=("doc_id", "text", "lang", "source", "n_chars"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing", mix),
]

#: Near-duplicate classes and multi-pattern scans aren't expressible in one SQL text; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back. What a stage has staged for itself goes
    when its result is written, and so does the result before."""
    docs = _base.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with _base.scratch(spark) as mine:
            before, docs = docs, _base.staged(stage(spark, docs, sf_dir), "stage")
            mine.remove(docs.staged_at)
        _base.drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
