"""Questions as nodes: asked, answered by documents, created where a link needs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text as t
from tallyweave.operators import lookup, mutate
from tallyweave.sources.embedding import embedded


def _created(nodes: DataFrame, names: DataFrame, now: Column, embed: Callable[[DataFrame], DataFrame] | None, dim: int) -> DataFrame:
    """nodes with a Question for every name (column question) and its embedding; one that is there is asked anew."""
    one = names.where(F.trim(F.coalesce("question", F.lit(""))) != "").select("question").distinct()
    rows = one.select(F.lit("Question").alias("label"), F.col("question").alias("name"), lookup.question(F.col("question"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("properties"))
    out = mutate.upsert_nodes(nodes, rows, now)
    if embed is None:
        return out
    vectors = embedded(one.select(F.lit("Question").alias("label"), F.col("question").alias("name"), t.question_text(F.col("question")).alias("text")), embed)
    return mutate.set_embeddings(out, vectors.select("label", "name", "embedding"), dim)


def ask(nodes: DataFrame, edges: DataFrame, asked: DataFrame, now: Column, *, embed: Callable[[DataFrame], DataFrame] | None = None, dim: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """asked: question and, where it is known, document. (nodes, edges, problems): every question becomes a node and is
    linked to its document; one that isn't in the graph is a problem (question, document), and the question stays."""
    out = _created(nodes, asked, now, embed, dim)
    known = nodes.where("label = 'Document'").select(F.col("name").alias("document"))
    wanted = asked.where("document IS NOT NULL AND trim(question) != ''").select("question", "document").distinct()
    out, edges = mutate.upsert_relationships(out, edges, lookup.answered(wanted.join(known, "document", "left_semi")), now)
    return out, edges, wanted.join(known, "document", "left_anti").select("question", "document")


def link(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, now: Column, *, embed: Callable[[DataFrame], DataFrame] | None = None, dim: int = 512) -> tuple[DataFrame, DataFrame]:
    """pairs: question, document. Questions that aren't there are created first; a document that isn't fails the job."""
    there = nodes.where("label = 'Question'").select(F.col("name").alias("question"))
    out = _created(nodes, pairs.join(there, "question", "left_anti"), now, embed, dim)
    return mutate.upsert_relationships(out, edges, lookup.link_answers(nodes, pairs.select("question", "document").distinct()), now)
