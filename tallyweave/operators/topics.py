"""The index of topics: READMEs one directory below docs, grouped by domain, as rows and as markdown.

Slugs and domains are sorted as people read them, by Unicode's collation: letters before case ("api", "Zeta"), accented ones beside plain
ones. Texts that collate alike go by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import escaped_cell, field, present, slug_of, slug_title, truncated_summary
from tallyweave.session import kept


def reading_order(text: str | Column, locale: str = "UNICODE") -> list[Column]:
    """Sort keys of a text in a language's order (a collation's name: UNICODE for all, de, sv, ...), then by bytes."""
    c = F.col(text) if isinstance(text, str) else text
    return [F.collate(c, locale), c]


def numbered(df: DataFrame, as_: str, *order: Column) -> DataFrame:
    """df with a row's number (from 1) in an order, without bringing all rows together: rows are dealt by ranges of the order, numbered in their
    range, and each range starts where those before it end."""
    spread = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__part")) - F.col("n"))  # a row per range
    here = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return spread.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(as_, (F.col("__before") + here).cast("int")).select(*df.columns, as_)


def grouped_as_read(df: DataFrame, text: str, locale: str = "UNICODE_CI") -> DataFrame:
    """Rows per group of texts that a collation takes for the same (case aside, by default): first (the least text in bytes), texts, rows."""
    out = df.groupBy(F.collate(F.col(text), locale).alias("__key")).agg(F.min(text).alias("first"), F.countDistinct(text).alias("texts"), F.count(F.lit(1)).alias("rows"))
    return out.drop("__key")


def topics(nodes: DataFrame) -> DataFrame:
    """slug, title, summary, domain, path of documents that are a topic's README (the name must be written README.md)."""
    p = F.col("properties")
    docs = nodes.where("label = 'Document' AND name LIKE '%/README.md'").withColumn("slug", slug_of(F.col("name"))).where("slug IS NOT NULL")
    return docs.select("slug", F.coalesce(present(field(p, "title")), slug_title(F.col("slug"))).alias("title"), F.coalesce(field(p, "summary"), F.lit("")).alias("summary"), F.coalesce(present(field(p, "domain")), F.lit("uncategorized")).alias("domain"), F.col("name").alias("path")).orderBy(*reading_order("slug"))


def by_domain(found: DataFrame) -> DataFrame:
    """One row per domain, uncategorized last: domain, display, its topics in order of slug."""
    display = F.when(F.col("domain") == "uncategorized", F.lit("Uncategorized")).otherwise(slug_title(F.col("domain")))
    one = F.struct(F.collate(F.col("slug"), "UNICODE").alias("order"), "slug", "title", "summary")
    grouped = found.groupBy("domain").agg(F.array_sort(F.collect_list(one)).alias("topics"))
    plain = F.transform("topics", lambda t: F.struct(t["slug"].alias("slug"), t["title"].alias("title"), t["summary"].alias("summary")))
    return grouped.select("domain", display.alias("display"), plain.alias("topics")).orderBy(F.col("domain") == "uncategorized", *reading_order("display"))


def markdown(found: DataFrame) -> DataFrame:
    """One row per domain: its section of the index."""
    row = lambda t: F.concat(F.lit("| ["), t["slug"], F.lit("](./"), t["slug"], F.lit("/readme) | "), escaped_cell(truncated_summary(t["summary"])), F.lit(" |"))
    g = by_domain(found)
    return g.select("domain", F.concat_ws("\n", F.concat(F.lit("## "), F.col("display")), F.lit(""), F.lit("| Topic | Description |"), F.lit("|-------|-------------|"), F.array_join(F.transform("topics", row), "\n"), F.lit("")).alias("section"))


def page(found: DataFrame, today: str) -> str:
    """The whole index page; one row per domain comes to the driver."""
    sections = [r.section for r in markdown(found).collect()]
    head = ["---", f"created: {today}", f"updated: {today}", "status: ongoing", "topic: welcome", 'summary: "Auto-generated index of all research topics organized by domain."', "---", "", "# Research Directory", ""]
    count = f"Organized collection of {found.count()} research topics. This page is auto-generated from the knowledge graph."
    return "\n".join([*head, count, "", *sections, "---", f"*Auto-generated: {today}*", ""])
