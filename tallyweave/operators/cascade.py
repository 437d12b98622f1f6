"""What a new version of a document does to others: renamed, deleted and retyped entities and the documents they touch.

Versions are exploded entities (path, pos, type, name). Pairing is by position within one document and type, in parallel
over all documents: both versions are dealt by path once, and every comparison is made where a document's rows lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import trigger_label
from tallyweave.operators import lookup
from tallyweave.session import kept


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (path, type, name) of either version: gone, came, k (place among those of its type that left, or joined),
    other (the name it is paired with), renamed, and of its name in the whole document old_type, new_type and first (one row
    of each name). Everything is worked out on one shuffle, by path."""
    side = lambda df, k: df.select("path", "type", "name", "pos", F.lit(k).alias("side"))
    both = side(old, 0).unionByName(side(new, 1)).repartition("path")
    at = lambda k: F.when(F.col("side") == k, F.col("pos"))
    one = both.groupBy("path", "type", "name").agg(F.min(at(0)).alias("o"), F.min(at(1)).alias("n"), F.max(at(1)).alias("last"))
    one = one.withColumns({"gone": F.col("n").isNull(), "came": F.col("o").isNull()})
    moved = F.col("gone") | F.col("came")
    turn = Window.partitionBy("path", "type", "gone", "came").orderBy(F.coalesce("o", "n"), "name")
    one = one.withColumn("k", F.when(moved, F.row_number().over(turn)))
    pair = Window.partitionBy("path", "type", "k")
    two = one.withColumn("other", F.when(moved, F.max(F.when(F.col("came"), F.col("name"))).over(pair))).withColumn("renamed", F.col("gone") & F.col("other").isNotNull())
    name = Window.partitionBy("path", "name")
    return two.withColumns(
        {
            "old_type": F.min(F.when(F.col("o").isNotNull(), F.struct("o", "type"))).over(name)["type"],
            "new_type": F.max(F.when(F.col("n").isNotNull(), F.struct("last", "type"))).over(name)["type"],
            "away": F.max("renamed").over(name),
            "first": F.row_number().over(name.orderBy("type")) == 1,
        }
    )


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, type, old_name, new_name: the i-th name that left a type is paired with the i-th that joined it."""
    return compared(old, new).where("renamed").select("path", "type", F.col("name").alias("old_name"), F.col("other").alias("new_name"))


def deletions(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, type, name: names that no type of the new version has and that weren't renamed away."""
    return compared(old, new).where("first AND new_type IS NULL AND NOT away").select("path", F.col("old_type").alias("type"), "name")


def type_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, name, old_type, new_type; of repeated names the last of the new version and the first of the old one count."""
    return compared(old, new).where("first AND old_type != new_type").select("path", "name", "old_type", "new_type")


def relationship_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, entity: ends of the relationships (path, source, relation, target) that only one of the versions has."""
    key = ["path", "source", "relation", "target"]
    both = old.select(*key, F.lit(0).alias("side")).unionByName(new.select(*key, F.lit(1).alias("side"))).repartition("path")
    moved = both.groupBy(*key).agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a = b")
    return moved.select("path", F.explode(F.array("source", "target")).alias("entity")).where("entity IS NOT NULL AND entity != path AND entity != 'this'").distinct()


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


#: Per trigger: its reason (of entity, old_type, new_type), the suggested action and the confidence. Fixed values.
TRIGGERS = {
    "entity_renamed": (lambda: _text('References "', F.col("entity"), '" in entities'), "update_reference", "high"),
    "entity_deleted": (lambda: _text('References deleted entity "', F.col("entity"), '"'), "review_content", "high"),
    "entity_type_changed": (lambda: _text('References "', F.col("entity"), '" with type "', F.col("old_type"), '" (now "', F.col("new_type"), '")'), "review_content", "medium"),
    "relationship_changed": (lambda: _text('Has relationship with "', F.col("entity"), '"'), "review_content", "medium"),
}


def entity_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, trigger, entity, old_type, new_type of renamed, deleted and retyped entities, all from one comparison."""
    of = lambda test, trigger: F.when(F.expr(test), F.lit(trigger))
    kinds = F.array_compact(F.array(of("renamed", "entity_renamed"), of("first AND new_type IS NULL AND NOT away", "entity_deleted"), of("first AND old_type != new_type", "entity_type_changed")))
    return compared(old, new).select("path", F.explode(kinds).alias("trigger"), F.col("name").alias("entity"), "old_type", "new_type").distinct()


def report(old: DataFrame, new: DataFrame, nodes: DataFrame, edges: DataFrame, *, relationships: tuple[DataFrame, DataFrame] | None = None, gone: DataFrame | None = None) -> DataFrame:
    """One row per change and affected document (never the changed one itself): path, trigger, entity, affected, reason,
    action, confidence. relationships: those of the old and of the new versions; gone: paths of deleted documents.
    Edges are first cut down to those of changed names, by a semi join; changes are kept as a table, as they are read twice."""
    changes = entity_changes(old, new)
    if relationships is not None:
        changes = changes.unionByName(relationship_changes(*relationships).withColumn("trigger", F.lit("relationship_changed")), allowMissingColumns=True)
    changes = kept(changes, "changes")
    # only edges of changed names go on, and only documents at these are looked for
    names = changes.select(F.col("entity").alias("source_name")).distinct()
    near = edges.where("target_label = 'Document'").join(names, "source_name", "left_semi").select("source_name", "target_name").distinct()
    docs = nodes.where("label = 'Document'").select(F.col("name").alias("target_name"))
    hit = near.join(docs, "target_name", "left_semi").select(F.col("source_name").alias("entity"), F.col("target_name").alias("affected"))
    both = changes.join(hit, "entity").where("affected != path")

    def told(k: int) -> Column:
        out = F.lit(None).cast("string")
        for name, parts in TRIGGERS.items():
            out = F.when(F.col("trigger") == name, parts[k]() if k == 0 else F.lit(parts[k])).otherwise(out)
        return out

    out = both.select("path", "trigger", "entity", "affected", told(0).alias("reason"), told(1).alias("action"), told(2).alias("confidence"))
    return out if gone is None else out.unionByName(deletion_impact(nodes, edges, gone))


def deletion_impact(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Documents that link to deleted ones (column path); run before the edges go."""
    hit = lookup.linking_documents(nodes, edges, paths.select(F.col("path").alias("target"))).where("path != target").select("target", "path").distinct()
    return hit.select(F.col("target").alias("path"), F.lit("document_deleted").alias("trigger"), F.lit(None).cast("string").alias("entity"), F.col("path").alias("affected"), _text('Links to deleted document "', F.col("target"), '"').alias("reason"), F.lit("remove_reference").alias("action"), F.lit("high").alias("confidence"))


def by_trigger(impact: DataFrame) -> DataFrame:
    return impact.groupBy("trigger").agg(F.count(F.lit(1)).alias("warnings"), F.countDistinct("affected").alias("documents"))


def totals(old: DataFrame, new: DataFrame, nodes: DataFrame, edges: DataFrame, *, relationships: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """by_trigger(report(...)) without its rows, which are as many as an entity has changes times documents.

    Changes and edges meet by document and entity as one row; its triggers are bits. What a row adds follows from two numbers of its entity:
    a change warns all documents that name it but its own, and a document is affected where a change of what it names lies in another one."""
    bits = {name: 1 << k for k, name in enumerate(TRIGGERS)}
    bit = F.coalesce(*(F.when(F.col("trigger") == name, F.lit(b)) for name, b in bits.items()))
    changes = entity_changes(old, new).select("path", "entity", bit.alias("bits"))
    if relationships is not None:
        changes = changes.unionByName(relationship_changes(*relationships).select("path", "entity", F.lit(bits["relationship_changed"]).alias("bits")))
    docs = nodes.where("label = 'Document'").select(F.col("name").alias("path"))
    named = edges.where("target_label = 'Document'").select(F.col("target_name").alias("path"), F.col("source_name").alias("entity")).join(docs, "path", "left_semi")
    both = changes.withColumn("edge", F.lit(0)).unionByName(named.withColumns({"bits": F.lit(0), "edge": F.lit(1)})).where("path IS NOT NULL AND entity IS NOT NULL")
    one = both.groupBy("path", "entity").agg(F.bit_or("bits").alias("bits"), F.max("edge").alias("edge"))
    of = Window.partitionBy("entity")
    has = lambda b, c="bits": F.col(c).bitwiseAND(b) != 0
    far = one.withColumns({"all": F.sum("edge").over(of), **{f"n{b}": F.count_if(has(b)).over(of) for b in bits.values()}})
    hit = [F.when((F.col("edge") == 1) & (F.col(f"n{b}") > has(b).cast("int")), b).otherwise(0) for b in bits.values()]
    far = far.select("path", sum(hit[1:], hit[0]).alias("hit"), *(F.when(has(b), F.col("all") - F.col("edge")).otherwise(0).alias(f"w{b}") for b in bits.values()))
    each = far.groupBy("path").agg(F.bit_or("hit").alias("hit"), *(F.sum(f"w{b}").alias(f"w{b}") for b in bits.values()))
    whole = each.agg(F.array(*(F.struct(F.lit(name).alias("trigger"), F.sum(f"w{b}").alias("warnings"), F.count_if(has(b, "hit")).alias("documents")) for name, b in bits.items())).alias("of"))
    return whole.select(F.inline("of")).where("warnings > 0")


def rendered(impact: DataFrame) -> list[str]:
    """A report's lines, for the driver to print: one per trigger and per affected document (a report is read by people)."""
    lines, last = [], None
    for r in impact.withColumn("shown", trigger_label(F.col("trigger"))).orderBy("trigger", "path", "entity", "affected").toLocalIterator():
        if r.trigger != last:
            last = r.trigger
            lines.append(r.shown)
        lines.append(f"  {r.affected}: {r.reason} [{r.action}, {r.confidence}]")
    return lines
