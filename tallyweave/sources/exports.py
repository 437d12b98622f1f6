"""Import of a property-graph dump: nodes (id, labels, properties, vector text) and edges (source id, relation, target id).

A dump is what the database answers to a query, as JSON text: [header, rows, statistics], nested arrays without types. A node's row
holds one list of pairs, ["id", n], ["labels", [...]] and ["properties", [[key, value], ...]]; an edge's row holds source id, target id,
relation and properties. Answers are read as VARIANT, so that every value keeps the type it has, and split into rows in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import present
from tallyweave.functions.vectors import bound, fixed_size, parse_vector


def answer_rows(answers: DataFrame, text: str = "value") -> DataFrame:
    """The rows of query answers (a column of JSON texts): answer (number of the text), pos (from 0) and row (VARIANT). What isn't an answer with
    rows gives none."""
    own = answers.select(F.monotonically_increasing_id().alias("answer"), F.try_parse_json(F.col(text)).alias("v"))
    rows = own.select("answer", F.expr("try_variant_get(v, '$[1]', 'array<variant>')").alias("rows"))  # null unless v is an array with rows
    return rows.select("answer", F.posexplode("rows").alias("pos", "row")).repartition("answer", "pos")


def _properties(pairs: Column) -> Column:
    """Pairs of key and value as a map; of repeated keys the last counts. Null where there are none."""
    pair = F.transform(pairs, lambda p: F.struct(F.variant_get(p, "$[0]", "string").alias("key"), F.variant_get(p, "$[1]", "variant").alias("value")))
    last = lambda own: F.filter(own, lambda x, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(bound(pair, last))


def parsed_nodes(answers: DataFrame, text: str = "value") -> DataFrame:
    """id, label (the first one; null: none), name, properties (JSON, without the vector) and vector (its text) of the nodes in raw answers."""
    pairs = answer_rows(answers, text).select(F.expr("try_variant_get(row, '$[0]', 'array<variant>')").alias("pairs"))
    of = lambda key: F.element_at(F.filter("pairs", lambda p: F.try_variant_get(p, "$[0]", "string") == key), -1)
    named = pairs.where("pairs IS NOT NULL").select(F.try_variant_get(of("id"), "$[1]", "bigint").alias("id"), F.try_variant_get(of("labels"), "$[1][0]", "string").alias("label"), F.try_variant_get(of("properties"), "$[1]", "array<variant>").alias("pairs"))
    own = named.withColumn("map", _properties(F.coalesce("pairs", F.array().cast("array<variant>"))))
    rest = F.to_json(F.map_filter("map", lambda k, _: k != "embedding"))
    return own.select(F.coalesce("id", F.lit(0)).alias("id"), "label", F.try_element_at("map", F.lit("name")).cast("string").alias("name"), rest.alias("properties"), F.try_element_at("map", F.lit("embedding")).cast("string").alias("vector"))


def parsed_edges(answers: DataFrame, text: str = "value") -> DataFrame:
    """source_id, relation, target_id and properties (JSON) of the edges in raw answers; rows of fewer than four values are left out."""
    rows = answer_rows(answers, text).select(F.expr("try_cast(row AS ARRAY<VARIANT>)").alias("r")).where("size(r) >= 4")
    at = lambda k, kind: F.try_variant_get(F.get("r", F.lit(k)), "$", kind)
    found = F.coalesce(at(3, "array<variant>"), F.array().cast("array<variant>"))
    return rows.select(at(0, "bigint").alias("source_id"), at(2, "string").alias("relation"), at(1, "bigint").alias("target_id"), F.to_json(_properties(found)).alias("properties"))


def imported_nodes(dump: DataFrame, dim: int) -> DataFrame:
    """dump: id, label, name, properties, vector. Nameless rows are left out; no label: Unknown; other lengths: no vector."""
    own = dump.where(present(F.col("name")).isNotNull())
    return own.select("id", F.coalesce(present(F.col("label")), F.lit("Unknown")).alias("label"), "name", F.coalesce("properties", F.lit("{}")).alias("properties"), fixed_size(parse_vector(F.col("vector")), dim).alias("embedding"))


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges: source_id, relation, target_id, properties -> edges by label and name; ends that aren't nodes drop the edge."""
    a = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"), F.col("name").alias("source_name"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"), F.col("name").alias("target_name"))
    return edges.join(a, "source_id").join(b, "target_id").select("source_label", "source_name", F.col("relation").alias("relation_type"), "target_label", "target_name", F.coalesce("properties", F.lit("{}")).alias("properties"))
