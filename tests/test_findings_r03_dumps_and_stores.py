"""Findings of round 3: dumps are parsed once a value from texts that don't grow with the tables; change sets read their own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.plans import catalogue, further  # noqa: F401
from tallyweave.sources import exports
from tallyweave.sources.store import Store


def test_dump_values_are_read_once(spark):
    """No schema of whole answers is worked out, and the pairs of a row are taken apart in one place; of repeated keys the last counts."""
    texts = ['[["n"],[[[["id",1],["labels",["A"]],["properties",[["name","x"],["p",1],["name","y"],["q","z"],["p",2]]]]]],["t"]]', '{"a": [1]}', "no", None, '"s"', "[1]", "[1,2]"]
    nodes = exports.parsed_nodes(spark.createDataFrame([(x,) for x in texts], "value string"))
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "schemaofvariant" not in plan.lower().replace("_", "") and plan.count("slice(transform(") == 0
    assert [(r.id, r.label, r.name, r.properties) for r in nodes.collect()] == [(1, "A", "y", '{"name":"y","q":"z","p":2}')]


def test_dump_texts_stay_short(spark, tmp_path, monkeypatch):
    """Four times the customers of one nation make more texts, no longer ones; all rows arrive."""
    rows = spark.range(40_000)
    rows.select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.5).alias("c_acctbal")).write.parquet(f"file://{tmp_path}/customer.parquet")
    rows.select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(2.5).alias("o_totalprice"), F.lit("LOW").alias("o_orderpriority")).write.parquet(f"file://{tmp_path}/orders.parquet")
    longest, parse = [], {n: getattr(exports, n) for n in ("parsed_nodes", "parsed_edges")}
    for n, f in parse.items():
        monkeypatch.setattr(exports, n, lambda answers, f=f: longest.append(answers.agg(F.max(F.length("value"))).first()[0]) or f(answers))
    assert catalogue.QUERIES["dump_import"](spark, f"file://{tmp_path}").count() == 40_000
    assert len(longest) == 2 and longest[0] < 2_000_000 and longest[1] < 10_000


def test_change_sets_read_their_own_rows(spark, monkeypatch):
    """Orders are dealt to their change sets once; what a step stages doesn't go back to all of them."""
    read, staged = [], Store.staged
    monkeypatch.setattr(Store, "staged", lambda self, df: read.extend(df.inputFiles()) or staged(self, df))
    assert catalogue.QUERIES["store_changes"](spark, "/root/testdata/sf0.001").count() == 12
    assert read and not [f for f in read if f.endswith("/orders.parquet")]
