"""Changes beside a base: reads, costs, folding, other versions and writers, and bases of an older schema."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyweave import schema
from tallyweave.operators import cascade, mutate
from tallyweave.schema import EDGE_KEY, NODE_KEY
from tallyweave.sources import sinks
from tallyweave.sources.store import Store



def now():
    return F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'")


EDGE_SQL = "source_label string, source_name string, relation_type string, target_label string, target_name string, properties string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/graph")


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "label string, name string, properties string")


def state(store):
    return {(r.label, r.name): r.properties for r in store.nodes().collect()}, {tuple(r[c] for c in EDGE_KEY): r.properties for r in store.relationships().collect()}


def upsert(store, rows):
    batch = nodes_of(store.spark, rows)
    near = store.staged(mutate.near_nodes(store.nodes(), batch))
    return store.apply((near, mutate.upsert_nodes(near, batch, now())))


def test_random_changes_read_like_a_plain_dict(spark, store):
    r = random.Random(1)
    plain_n, plain_e = {}, {}
    key = lambda: (r.choice("AB"), f"n{r.randrange(25)}")
    for turn in range(7):
        put = {key(): f'{{"t":{turn}}}' for _ in range(r.randrange(1, 9))}
        tie = {(*key(), "REFERENCES", *key()): f'{{"e":{turn}}}' for _ in range(r.randrange(1, 6))}
        drop = {key() for _ in range(r.randrange(4))}
        batch, edges = nodes_of(spark, [(*k, p) for k, p in put.items()]), spark.createDataFrame([(*k, p) for k, p in tie.items()], EDGE_SQL)
        gone = spark.createDataFrame(sorted(drop), "label string, name string") if drop else spark.createDataFrame([], "label string, name string")
        touched = batch.select(*NODE_KEY).union(mutate.endpoints(edges)).union(gone)
        near, near_e = store.staged(mutate.near_nodes(store.nodes(), touched)), store.staged(mutate.near_edges(store.relationships(), keys=edges, ends=gone))
        n, e = mutate.upsert_relationships(mutate.upsert_nodes(near, batch, now()), near_e, edges, now())
        n, e = mutate.delete_nodes(n, e, gone)
        store.apply((near, n), (near_e, e))
        plain_n |= put
        for a, b, _, c, d in tie:
            plain_n.setdefault((a, b), "{}"), plain_n.setdefault((c, d), "{}")
        plain_e |= tie
        plain_n = {k: p for k, p in plain_n.items() if k not in drop}
        plain_e = {k: p for k, p in plain_e.items() if k[:2] not in drop and k[3:] not in drop}
        assert state(store) == (plain_n, plain_e), turn
        if turn in (3, 5):
            store.compact(most=2, whole=turn == 5 or None, share=10.0)
            assert len(store.manifest()["changes"]) <= 1 and state(store) == (plain_n, plain_e)


def test_bytes_follow_the_change(spark, store):
    wide = spark.range(200_000).select(F.lit("Topic").alias("label"), F.concat(F.lit("n"), "id").alias("name"), F.to_json(F.struct(F.sha2(F.col("id").cast("string"), 256).alias("x"))).alias("properties"))
    base = store.commit(wide, store.relationships())
    sizes = [store.size(upsert(store, [("Topic", f"n{k}", '{"y":1}') for k in range(count)])) for count in (1, 10, 1000)]
    assert sizes[0] < 40_000 and sizes[2] < store.size(base) / 20 and sizes[0] <= sizes[1] < sizes[2]
    assert store.nodes().count() == 200_000 and store.nodes().where("properties = '{\"y\":1}'").count() == 1000
    before = store.version()
    near = store.staged(store.nodes().where("name = 'n5'"))
    assert store.apply((near, near)) == before  # nothing differs, nothing is written


def test_versions_writers_and_vacuum(spark, store):
    assert upsert(store, [("A", "x", "1")]) == store.version() and store.manifest()["changes"] == []  # the first change is a base
    second = upsert(store, [("A", "y", "2")])
    third = upsert(store, [("A", "x", "3")])
    assert state(store)[0] == {("A", "x"): "3", ("A", "y"): "2"} and state(store.at(second))[0] == {("A", "x"): "1", ("A", "y"): "2"}
    assert store.vacuum(keep=2) == ["staging"]  # both stand on the base and the first change
    store.compact(whole=True)
    assert set(store.vacuum(keep=1)) >= {second, third} and state(store)[0] == {("A", "x"): "3", ("A", "y"): "2"}

    class Other(Store):
        """Another writer commits while this one works."""

        def _publish(self, version, manifest, started):
            if not getattr(self, "met", False):
                self.met = True
                upsert(Store(self.spark, self.root), [("A", "z", "9")])
            return super()._publish(version, manifest, started)

    with pytest.raises(RuntimeError, match="moved"):
        upsert(Other(spark, store.root), [("A", "x", "lost")])
    assert state(store)[0] == {("A", "x"): "3", ("A", "y"): "2", ("A", "z"): "9"}


def test_older_schema(spark, store):
    old = nodes_of(spark, [("Document", "d", "{}"), ("Topic", "t", "{}")]).select("*", F.lit(None).cast("array<float>").alias("embedding"), now().alias("created_at"), now().alias("updated_at"))
    assert schema.version_of("nodes", old.columns) == 1 and schema.version_of("nodes", schema.NODES.names) == schema.VERSION
    old.write.partitionBy("label").parquet(f"{store.root}/v20200101000000-x/nodes")
    spark.createDataFrame([], schema.RELATIONSHIPS).write.parquet(f"{store.root}/v20200101000000-x/relationships")
    sinks.write_tree(spark.createDataFrame([("CURRENT", '{"version": "v20200101000000-x"}')], "path string, content string"), store.root)
    assert store.nodes().columns == schema.NODES.names and {(r.name, r.extraction_method, r.content_hash) for r in store.nodes().collect()} == {("d", "frontmatter", None), ("t", "frontmatter", None)}
    near = store.staged(store.nodes().where("name = 'd'"))
    store.apply((near, mutate.set_hashes(near, spark.createDataFrame([("d", "h", None)], "name string, content_hash string, embedding_source_hash string"), now())))
    want = {("d", "frontmatter", "h"), ("t", "frontmatter", None)}
    assert {(r.name, r.extraction_method, r.content_hash) for r in store.nodes().collect()} == want and store.manifest()["schema"] == 1
    store.compact(whole=True)
    assert {(r.name, r.extraction_method, r.content_hash) for r in store.nodes().collect()} == want and store.manifest()["schema"] == schema.VERSION


def test_impact_reads_the_edges_of_changed_names_only(spark):
    """A change of one entity: of 50,000 edges only its own get past the semi join."""
    edges = spark.range(50_000).select(F.lit("Topic").alias("source_label"), F.concat(F.lit("e"), F.col("id") % 10_000).alias("source_name"), F.lit("APPEARS_IN").alias("relation_type"), F.lit("Document").alias("target_label"), F.concat(F.lit("d"), F.col("id") % 500).alias("target_name"), F.lit("{}").alias("properties"))
    nodes = spark.range(500).select(F.lit("Document").alias("label"), F.concat(F.lit("d"), "id").alias("name"), F.lit("{}").alias("properties"))
    shape = "path string, pos int, type string, name string"
    old, new = spark.createDataFrame([("d1", 0, "Topic", "e7"), ("d1", 1, "Topic", "e8")], shape), spark.createDataFrame([("d1", 1, "Topic", "e8")], shape)
    impact = cascade.report(old, new, nodes, edges)
    assert {(r.entity, r.affected) for r in impact.collect()} == {("e7", f"d{k}") for k in range(500) if k % 500 in {7, *(x % 500 for x in range(7, 50_000, 10_000))} and k != 1}
    plan = impact._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("LeftSemi")
    assert "source_name" in plan[at : at + 200] and plan.count("Join Inner") == 1  # the inner join meets what the semi joins left
