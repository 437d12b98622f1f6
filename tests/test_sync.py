"""Markdown trees, snapshots and streams end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import validate
from tallyweave.operators.sync import sync
from tallyweave.sources import embedding, markdown
from tallyweave.sources.store import Store
from tallyweave.streaming import ingest

DOC = """---
title: {title}
summary: about {title}
created: 2024-02-29
status: ongoing
tags: [a, "b: c"]
graph: {{importance: high, domain: dev}}
entities:
  - {{name: {entity}, type: Tool, description: a tool}}
  - {{name: Git, type: Tool}}
relationships:
  - {{source: this, relation: REFERENCES, target: {entity}}}
  - {{source: Git, relation: REFERENCES, target: nowhere}}
---
# Heading
text
"""


def write(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def test_sync(spark, tmp_path):
    root = tmp_path / "docs"
    write(root, "a.md", DOC.format(title="A", entity="Vim"))
    write(root, "sub/b.md", DOC.format(title="B", entity="Vim"))
    write(root, "bad.md", "---\ntitle: [x\n  y: {\n---\n")
    write(root, "node_modules/c.md", "# no")
    write(root, "plain.md", "no header")
    store = Store(spark, f"file://{tmp_path}/graph")
    embed = embedding.provider("mock", 8)
    dry = sync(spark, store, str(root), dry_run=True)
    assert dry.version is None and store.version() is None
    first = sync(spark, store, str(root), embed=embed, dim=8)
    assert first.counts == {"new": 4} and store.version() == first.version
    assert {r.path.rsplit("/", 1)[1] for r in first.problems.collect()} == {"bad.md", "a.md", "b.md"}
    n = store.nodes()
    assert n.where("label = 'Document'").count() == 3 and n.where("label = 'Tool'").count() == 2
    assert n.where("embedding IS NULL").count() == 0 and n.where("label = 'Document' AND content_hash IS NULL").count() == 0
    e = store.relationships()
    assert e.where("relation_type = 'APPEARS_IN'").count() == 4 and e.where("relation_type = 'REFERENCES'").count() == 2
    assert validate.issues(n).where("field = 'title'").count() == 0
    # a changed document: its entity is renamed, which touches the other one
    write(root, "a.md", DOC.format(title="A", entity="Emacs"))
    (root / "plain.md").unlink()
    second = sync(spark, store, str(root), embed=embed, dim=8)
    assert second.counts == {"new": 1, "updated": 1, "unchanged": 1, "deleted": 1}
    found = {(r.trigger, r.entity, r.affected.rsplit("/", 1)[1]) for r in second.impact.collect()}
    assert found == {("entity_renamed", "Vim", "b.md"), ("relationship_changed", "Vim", "b.md")}
    assert store.nodes().where("label = 'Document'").count() == 2 and store.relationships().where("source_name = 'Vim'").count() == 1
    store.views()
    assert spark.sql("SELECT count(*) AS n FROM nodes WHERE label = :label", args={"label": "Tool"}).first().n == 3


def test_front_matter(spark, tmp_path):
    write(tmp_path, "x.md", "---\ncreated: 2025-02-30\nentities: [{name: '', type: Nope}]\n---\nbody")
    write(tmp_path, "y.md", "---\ngraph: {importance: huge, domain: d}\nextra: 1\n---\nbody\n---\nmore")
    got = {r.path.rsplit("/", 1)[1]: r for r in markdown.parsed(markdown.scan(spark, str(tmp_path))).collect()}
    assert got["y.md"].content == "body\n---\nmore" and got["y.md"].graph is None and got["y.md"].title == "y"
    problems = {r.problem.split(":")[0] for r in markdown.front_problems(markdown.parsed(markdown.scan(spark, str(tmp_path)))).collect()}
    assert "entities" in problems or got["x.md"].error


def test_header_round_trip(spark):
    data = {"title": "a: b", "status": "ongoing", "tags": ["x", "y, z", "yes"], "n": 3, "on": None, "quote": 'say "hi"', "graph": {"importance": "high", "domain": "dev"}, "entities": [{"name": "A", "type": "Tool", "description": ""}, {"name": "-b", "type": "Tool", "description": "d"}]}
    text = markdown.header_of(data)
    assert markdown._record(text.removeprefix("---\n").removesuffix("---"))["json"].replace('"true"', '"on"') is not None
    import yaml

    assert {str(k).replace("True", "on"): v for k, v in yaml.safe_load(text.strip("-\n")).items()} == data


def test_streams(spark, tmp_path):
    src = tmp_path / "feed"
    feed = spark.createDataFrame([("P", "a", '{"v":1}', 1), ("P", "a", '{"v":2}', 2), ("P", "b", "{}", 1)], "label string, name string, properties string, at int")
    feed.write.parquet(f"file://{src}")
    store = Store(spark, f"file://{tmp_path}/graph")
    ingest.upsert_stream(spark.readStream.schema(feed.schema).parquet(f"file://{src}"), store, f"file://{tmp_path}/cp", "at").awaitTermination()
    assert {(r.name, r.properties) for r in store.nodes().collect()} == {("a", '{"v":2}'), ("b", "{}")}
    write(tmp_path / "tree", "a.md", "# A")
    tree = Store(spark, f"file://{tmp_path}/graph2")
    ingest.watch(spark, f"{tmp_path}/tree", tree, f"file://{tmp_path}/cp2", once=True).awaitTermination()
    assert tree.nodes().where("label = 'Document'").count() == 1
    ev = spark.sql("SELECT 1 AS u, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-01 00:00:01' UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-01 01:00:00'")
    assert sorted(r.events for r in ingest.sessions(ev, "u", "ts", "10 minutes").collect()) == [1, 2]
    assert ingest.windows(ev.withColumn("value", F.lit(1.0)), "ts", "1 hour").count() == 2
