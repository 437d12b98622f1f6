"""Findings of round 4: provenance is parsed once, impact is counted without pairs, listings of trees stay out of the driver."""

from __future__ import annotations

import json
import os
import pickle
import random

from tallyweave.operators import cascade, mutate
from tallyweave.sources import sinks, tree

_EDGE = "source_label string, source_name string, relation_type string, target_label string, target_name string, properties string"


def test_provenance_is_parsed_before_it_is_sorted(spark):
    """No join or sort works with an expression that parses JSON; edges without a path stay, and are dealt to several tasks."""
    rows = [("a", f"n{k}", "R", "b", "m", '{"documentPath":"x.md"}' if k % 3 == 0 else '{"documentPath":"y.md"}' if k % 3 == 1 else None if k % 2 else "{}") for k in range(300)]
    edges = spark.createDataFrame(rows, _EDGE)
    paths = spark.createDataFrame([("x.md",), ("x.md",), ("z.md",), (None,)], "name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = mutate.delete_by_document(edges, paths)
        near = mutate.near_edges(edges, documents=paths)
        for df in (left, near):
            lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
            assert any("Join" in x for x in lines) and not any("get_json_object" in x for x in lines if "Project" not in x and "Filter" not in x)
        assert sorted(map(tuple, left.collect()), key=lambda r: r[1]) == sorted((r for r in rows if r[5] is None or "x.md" not in r[5]), key=lambda r: r[1])
        assert near.count() == 100 and near.columns == left.columns == edges.columns
        assert sum(any(r.properties is None for r in part) for part in left.rdd.glom().collect()) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_totals_are_those_of_the_report(spark):
    """Counts of all triggers as the whole report has them: names that change in one document or in many, in documents that aren't nodes or that no edge names, repeated edges, nulls; and no join on names."""
    r = random.Random(4)
    name = lambda: r.choice([*"abcdefgh", "hot", "hot", None])
    version = lambda: spark.createDataFrame([(r.choice([*"pqrstuv", None]), k, r.choice(["T", "U"]), name()) for k in range(60)], "path string, pos int, type string, name string")
    links = lambda: spark.createDataFrame([(r.choice("pqrs"), name(), "R", name()) for _ in range(25)], "path string, source string, relation string, target string")
    nodes = spark.createDataFrame([("Document", x) for x in "pqrstxyz"] + [("Tool", "v")], "label string, name string")
    edges = spark.createDataFrame([("Tool", name(), "R", r.choice(["Document", "Document", "Tool"]), r.choice([*"pqrtuvwxyz", None])) for _ in range(120)], "source_label string, source_name string, relation_type string, target_label string, target_name string")
    for _ in range(2):
        old, new, rels = version(), version(), (links(), links())
        for more in (None, rels):
            want = {tuple(x) for x in cascade.by_trigger(cascade.report(old, new, nodes, edges, relationships=more)).collect()}
            got = cascade.totals(old, new, nodes, edges, relationships=more)
            rows = [tuple(x) for x in got.collect()]
            assert set(rows) == want and len(rows) == len(want) and got.columns == ["trigger", "warnings", "documents"]
    assert cascade.totals(old.limit(0), new.limit(0), nodes, edges).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "LeftSemi" not in x]


def _steps(tree_root, state, old: dict) -> tuple[dict, list, dict]:
    """A new offset of a tree, the partitions up to it, and the changes that tasks find in them."""
    stream = tree._Stream({"path": str(tree_root), "state": str(state)})
    new = stream.latestOffset()
    parts = stream.partitions(old, new)
    found = [(os.path.relpath(p, tree_root), c) for x in parts for p, c, _ in stream.read(x)]
    stream.commit(new)
    assert len(dict(found)) == len(found)
    return new, parts, dict(found)


def test_listings_stay_out_of_the_driver(tmp_path, monkeypatch):
    """Partitions name parts of listings, not files; parts are right as a tree grows from one part to many and shrinks again; a quiet tree has no new listing."""
    root, state = tmp_path / "docs", tmp_path / "state"
    write = lambda k, text="": ((root / f"d{k % 3}").mkdir(parents=True, exist_ok=True), (root / f"d{k % 3}/{k}.md").write_text(text))
    name = lambda k: f"d{k % 3}/{k}.md"
    monkeypatch.setattr(tree, "_SMALL", 50)
    monkeypatch.setattr(tree, "_BUFFER", 100)
    for k in range(20):
        write(k)
    at, parts, got = _steps(root, state, {"listing": 0})
    assert len(parts) == 1 and got == {name(k): "came" for k in range(20)}
    for k in range(20, 2000):
        write(k)
    write(3, "longer")
    (root / name(4)).unlink()
    at, parts, got = _steps(root, state, at)
    assert got == {name(k): "came" for k in range(20, 2000)} | {name(3): "changed", name(4): "gone"}
    assert sum(len(pickle.dumps(p)) for p in parts) < 256 * 200 and b".md" not in pickle.dumps(parts)
    assert _steps(root, state, at) == (at, [], {}) and {x.name for x in state.iterdir()} == {f"{at['listing']}.json", str(at["listing"])}
    write(5, "longer")
    at, parts, got = _steps(root, state, at)
    assert len(parts) == 1 and got == {name(5): "changed"}  # one part differs, and only that is read
    for k in range(30, 2000):
        (root / name(k)).unlink()
    at, parts, got = _steps(root, state, at)
    assert got == {name(k): "gone" for k in range(30, 2000)}
    write(2000)
    at, parts, got = _steps(root, state, at)
    assert len(parts) == 1 and got == {name(2000): "came"}


def test_a_listing_of_an_earlier_version_goes_on(tmp_path):
    root, state = tmp_path / "docs", tmp_path / "state"
    for d in (root, state):
        d.mkdir()
    for k in "abc":
        (root / f"{k}.md").write_text(k)
    had = {x.path: f"{x.size}:{x.mtime_ns}" for x in tree._files(str(root), str(root), "*.md")}
    (state / "3.json").write_text(json.dumps(had | {str(root / "z.md"): "1:1"}))
    (root / "d.md").write_text("d")
    assert _steps(root, state, {"listing": 3})[2] == {"d.md": "came", "z.md": "gone"}
    (root / "d.md").unlink()
    (state / "4.json").unlink()
    (state / "3.json").write_text(json.dumps(had))
    assert _steps(root, state, {"listing": 3})[:2] == ({"listing": 3}, [])


def test_files_are_deleted_by_tasks(spark, tmp_path):
    for k in "abc":
        (tmp_path / f"{k} é.md").write_text(k)
    gone = spark.createDataFrame([("a é.md",), ("/b é.md",), ("none.md",), (None,)], "path string")
    assert sinks.delete_files(gone, f"file://{tmp_path}") == 2 and [x.name for x in tmp_path.iterdir()] == ["c é.md"]
