"""Settings, headers, extraction, manifests, sinks, questions, other joins, and syncs of parts of a tree."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.config import EngineConfig, SyncOptions
from tallyweave.operators import cascade, joins, lookup, questions, search
from tallyweave.operators.sync import sync, sync_in_parts
from tallyweave.schema import NODES, RELATIONSHIPS
from tallyweave.sources import embedding, extraction, manifest, markdown, sinks
from tallyweave.sources.store import Store
from tallyweave.streaming import ingest


def now():
    return F.expr("TIMESTAMP_NTZ '2024-05-01 10:00:00'")


def write(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def doc(title, *entities, links=()):
    rows = "\n".join(f"  - {{name: {e}, type: Tool, description: d}}" for e in entities)
    refs = "\n".join(f"  - {{source: this, relation: REFERENCES, target: {e}}}" for e in links)
    return f"---\ntitle: {title}\nsummary: s\ncreated: 2024-01-01\nupdated: 2024-01-01\nstatus: draft\n" + (f"entities:\n{rows}\n" if entities else "") + (f"relationships:\n{refs}\n" if links else "") + "---\ntext"


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


# ------------------------------------------------------------------ settings


def test_config():
    c = EngineConfig.load("/home/x/", {})
    assert (c.provider, c.dim, c.path("docs")) == ("mock", 512, "/home/x/docs")
    c = EngineConfig.load("s3a://b/x", {"EMBEDDING_PROVIDER": "openai", "EMBEDDING_DIMENSIONS": "256", "OPENAI_API_KEY": "k"})
    assert c.dim == 256 and c.api_key == "k" and "k" not in repr(c).replace("openai", "").split("api")[0]
    for env in ({"EMBEDDING_PROVIDER": "nobody"}, {"EMBEDDING_DIMENSIONS": "many"}, {"EMBEDDING_DIMENSIONS": "0"}):
        with pytest.raises(ValueError):
            EngineConfig.load("/x", env)
    with pytest.raises(ValueError):
        EngineConfig.load("/x", {"EMBEDDING_PROVIDER": "voyage"}).embed("query")
    with pytest.raises(ValueError):
        c.path("elsewhere")


@pytest.mark.parametrize("options", [{"watch": True, "dry_run": True}, {"watch": True, "force": True, "paths": ("a",)}, {"force": True}])
def test_options_that_exclude_each_other(options):
    with pytest.raises(ValueError):
        SyncOptions(**options)
    assert SyncOptions(force=True, paths=("a",)).force


# ------------------------------------------------------------------ headers and paths


def test_header_problems():
    good = {"created": "2024-02-29", "updated": "2024-01-31", "status": "draft", "tags": ["a"], "entities": [{"name": "x", "type": "Tool", "description": "d"}], "graph": {"importance": "low", "domain": "d"}, "own": 1}
    assert markdown.header_problems(good) == []
    bad = {"created": "2023-02-29", "status": 3, "tags": ["a", 5], "topic": None, "entities": [{"name": "", "type": "Nope"}, "x"], "relationships": {"a": 1}, "graph": {"importance": "huge"}}
    assert [p.split(":")[0] for p in markdown.header_problems(bad)] == ["created", "updated", "status", "topic", "tags.1", "entities.0.name", "entities.0.type", "entities.0.description", "entities.1", "relationships", "graph.importance"]
    assert markdown._record(None)["problems"] == ["No frontmatter found"]


def test_resolved(spark, tmp_path):
    write(tmp_path / "docs", "a/b.md", "x")
    root = str(tmp_path / "docs")
    assert markdown.resolved(spark, ["a/b.md", f"{root}/a/b.md", "./a/../a/b.md"], root) == [f"{root}/a/b.md"] * 3
    assert markdown.resolved(spark, ["none.md"], root, exists=False) == [f"{root}/none.md"]
    for p in ("../x.md", f"{root}-other/x.md", "/etc/x.md"):
        with pytest.raises(ValueError, match="outside"):
            markdown.resolved(spark, [p], root)
    with pytest.raises(FileNotFoundError):
        markdown.resolved(spark, ["none.md"], root)


# ------------------------------------------------------------------ extraction


def test_rule_based(spark):
    text = "# Title\n\nFirst `Spark` line.\nSecond.\n\n## Setup ##\n```\n## no `code`\n```\n[[Page|p]] `Spark` [[Spark]]\n"
    got = extraction.rule_based(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "path string, content string")).collect()
    assert [(e.name, e.type) for e in got[0].entities] == [("Setup", "Topic"), ("Spark", "Technology"), ("Page", "Concept")]
    assert got[0].summary == "First `Spark` line. Second." and [r.target for r in got[0].relationships] == ["Setup", "Spark", "Page"]
    assert [len(r.entities) for r in got[1:]] == [0, 0]


def test_calling(spark):
    def call(path, content, errors):
        if content == "raises":
            raise RuntimeError("down")
        end = "A" if errors or content == "good" else "missing"
        return {"entities": [{"name": "A", "type": "Tool", "description": "d"}], "relationships": [{"source": "this", "relation": "REFERENCES", "target": end}], "summary": "s"} if content != "never" else {"entities": None}

    docs = spark.createDataFrame([(c, c) for c in ("good", "mends", "never", "raises")], "path string, content string").coalesce(1)
    got = {r.path: (r.success, r.error) for r in extraction.calling(call, pause=0)(docs).collect()}
    assert got == {"good": (True, None), "mends": (True, None), "never": (False, "Entities array is missing or invalid"), "raises": (False, "down")}
    bare = "array<struct<name:string,type:string,description:string>>"
    docs = docs.selectExpr("path", "content", f"CASE WHEN path = 'good' THEN array(named_struct('name', 'own', 'type', 'Tool', 'description', 'd')) ELSE CAST(NULL AS {bare}) END AS entities", "CAST(NULL AS array<struct<source:string,relation:string,target:string>>) AS relationships", "CASE WHEN path = 'mends' THEN 'kept' END AS summary")
    filled = {r.path: ([e.name for e in r.entities or []], r.summary) for r in extraction.filled(docs, extraction.calling(call, pause=0)).collect()}
    assert filled == {"good": (["own"], None), "mends": (["A"], "kept"), "never": ([], None), "raises": ([], None)}


# ------------------------------------------------------------------ manifest and sinks


def test_manifest(spark, tmp_path):
    assert manifest.load(spark, f"file://{tmp_path}/none").count() == 0
    entry = {"contentHash": "c", "frontmatterHash": "f", "lastSynced": "2024", "entityCount": 1, "relationshipCount": 2}
    (tmp_path / "m.json").write_text(json.dumps({"version": "1.0", "lastSync": "2024", "documents": {"a.md": entry, "b.md": entry}}, indent=2))
    one = manifest.load(spark, f"file://{tmp_path}/m.json")
    assert {(r.path, r.content_hash, r.relationship_count) for r in one.collect()} == {("a.md", "c", 2), ("b.md", "c", 2)}
    (tmp_path / "bad.json").write_text('{"version": "1.0", "documents": [')
    assert manifest.load(spark, f"file://{tmp_path}/bad.json").count() == 0
    whole = json.loads(manifest.document(one, now()).first().json)
    assert whole["version"] == "1.0" and whole["documents"]["a.md"] == entry and whole["lastSync"] == "2024-05-01T10:00:00.000Z"
    assert manifest.removed(one).count() == 0 and manifest.removed(one, spark.createDataFrame([("a.md",)], "path string")).count() == 1


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a/x.md", '{"title":"é: b"}', "body\r\n"), ("y.md", None, "plain"), ("z.md", "{}", None), ("n.md", None, None)], "path string, front string, body string")
    tree = files.select("path", sinks.with_header(F.col("front"), F.col("body")).alias("content"))
    assert sinks.write_tree(tree, f"file://{tmp_path}/t") == 3
    assert (tmp_path / "t/a/x.md").read_bytes().decode() == '---\ntitle: "é: b"\n---\nbody\r\n' and (tmp_path / "t/y.md").read_text() == "plain"
    assert sinks.write_tree(tree, f"file://{tmp_path}/t") == 3
    df = spark.createDataFrame([(1, None), (2**40, "é")], "a long, b string")
    assert json.loads(sinks.result_json(df)) == {"columns": ["a", "b"], "resultSet": [{"a": 1, "b": None}, {"a": 2**40, "b": "é"}]}
    sinks.write_page(spark, "é\n", f"file://{tmp_path}/p/welcome.md")
    assert (tmp_path / "p/welcome.md").read_text() == "é\n"


# ------------------------------------------------------------------ questions and search


def test_questions(spark):
    nodes = spark.createDataFrame([("Document", "d.md")], "label string, name string")
    nodes = spark.createDataFrame([], NODES).unionByName(nodes, allowMissingColumns=True)
    edges = spark.createDataFrame([], RELATIONSHIPS)
    asked = spark.createDataFrame([("why?", "d.md"), ("how?", None), ("what?", "none.md"), (" ", "d.md"), ("why?", "d.md")], "question string, document string")
    n, e, lost = questions.ask(nodes, edges, asked, now(), embed=embedding.provider("mock", 8), dim=8)
    q = n.where("label = 'Question'").collect()
    assert sorted(r.name for r in q) == ["how?", "what?", "why?"] and all(len(r.embedding) == 8 and json.loads(r.properties)["createdAt"] == "2024-05-01T10:00:00.000Z" for r in q)
    assert [(r.source_name, r.target_name) for r in e.collect()] == [("why?", "d.md")] and [(r.question, r.document) for r in lost.collect()] == [("what?", "none.md")]
    n2, e2 = questions.link(n, e, spark.createDataFrame([("new?", "d.md"), ("how?", "d.md")], "question string, document string"), now())
    assert n2.where("label = 'Question'").count() == 4 and e2.count() == 3
    with pytest.raises(Exception, match="Document not found: none.md"):
        questions.link(n, e, spark.createDataFrame([("x", "none.md")], "question string, document string"), now())[1].collect()


def test_semantic(spark):
    n = spark.createDataFrame([("Tool", "a", '{"title":"T","description":"D"}', "x"), ("Topic", "b", "{}", "y")], "label string, name string, properties string, text string")
    n = embedding.mock(8)(n)
    got = search.semantic(n, "x", embedding.mock(8)).collect()
    assert [(r.name, r.shown, r.description) for r in got][0] == ("a", "100.00%", "D") and len(got) == 2
    assert search.semantic(n, "x", None, fallback=embedding.mock(8), label="Tool").first().description is None
    assert search.shown(search.semantic(n, "x", embedding.mock(8), label="None"), "x")[-1] == "No results found."
    for text, embed in (("", embedding.mock(8)), ("x", None)):
        with pytest.raises(ValueError):
            search.semantic(n, text, embed)


def test_index_is_kept(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, [r.gauss(0, 1) for _ in range(16)]) for k in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    store = Store(spark, f"file://{tmp_path}/g")
    store.commit(spark.createDataFrame([], NODES), spark.createDataFrame([], RELATIONSHIPS))
    assert store.index() is None
    store.save_index(search.build_index(v, dim=16))
    store.save_index(search.build_index(v.limit(1), dim=16))  # one that is there stays
    assert store.index().count() == 300 * 16
    with_, without = (search.nearest_by_index(v, v.limit(5), 3, dim=16, index=x).count() for x in (store.index(), None))
    assert with_ == without > 0


def test_vacuum(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    assert store.vacuum() == []
    empty = (spark.createDataFrame([], NODES), spark.createDataFrame([], RELATIONSHIPS))
    old = [store.commit(*empty) for _ in range(3)]
    store.staged(spark.range(3))
    gone = store.vacuum(keep=2)
    assert "staging" in gone and len(gone) == 2 and store.version() == old[-1] and store.nodes().count() == 0


# ------------------------------------------------------------------ joins and paths


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    r = random.Random(3)
    a = [(k, r.choice(["x", "y", None]), r.choice([*range(12), None])) for k in range(60)]
    b = [(r.choice(["x", "y", None]), r.randrange(12), r.choice([None, *range(5)])) for _ in range(40)]
    got = joins.as_of(spark.createDataFrame(a, "i long, k string, t long"), spark.createDataFrame(b, "k string, t long, v long"), "k", "t", ["v"], strict=strict)
    want = []
    for i, k, t in a:
        before = [(s, -1 if v is None else v) for key, s, v in b if k is not None and key == k and t is not None and (s < t or (s == t and not strict))]
        v = max(before)[1] if before else None
        want.append((i, None if v == -1 else v))
    assert sorted((x.i, x.last_v) for x in got.collect()) == sorted(want)


def test_interval_and_condition(spark):
    r = random.Random(4)
    points = [(k, r.choice([r.uniform(-20, 20), None])) for k in range(80)]
    spans = [(k, a, a + r.choice([-1, 0, 0.5, 3, 17])) for k in range(30) for a in [r.uniform(-20, 20)]] + [(99, None, 1.0)]
    p, s = spark.createDataFrame(points, "i long, x double"), spark.createDataFrame(spans, "j long, a double, b double")
    want = sorted((i, j) for i, x in points for j, a, b in spans if x is not None and a is not None and a <= x < b)
    assert sorted((y.i, y.j) for y in joins.in_interval(p, s, "x", "a", "b").collect()) == want
    for pairs in (10**9, 500, 7):
        assert sorted((y.i, y.j) for y in joins.where_pairs(p, s, (F.col("x") >= F.col("a")) & (F.col("x") < F.col("b")), pairs=pairs).collect()) == want


def test_long_chains_are_followed(spark):
    edges = spark.createDataFrame([("T", f"n{k}", "T", f"n{k + 1}") for k in range(58)], "source_label string, source_name string, target_label string, target_name string")
    assert lookup.reachable(edges).count() == 58 * 59 // 2


def test_relationship_changes(spark):
    kind = "path string, source string, relation string, target string"
    old = spark.createDataFrame([("a", "a", "R", "X"), ("a", "Y", "R", "Z"), ("a", "Y", "R", "Z"), ("b", "b", "R", "Q")], kind)
    new = spark.createDataFrame([("a", "a", "R", "W"), ("a", "Y", "R", "Z"), ("b", "b", "R", "Q")], kind)
    assert {(r.path, r.entity) for r in cascade.relationship_changes(old, new).collect()} == {("a", "X"), ("a", "W")}


# ------------------------------------------------------------------ syncs


def test_sync_of_some_paths(spark, tmp_path):
    root = tmp_path / "docs"
    for k in range(4):
        write(root, f"{k}.md", doc(f"D{k}", "Vim", f"E{k}", links=("Vim",)))
    store = Store(spark, f"file://{tmp_path}/g")
    paths = lambda *ks: spark.createDataFrame([(f"{root}/{k}.md",) for k in ks], "path string")
    assert sync(spark, store, str(root), only=paths(0, 1)).counts == {"new": 2}
    assert sync(spark, store, str(root), only=paths(1, 2)).counts == {"unchanged": 1, "new": 1}
    forced = sync(spark, store, str(root), only=paths(1), force=True)
    assert forced.counts == {"new": 1} and forced.impact.count() == 0
    (root / "0.md").unlink()
    assert sync(spark, store, str(root), only=paths(0)).counts == {}  # not a deletion unless it is said
    last = sync(spark, store, str(root), only=paths(0), removed=paths(0, 1))
    assert last.counts == {"deleted": 1, "unchanged": 1} and names(last.changes.where("change_type = 'deleted'")) == ["0.md"]
    assert store.nodes().where("label = 'Document'").count() == 2 and store.relationships().where(F.col("properties").contains("0.md")).count() == 0
    assert store.nodes().where("label = 'Tool'").count() == 4  # entities stay


def test_sync_in_parts(spark, tmp_path):
    root = tmp_path / "docs"
    for k in range(9):
        write(root, f"{k}.md", doc(f"D{k}", f"E{k}"))
    store = Store(spark, f"file://{tmp_path}/g")
    done = sync_in_parts(spark, store, str(root), documents=4)
    assert len(done) == 3 and sum(r.counts.get("new", 0) for r in done) == 9 and len({r.version for r in done}) == 3
    again = sync_in_parts(spark, store, str(root), documents=4)
    assert [r.counts for r in again] == [{"unchanged": 9}]
    assert store.nodes().where("label = 'Document'").count() == 9


def test_sync_with_an_extractor(spark, tmp_path):
    write(tmp_path / "docs", "a.md", "# A\n\nAbout `Spark`.\n")
    store = Store(spark, f"file://{tmp_path}/g")
    sync(spark, store, str(tmp_path / "docs"), extract=extraction.rule_based)
    assert {(r.label, r.name) for r in store.nodes().where("label != 'Document'").collect()} == {("Technology", "Spark")}
    assert {r.relation_type for r in store.relationships().collect()} == {"APPEARS_IN", "REFERENCES"}


def test_watch_finds_what_came_and_went(spark, tmp_path):
    tree, store = tmp_path / "tree", Store(spark, f"file://{tmp_path}/g")
    write(tree, "a.md", doc("A", "Vim"))
    write(tree, "b.md", doc("B", "Vim"))
    run = lambda: ingest.watch(spark, str(tree), store, f"file://{tmp_path}/cp", once=True).awaitTermination()
    run()
    assert store.nodes().where("label = 'Document'").count() == 2
    (tree / "a.md").unlink()
    write(tree, "c.md", doc("C", "Git"))
    run()
    assert {r.name.rsplit("/", 1)[1] for r in store.nodes().where("label = 'Document'").collect()} == {"b.md", "c.md"}
    before = store.version()
    run()
    assert store.version() == before


def test_settled_and_state(spark, tmp_path):
    """Bursts come out once they are over, late events are dropped, a key's state follows its latest event."""
    src = tmp_path / "in"
    say = lambda k, rows: spark.createDataFrame(rows, "path string, at string").select("path", F.to_timestamp("at").alias("at"), F.lit(k).alias("u")).coalesce(1).write.mode("append").parquet(f"file://{src}")
    kind = "path string, at timestamp, u int"
    say(1, [("a", "2024-01-01 00:00:00.0"), ("b", "2024-01-01 00:00:00.3"), ("a", "2024-01-01 00:00:00.4")])
    say(1, [("c", "2024-01-01 00:00:05.0")])
    changes = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    out = ingest.settled(changes, "at", "500 milliseconds")
    q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True)
    q.start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(list(r.paths), r.events) for r in got] == [(["a", "b"], 3)]  # the last burst isn't over
    say(1, [("late", "2024-01-01 00:00:00.2"), ("d", "2024-01-01 00:01:00.0")])
    q.start().awaitTermination()
    got = {tuple(r.paths): r.events for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[("c",)] == 1 and not any("late" in p for p in got)
    last = ingest.latest_by_key(spark.read.schema(kind).parquet(f"file://{src}"), "u", "at", "path").first()
    assert (last.path, last.events) == ("d", 6)


def test_a_failing_embedding_costs_its_own_row_only(spark, tmp_path):
    """A service that refuses one text and stumbles once: all others get vectors, the sync goes on and names the document."""
    calls = []

    def post(url, headers, body):
        calls.append(len(body["input"]))
        if any("poison" in x for x in body["input"]):
            raise OSError("refused")
        return {"data": [{"index": k, "embedding": [float(len(x)), 1.0]} for k, x in enumerate(body["input"])]}

    def run(frames):
        return embedding.http("openai", "k", "m", post=post, errors="rows", turns=2, sleep=lambda _: None)(frames)

    df = spark.createDataFrame([(k, "poison" if k == 5 else f"text {k}") for k in range(9)], "id long, text string").coalesce(1)
    got = {r.id: r for r in run(df).collect()}
    assert len(got) == 9 and [i for i, r in got.items() if r.embedding is None] == [5] and "refused" in got[5].embedding_error and got[4].embedding_error is None
    with pytest.raises(ValueError):
        embedding.http("openai", "k", "m", errors="skip")
    tree = tmp_path / "docs"
    for name in ("good", "bad"):
        (tree / f"{name}.md").parent.mkdir(parents=True, exist_ok=True)
        (tree / f"{name}.md").write_text(f"# {name}\n" + ("poison" if name == "bad" else "fine"))
    store = Store(spark, f"file://{tmp_path}/graph")
    result = sync(spark, store, f"file://{tree}", embed=run, dim=2)
    assert [(r.path.rsplit("/", 1)[1], "refused" in r.error) for r in result.problems.collect()] == [("bad.md", True)]
    rows = {r.name.rsplit("/", 1)[1]: (r.embedding is not None, r.embedding_source_hash is not None, r.content_hash is not None) for r in store.nodes().where("label = 'Document'").collect()}
    assert rows == {"good.md": (True, True, True), "bad.md": (False, False, True)}
