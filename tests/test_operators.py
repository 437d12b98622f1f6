"""Graph operators on small literal tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallyweave import schema
from tallyweave.functions import text as t
from tallyweave.functions import vectors as vec
from tallyweave.operators import cascade, changes, entities, lookup, mutate, search, topics, validate
from tallyweave.sources import embedding, exports

def later():
    return F.expr("TIMESTAMP_NTZ '2024-05-05 00:00:00'")

def early():
    return F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'")



def nodes(spark, *rows):
    df = spark.createDataFrame([(*r, None, None)[:3] for r in rows] or [], "label string, name string, properties string")
    return df.withColumns({"embedding": F.lit(None).cast("array<float>"), "created_at": early(), "updated_at": early(), "content_hash": F.lit(None).cast("string"), "embedding_source_hash": F.lit(None).cast("string")})


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "{}")[:6] for r in rows], "source_label string, source_name string, relation_type string, target_label string, target_name string, properties string").withColumn("created_at", early())


def test_upsert_keeps_one_row_and_replaces(spark):
    have = mutate.upsert_nodes(nodes(spark), nodes(spark, ("Technology", "TypeScript", '{"version":"4.0"}')), early())
    have = mutate.upsert_nodes(have, nodes(spark, ("Technology", "TypeScript", '{"version":"5.0"}'), ("Tool", "Test's", '{"a":"\\"q\\""}')), later())
    got = {r.name: r for r in have.collect()}
    assert len(got) == 2 and got["TypeScript"].properties == '{"version":"5.0"}' and got["Test's"].properties == '{"a":"\\"q\\""}'
    assert got["TypeScript"].created_at.year == 2020 and got["TypeScript"].updated_at.year == 2024
    again = mutate.upsert_nodes(have, nodes(spark, ("Technology", "TypeScript", '{"version":"5.0"}')), later())
    assert again.exceptAll(have).count() == 0 and again.count() == 2


def test_nameless_node_raises(spark):
    with pytest.raises(Exception, match="name"):
        mutate.upsert_nodes(nodes(spark), nodes(spark, ("Tool", "", "{}")), later()).collect()


def test_delete_cascades_and_missing_is_harmless(spark):
    n, e = nodes(spark, ("Tool", "A"), ("Tool", "B")), edges(spark, ("Tool", "A", "USES", "Tool", "B"), ("Tool", "B", "USES", "Tool", "B"))
    key = lambda name: spark.createDataFrame([("Tool", name)], "label string, name string")
    n2, e2 = mutate.delete_nodes(n, e, key("A"))
    assert [r.name for r in n2.collect()] == ["B"] and e2.count() == 1
    n3, e3 = mutate.delete_nodes(n, e, key("Z"))
    assert n3.count() == 2 and e3.count() == 2


def test_relationships_create_ends_and_delete_by_document(spark):
    n, e = mutate.upsert_relationships(nodes(spark), edges(spark).limit(0) if False else edges(spark, ("x", "x", "x", "x", "x")).limit(0), edges(spark, ("T", "React", "USES", "T", "JavaScript", '{"documentPath":"a.md"}'), ("T", "React", "USES", "T", "B", '{"documentPath":"b.md"}'), ("T", "React", "USES", "T", "C")), later())
    assert {r.name for r in n.collect()} == {"React", "JavaScript", "B", "C"} and e.count() == 3
    left = mutate.delete_by_document(e, spark.createDataFrame([("a.md",)], "name string"))
    assert {r.target_name for r in left.collect()} == {"B", "C"}
    assert mutate.orphans(nodes(spark, ("T", "alone"), ("T", "React")), e).count() == 1


def test_embeddings_and_hashes(spark):
    n = nodes(spark, ("Document", "a"), ("Document", "b"))
    e = spark.createDataFrame([("Document", "a", [1.0, 2.0]), ("Document", "zz", [1.0, 2.0])], "label string, name string, embedding array<double>")
    got = {r.name: r for r in mutate.set_embeddings(n, e, 2).collect()}
    assert got["a"].embedding == [1.0, 2.0] and got["b"].embedding is None and got["a"].updated_at.year == 2020
    with pytest.raises(Exception, match="3 elements"):
        mutate.set_embeddings(n, e, 3).collect()
    h = spark.createDataFrame([("a", "h1", None), ("b", "h2", "e2")], "name string, content_hash string, embedding_source_hash string")
    got = {r.name: (r.content_hash, r.embedding_source_hash, r.updated_at.year) for r in mutate.set_hashes(n, h, later()).collect()}
    assert got == {"a": ("h1", None, 2024), "b": ("h2", "e2", 2024)}
    hashed = mutate.set_hashes(n, h, later())
    assert {(r.name, r.needs) for r in changes.stale_embeddings(hashed).collect()} == {("a", "missing"), ("b", "stale")}


def test_neighbours_and_hops(spark):
    e = edges(spark, ("T", "TypeScript", "USES", "T", "Node.js"), ("T", "TypeScript", "DEPENDS_ON", "T", "Express"), ("T", "Express", "USES", "T", "Node.js"), ("T", "L", "USES", "T", "L"), ("T", "Node.js", "USES", "T", "TypeScript"))
    assert lookup.neighbours(e, "TypeScript").count() == 3 and lookup.neighbours(e, "nobody").count() == 0
    assert [r.name for r in lookup.neighbours(e, "L").collect()] == ["L"]
    assert ("TypeScript", "Node.js") in {(r.start_name, r.end_name) for r in lookup.hops(e, 2).collect()}
    reach = {(r.start_name, r.end_name) for r in lookup.reachable(e).collect()}
    assert {("TypeScript", "TypeScript"), ("L", "L"), ("Express", "Express")} <= reach and ("L", "Express") not in reach


def test_changes(spark):
    stored = spark.createDataFrame([("existing.md", "abc"), ("same.md", "x"), ("legacy.md", None), ("gone.md", "y")], "path string, content_hash string")
    now = spark.createDataFrame([("existing.md", "new"), ("same.md", "x"), ("legacy.md", "z"), ("new.md", "n"), ("broken.md", None)], "path string, content_hash string")
    kinds = lambda df: {r.path: r.change_type for r in df.collect()}
    want = {"existing.md": "updated", "same.md": "unchanged", "legacy.md": "updated", "new.md": "new", "broken.md": "new", "gone.md": "deleted"}
    assert kinds(changes.detect(now, stored)) == want
    only = spark.createDataFrame([("same.md",)], "path string")
    assert kinds(changes.detect(now, stored, only=only)) == {"same.md": "unchanged"}
    assert kinds(changes.detect(now, stored, force=True))["same.md"] == "new"
    assert set(kinds(changes.detect(now, now.where("content_hash IS NOT NULL"))).values()) <= {"unchanged", "new"}


def lists(spark, *rows):
    return spark.createDataFrame(rows, "path string, pos int, type string, name string, description string")


def test_unique_entities(spark):
    e = lists(spark, ("a", 0, "T", "X", None), ("a", 1, "T", "X", "long1"), ("b", 0, "T", "X", "long2"), ("b", 1, "T", "X", ""), ("b", 2, "U", "X", "u"), ("c", 0, "T", "Y", None))
    got = {(r.type, r.name): (r.description, r.paths) for r in entities.unique_entities(e).collect()}
    assert got == {("T", "X"): ("long1", ["a", "a", "b", "b"]), ("U", "X"): ("u", ["b"]), ("T", "Y"): (None, ["c"])}
    assert entities.examples(e).where("name = 'X'").first().documents == 2
    assert entities.top_entities(e).first().name == "X"


def test_resolution(spark):
    e = lists(spark, ("d.md", 0, "Tool", "Git", None), ("d.md", 1, "Tech", "Git", None), ("d.md", 2, "Tool", "Vim", None))
    r = spark.createDataFrame([("d.md", k, *x) for k, x in enumerate([("this", "REFERENCES", "Git"), ("Git", "REFERENCES", "o.md"), ("Git", "REFERENCES", "Vim"), ("who", "REFERENCES", "Git"), ("Git", "REFERENCES", "what"), ("this", "REFERENCES", "x.md"), ("who", "REFERENCES", "y.md")])], "path string, pos int, source string, relation string, target string")
    got = {(x.source_name, x.target_name): (x.source_label, x.target_label, x.problem) for x in entities.resolve(e.select("path").distinct(), e, r).collect()}
    assert got["d.md", "Git"] == ("Document", "Tech", None) and got["Git", "o.md"] == ("Tech", "Document", None) and got["Git", "Vim"] == ("Tech", "Tool", None)
    assert "who" in got["who", "Git"][2] and "what" in got["Git", "what"][2] and "x.md" in got["d.md", "x.md"][2] and "who" in got["who", "y.md"][2]
    assert entities.appears_in(e).count() == 3


def test_extraction_errors(spark):
    df = spark.createDataFrame([([("A", "T", None)], [("A", "R", "A"), ("this", "R", "A"), ("B", "R", "this")]), ([], None)], "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,relation:string,target:string>>")
    got = [r.e for r in df.select(entities.extraction_errors(F.col("entities"), F.col("relationships")).alias("e")).collect()]
    assert len(got[0]) == 2 and got[1] == []


def test_cascade(spark):
    v = lambda *rows: spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "path string, pos int, type string, name string")
    old, new = v(("T", "A"), ("T", "B"), ("U", "C"), ("T", "K")), v(("T", "A2"), ("T", "K"), ("V", "C"))
    assert [(r.old_name, r.new_name) for r in cascade.renames(old, new).collect()] == [("A", "A2")]
    assert [r.name for r in cascade.deletions(old, new).collect()] == ["B"]
    assert [(r.name, r.old_type, r.new_type) for r in cascade.type_changes(old, new).collect()] == [("C", "U", "V")]
    n = nodes(spark, ("Document", "d"), ("Document", "other"), ("T", "A"))
    e = edges(spark, ("T", "A", "APPEARS_IN", "Document", "other"), ("T", "A", "APPEARS_IN", "Document", "d"), ("T", "B", "APPEARS_IN", "Document", "other"), ("Document", "other", "REFERENCES", "Document", "d"))
    got = {(r.trigger, r.entity, r.affected, r.action) for r in cascade.report(old, new, n, e).collect()}
    assert got == {("entity_renamed", "A", "other", "update_reference"), ("entity_deleted", "B", "other", "review_content")}
    assert cascade.deletion_impact(n, e, spark.createDataFrame([("d",)], "path string")).first().affected == "other"
    assert cascade.renames(old, old).count() == cascade.deletions(old, old).count() == 0


def test_validation(spark):
    n = nodes(spark, ("Document", "ok", '{"title":null,"contentHash":"x","summary":"","created":1,"updated":1,"status":1}'), ("Document", "bad", '{"name":"x"}'), ("Tool", "t", '{"description":""}'), ("Tool", "broken", "{"), ("Tool", "none", None), ("Tool", "fine", '{"description":"d"}'))
    got = {(r.name, r.field, r.type) for r in validate.issues(n).collect()}
    assert got == {("bad", "name", "warning"), ("bad", "title", "error"), ("bad", "contentHash", "error"), *(("bad", f, "warning") for f in ("summary", "created", "updated", "status")), ("t", "description", "error"), ("broken", "properties", "error"), ("none", "properties", "error")}
    s = validate.stats(n).first()
    assert (s.total_nodes, s.documents_checked, s.entities_checked, s.errors_found, s.warnings_found, s.valid) == (6, 2, 2, 5, 5, False)
    assert validate.document(n, "zz").first().message == "Document not found in graph" and validate.document(n, "ok").count() == 0


def test_topics(spark):
    n = nodes(spark, ("Document", "/docs/ai-tools/README.md", '{"summary":"a|b\\nc"}'), ("Document", "/docs/x/readme.md", "{}"), ("Document", "/docs/x/y/README.md", "{}"), ("Document", "/docs/zed/README.md", '{"title":"","domain":"dev-API"}'))
    found = topics.topics(n)
    assert [(r.slug, r.title, r.domain) for r in found.collect()] == [("ai-tools", "AI Tools", "uncategorized"), ("zed", "Zed", "dev-API")]
    page = topics.page(found, "2024-01-02")
    assert page.index("## Dev API") < page.index("## Uncategorized") and "| [ai-tools](./ai-tools/readme) | a\\|b c |" in page


def test_questions(spark):
    n = nodes(spark, ("Question", "q1", '{"createdAt":"2024-01-02T00:00:00Z"}'), ("Question", "q2", "{}"), ("Question", "q3", "{}"), ("Document", "d"))
    links = lookup.link_answers(n, spark.createDataFrame([("q3", "d")], "question string, document string"))
    assert [r.question for r in lookup.unanswered(n, links).collect()] == ["q1", "q2"]
    with pytest.raises(Exception, match="not found"):
        lookup.link_answers(n, spark.createDataFrame([("q1", "zz")], "question string, document string")).collect()


def seeded(seed, n=512):
    return [math.sin(seed * (i + 1) * 0.01) for i in range(n)]


def test_search(spark):
    rows = [("Document", "doc1.md", seeded(1)), ("Document", "doc2.md", seeded(2)), ("Document", "doc3.md", seeded(3)), ("Technology", "tech", seeded(1.1)), ("Document", "zero", [0.0] * 512), ("Document", "short", [1.0]), ("Document", "none", None)]
    n = spark.createDataFrame(rows, "label string, name string, embedding array<float>").withColumn("properties", F.lit('{"title":"T","description":"D"}'))
    got = search.nearest(n, seeded(1), 10, "Document").collect()
    assert got[0].name == "doc1.md" and got[0].score > got[1].score and {r.name for r in got[3:]} == {"zero", "short"} and got[3].score is None
    assert {r.label for r in search.nearest(n, seeded(1), 2).collect()} == {"Document", "Technology"}
    assert search.rendered(search.nearest(n, seeded(1), 2)).first().description is None
    with pytest.raises(ValueError):
        search.limited(0)
    assert search.limited(None) == 20 and search.limited(1000) == 100
    many = n.select(F.monotonically_increasing_id().alias("id"), "embedding")
    ids = n.withColumn("id", F.when(F.col("name") == "doc1.md", 1).when(F.col("name") == "tech", 2).when(F.col("name") == "doc2.md", 3).otherwise(9)).select("id", "embedding")
    best = search.nearest_of_many(ids, ids.where("id IN (1, 3)"), 1, most=1).collect()
    assert {(r.query, r.id) for r in best} == {(1, 2), (3, 2)} or {(r.query, r.id) for r in best if r.query == 1} == {(1, 2)}
    assert search.nearest_of_many(many, many.limit(0)).count() == 0


def test_index_recall(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    import os

    if not os.path.exists(path):
        pytest.skip("no test tables")
    base = spark.read.parquet(path).select(F.col("vec_id").alias("id"), "embedding")
    asked = base.where("id % 100 = 0")
    exact = {(r.query, r.id) for r in search.nearest_of_many(base, asked).collect()}
    found = {(r.query, r.id) for r in search.nearest_by_index(base, asked).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_mock_embedding(spark):
    def model(s, dim):
        h = 0
        for c in s.encode("utf-16-le")[::1] and [int.from_bytes(s.encode("utf-16-le")[k : k + 2], "little") for k in range(0, len(s.encode("utf-16-le")), 2)]:
            h = (31 * h + c + 2**31) % 2**32 - 2**31
        raw = []
        for i in range(dim):
            x = (h * (i + 1) + 2**31) % 2**32 - 2**31 ^ 31 * i
            raw.append((int(math.fmod(x, 2000)) - 1000) / 1000)
        n = math.sqrt(sum(x * x for x in raw))
        return [x / n for x in raw]

    texts = ["hello", "ünïcode é", "emoji 😀", "TypeScript"]
    df = spark.createDataFrame([(x,) for x in [*texts, " ", None]], "text string")
    got = {r.text: r.embedding for r in embedding.embedded(df, embedding.provider("mock", 1536)).collect()}
    assert set(got) == set(texts)
    for x in texts:
        assert max(abs(a - b) for a, b in zip(got[x], model(x, 1536), strict=True)) < 1e-6
    with pytest.raises(ValueError):
        embedding.provider("nomic", 3)


def test_http_provider(spark):
    def post(url, headers, body):
        return {"data": [{"index": k, "embedding": [float(len(x)), 0.0]} for k, x in reversed(list(enumerate(body["input"])))]}

    df = spark.createDataFrame([("a",), ("bbb",)], "text string")
    got = {r.text: r.embedding[0] for r in embedding.embedded(df, embedding.http("voyage", "k", "m", batch=1, post=post)).collect()}
    assert got == {"a": 1.0, "bbb": 3.0}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    s = F.lit
    assert one(t.title_of(s("x\n# Hello  world\n"), s("/a/b.md"))) == "Hello  world" and one(t.title_of(s("no"), s("/a/b.md.md"))) == "b.md"
    assert [one(t.valid_date(s(x))) for x in ("2024-02-29", "2025-02-29", "2025-02-30", "x", "2024-2-1")] == [True, False, False, False, False]
    assert [one(t.needs_quotes(s(x))) for x in ("", " a", "a: b", "-x", "Yes", "plain", "a-b")] == [True, True, True, True, True, False, False]
    assert [one(t.stripped_link(s(x))) for x in ("a.md", "https://x/a.md", "//x/a.md", "a.html")] == ["a", "https://x/a.md", "//x/a.md", "a.html"]
    assert [one(t.inside(s(x), "/docs/")) for x in ("/docs", "/docs/", "/docs/a", "/docs-other")] == [True, True, True, False]
    assert one(t.resolved_path(s("./a.md"), "/docs/")) == "/docs/a.md" and one(t.relative_path(s("/docs/a.md"), "/docs")) == "a.md"
    assert len(one(t.truncated_summary(s("x" * 101)))) == 100 and one(t.trigger_label(s("entity_renamed"))) == "Entity Renamed"
    assert one(vec.parse_vector(s("<1, 2.5>"))) == [1.0, 2.5] and one(vec.parse_vector(s("<1, x>"))) is None and one(vec.parse_vector(s("1"))) is None


def test_import(spark):
    dump = spark.createDataFrame([("1", "Tool", "A", None, "<1, 2>"), ("2", "", "B", "{}", "<1>"), ("3", "Tool", None, None, None)], "id string, label string, name string, properties string, vector string")
    n = exports.imported_nodes(dump, 2)
    assert {(r.label, r.name, r.embedding is None) for r in n.collect()} == {("Tool", "A", False), ("Unknown", "B", True)}
    e = spark.createDataFrame([("1", "USES", "2", None), ("1", "USES", "3", None), ("9", "USES", "1", None)], "source_id string, relation string, target_id string, properties string")
    assert [(r.source_name, r.target_label) for r in exports.resolved_edges(e, n).collect()] == [("A", "Unknown")]
    assert schema.EDGE_KEY[2] == "relation_type"
