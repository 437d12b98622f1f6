"""The kept vector index, mergeable sketches, functions for SQL, the dump parser, the tree source and the state of streams."""

from __future__ import annotations

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import registered
from tallyweave.functions import text as t
from tallyweave.functions import vectors as vec
from tallyweave.operators import search, sketches, vectorindex
from tallyweave.sources import exports, extraction, sinks, tree
from tallyweave.streaming import ingest

# ------------------------------------------------------------------ vectors


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((30, 32))
    rows = [(k, (centres[k % 30] + 0.4 * r.standard_normal(32)).tolist()) for k in range(3000)]
    rows += [(9000, None), (9001, [0.0] * 32), (9002, [1.0] * 5), (9003, [math.nan] * 32), (None, [1.0] * 32)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4).cache()


def test_index_recall_and_share(spark, clustered, tmp_path):
    """Fitted on half the rows, the rest added later: recall at 10 over 0.9 while few lists are probed and few vectors compared."""
    at = f"file://{tmp_path}"
    old, new = clustered.where("id % 2 = 0 OR id IS NULL"), clustered.where("id % 2 = 1")
    model = vectorindex.fit(old)
    vectorindex.save(vectorindex.build(old, model), f"{at}/lists")
    vectorindex.save_model(spark, model, f"{at}/model")
    again = vectorindex.load_model(spark, f"{at}/model")
    assert np.array_equal(again.centres, model.centres) and np.array_equal(again.books, model.books) and again.probe == model.probe
    before = spark.read.parquet(f"{at}/lists").count()
    vectorindex.save(vectorindex.build(new, again), f"{at}/lists", add=True)
    index = spark.read.parquet(f"{at}/lists")
    assert before == 1500 and index.count() == 3000 == index.select("id").distinct().count()
    asked = clustered.where("id % 100 = 0 OR id > 8999")
    got = vectorindex.search(index, again, clustered, asked, 10, exact=60).collect()
    want = {(r.query, r.id): r.score for r in search.nearest_of_many(clustered, asked, 10).collect()}
    hit = [r for r in got if (r.query, r.id) in want]
    assert len(want) == 300 and len(hit) / len(want) >= 0.9 and all(r.score == pytest.approx(want[r.query, r.id]) for r in hit)
    scored = index.where(F.col("list").isin(list(range(len(model.centres))))).groupBy("list").count().agg(F.max("count")).first()[0] * model.probe
    assert model.probe <= len(model.centres) // 4 and scored < 3000 and 60 / 3000 < 0.1
    assert [r.rank for r in sorted(got, key=lambda r: (r.query, r["rank"])) if r.query == 0] == list(range(1, 11))


def test_index_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    with pytest.raises(ValueError):
        vectorindex.fit(empty)
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, embedding array<float>")
    model = vectorindex.fit(one)
    index = vectorindex.build(one.unionByName(spark.createDataFrame([(2, [2.0, 4.0, 6.1]), (3, [1.0])], "id long, embedding array<float>")), model)
    got = vectorindex.search(index, model, one.unionByName(spark.createDataFrame([(2, [2.0, 4.0, 6.1])], "id long, embedding array<float>")), one, 5).collect()
    assert [(r.query, r.id, r["rank"]) for r in got] == [(1, 2, 1)] and index.count() == 2


@pytest.mark.parametrize("most", [64 << 20, 4000])
def test_many_queries_fold_once_a_task(spark, clustered, most):
    """The same rows whether queries are sent or dealt in blocks; a task gives k rows a query, not k a batch."""
    asked = clustered.where("id % 60 = 0")
    rows = {r.id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in clustered.where("id < 9000").collect()}
    want = {q: sorted(((-round(float(rows[q] @ v), 9), i) for i, v in rows.items() if i != q))[:3] for q in rows if q % 60 == 0}
    got = search.nearest_of_many(clustered, asked, 3, most=most, part=700).collect()
    assert {(r.query, r["rank"]): r.id for r in got} == {(q, k + 1): i for q, best in want.items() for k, (_, i) in enumerate(best)}
    batches = list(search._folded(iter(clustered.where("id < 9000").select("id", "embedding").toArrow().to_batches(max_chunksize=100)), np.array([0, 1]), np.stack([rows[0], rows[1]]), 4))
    assert sum(b.num_rows for b in batches) == 8
    of = search.nearest_of_many(clustered.withColumn("g", F.col("id") % 2), asked.where("id < 200"), 2, of="g", most=most).collect()
    assert {(r.query, r.g, r["rank"]) for r in of} == {(q, g, k) for q in range(0, 200, 60) for g in (0, 1) for k in (1, 2)}


# ------------------------------------------------------------------ sketches


def test_sketches_merge(spark):
    r = random.Random(2)
    rows = [(d, r.choice("xyz"), r.randrange(4000), r.paretovariate(1.5), r.choice("aaaabbc")) for d in range(6) for _ in range(3000)] + [(0, "x", None, None, None)]
    df = spark.createDataFrame(rows, "day int, kind string, who int, size double, what string")
    stored = sketches.sketched(df, ["day", "kind"], distinct="who", quantiles="size", frequent="what")
    whole = sketches.estimates(sketches.rolled_up(stored, []), at=(0.1, 0.9), top=2).first()
    sizes = sorted(x[3] for x in rows if x[3] is not None)
    exact = len({x[2] for x in rows if x[2] is not None})
    assert whole.rows == len(rows) and abs(whole.distinct_count - exact) <= 3 * 0.01625 * exact
    for at, got in zip((0.1, 0.9), whole.quantiles, strict=True):
        assert abs(sum(x <= got for x in sizes) / len(sizes) - at) < 0.02
    assert [(x["item"], x["count"]) for x in whole.frequent] == [(w, sum(x[4] == w for x in rows)) for w in "ab"]
    cells = sketches.estimates(sketches.cube(stored, ["day", "kind"])).collect()
    assert len(cells) == 7 * 4
    for c in cells:
        own = [x for x in rows if c.day in (None, x[0]) and c.kind in (None, x[1])]
        n = len({x[2] for x in own if x[2] is not None})
        assert c.rows == len(own) and abs(c.distinct_count - n) <= max(1, 3 * 0.01625 * n)
    assert sketches.rolled_up(stored.where("day > 99"), ["kind"]).count() == 0


# ------------------------------------------------------------------ functions for SQL


def test_sql_functions_mean_what_columns_mean(spark):
    assert set(registered.register(spark)) == {*registered.SCALARS, "tw_entities"}
    rows = [("/x/docs/my-api/README.md", "# Head line\nx", [1.0, 2.0], [2.0, 4.0]), ("/docs/readme.md", "no\n# Later", [0.0, 0.0], [1.0, 1.0]), ("a.md.md", None, [1.0], [1.0, 2.0]), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "p string, c string, a array<double>, b array<double>")
    df.createOrReplaceTempView("__f")
    got = spark.sql("SELECT tw_slug(p) AS s, tw_slug_title(tw_slug(p)) AS st, tw_title(c, p) AS t, tw_cosine(a, b) AS cos, tw_norm(a) AS n, tw_field('{\"k\":\"v\"}', 'k') AS f FROM __f").collect()
    want = df.select(t.slug_of(F.col("p")).alias("s"), t.slug_title(t.slug_of(F.col("p"))).alias("st"), t.title_of(F.col("c"), F.col("p")).alias("t"), vec.cosine_similarity(F.col("a"), F.col("b")).alias("cos"), vec.norm(F.col("a")).alias("n"), F.lit("v").alias("f")).collect()
    key = lambda r: tuple(None if x is None else x if isinstance(x, str) else round(x, 9) for x in r)
    assert [key(r)[:2] + key(r)[3:] for r in got] == [key(r)[:2] + key(r)[3:] for r in want]
    assert [r.t for r in got][:2] == [r.t for r in want][:2]


def test_entities_in_sql_are_those_of_the_extractor(spark):
    registered.register(spark)
    docs = spark.createDataFrame([("a", "# T\n## One ##\n`code` and [[Two|x]] `code`\n```\n## no\n`no`\n```\n### One\n[[ code ]]"), ("b", None), ("c", "nothing"), ("d", "```\n## open")], "path string, content string")
    docs.createOrReplaceTempView("__docs")
    got = {(r.path, r.pos, r.type, r.name) for r in spark.sql("SELECT * FROM tw_entities(TABLE(__docs))").collect()}
    want = {(r.path, k + 1, e["type"], e["name"]) for r in extraction.rule_based(docs).collect() for k, e in enumerate(r.entities)}
    assert got == want and len(got) == 3
    with pytest.raises(Exception, match="path and content"):
        spark.sql("SELECT * FROM tw_entities(TABLE(SELECT 1 AS x))").collect()


# ------------------------------------------------------------------ dumps


def test_dump_parser(spark):
    node = lambda i, labels, props: [[["id", i], ["labels", labels], ["properties", props]]]
    answers = [
        [["n"], [node(1, ["Person", "X"], [["name", "old"], ["name", "Ann"], ["age", 7], ["tags", ["a", 1]], ["embedding", "<1, 2>"]]), node(2, [], [["name", "é\"q'"]]), node(3, ["T"], []), [], "odd", [None]], ["stats"]],
        [["n"], []],
        [["n"]],
    ]
    texts = [(json.dumps(a),) for a in answers] + [("not json",), (None,), ("{}",), ("7",)]
    got = {r.id: r for r in exports.parsed_nodes(spark.createDataFrame(texts, "value string")).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].label, got[1].name, got[1].vector) == ("Person", "Ann", "<1, 2>") and json.loads(got[1].properties) == {"name": "Ann", "age": 7, "tags": ["a", 1]}
    assert (got[2].label, got[2].name) == (None, "é\"q'") and (got[3].name, got[3].properties) == (None, "{}")
    edges = [[["a"], [[1, 2, "KNOWS", [["since", 2020], ["since", 2021]]], [2, 1, "KNOWS", None], [1, 2], [1, 3, "R", []]], []]]
    found = {(r.source_id, r.relation, r.target_id): json.loads(r.properties) for r in exports.parsed_edges(spark.createDataFrame([(json.dumps(a),) for a in edges], "value string")).collect()}
    assert found == {(1, "KNOWS", 2): {"since": 2021}, (2, "KNOWS", 1): {}, (1, "R", 3): {}}
    nodes = exports.imported_nodes(exports.parsed_nodes(spark.createDataFrame(texts, "value string")), 2)
    assert {(r.label, r.name, tuple(r.embedding or ())) for r in nodes.collect()} == {("Person", "Ann", (1.0, 2.0)), ("Unknown", "é\"q'", ())}


# ------------------------------------------------------------------ trees and streams


def test_tree_source(spark, tmp_path):
    tree.register(spark)
    root = tmp_path / "docs"
    for name, text in {"a.md": "A", "x/b.md": "B é", "x/y/c.md": "", "x/skip.txt": "no", "node_modules/d.md": "no", ".git/e.md": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    df = spark.read.format("file_tree").load(f"file://{root}")
    assert {(os.path.relpath(r.path, root), r.change, r.content) for r in df.collect()} == {("a.md", "there", "A"), ("x/b.md", "there", "B é"), ("x/y/c.md", "there", "")}
    assert df.rdd.getNumPartitions() == 3 and spark.read.format("file_tree").load(f"file://{tmp_path}/none").count() == 0
    batches = []

    def run():
        stream = spark.readStream.format("file_tree").option("path", f"file://{root}").option("state", f"file://{tmp_path}/listings").option("content", "true").load()
        batches.clear()
        stream.writeStream.foreachBatch(lambda b, _: batches.append({(os.path.relpath(r.path, root), r.change, r.content) for r in b.collect()})).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return [b for b in batches if b]

    assert run() == [{("a.md", "came", "A"), ("x/b.md", "came", "B é"), ("x/y/c.md", "came", "")}]
    assert run() == []
    (root / "a.md").unlink()
    (root / "x/b.md").write_text("B2 longer")
    (root / "new.md").write_text("N")
    assert run() == [{("a.md", "gone", None), ("x/b.md", "changed", "B2 longer"), ("new.md", "came", "N")}]
    with pytest.raises(Exception, match="state"):
        spark.readStream.format("file_tree").option("path", f"file://{root}").load().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()


def test_results_are_never_cut(spark):
    assert len(json.loads(sinks.result_json(spark.range(2500)))["resultSet"]) == 2500
    with pytest.raises(ValueError, match="json_lines"):
        sinks.result_json(spark.range(11), most=10)


def _files(spark, at, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{at}")


def test_debounce_of_late_and_replayed_input(spark, tmp_path):
    """Many files, events out of order within the allowed lateness, some files twice: the bursts are those of all events at once."""
    r = random.Random(12)
    events, at = [], 1_700_000_000.0
    for k in range(120):
        at += r.choice([1, 2, 5, 9, 40, 90])  # neighbours are some minutes apart at most
        events.append((k, f"p{r.randrange(9)}", at))
    events.append((999, "end", at + 10_000))  # closes all before
    parts = [events[k : k + 15] for k in range(0, 120, 15)]
    for p, q in zip(parts, parts[1:]):  # neighbours change places across files
        p[-1], q[0] = q[0], p[-1]
    files = []
    for p in parts:
        files += [p, p[:4]] if r.random() < 0.5 else [p]
    files.append(events[120:])
    schema = "event long, path string, at double"
    _files(spark, tmp_path / "in", files, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").withColumn("at", F.timestamp_seconds("at"))
    fresh = ingest.once(stream, "event", "at", "10 minutes")
    q = ingest.settled(fresh, "at", "30 seconds", None, shards=3).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True)
    q.start().awaitTermination()
    want, burst = [], []
    for k, path, t_ in sorted(events, key=lambda e: e[2]):
        if burst and t_ - burst[-1][2] >= 30:
            want.append(burst)
            burst = []
        burst.append((k, path, t_))
    got = spark.read.parquet(f"file://{tmp_path}/out").groupBy(F.unix_timestamp("start").alias("s"), F.unix_timestamp("end").alias("e")).agg(F.sum("events").alias("n"), F.array_sort(F.flatten(F.collect_list("paths"))).alias("paths")).collect()
    assert sorted((x.s, x.e, x.n, tuple(x.paths)) for x in got) == sorted((int(b[0][2]), int(b[-1][2]) + 30, len(b), tuple(sorted({p for _, p, _ in b}))) for b in want)
    assert len(want) > 10


def test_stream_join_within_watermarks(spark, tmp_path):
    r = random.Random(13)
    asks = [(r.choice("uvw"), 1_700_000_000.0 + 7 * k) for k in range(60)]
    answers = [(r.choice("uvw"), 1_700_000_000.0 + 11 * k + 3, k) for k in range(40)]
    for k in range(0, 60, 20):
        _files(spark, tmp_path / "a", [asks[k : k + 20]], "u string, asked double")
        _files(spark, tmp_path / "b", [answers[k * 2 // 3 : k * 2 // 3 + 14]], "u string, told double, k long")
    last = [("z", 1_700_100_000.0)]
    _files(spark, tmp_path / "a", [last], "u string, asked double")
    _files(spark, tmp_path / "b", [[("z", last[0][1], 999)]], "u string, told double, k long")
    read = lambda name, schema, c: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}").withColumn(c, F.timestamp_seconds(c))
    used = {(u, a, t_, k) for u, a in asks for w, t_, k in answers[:42] if u == w and a < t_ <= a + 60}
    for how in ("inner", "leftOuter"):
        out = ingest.followed_by(read("a", "u string, asked double", "asked"), read("b", "u string, told double, k long", "told"), "u", ("asked", "told"), "60 seconds", "1000 seconds", how=how)
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out-{how}").option("checkpointLocation", f"file://{tmp_path}/cp-{how}").trigger(availableNow=True).start().awaitTermination()
        got = {(x.u, x.asked.timestamp(), x.told.timestamp() if x.told else None, x.k) for x in spark.read.parquet(f"file://{tmp_path}/out-{how}").collect()}
        alone = {(u, a, None, None) for u, a in asks if not any(x[:2] == (u, a) for x in used)} if how == "leftOuter" else set()
        assert got == used | alone
