"""Joins by grids, levels and ranges of time, path patterns and shortest paths, each against plain Python."""

from __future__ import annotations

import collections
import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import joins, paths, topics


def test_intervals_of_any_length(spark):
    r = random.Random(5)
    points = [(k, r.choice([r.uniform(-1e6, 1e6), r.uniform(-1, 1), float(r.randrange(-8, 8)), None])) for k in range(300)]
    spans = [(k, a, a + r.choice([0.0, -1.0, 1e-9, 0.5, 1.0, 2.0, 4.0, 1e3, 3e6])) for k in range(120) for a in [r.choice([r.uniform(-1e6, 1e6), float(r.randrange(-8, 8))])]] + [(998, None, 1.0), (999, 1.0, None)]
    p, s = spark.createDataFrame(points, "i long, x double"), spark.createDataFrame(spans, "j long, a double, b double")
    want = sorted((i, j) for i, x in points for j, a, b in spans if None not in (x, a, b) and a <= x < b)
    assert len(want) > 500 and sorted((y.i, y.j) for y in joins.in_interval(p, s, "x", "a", "b").collect()) == want
    assert joins.in_interval(p, s.limit(0), "x", "a", "b").count() == 0 == joins.in_interval(p.limit(0), s, "x", "a", "b").count()
    # a long interval is a row or three, not one a bin
    rows = joins.in_interval(p, s, "x", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in rows


def test_intervals_of_times(spark):
    at = datetime.datetime(2024, 1, 1)
    span = [(k, at + datetime.timedelta(hours=k), at + datetime.timedelta(hours=k, seconds=3**k)) for k in range(12)]
    point = [(k, at + datetime.timedelta(minutes=17 * k)) for k in range(100)]
    want = sorted((i, j) for i, x in point for j, a, b in span if a <= x < b)
    for kind in ("timestamp", "timestamp_ntz"):
        got = joins.in_interval(spark.createDataFrame(point, f"i long, x {kind}"), spark.createDataFrame(span, f"j long, a {kind}, b {kind}"), "x", "a", "b")
        assert sorted((y.i, y.j) for y in got.collect()) == want
    days = spark.createDataFrame([(1, datetime.date(2024, 1, 1), datetime.date(2024, 3, 1))], "j long, a date, b date")
    assert joins.in_interval(spark.createDataFrame([(datetime.date(2024, 2, 29),), (datetime.date(2024, 3, 1),)], "x date"), days, "x", "a", "b").count() == 1


def test_overlapping(spark):
    r = random.Random(6)
    make = lambda n: [(k, a, a + r.choice([0, 1, 2, 7, 300])) for k in range(n) for a in [r.randrange(100)]]
    a, b = make(60), make(50)
    want = sorted((i, j) for i, s, e in a for j, t, f in b if s < e and t < f and s < f and t < e)
    got = joins.overlapping(spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, t long, f long"), ("s", "t"), ("e", "f"))
    assert sorted((y.i, y.j) for y in got.collect()) == want


def test_grid_of_any_shape(spark):
    left = spark.range(300).select(F.col("id").alias("i"), (F.col("id") % 7).alias("x"))
    right = spark.range(40).select(F.col("id").alias("j"), (F.col("id") % 5).alias("y"))
    want = sorted((i, j) for i in range(300) for j in range(40) if (i % 7) * (j % 5) == 6 or i < j)
    condition = (F.col("x") * F.col("y") == 6) | (F.col("i") < F.col("j"))
    for pairs in (10**9, 3000, 100):
        assert sorted((r.i, r.j) for r in joins.where_pairs(left, right, condition, pairs=pairs).collect()) == want
        assert sorted((r.i, r.j) for r in joins.where_pairs(right, left, condition, pairs=pairs).collect()) == want
    assert joins.where_pairs(left, right.limit(0), condition).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_as_of_with_a_hot_key(spark, parts):
    """Nine of ten rows share a key; rows come from several ranges, with times that tie and nulls."""
    r = random.Random(parts)
    key = lambda: "hot" if r.random() < 0.9 else r.choice(["a", "b", None])
    a = [(k, key(), r.choice([*range(200), None])) for k in range(500)]
    b = [(key(), r.randrange(0, 200, 3), r.choice([None, *range(5)])) for _ in range(120)]
    for strict in (False, True):
        got = joins.as_of(spark.createDataFrame(a, "i long, k string, t long"), spark.createDataFrame(b, "k string, t long, v long"), "k", "t", ["v"], strict=strict, parts=parts)
        want = []
        for i, k, t in a:
            before = [(s, -1 if v is None else v) for q, s, v in b if k is not None and q == k and t is not None and (s < t or (s == t and not strict))]
            v = max(before)[1] if before else None
            want.append((i, None if v == -1 else v))
        assert sorted((x.i, x.last_v) for x in got.collect()) == sorted(want)


def test_as_of_deals_a_hot_key_evenly(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"), (F.col("id") % 2).alias("side"))
    dealt = rows.repartitionByRange(8, "k", "t").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.n for r in dealt) <= 2 * statistics.median(r.n for r in dealt)
    got = joins.as_of(rows.where("side = 1").select("k", "t"), rows.where("side = 0").withColumn("v", F.col("t")), "k", "t", ["v"], parts=8)
    assert got.where("k = 0 AND last_v != t - 1 AND (t % 10 != 9) AND last_v != t - 1").where("t - last_v > 2").count() == 0


EDGES = "source_label string, source_name string, relation_type string, target_label string, target_name string"


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(9)
    rows = [(r.choice("AB"), f"n{r.randrange(40)}", r.choice(["R", "S"]), r.choice("AB"), f"n{r.randrange(40)}") for _ in range(110)]
    rows += [("A", "hub", "R", "B", f"n{k}") for k in range(40)] + rows[:5]
    return rows, spark.createDataFrame(rows, EDGES).repartition(4)


def test_patterns(spark, graph):
    rows, edges = graph
    start = spark.createDataFrame([("A", "hub"), ("A", "n1"), ("A", "n1"), ("B", "none")], "label string, name string")
    hop = {(a, b, t, c, d) for a, b, t, c, d in rows}
    want = set()
    for s in (("A", "hub"), ("A", "n1")):
        one = {(s, (c, d)) for a, b, t, c, d in hop if (a, b) == s and t == "R"}
        reach = {(s, x, 1) for _, x in one} | {(s, (c, d), 2) for _, x in one for a, b, t, c, d in hop if (a, b) == x and t == "R"}
        reach = {(s, x, n) for s, x, n in reach if x[0] == "B"}
        want |= {(s, x, (a, b), n + 1) for s, x, n in reach for a, b, t, c, d in hop if (c, d) == x and b != "n3"}
    got = paths.match(edges, start, [paths.Step("R", "B", most=2), paths.Step(against=True, where=F.col("name") != "n3")])
    assert {(tuple(x.v0), tuple(x.v1), tuple(x.v2), x.edges) for x in got.collect()} == want and got.count() == len(want)
    with pytest.raises(ValueError):
        paths.match(edges, start, [paths.Step(most=0)])


@pytest.mark.parametrize(("directed", "most"), [(True, None), (False, 3)])
def test_shortest_paths(spark, graph, directed, most):
    rows, edges = graph
    near = collections.defaultdict(set)
    for a, b, _, c, d in rows:
        near[a, b].add((c, d))
        if not directed:
            near[c, d].add((a, b))
    want = {}
    for s in (("A", "hub"), ("B", "n2"), ("A", "nowhere")):
        dist, turn = {s: (0, None)}, [s]
        while turn and (most is None or dist[turn[0]][0] < most):
            new = {}
            for x in turn:
                for y in near[x]:
                    if y not in dist:
                        new[y] = min(new.get(y, x), x)
            dist |= {y: (dist[x][0] + 1, x) for y, x in new.items()}
            turn = sorted(new)
        want |= {(s, y): d for y, d in dist.items()}
    start = spark.createDataFrame([("A", "hub"), ("B", "n2"), ("A", "nowhere"), ("B", "n2")], "label string, name string")
    reached = paths.shortest(edges, start, directed=directed, most=most, hub=5)
    got = {(tuple(x.start), tuple(x.vertex)): (x.distance, tuple(x.parent) if x.parent else None) for x in reached.collect()}
    assert got == want and len(want) > 40
    for x in paths.routes(reached, reached.select("start", "vertex")).collect():
        path = [tuple(y) for y in x.path]
        assert path[0] == tuple(x.start) and path[-1] == tuple(x.vertex) and len(path) == x.distance + 1
        assert all(b in near[a] for a, b in zip(path, path[1:]))


def test_numbered_in_reading_order(spark):
    names = ["Zeta", "api", "API", "éclair", "eclair", "Eclipse", "zeta", "", None, "äpfel", "apfel", "api"]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    rows = topics.numbered(df, "place", *topics.reading_order("name")).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 13))
    assert [r.name for r in rows] == [None, "", "apfel", "äpfel", "api", "api", "API", "eclair", "éclair", "Eclipse", "zeta", "Zeta"]
    swedish = [r.name for r in df.where("name LIKE '%pfel'").orderBy(*topics.reading_order("name", "sv")).collect()]
    assert swedish == ["apfel", "äpfel"]
    alike = {r["first"]: (r.texts, r.rows) for r in topics.grouped_as_read(df, "name").collect()}
    assert alike["API"] == (2, 3) and alike["Zeta"] == (2, 2) and alike["eclair"] == (1, 1)
