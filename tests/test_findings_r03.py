"""Findings of round 3: totals without pairs, bursts that go on in open windows, contents read where they lie, searches without pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import vectors as vec
from tallyweave.operators import joins
from tallyweave.plans import catalogue, further  # noqa: F401
from tallyweave.plans.views import Views
from tallyweave.session import sized
from tallyweave.sources import markdown
from tallyweave.streaming import ingest


@pytest.mark.parametrize("part", [7, 10_000])
def test_totals_below_are_those_of_all_pairs(spark, part):
    """Equal places, equal bounds, null places, bounds, keys and values; ranges that split keys and runs of equal bounds."""
    r = random.Random(31)
    rows = [(r.choice(["x", "y", "y", None]), r.choice([None, *range(12)]), r.choice([None, 0.1, 0.2, -3.5])) for _ in range(150)]
    asked = [(k, r.choice(["x", "y", "z", None]), r.choice([None, 5, 5, 5, *range(-1, 14)])) for k in range(120)]
    a, b = spark.createDataFrame(asked, "i int, k string, bound int"), spark.createDataFrame(rows, "k string, at int, v double")
    for key in (None, "k"):
        want = {}
        for i, k, bound in asked:
            if bound is not None and (key is None or k is not None):
                own = [v for q, at, v in rows if at is not None and at < bound and (key is None or q == k)]
                some = [v for v in own if v is not None]
                want[i] = (len(own), len(some), round(sum(some), 6) if some else None)
        got = {x.i: (x.n, x.filled, None if x.total is None else round(float(x.total), 6)) for x in joins.totals_below(a, b, "bound", "at", "v", key=key, part=part).collect()}
        assert got == want


@pytest.mark.parametrize("name", ["interval_levels", "theta_grid"])
def test_inequality_queries_make_no_pairs(spark, name):
    """Work follows the rows: nothing but equalities is joined on, and no join has more rows than there are bounds."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__level" not in plan and "__r" not in plan.replace("__row", "") and " < " not in plan


def test_a_burst_that_goes_on_at_the_end_is_not_over(spark, tmp_path):
    """A burst whose last event lies in a window that is still open when the stream ends isn't given; one that ends right at the end is."""
    rows = [("u", "a", 0), ("u", "b", 700), ("w", "a", 700), ("v", "z", 800), ("w2", "a", 0), ("end", "z", 1001)]  # seconds; a gap of 800
    spark.createDataFrame(rows, "k string, path string, s int").select("k", "path", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k string, path string, at timestamp").parquet(f"file://{tmp_path}/in")
    ingest.settled(stream, "at", "800 seconds", key="k").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {(x.k, x.events, tuple(x.paths)) for x in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {("w2", 1, ("a",))}
    rows = [("u", "a", 200.9), ("u", "b", 1000.5), ("end", "z", 1001.0)]
    spark.createDataFrame(rows, "k string, path string, s double").select("k", "path", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"file://{tmp_path}/in2")
    stream = spark.readStream.schema("k string, path string, at timestamp").parquet(f"file://{tmp_path}/in2")
    ingest.settled(stream, "at", "800 seconds", key="k").writeStream.format("parquet").option("path", f"file://{tmp_path}/out2").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out2").count() == 0  # u goes on in the window from 1000 to 1100, which 1001 doesn't close


def test_scan_reads_contents_where_they_lie(spark, tmp_path):
    """Names and bytes as they are on disk (Spark's reader encodes names and leaves out empty files), and no join or sort that contents go through, whatever number of paths is asked for."""
    files = {"a.md": b"A", "x/b c%20d.md": "é".encode(), "x/y/c.md": b"", "x/bad.md": b"\xff\xfe z", "x/no.txt": b"n", "_h.md": b"h", ".h.md": b"h", "_d/e.md": b"h", "node_modules/f.md": b"n", "x/.git/g.md": b"n"}
    for name, content in files.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(content)
    root = f"file://{tmp_path}/t"
    rows = lambda df: {(r.path, bytes(r.c)) for r in df.select("path", F.col("content").cast("binary").alias("c")).collect()}
    want = {(f"{tmp_path}/t/{n}", files[n]) for n in ("a.md", "x/b c%20d.md", "x/y/c.md", "x/bad.md")}
    assert rows(markdown.scan(spark, root)) == want and len(want) == 4
    some = spark.createDataFrame([(f"{tmp_path}/t/a.md",), (f"{tmp_path}/t/a.md",), (f"file://{tmp_path}/t/x/bad.md",), (f"{tmp_path}/t/gone.md",)], "path string")
    found = markdown.scan(spark, root, some)
    assert rows(found) == {(p, c) for p, c in want if p.endswith(("/a.md", "/bad.md"))} and found.count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Repartition")


def test_mock_vectors_hash_a_text_once(spark):
    """The hash of a text stands once in the plan, outside of what is worked out for every element."""
    df = spark.createDataFrame([("abc",), ("",), (None,)], "x string").select(vec.mock_embedding(F.col("x"), 4).alias("e"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("java.util.Objects") <= 1 or df._jdf.queryExecution().optimizedPlan().toString().count("hashCode") == 1
    assert abs(sum(v * v for v in df.first().e) - 1) < 1e-9


def test_mentions_are_made_distinct_as_keys_and_shuffles_follow_the_input(spark, tmp_path):
    """Repeats go before names and JSON are made; a larger input gets more partitions, a small one those of the session."""
    first = Views(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 4
    plan = first.mentions()._jdf.queryExecution().optimizedPlan().toString()
    groups = [line.split("Aggregate [", 1)[1].split("]", 1)[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert len(groups) == 2 and all(len(g.split(",")) == 2 and "properties" not in g for g in groups)
    sized(spark, "/root/testdata/sf0.1", part=1 << 20)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > 30
