"""Paths in the graph: patterns of labelled steps, and shortest paths.

Vertices are (label, name). A pattern is compiled to one equi-join a step; a step of bounded length is the union of its
lengths. Shortest paths go in rounds: only vertices that were reached in the last one are joined with the edges, a vertex keeps
its first distance and its least parent, each round is a stored table. Edges of hubs are dealt to several tasks by a hash of their
other end, and the frontier's rows of hubs go to each of these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import kept


@dataclass(frozen=True)
class Step:
    """One step of a pattern: `least` to `most` edges of a relation (any if None) along their direction (or against it), to a vertex
    of a label (any if None); where: a further condition on the vertex reached, over label and name."""

    relation: str | None = None
    label: str | None = None
    against: bool = False
    least: int = 1
    most: int = 1
    where: Column | None = None


def _edges(edges: DataFrame, relation: str | None = None, against: bool = False) -> DataFrame:
    own = edges if relation is None else edges.where(F.col("relation_type") == relation)
    a, b = ("target", "source") if against else ("source", "target")
    return own.select(F.struct(F.col(f"{a}_label").alias("label"), F.col(f"{a}_name").alias("name")).alias("a"), F.struct(F.col(f"{b}_label").alias("label"), F.col(f"{b}_name").alias("name")).alias("b")).distinct()


def _fits(step: Step, at: str) -> Column:
    return F.lit(True) if step.label is None else F.col(f"{at}.label") == step.label


def match(edges: DataFrame, start: DataFrame, steps: list[Step]) -> DataFrame:
    """Paths from the vertices of start (label, name) that go by the steps: columns v0, v1, ... (label, name), the vertex after each step,
    and edges (how many there are on the path). Paths that differ only inside a step of several edges are one row a length."""
    out = start.select(F.struct("label", "name").alias("v0"), F.lit(0).alias("edges")).distinct()
    for k, step in enumerate(steps, 1):
        if not 1 <= step.least <= step.most:
            raise ValueError("a step has one edge at least and a bounded length")
        hop = _edges(edges, step.relation, step.against)
        last, reached = f"v{k - 1}", None
        front = out.select("*", F.col(last).alias("__m"))
        for length in range(1, step.most + 1):
            front = front.join(hop.withColumnRenamed("a", "__m"), "__m").drop("__m").withColumnRenamed("b", "__m").withColumn("edges", F.col("edges") + 1)
            if step.most > 1:
                front = front.distinct()
            if length >= step.least:
                reached = front if reached is None else reached.unionByName(front)
        out = reached.where(_fits(step, "__m")).withColumnRenamed("__m", f"v{k}")
        if step.where is not None:
            out = out.select("*", f"v{k}.label", f"v{k}.name").where(step.where).drop("label", "name")
    return out.select(*(f"v{k}" for k in range(len(steps) + 1)), "edges")


def shortest(edges: DataFrame, start: DataFrame, *, directed: bool = True, most: int | None = None, hub: int = 100_000) -> DataFrame:
    """From every vertex of start to all it reaches: start, vertex, distance (0 for itself) and parent (the vertex before it on a
    shortest path, the least by label and name; null for itself). most: the longest distance to look at; None: until nothing new is
    reached. hub: a vertex with more edges than this is dealt to several tasks."""
    hop = _edges(edges)
    if not directed:
        hop = hop.unionByName(_edges(edges, against=True)).distinct()
    fans = kept(hop.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("fan")).where("fan > 1"), "hubs")
    salted = hop.join(fans, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("fan", F.lit(1))).cast("int")).drop("fan")
    hop = kept(salted, "hops")
    seen = kept(start.select(F.struct("label", "name").alias("start")).distinct().select("start", F.col("start").alias("vertex"), F.lit(0).alias("distance"), F.lit(None).cast("struct<label:string,name:string>").alias("parent")), "reached")
    front, turn, out = seen, 0, seen
    while not front.isEmpty() and (most is None or turn < most):
        turn += 1
        near = front.select("start", F.col("vertex").alias("a")).join(fans, "a", "left")
        near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1))).drop("fan")
        found = near.join(hop, ["a", "salt"]).groupBy("start", F.col("b").alias("vertex")).agg(F.min("a").alias("parent"))
        new = found.join(out.select("start", "vertex"), ["start", "vertex"], "left_anti").select("start", "vertex", F.lit(turn).alias("distance"), "parent")
        front = kept(new, "reached")
        out = out.unionByName(front)
    return out


def routes(reached: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shortest path itself of wanted (start, vertex) pairs of `shortest`'s rows: start, vertex, distance, path (vertices from start on)."""
    facts = kept(reached, "reached")
    own = facts.join(wanted.select("start", "vertex").distinct(), ["start", "vertex"])
    walk = own.select("start", F.col("vertex").alias("end"), "distance", F.col("parent").alias("vertex"), F.array("vertex").alias("path"))
    done = None
    while True:
        walk = kept(walk, "walks")
        full = walk.where("vertex IS NULL").select("start", F.col("end").alias("vertex"), "distance", "path")
        done = full if done is None else done.unionByName(full)
        walk = walk.where("vertex IS NOT NULL")
        if walk.isEmpty():
            return done
        step = facts.select("start", "vertex", F.col("parent").alias("__p"))
        walk = walk.join(step, ["start", "vertex"]).select("start", "end", "distance", F.col("__p").alias("vertex"), F.concat(F.array("vertex"), "path").alias("path"))
