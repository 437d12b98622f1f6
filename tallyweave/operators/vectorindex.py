"""A kept index of vectors: inverted lists with product quantisation.

Centroids and code books are fitted by k-means on at most SAMPLE rows (the least hashes of their ids). Every row is
assigned to its nearest centroid and stored as a list number and a code of one byte per part of the vector; new rows are
added with the same model, without a rebuild. A search reads the codes of the lists nearest to a query, scores them by
tables of its distances to the code books, and scores the best of them exactly. How many lists that takes is measured on
the sample when the index is fitted, as data without clusters need many and clustered data few.

Vectors are compared by cosine: all are brought to length one. Rows whose vector is null, of another length, zero or not
finite, and rows without an id, are not indexed. Equal scores go by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions.vectors import cosine_similarity
from tallyweave.operators.search import _matrix
from tallyweave.session import kept

SAMPLE = 20_000  # rows that a model is fitted on
_BLOCK = 50_000  # codes that one task scores at once


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm from evenly spread rows; a centre that loses all its rows takes the row farthest from its own."""
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(x))
    centres = x[order[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if not full.all():
            far = np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable")[: int((~full).sum())]
            centres[~full] = x[far]
    return centres


@dataclass
class Model:
    """centres of the lists; books (parts, 256 at most, dim of a part) of what a vector differs by from its centre; lists a search probes."""

    centres: np.ndarray
    books: np.ndarray
    probe: int

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(unit, self.centres)
        rest = (unit - self.centres[own]).reshape(len(unit), len(self.books), -1)
        return own.astype(np.int32), np.stack([_nearest(rest[:, p], book) for p, book in enumerate(self.books)], 1).astype(np.uint8)

    def scores(self, query: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """The query's cosine with what the codes of one list stand for."""
        table = np.einsum("pkd,pd->pk", self.books, query.reshape(len(self.books), -1))
        return query @ self.centres[own] + table[np.arange(len(self.books)), codes].sum(1)


def fit(vectors: DataFrame, *, lists: int | None = None, parts: int = 16, target: float = 0.95, k: int = 10) -> Model:
    """A model of vectors (id, embedding) of one length. lists: about the root of the rows, 4,096 at most. probe is the least number of lists
    that hold `target` of the k nearest of sampled rows among the sample."""
    own = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding")
    n = own.count()
    rows = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not n:
        raise ValueError("no vectors to fit an index on")
    sizes = [len(x) for x in rows.column("embedding").to_pylist()]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s))
    if dim % parts:
        parts = math.gcd(dim, parts)
    x, _ = _matrix(rows.column("embedding").combine_chunks(), dim)
    if not len(x):
        raise ValueError("no vectors that have a length")
    lists = min(lists or max(1, round(math.sqrt(n))), 4096, len(x))
    centres = k_means(x, lists)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
    books = [k_means(rest[:, p], min(256, len(x))) for p in range(parts)]
    model = Model(centres, np.stack(books), lists)
    asked = x[: min(256, len(x))]
    s = asked @ x.T
    s[np.arange(len(asked)), np.arange(len(asked))] = -2  # not itself
    best = np.argpartition(-s, min(k, len(x)) - 1, axis=1)[:, : min(k, len(x) - 1)] if len(x) > 1 else np.zeros((1, 0), int)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # each list's turn for each query
    turns = np.sort(np.take_along_axis(place, _nearest(x, centres)[best], 1).ravel())
    if len(turns):
        model.probe = int(turns[min(len(turns) - 1, math.ceil(target * len(turns)) - 1)]) + 1
    return model


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """One row beside an index, so that rows can be added and searches run in other sessions."""
    row = (model.centres.astype("<f8").tobytes(), model.dim, model.books.astype("<f8").tobytes(), *model.books.shape[:2], model.probe)
    spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in row)], "centres binary, dim int, books binary, parts int, entries int, probe int").write.parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(path).first()
    return Model(np.frombuffer(bytes(r.centres), "<f8").reshape(-1, r.dim), np.frombuffer(bytes(r.books), "<f8").reshape(r.parts, r.entries, -1), r.probe)


def build(vectors: DataFrame, model: Model) -> DataFrame:
    """id, list, code of every row that can be compared. For new rows as well: append them to what is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, own = _matrix(batch.column(1), model.dim)
            if len(own):
                where, codes = model.encode(unit)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(where), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

    base = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    return base.mapInArrow(run, "id bigint, list int, code binary")


def save(index: DataFrame, path: str, *, add: bool = False) -> None:
    """One folder a list, so that a search reads the lists it probes only; a large list is several files."""
    index.hint("rebalance", "list").write.partitionBy("list").mode("append" if add else "errorifexists").parquet(path)


def search(index: DataFrame, model: Model, vectors: DataFrame, queries: DataFrame, k: int = 10, *, probe: int | None = None, exact: int = 64) -> DataFrame:
    """Per query (id, embedding) the k best of vectors, itself left out: query, id, score, rank. Of the codes in the probed lists the
    `exact` best are scored by their vectors.

    Queries are dealt to their lists, and long lists and many queries to blocks; a task folds what it scores to the best of each query.
    """
    probe = min(probe or model.probe, len(model.centres))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, own = _matrix(batch.column(1), model.dim)
            if len(own):
                near = unit @ model.centres.T
                lists = np.argpartition(-near, probe - 1, axis=1)[:, :probe].astype(np.int32)
                ids = np.repeat(batch.column(0).to_numpy()[own], probe)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lists.ravel()), pa.array(np.repeat(unit, probe, 0).tolist(), pa.list_(pa.float64()))], names=["query", "list", "unit"])

    def scored(codes: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if codes.num_rows and asked.num_rows:
            ids = codes.column("id").to_numpy()
            bytes_ = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            own = codes.column("list")[0].as_py()
            for query, unit in zip(asked.column("query").to_pylist(), asked.column("unit").to_pylist(), strict=True):
                s = np.round(model.scores(np.array(unit), own, bytes_), 9)
                best = np.lexsort((ids, -s))[: exact + 1]
                out.append((np.full(len(best), query, np.int64), ids[best], s[best]))
        q, i, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "near": pa.array(s, pa.float64())})

    base = queries.where("id IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    asked = kept(base.mapInArrow(places, "query bigint, list int, unit array<double>"), "asked")
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("blocks"))
    turns = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / 2048).cast("int").alias("turns"))
    both = F.broadcast(kept(sizes.join(turns, "list"), "blocks"))  # 4,096 lists at most
    part = lambda column, of: F.pmod(F.xxhash64(column), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = index.join(both, "list").select("id", "list", "code", part("id", "blocks").alias("b"), every("turns").alias("t"))
    right = asked.join(both, "list").select("query", "list", "unit", part("query", "turns").alias("t"), every("blocks").alias("b"))
    key = ["list", "b", "t"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(scored, "query bigint, id bigint, near double")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "id"))
    chosen = found.where("query != id").withColumn("turn", first).where(F.col("turn") <= exact).select("query", "id")
    vector = lambda df, name, v: df.select(F.col("id").cast("long").alias(name), F.col("embedding").cast("array<double>").alias(v))
    pairs = chosen.join(vector(queries, "query", "q"), "query").join(vector(vectors, "id", "v"), "id")
    ranked = pairs.select("query", "id", F.round(cosine_similarity(F.col("q"), F.col("v")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k)
