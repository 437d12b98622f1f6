"""Near-duplicate vectors by a pivot-permutation index: ordered nearest pivots, inverted pivot lists, verification.

Pivots are at most 16,384 of the different vectors themselves (the least hashes, one for 32 vectors), thinned so that no two have a
cosine of 0.9 or more: a crowd of near copies is then one pivot, not many whose order is noise. Every vector is described by
its `depth` nearest pivots in order, and stands in the inverted list of each of them, within its own group (compared are only vectors of
equal label and length). Two vectors are candidates if they share at least `shared` pivots; of the lists they meet in, the one of their
smallest common pivot counts them. Candidates are verified by cosine in double precision.

Lists are walked twice. First only descriptions travel (some 40 bytes a vector and list), which tells who has a candidate where. Then
vectors travel to just these lists. No pair is ever a row: a list gives each vector's number of links, and of its links a spanning forest.
A list of more than `block` members is dealt to tasks by pairs of blocks, each pair once; no list is capped, so which candidates are
found depends on the pivots alone. With 12 pivots, three of them shared, none of 390,000 simulated pairs right at cosine 0.98 was
missed (64 dimensions, 64 to 16,384 random pivots: a chance below 1e-4 at each size); closer pairs share more.

Equal vectors of a group are one class with a count, all of whose rows are linked. Vectors that are null, empty, zero, or hold null or
non-finite elements link with nothing, and so do rows without a label or an id. Rows that share an id are vectors of their own; each
is linked and counted by itself. An empty table gives no rows. Columns that aren't asked for are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm.neardup import components

MOST_PIVOTS = 16_384


def _packed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, their length, and the print of label and bytes; nulls where a row links with nothing."""
    for batch in batches:
        column = batch.column(2)
        flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(kind, copy=False)
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        dims, z, prints = [], [], []
        for i, label, n, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), size.tolist(), np.cumsum(size).tolist(), strict=True):
            x = flat[end - n : end]
            if i is None or label is None or not n or not np.isfinite(x).all() or not x.any():
                dims.append(None), z.append(None), prints.append(None)
                continue
            dims.append(n), z.append(x.tobytes()), prints.append(hashlib.sha256(label.encode() + b"\0" + z[-1]).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(z, pa.binary()), pa.array(prints, pa.binary())], names=["vec_id", "label", "dim", "z", "print"])


def _units(z: list[bytes], kind: str, dim: int | None = None) -> np.ndarray:
    """Unit vectors as rows, in double precision, cut or filled with zeros to dim. Scaled by the largest element first, so that
    no length overflows."""
    rows = [np.frombuffer(x, kind) for x in z]
    out = np.zeros((len(rows), dim or max(map(len, rows), default=0)))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x[: out.shape[1]]
    out /= np.maximum(np.abs(out).max(1, keepdims=True, initial=0), 1e-300)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


def thinned(unit: np.ndarray, apart: float) -> np.ndarray:
    """unit without the rows whose cosine with a row that stays is `apart` or more."""
    kept = np.zeros_like(unit)
    n = 0
    for at in range(0, len(unit), 512):
        part = unit[at : at + 512]
        part = part[(part @ kept[:n].T < apart).all(1)] if n else part
        own = part @ part.T >= apart
        gone = np.zeros(len(part), bool)
        for k in range(len(part)):
            if not gone[k]:
                gone[k + 1 :] |= own[k, k + 1 :]
        part = part[~gone]
        kept[n : n + len(part)] = part
        n += len(part)
    return kept[:n]


def _described(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, depth: int, kind: str) -> Iterator[pa.RecordBatch]:
    """v, label, dim and the nearest pivots, the nearest first, as 16-bit numbers and as a list."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            near = _units(part.column(3).to_pylist(), kind, pivots.shape[1]) @ pivots.T
            best = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
            order = np.lexsort((best, -np.take_along_axis(near, best, 1)), axis=1)
            prefix = np.take_along_axis(best, order, 1)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in prefix.astype("<u2")], pa.binary()), pa.array(prefix.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["v", "label", "dim", "prefix", "pivots"])


def _alike(a: np.ndarray, b: np.ndarray, own: int, shared: int) -> np.ndarray:
    """Which rows of a and b share `shared` pivots or more and meet for the first time in the list of pivot `own`."""
    n = len(a)
    whole, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    onehot = np.zeros((n + len(b), len(whole)), np.float32)
    np.put_along_axis(onehot, number.reshape(n + len(b), -1), 1.0, 1)
    both = onehot[:n].any(0) & onehot[n:].any(0)
    out = onehot[:n, both] @ onehot[n:, both].T >= shared - 0.5
    sooner = both & (whole < own)
    if sooner.any():
        out &= onehot[:n, sooner] @ onehot[n:, sooner].T < 0.5
    return out


def _sides(left: pa.ListScalar, right: pa.ListScalar) -> Iterator[list[list] | None]:
    """The fields of a block pair's members, as lists; the right side is None where a block meets itself."""
    for side in (left, right):
        yield [x.to_pylist() for x in side.values.flatten()] if len(side) else None


def _prefixes(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<u2").reshape(len(packed), -1).astype(np.int32)


def _candidates(batches: Iterator[pa.RecordBatch], shared: int) -> Iterator[pa.RecordBatch]:
    """(v, label, dim, pivot) of the members that have a candidate in this list."""
    for batch in batches:
        v, rows = [], []
        for k in range(batch.num_rows):
            pivot = batch.column(2)[k].as_py()
            left, right = _sides(batch.column(3)[k], batch.column(4)[k])
            a = _prefixes(left[1])
            hit = _alike(a, a if right is None else _prefixes(right[1]), pivot, shared)
            if right is None:
                np.fill_diagonal(hit, False)
            found = [left[0][i] for i in np.flatnonzero(hit.any(1))] + ([] if right is None else [right[0][j] for j in np.flatnonzero(hit.any(0))])
            v += found
            rows += [k] * len(found)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), *(batch.column(c).take(at) for c in range(3))], names=["v", "label", "dim", "pivot"])


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what all links of a symmetric table hold together."""
    out, todo = [], linked.any(1)
    while todo.any():
        stack = [int(todo.argmax())]
        todo[stack[0]] = False
        while stack:
            x = stack.pop()
            new = np.flatnonzero(linked[x] & todo).tolist()
            todo[new] = False
            out += [(x, y) for y in new]
            stack += new
    return out


def _links(batches: Iterator[pa.RecordBatch], shared: int, cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    """(v, n): to how many rows v is linked in this block pair; and (a, b): a spanning forest of its links."""
    for batch in batches:
        v, n, ends = [], [], ([], [])
        for k in range(batch.num_rows):
            pivot = batch.column(2)[k].as_py()
            left, right = _sides(batch.column(3)[k], batch.column(4)[k])
            other = left if right is None else right
            a, x = _prefixes(left[1]), _units(left[3], kind)
            b, y = (a, x) if right is None else (_prefixes(right[1]), _units(right[3], kind))
            hit = _alike(a, b, pivot, shared) & (x @ y.T >= cosine)
            if right is None:
                hit |= hit.T  # a product of matrices need not be symmetric to the last bit
                np.fill_diagonal(hit, False)
            sums = [(left[0], hit @ np.array(other[2]))] + ([] if right is None else [(right[0], hit.T @ np.array(left[2]))])
            for ids, own in sums:
                some = np.flatnonzero(own)
                v += [ids[i] for i in some]
                n += own[some].tolist()
            whole, ids = hit, left[0]
            if right is not None:
                whole = np.zeros((sum(hit.shape),) * 2, bool)
                whole[: len(hit), len(hit) :], whole[len(hit) :, : len(hit)] = hit, hit.T
                ids = left[0] + right[0]
            for i, j in _forest(whole):
                ends[0].append(ids[i]), ends[1].append(ids[j])
        none = lambda m: [None] * m
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (v + none(len(ends[0])), n + none(len(ends[0])), none(len(v)) + ends[0], none(len(v)) + ends[1])], names=["v", "n", "a", "b"])


_LIST = ["label", "dim", "pivot"]


def _in_blocks(members: DataFrame, fields: list[str], block: int) -> DataFrame:
    """members (v, label, dim, pivot, fields) as lists, or as pairs of blocks of a long list: label, dim, pivot, left, right. Each pair
    of members meets once; right is empty only where a block meets itself (pairs with an empty block are left out)."""
    own = members.withColumn("list", F.xxhash64(*_LIST))  # should two lists ever meet here, both are dealt to more blocks
    counts = own.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    long = _base.staged(counts.where(F.col("n") > block), "lists")
    dealt = _base.looked_up(own, long.select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "list", counts=long)
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("k", F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("k", "with"), "j": F.greatest("k", "with")})
    member = F.struct("v", *fields)
    side = lambda is_left: F.collect_list(F.when((F.col("k") == F.col("i")) == is_left, member))
    return dealt.groupBy(*_LIST, "i", "j").agg(side(True).alias("left"), side(False).alias("right")).where("i = j AND size(left) > 1 OR size(left) > 0 AND size(right) > 0").select(*_LIST, "left", "right")


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98, depth: int = 12, shared: int = 3, most_pivots: int = MOST_PIVOTS, apart: float = 0.9, block: int = 512,
) -> DataFrame:
    """Per row: vec_id, n_links (rows linked with it), component_id (least linked vec_id, its own if none; null for a null id) and
    kept (vec_id is component_id, or null)."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    as_list = "array<float>" if kind == "<f4" else "array<double>"
    one = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(as_list).alias("embedding"))
    rows = _base.staged(one.mapInArrow(lambda it: _packed(it, kind), "vec_id bigint, label string, dim int, z binary, print binary"), "vectors")
    classes = rows.where("print IS NOT NULL").groupBy("print").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("z").alias("z"))
    classes = _base.staged(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("print"), "print").limit(min(most_pivots, max(64, -(-n // 32)))).select("z").collect()
    pivots = thinned(_units([bytes(r.z) for r in sample], kind), apart)
    depth, shared = min(depth, len(pivots)), min(shared, len(pivots))
    if n:
        ahead = classes.select("v", "label", "dim", "z").mapInArrow(lambda it: _described(it, pivots, depth, kind), "v bigint, label string, dim int, prefix binary, pivots array<int>")
        ahead = _base.staged(ahead, "described")
        postings = ahead.select("v", "label", "dim", "prefix", F.explode("pivots").alias("pivot"))
        places = _in_blocks(postings, ["prefix"], block).mapInArrow(lambda it: _candidates(it, shared), "v bigint, label string, dim int, pivot int")
        places = _base.staged(places.distinct(), "places")
        meeting = _base.staged(places.join(ahead.select("v", "prefix"), "v").join(classes.select("v", "size", "z"), "v"), "meeting")
        found = _in_blocks(meeting, ["prefix", "size", "z"], block).mapInArrow(lambda it: _links(it, shared, cosine, kind), "v bigint, n bigint, a bigint, b bigint")
    else:
        found = spark.createDataFrame([], "v bigint, n bigint, a bigint, b bigint")
    found = _base.staged(found, "links")
    links = found.where("v IS NOT NULL").groupBy("v").agg(F.sum("n").alias("n"))
    part = components(found.where("a IS NOT NULL").select("a", "b"))
    part = _base.staged(part.join(classes.select("v", "first"), "v"), "linked")
    least = _base.looked_up(part.select("v", "c"), part.groupBy("c").agg(F.min("first").alias("least")), "c").select("v", "least")
    known = classes.select("v", "print", "first", "size").join(links, "v", "left").join(least, "v", "left")
    known = _base.staged(known.select("print", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least", "first").alias("least")), "known")
    out = _base.looked_up(rows.select("vec_id", "print"), known.select("print", "n_links", "least"), "print", counts=known.select("print", F.col("size").alias("n")))
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def op12_embeddings(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every vector: links at a cosine of 0.98 within a label."""
    return near_vectors(_base.table(spark, sf_dir, "embeddings"), cosine=0.98)


#: DuckDB SQL for the same rows: all pairs of a label, exactly.
ORACLE_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a),
k AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, k.c AS component_id, k.c = v.vec_id AS kept FROM v JOIN k ON k.v = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
