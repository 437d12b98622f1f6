"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: each round hashes every shingle into one of `coords` bins with a value; a bin keeps the least value of the first
round that reaches it. After `coords` random rounds, round coords + j sends every shingle to bin j, so every coordinate
fills; equal coordinates concentrate like sampling without replacement (Dahlgaard, Knudsen, Thorup 2017).

Documents with equal words (SHA-256 of all of them, lower-cased) form a class, which stands for them in all that follows.
Bands of `rows` coordinates put classes into buckets. First every bucket is tied to its most central member (the one
sharing buckets with most others), pairs are verified on their full sets of shingles, word by word, and verified links are
contracted. Only buckets that still hold several components are then searched for further pairs: members of different
components whose sketches agree often enough (4.5 standard deviations below the threshold, for the number of
coordinates at hand: a pair right there is left out with a chance of 3e-6) and whose sizes allow it, in blocks, each pair once, verified exactly as well. No bucket is capped or sampled; no group of all
members is ever paired before the contraction. Joins that many rows of one key meet in send that key's one fact to the rows.

Words are split at ASCII white space, A-Z lower-cased. Fewer words than `size`: one shingle of them all. Null or blank
texts: empty set, linked with nothing. Null doc_ids: never linked. Rows sharing one doc_id are one vertex, whatever their
texts: it has the links of each; every row is returned. An empty table gives no rows. Columns that aren't asked for are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm._text import U, Words, mix, slices

_GOLD = U(0x9E3779B97F4A7C15)
_M = U(0xBF58476D1CE4E5B9)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of `size` words (all words as one run if fewer)."""
    hashes, inside = words.windows(size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        elif b > a:
            h = np.zeros(1, U)
            for x in words.hash[a:b]:
                h = mix(h * _M + x + _GOLD)
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def sketch(items: np.ndarray, coords: int) -> np.ndarray:
    """The fast similarity sketch of a set of hashes: `coords` values, each naming a round and an item."""
    s = np.full(coords, U(2**64 - 1))
    left, at = coords, 0
    step = max(1, min(coords, 4096 // len(items)))
    while left and at < coords:
        rounds = np.arange(at, min(at + step, coords), dtype=U)
        h = mix(items[None, :] ^ ((rounds + U(1)) * _GOLD)[:, None])
        value = (rounds[:, None] << U(53)) | (h >> U(11))
        np.minimum.at(s, (mix(h ^ _M) % U(coords)).astype(np.int64).ravel(), value.ravel())
        left, at = int((s == U(2**64 - 1)).sum()), at + step
    if left:
        empty = np.flatnonzero(s == U(2**64 - 1))
        for j in empty:  # round coords + j: all items, bin j
            salt = np.full(1, coords + j + 1, U) * _GOLD
            s[j] = (U(coords) << U(53)) | (mix(items ^ salt) >> U(11)).min()
    return s


def _features(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    coords = bands * rows
    band_id = (np.arange(bands, dtype=U) + U(1)) * _GOLD
    for batch in batches:
        for part in slices(batch, "text"):
            n, prints, keys, small = [], [], [], []
            for items, text in zip(shingle_sets(Words(part.column(1), lower=True), size), part.column(1), strict=True):
                n.append(len(items))
                if not len(items):
                    prints.append(None), keys.append(None), small.append(None)
                    continue
                prints.append(_print(text.as_py()))
                s = sketch(items, coords)
                h = np.zeros(bands, U)
                for col in s.reshape(bands, rows).T:
                    h = mix(h * _M + col)
                keys.append((h + band_id).view(np.int64))
                small.append((s & U(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary())], names=["doc_id", "n", "print", "bands", "small"])


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only


def _print(text: str) -> bytes:
    return hashlib.sha256(b" ".join(_words(text))).digest()


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their print; packed, as they are shuffled more than once."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = [b" ".join(_words(x.as_py() or "")) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.sha256(w).digest() for w in words], pa.binary()), pa.array([zlib.compress(w, 1) for w in words], pa.binary())], names=["doc", "print", "z"])


def _links(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose full sets pass; za and zb are packed words. Rows of one a mostly follow each other."""
    last: tuple[bytes | None, set[bytes]] = (None, set())
    for batch in batches:
        a, b = [], []
        for i, j, za, zb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if (z := za.as_py()) != last[0]:
                last = (z, _set_of(z, size))
            other = _set_of(zb.as_py(), size)
            both = len(last[1] & other)
            if 100 * both >= percent * (len(last[1]) + len(other) - both):
                a.append(i), b.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _set_of(z: bytes, size: int) -> set[bytes]:
    """The shingles themselves."""
    words = zlib.decompress(z).split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each vertex of the links (a, b) and the vertex that stands for all it can reach.

    Contraction: every vertex hooks to the least of itself and its neighbours in an order dealt anew each round (so chains
    of hooks stay short), one jump, links are renamed; each round is a table in the shared folder. Vertices with very many
    links are looked up where the links lie.
    """
    spark = edges.sparkSession
    label: DataFrame | None = None
    live = _base.staged(edges.where("a != b").select("a", "b").distinct(), "links")
    turn = 0
    while not live.isEmpty():
        rank = lambda x: F.struct(F.xxhash64(F.col(x), F.lit(turn)).alias("h"), F.col(x).alias("v"))  # noqa: B023, E731
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = _base.staged(both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("m")).select("v", F.least(rank("v"), "m")["v"].alias("p")), "hooks")
        hook = _base.staged(_base.looked_up(first, first.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p")), "hooks")
        if label is None:
            old, label = None, _base.staged(hook.select("v", F.col("p").alias("c")), "labels")
        else:
            old, label = label, _base.staged(_base.looked_up(label, hook.select(F.col("v").alias("c"), "p"), "c").select("v", F.coalesce("p", "c").alias("c")), "labels")
        a, b = (hook.select(F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        half = _base.staged(_base.looked_up(live, a, "a").select("pa", "b"), "links")
        ends = _base.looked_up(half, b, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        spent, live = live, _base.staged(ends.distinct(), "links")
        _base.drop_staged(first, hook, old, half, spent)
        turn += 1
    return label if label is not None else spark.createDataFrame([], "v bigint, c bigint")


def _members(block: pa.StructArray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(v, c, size), bands and sketches of a block's members."""
    n = len(block)
    v, c, size, bands, small = block.flatten()
    return [x.to_numpy() for x in (v, c, size)], bands.flatten().to_numpy().reshape(n, -1), np.frombuffer(b"".join(small.to_pylist()), np.uint8).reshape(n, -1)


def _further(least: float, percent: int):
    """Pairs of one block pair of a bucket: different components, first common band is this one, sizes and sketches alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for band, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                (lv, lb, ls), (rv, rb, rs) = _members(left.values), _members(right.values)
                for i in range(len(left)):
                    n = lv[2][i]
                    js = np.flatnonzero((rv[1] != lv[1][i]) & (100 * np.minimum(n, rv[2]) >= percent * np.maximum(n, rv[2])))
                    if len(js):
                        js = js[(rs[js] == ls[i]).mean(1) >= least]
                    if len(js):
                        js = js[(rb[js] == lb[i]).argmax(1) == band]
                    for j in js:
                        x, y = sorted((int(lv[0][i]), int(rv[0][j])))
                        a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int | None = None, rows: int = 8, block: int = 512) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (least linked doc_id, its own if none), kept (doc_id is component_id).

    bands: how many bands of `rows` coordinates; by default as many as leave a pair right at `percent` without a common bucket
    with a chance of 1e-4 at most (50 at 80 percent; a pair at 85 percent is then missed with 1e-7).
    """
    bands = bands or math.ceil(math.log(1e-4) / math.log1p(-((percent / 100) ** rows)))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = _base.staged(own.mapInArrow(lambda it: _features(it, size, bands, rows), "doc_id bigint, n bigint, print binary, bands array<bigint>, small binary"), "sketches")
    sets = feats.where("n > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("print").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.count(F.lit(1)).alias("size"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("small", "doc_id").alias("small"))
    reps = _base.staged(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    placed = reps.select("v", F.posexplode("bands").alias("band", "key"))
    fill = _base.staged(placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "fills")
    members = _base.staged(_base.looked_up(placed, fill, ["band", "key"], counts=fill).where("n IS NOT NULL"), "buckets")
    central = members.groupBy("v").agg(F.sum("n").alias("score"))
    ranked = members.join(central, "v")
    heads = ranked.groupBy("band", "key").agg(F.max(F.struct("score", (-F.col("v")).alias("u"))).alias("m")).select("band", "key", (-F.col("m.u")).alias("head"))
    heads = _base.staged(heads, "heads")
    star = _base.looked_up(members, heads, ["band", "key"], counts=fill).where("v != head").select(F.col("head").alias("a"), F.col("v").alias("b")).distinct()
    texts = own.where("doc_id IS NOT NULL").mapInArrow(_zipped, "doc bigint, print binary, z binary")
    wanted = reps.join(members.select("v").distinct(), "v", "left_semi").select("v", "doc", "print")
    packed = _base.staged(texts.join(wanted, ["doc", "print"]).groupBy("v").agg(F.min("z").alias("z")), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = _base.dealt(_base.staged(pairs, "pairs"), packed.select("v", "z"), "z")
        return both.mapInArrow(lambda it: _links(it, size, percent), "a bigint, b bigint")

    links = _base.staged(verified(star), "verified")
    # classes of rows that share a doc_id are one vertex
    shared = _base.staged(sets.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low != high").select("doc_id"), "shared")
    if not shared.isEmpty():
        tied = _base.staged(sets.select("doc_id", "print").join(shared, "doc_id").distinct().join(reps.select("print", "v"), "print").select("doc_id", "v"), "tied")
        links = links.unionByName(tied.join(tied.groupBy("doc_id").agg(F.min("v").alias("a")), "doc_id").select("a", F.col("v").alias("b")).where("a != b"))
    label = components(links)
    # buckets that still hold several components: what lies outside a bucket's largest component meets the whole bucket
    colored = members.join(label, "v", "left").withColumn("c", F.coalesce("c", "v"))
    sizes = colored.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("band", "key").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("band", "key", F.col("top.c").alias("top"), "m", (F.col("m") - F.col("top.m")).alias("m_out"))
    mixed = _base.staged(mixed, "mixed")
    rest = _base.looked_up(colored, mixed, ["band", "key"], counts=fill).where("m IS NOT NULL").join(reps.select("v", "bands", "small", F.col("n").alias("size")), "v")
    rest = rest.select("band", "key", "v", "c", "bands", "small", "size", "m", "m_out", (F.col("c") != F.col("top")).alias("out"), F.xxhash64("v").alias("h"))
    member = F.struct("v", "c", "size", "bands", "small")
    part = lambda count: F.pmod(F.col("h"), F.ceil(F.col(count) / block)).cast("int")
    rest = _base.staged(rest, "rest")
    left = rest.where("out").groupBy("band", "key", part("m_out").alias("k")).agg(F.collect_list(member).alias("left"), F.first("m").alias("m"))
    left = left.withColumn("k2", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / block).cast("int") - 1)))  # dealt by pairs of blocks
    right = rest.groupBy("band", "key", part("m").alias("k2")).agg(F.collect_list(member).alias("right"))
    p = percent / 100
    alike = p - 4.5 * math.sqrt(p * (1 - p) / (bands * rows))
    pairs = left.join(right, ["band", "key", "k2"]).select("band", "left", "right").mapInArrow(_further(alike, percent), "a bigint, b bigint").distinct()
    more = _base.staged(verified(pairs), "verified")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    least = _base.staged(label.join(reps.select("v", "doc"), "v").select("v", "c", "doc"), "linked")
    found = _base.looked_up(least.select("v", "c"), least.groupBy("c").agg(F.min("doc").alias("component_id")), "c").select("v", "component_id")
    known = reps.where("size > 1").select("print", "v", "doc").unionByName(reps.where("size = 1").join(found.select("v"), "v", "left_semi").select("print", "v", "doc"))
    known = _base.staged(known.join(found, "v", "left").select("print", F.coalesce("component_id", "doc").alias("component_id")), "known")
    out = _base.looked_up(feats.select("doc_id", "n", "print"), known, "print", counts=reps.select("print", F.col("size").alias("n")))
    final = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), final).alias("component_id"), F.coalesce(F.col("doc_id") == final, F.lit(True)).alias("kept"))


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: links at 85 percent of five-word shingles; one right there is missed with a chance of 3e-6."""
    return near_duplicates(_base.table(spark, sf_dir, "documents"), size=5, percent=85, bands=40)


#: DuckDB SQL for the same rows: all pairs that share a shingle, exactly.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT u.b, r.c FROM r JOIN u ON r.v = u.a),
k AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.c AS component_id, k.c = w.doc_id AS kept FROM w JOIN k ON w.doc_id = k.v LEFT JOIN n ON n.doc_id = w.doc_id
"""
