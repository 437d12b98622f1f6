"""Stupid-backoff scores of whole documents under trigram counts of the whole corpus, computed as joins of count tables.

S(w | u v) = c(u v w) / c(u v) where c(u v w) >= least_count, else alpha * S(w | v); S(w | v) = c(v w) / c(v) where
c(v w) >= least_count, else alpha * c(w) / N. A document's first word is scored by c(w) / N and its second by S(w | v): what
a word has no context for is no fallback. Counts cover all words of all documents; n-grams seen fewer than least_count times
fall back, which a corpus scored by itself would otherwise always know.

1. Texts are staged in packs of about `pack_tokens` words; long ones go on in the next pack, with two words of context.
2. A pack's n-grams of all orders are folded to distinct ones with their counts and dealt by hash: the count tables'
   partitions. An n-gram that every document holds so reaches its partition once a pack, and no key is hot.
3. A partition sums its n-grams, and answers each pack with the totals of what it sent: the join of the exploded n-grams with
   the table, in the order they came, so an answer is a number.
4. A pack meets its answers, scores its words and sums them per document.
Rows carry packed arrays, so an n-gram costs a few bytes. Sums are whole numbers of 2**-20, so their order doesn't matter.

Words are split at ASCII white space, A-Z lower-cased. N-grams are named by hashes of as many bits as leave less than one
expected collision in the whole table (twice the bits of the number of tokens and one more, 64 at most).
Null or blank texts: no tokens, null score. Repeated rows and ids are scored row by row and all count. An empty table gives
no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm._text import U, Words, mix, slices

_ONE = 2.0**20
_PACK = pa.schema([("docs", pa.binary()), ("text", pa.binary())])
_STRETCH = 4 << 20  # bytes of one text in a pack


def _squeezed(raw: bytes, level: int = 1) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _full(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return pa.decompress(b[8:], n, codec="zstd", asbytes=True) if n else b""


def _planes(a: np.ndarray) -> bytes:
    """Packed with equal bytes of all numbers together: the upper ones repeat."""
    return _squeezed(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8).T).tobytes())


def _numbers(b: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_full(b), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """docs: row ids and how many first words of each stretch are context only; text: stretches, one a line."""
    texts, ids, held = [], [], 0

    def pack() -> pa.RecordBatch:
        table = np.array(ids, np.int64).ravel()
        return pa.RecordBatch.from_pydict({"docs": [_squeezed(table.tobytes())], "text": [_squeezed(b"\n".join(texts), 12)]}, schema=_PACK)

    for batch in batches:
        for part in slices(batch, "text"):
            for rid, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                words = b" ".join((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split())  # both know ASCII only
                at, head, context = 0, 0, 0  # where words to score begin, where those of their context do, and how many these are
                while at < len(words):
                    end = words.find(b" ", at + _STRETCH)
                    end = len(words) if end < 0 else end
                    texts.append(words[head:end]), ids.append((rid, context))
                    held += end - head
                    if held >= 6 * most:
                        yield pack()
                        texts, ids, held = [], [], 0
                    last = words.rfind(b" ", 0, end)
                    head, context = (words.rfind(b" ", 0, last) + 1, 2) if last >= 0 else (0, 1)
                    at = end + 1
    if texts:
        yield pack()


class Grams:
    """The n-grams of a pack: keys (distinct, sorted, all orders), at (per order, each word's n-gram that ends there, or -1),
    own (which words are scored), row (each word's stretch). Orders are folded one after the other, to hold less at once."""

    def __init__(self, text: bytes, context: np.ndarray, bits: int):
        hashes, rows, base = [], [], 0
        raw = _full(text)
        lines = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1, [len(raw) + 1]])
        at = 0
        while at < len(lines) - 1:  # about a megabyte at a time
            end = max(at + 1, int(np.searchsorted(lines, lines[at] + (1 << 20), side="right")) - 1)
            a, b = int(lines[at]), min(int(lines[end]), len(raw))
            words = Words(raw=(np.frombuffer(raw, np.uint8, b - a, a), np.minimum(lines[at : end + 1] - a, b - a)))
            hashes.append(words.hash), rows.append((words.row + base).astype(np.int32))
            base += end - at
            at = end
        h, self.row = np.concatenate(hashes), np.concatenate(rows)
        del raw, hashes, rows, words
        first = np.searchsorted(self.row, np.arange(base)).astype(np.int32)
        place = np.arange(len(h), dtype=np.int32)
        place -= first[self.row]
        self.own = place >= context.astype(np.int32)[self.row]
        tables, self.at, out = [], [], h
        for order in (1, 2, 3):
            if order > 1:
                out = mix(out[:-1] * U(0xD6E8FEB86659FD93) + h[order - 1 :])
            ok = np.flatnonzero(place[order - 1 :] >= order - 1)
            table, inverse = np.unique(mix(out[ok] + U(order)) >> U(64 - bits), return_inverse=True)
            where = np.full(len(h), -1, np.int32)
            where[ok + order - 1] = inverse + sum(map(len, tables))
            tables.append(table), self.at.append(where)
            del ok, inverse
        del out, h, place
        self.keys = np.concatenate(tables)
        del tables
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        spot = np.empty(len(order) + 1, np.int32)
        spot[order], spot[-1] = np.arange(len(order), dtype=np.int32), -1
        self.at = [spot[where] for where in self.at]

    def counts(self) -> np.ndarray:
        return sum((np.bincount(where[self.own & (where >= 0)], minlength=len(self.keys)) for where in self.at), np.zeros(len(self.keys), np.int64))

    def cuts(self, parts: int, bits: int) -> np.ndarray:
        """Where each partition's keys begin; partitions are ranges of keys."""
        bounds = np.array([(k << bits) // parts for k in range(1, parts)], U)
        return np.concatenate([[0], np.searchsorted(self.keys, bounds), [len(self.keys)]])


def _table(docs: bytes) -> np.ndarray:
    return np.frombuffer(_full(docs), np.int64).reshape(-1, 2)


def _dealt(batches: Iterator[pa.RecordBatch], parts: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack, docs, text in zip(*batch.columns, strict=True):
            grams = Grams(text.as_py(), _table(docs.as_py())[:, 1], bits)
            counts, cut = grams.counts(), grams.cuts(parts, bits)
            full = np.flatnonzero(cut[1:] > cut[:-1])
            keys = [_planes(np.diff(grams.keys[cut[p] : cut[p + 1]], prepend=U(0))) for p in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), pack.as_py(), np.int64)), pa.array(keys, pa.binary()), pa.array([_planes(counts[cut[p] : cut[p + 1]]) for p in full], pa.binary())], names=["part", "pack", "keys", "counts"])


def _answered(t: pa.Table) -> pa.Table:
    """One partition: the totals of every pack's n-grams, in the order they were sent. Keys of different orders are different."""
    keys = [np.cumsum(_numbers(k.as_py(), np.uint64), dtype=U) for k in t.column("keys")]
    counts = np.concatenate([_numbers(c.as_py(), np.int64) for c in t.column("counts")])
    sizes = np.cumsum([len(k) for k in keys])
    table, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.zeros(len(table), np.int64)
    np.add.at(total, inverse, counts)
    answers = [_planes(total[i]) for i in np.split(inverse, sizes[:-1])]
    return pa.table({"pack": t.column("pack"), "part": t.column("part"), "totals": pa.array(answers, pa.binary())})


def _scored(pack: pa.Table, answers: pa.Table, tokens: int, alpha: float, least: int, bits: int) -> pa.Table:
    """One pack and its answers: sums and fallbacks per document."""
    docs = _table(pack.column("docs")[0].as_py())
    grams = Grams(pack.column("text")[0].as_py(), docs[:, 1], bits)
    order = np.argsort(answers.column("part").to_numpy()).tolist()
    total = np.concatenate([_numbers(answers.column("totals")[k].as_py(), np.int64) for k in order] + [np.zeros(1, np.int64)])
    rid, inverse = np.unique(docs[:, 0], return_inverse=True)
    sums, back = np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64)
    ln = lambda x: np.log(np.maximum(x, 1))
    for a in range(0, len(grams.own), 1 << 18):  # a slice of words at a time
        at = [where[a : a + (1 << 18)] for where in grams.at]
        c1, c2, c3 = (total[where] for where in at)  # the last total stands for what isn't there
        v = np.maximum(np.arange(a, a + len(c1)) - 1, 0)
        lead1, lead2 = total[grams.at[0][v]], total[grams.at[1][v]]  # c(v) and c(u v)
        one = ln(c1) - np.log(tokens)
        two = np.where(at[1] >= 0, np.where(c2 >= least, ln(c2) - ln(lead1), np.log(alpha) + one), one)
        three = np.where(at[2] >= 0, np.where(c3 >= least, ln(c3) - ln(lead2), np.log(alpha) + two), two)
        fell = np.where(at[2] >= 0, c3 < least, (at[1] >= 0) & (c2 < least))
        own = grams.own[a : a + (1 << 18)]
        who = inverse[grams.row[a : a + (1 << 18)][own]]
        np.add.at(sums, who, np.rint(three * _ONE).astype(np.int64)[own])
        np.add.at(back, who, fell[own].astype(np.int64))
    return pa.table({"rid": rid, "total": sums, "fallbacks": back})


def _name(seed: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.4, least_count: int = 2, pack_tokens: int = 1_600_000, part_grams: int = 2_000_000) -> DataFrame:
    """Per document row: doc_id, n_tokens, n_fallbacks (words scored below the order their context allows), log_score (sum of
    natural logs, null without tokens).

    pack_tokens, part_grams: about how many words a pack and how many sent n-grams a partition hold; they set memory, not results.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    for seed in itertools.count():
        # rows are named by a hash of id and text; a second one tells whether two of them share a name, and then all are named anew
        rid = _name(seed).alias("rid")
        rows = _base.staged(own.select("doc_id", rid, F.xxhash64("text", F.lit("other"), "doc_id").alias("other"), count.alias("n_tokens")), "rows")
        if rows.groupBy("rid").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low != high").isEmpty():
            break
        _base.drop_staged(rows)
    tokens = rows.agg(F.sum("n_tokens").alias("n")).first().n or 0
    parts = max(16, int(tokens * 1.7 / part_grams) + 1)
    bits = min(64, 2 * max(tokens, 2).bit_length() + 1)
    packed = own.where("length(text) > 0").select(rid, "text").mapInArrow(lambda it: _packs(it, pack_tokens), "docs binary, text binary")
    packed = _base.staged(packed.select(F.monotonically_increasing_id().alias("pack"), "docs", "text"), "packs")
    sent = packed.mapInArrow(lambda it: _dealt(it, parts, bits), "part int, pack bigint, keys binary, counts binary")
    answers = sent.groupBy("part").applyInArrow(_answered, "pack bigint, part int, totals binary")
    sums = packed.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(lambda a, b: _scored(a, b, tokens, alpha, least_count, bits), "rid bigint, total bigint, fallbacks bigint")
    sums = sums.groupBy("rid").agg(F.sum("total").alias("total"), F.sum("fallbacks").alias("fallbacks"))
    # rows with equal ids and texts were summed together: each has its equal share
    shares = rows.groupBy("rid").agg(F.count(F.lit(1)).alias("m")).join(sums, "rid")
    out = rows.join(shares, "rid", "left")
    return out.select("doc_id", "n_tokens", F.coalesce(F.col("fallbacks") / F.col("m"), F.lit(0)).cast("long").alias("n_fallbacks"), (F.col("total") / F.col("m") / F.lit(_ONE)).alias("log_score"))


def op7_lmscore(spark, sf_dir: str) -> DataFrame:
    """Every document's sum, mean per word and number of fallbacks."""
    out = scores(_base.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", "n_fallbacks", F.round("log_score", 4).alias("log_score"), F.round(F.try_divide("log_score", "n_tokens"), 6).alias("mean_log"))


#: DuckDB SQL for the same rows; logs in whole numbers of 2**-20, as they are summed.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
one AS (SELECT w, count(*) AS c FROM t GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= 2),
n AS (SELECT count(*) AS n FROM t),
c AS (SELECT t.doc_id, t.u, t.v, coalesce(three.c, 0) AS c3, lead2.c AS cuv, coalesce(two.c, 0) AS c2, lead1.c AS cv, one.c AS c1
  FROM t JOIN one ON t.w = one.w LEFT JOIN two ON t.v = two.v AND t.w = two.w LEFT JOIN one lead1 ON t.v = lead1.w LEFT JOIN two lead2 ON t.u = lead2.v AND t.v = lead2.w LEFT JOIN three ON t.u = three.u AND t.v = three.v AND t.w = three.w),
s AS (SELECT doc_id, CASE WHEN u IS NOT NULL THEN c3 < 2 WHEN v IS NOT NULL THEN c2 < 2 ELSE false END AS fell,
  round_even((CASE WHEN u IS NOT NULL AND c3 >= 2 THEN ln(c3) - ln(cuv) ELSE CASE WHEN u IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + CASE WHEN v IS NOT NULL AND c2 >= 2 THEN ln(c2) - ln(cv) ELSE CASE WHEN v IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + (ln(c1) - ln(n.n)) END END) * 1048576, 0) AS z FROM c, n),
g AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE fell) AS n_fallbacks, sum(z::BIGINT)::DOUBLE / 1048576 AS z FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_fallbacks, 0)::BIGINT AS n_fallbacks, round(z, 4) AS log_score, round(z / n_tokens, 6) AS mean_log FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
