"""Periodic runs of words: maximal repetitions found from Lyndon words, and texts with each run cut to one period.

A run is a stretch of words that repeats its smallest period and that neither neighbour extends. By the runs theorem, every
run holds, for one of the two orders of words (any total order and its reverse; the text's end is least in both), positions
whose longest Lyndon word is exactly one period. So each text is scanned from right to left under both orders: a stack of
Lyndon words, linked from each position to its next smaller suffix, is popped by comparing suffixes. Where the word that
starts at i ends at j, i and j are compared onward and backward; how far they agree gives the run of period j - i.

Suffixes are compared by their first two words, then by the length of their longest common extension: its length is found
by binary search over rolling hashes (modulo 2^31 - 1), and the words it names are then compared themselves; should they
differ, the words alone decide. Two positions at the same distance as two compared a little further right need only
the words in between. No suffix array is built.

Words are split at ASCII white space; equal words are equal bytes. Null and blank texts have no words and no runs. One
text at a time is held, with some 150 bytes a word; nothing is cut short. Rows that share a doc_id are judged row by row,
columns that aren't asked for are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm._text import slices

_PRIME = 2**31 - 1
_NEAR = 256  # how far right a pair at the same distance may lie to be built upon


class _Extensions:
    """How many words from (or before) two places agree, for one text given as word numbers."""

    def __init__(self, code: list[int]):
        self.code, self.n = code, len(code)
        self._bytes = memoryview(array("i", code).tobytes())
        self._sums: list[int] | None = None

    def _hash(self) -> None:
        values = (np.array(self.code, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)) + np.uint64(1)
        power, have = np.ones(self.n + 1, np.uint64), 1
        step = 1_000_003
        while have <= self.n:
            more = min(have, self.n + 1 - have)
            power[have : have + more] = power[:more] * np.uint64(step) % np.uint64(_PRIME)
            have += more
            step = step * step % _PRIME
        sums = np.cumsum(values * power[: self.n] % np.uint64(_PRIME)) % np.uint64(_PRIME)
        self._power, self._sums = power.tolist(), [0, *sums.tolist()]

    def same(self, i: int, j: int, count: int) -> bool:
        """Whether `count` words from i and from j are equal, word by word."""
        return self._bytes[4 * i : 4 * (i + count)] == self._bytes[4 * j : 4 * (j + count)]

    def _search(self, alike: Callable[[int], bool], low: int, most: int) -> int:
        """The greatest length up to `most` that is alike; `low` is known to be."""
        step = 4
        while low + step <= most and alike(low + step):
            low += step
            step *= 2
        high = min(most, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if alike(mid) else (low, mid - 1)
        return low

    def onward(self, i: int, j: int, known: int = 0) -> int:
        """Words that agree from i and from j > i on; `known` of them do."""
        if self._sums is None:
            self._hash()
        s, shift, most = self._sums, self._power[j - i], self.n - j
        found = self._search(lambda k: ((s[i + k] - s[i]) * shift - s[j + k] + s[j]) % _PRIME == 0, known, most)
        if self.same(i, j, found) and (found == most or self.code[i + found] != self.code[j + found]):
            return found
        return self._search(lambda k: self.same(i, j, k), known, most)

    def backward(self, i: int, j: int) -> int:
        """Words that agree just before i and just before j > i."""
        if self._sums is None:
            self._hash()
        s, shift = self._sums, self._power[j - i]
        found = self._search(lambda k: ((s[i] - s[i - k]) * shift - s[j] + s[j - k]) % _PRIME == 0, 0, i)
        if self.same(i - found, j - found, found) and (found == i or self.code[i - found - 1] != self.code[j - found - 1]):
            return found
        return self._search(lambda k: self.same(i - k, j - k, k), 0, i)


def _scan(code: list[int], extend: _Extensions, exponent: int, found: set[tuple[int, int, int]]) -> None:
    """Adds the runs (start, end, period) that Lyndon words under the order of `code` name; code ends with -1."""
    n = extend.n
    after = [0] * n  # each position's next smaller suffix: the ends of the Lyndon words on the stack
    far: dict[int, tuple[int, int]] = {}
    last: dict[int, tuple[int, int]] = {}
    for i in range(n - 1, -1, -1):
        x, j = code[i], i + 1
        while (y := code[j]) >= x:
            if y == x:
                if code[i + 1] != code[j + 1]:
                    common = 1
                else:
                    d = j - i
                    at, common = far.get(d, (n + _NEAR, 0))
                    if at - i <= _NEAR and extend.same(i, j, at - i):
                        common += at - i
                    else:
                        common = extend.onward(i, j, 2)
                    far[d] = (i, common)
                if code[i + common] > code[j + common]:
                    d = j - i
                    # a run's first Lyndon root agrees onward for its length less two periods at least
                    if common >= (exponent - 2) * d and common:
                        start, end = last.get(d, (n, 0))
                        if i < start or j + common != end:
                            start, end = i - extend.backward(i, j), j + common
                            last[d] = start, end
                            if end - start >= exponent * d:
                                found.add((start, end, d))
                    break
            j = after[j]
        after[i] = j


def runs_of(words: list, *, exponent: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `exponent` periods and `least` words or more, by start, then period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    number: dict = {}
    code = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(code):  # no word twice: nothing repeats
        return []
    extend, found = _Extensions(code), set()
    _scan([*code, -1], extend, exponent, found)
    top = len(number) - 1
    _scan([*(top - x for x in code), -1], extend, exponent, found)
    return sorted((start, end - start, d) for start, end, d in found if end - start >= least)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, runs (start, length, period, in words from 0; by start, then period) and collapsed (the
    words kept, joined by one space). rewrite: from doc_id and the words, the words to look at instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, all_runs, texts = [], [], []
                for i, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words = bytes(value.as_buffer()).split() if value.is_valid else []  # bytes split at ASCII white space
                    if rewrite is not None:
                        words = rewrite(i, words)
                    runs = runs_of(words, exponent=exponent, least=least)
                    sizes.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    texts.append(b" ".join(collapsed(words, runs)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(all_runs, run_type), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The contract's test pattern: documents whose id's crc32 is divisible by 10 repeat themselves from a word on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document: runs of four periods and six words or more. A null doc_id plants nothing."""
    found = periodic_runs(_base.table(spark, sf_dir, "documents"), exponent=4, least=6, rewrite=planted)
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: DuckDB SQL for the same rows, from the definition: for each distance, stretches of words equal to those that far on.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: [ord(substr(doc_id::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS h FROM documents),
e AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, h % 10 = 0 AND len(ws) > 0 AS hit, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN hit THEN g % n ELSE n END AS a, CASE WHEN hit THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM e),
m AS (SELECT doc_id, n, list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) AS ws FROM a),
u AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM m),
q AS (SELECT x.doc_id, y.i - x.i AS period, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
r0 AS (SELECT doc_id, period, min(i) AS start, count(*) + period AS length FROM q GROUP BY doc_id, period, island HAVING count(*) + period >= greatest(6, 4 * period)),
r AS (SELECT * FROM r0 WHERE NOT EXISTS (SELECT 1 FROM r0 s WHERE s.doc_id = r0.doc_id AND s.period < r0.period AND s.start <= r0.start AND s.start + s.length >= r0.start + r0.length)),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, arg_max(struct_pack(start := start, length := length, period := period), (length, -start, -period)) AS best FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = u.doc_id AND u.i >= r.start + r.period AND u.i < r.start + r.length) GROUP BY doc_id)
SELECT m.doc_id, coalesce(t.n_runs, 0)::BIGINT AS n_runs, t.best.start::BIGINT AS start, t.best.length::BIGINT AS length, t.best.period::BIGINT AS period, (1000 * t.best.length // t.best.period)::BIGINT AS exponent_milli, sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256 FROM m LEFT JOIN t ON m.doc_id = t.doc_id LEFT JOIN k ON m.doc_id = k.doc_id
"""
