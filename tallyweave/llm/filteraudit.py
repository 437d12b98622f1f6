"""What each of several filters removes, alone and in every order: a polynomial of removals for each part of a corpus.

Each document fails a set of filters; per part only the numbers of documents by that set (2^filters at most, combined before
the shuffle) are needed. With x_i = 1 where filter i is on, the documents removed are the multilinear polynomial

    f(x) = sum over sets m of n_m * (1 - product over i in m of (1 - x_i)).

Its value at a corner of the cube is what that set of filters removes, so survivors after each step of an order are the
part's size less a corner, and a filter's removals the difference of two. A filter's Shapley value is the integral of
df/dx_i along the diagonal from 0 to 1 (Owen's multilinear extension), taken in exact rationals term by term; times the
number of orders it is a whole number, the filter's removals summed over all orders. Losses (documents marked good or toxic, say) have
polynomials of their own.

Null texts count as empty ones; null parts are the part "". Documents without a label are no loss; of repeated labels of one
doc_id the larger counts. A text is repeated if a row with a smaller doc_id has it: rows of one id don't repeat each other, a
null doc_id neither repeats nor is repeated. Repeated rows count as often as they are there. An empty table gives no rows. Columns
that aren't asked for are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm._text import buffers, slices


class Removals:
    """The polynomial of a part: counts[m] documents fail exactly the filters in the bits of m."""

    def __init__(self, counts: Sequence[int], filters: int):
        self.filters, self.counts = filters, list(counts)
        holding = list(counts)  # documents that fail at least the filters of a set
        for i in range(filters):
            for m in range(1 << filters):
                if not m >> i & 1:
                    holding[m] += holding[m | 1 << i]
        self.coefficients = [0] + [(1 if t.bit_count() % 2 else -1) * holding[t] for t in range(1, 1 << filters)]
        self.corners = list(self.coefficients)  # f at every corner: the sum over the terms whose filters are all on
        for i in range(filters):
            for m in range(1 << filters):
                if m >> i & 1:
                    self.corners[m] += self.corners[m ^ 1 << i]

    def shapley(self, i: int) -> Fraction:
        """The integral over t of df/dx_i at (t, ..., t): a term over a set of size k holding i has c * t^(k-1), so c / k."""
        return sum((Fraction(c, t.bit_count()) for t, c in enumerate(self.coefficients) if t >> i & 1), Fraction(0))


def _orders(batches: Iterator[pa.RecordBatch], names: Sequence[str], losses: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """All orders and steps of every part; a row holds a part and its counts by set."""
    k = len(names)
    steps = [(order, s, sum(1 << i for i in order[:s]), order[s]) for order in permutations(range(k)) for s in range(k)]
    label = {order: "".join(names[i] for i in order) for order in permutations(range(k))}
    for batch in batches:
        for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by = [[0] * (1 << k) for _ in range(1 + len(losses))]
            for x in found:
                for counts, name in zip(by, ("n", *losses), strict=True):
                    counts[x["mask"]] += x[name]
            docs, *lost = (Removals(counts, k) for counts in by)
            size = sum(docs.counts)
            failing = [docs.corners[1 << i] for i in range(k)]
            value = [docs.shapley(i) * factorial(k) for i in range(k)]
            if any(v.denominator != 1 for v in value):
                raise ArithmeticError("Shapley values times the number of orders are whole numbers")
            removed = [docs.corners[at | 1 << i] - docs.corners[at] for _, _, at, i in steps]
            cols = [
                pa.array([part] * len(steps), pa.string()), pa.array([label[o] for o, *_ in steps]), pa.array([s + 1 for _, s, _, _ in steps], pa.int32()), pa.array([names[i] for *_, i in steps]),
                pa.array([size - docs.corners[at | 1 << i] for _, _, at, i in steps], pa.int64()), pa.array(removed, pa.int64()), pa.array([failing[i] - r for (*_, i), r in zip(steps, removed, strict=True)], pa.int64()), pa.array([docs.counts[1 << i] for *_, i in steps], pa.int64()),
                *(pa.array([x.corners[at | 1 << i] - x.corners[at] for _, _, at, i in steps], pa.int64()) for x in lost), pa.array([int(value[i]) for *_, i in steps], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", *(f"{x}_lost" for x in losses), "shapley"])


def audit(docs: DataFrame, filters: Mapping[str, Column], *, part: Column, losses: Mapping[str, Column]) -> DataFrame:
    """One row per part, order of the filters and step: filter (the one of this step), kept after it, removed by it, redundant (fail it, but
    were removed before), unique_fails (fail it alone), <loss>_lost (removed here and so marked), shapley (removed by it in all orders together).

    filters: what each one fails, by name, up to 7 of them (5,040 orders). A condition that is null does not fail.
    """
    if not 1 <= len(filters) <= 7:
        raise ValueError("one to seven filters")
    names, kinds = list(filters), list(losses)
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))
    marks = [F.coalesce(c, F.lit(False)).cast("long").alias(x) for x, c in losses.items()]
    own = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *marks)
    counted = own.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in losses))
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *losses)).alias("found"))  # 2^filters entries at most
    schema = "part string, filter_order string, step int, filter string, kept bigint, removed bigint, redundant bigint, unique_fails bigint, " + "".join(f"`{x}_lost` bigint, " for x in losses) + "shapley bigint"
    return by_part.mapInArrow(lambda it: _orders(it, names, kinds), schema)


_SYMBOL = np.isin(np.arange(256), list(b"#$%&*|"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_FIRST = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


def text_facts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per row doc_id, part, n_words, n_distinct, n_upper (A-Z), n_points (code points), n_symbols (#$%&*|) and the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                data, at = buffers(rows.column(2))
                raw, n, distinct, print_ = data.tobytes(), [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = raw[a:b]
                    words = own.split()  # bytes split at ASCII white space
                    n.append(len(words)), distinct.append(len(set(words))), print_.append(hashlib.sha256(own).digest())
                counts = [np.diff(np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])[at]) for kind in (_UPPER, _FIRST, _SYMBOL)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(x, pa.int64()) for x in (n, distinct, *counts)), pa.array(print_, pa.binary())], names=["doc_id", "part", "n_words", "n_distinct", "n_upper", "n_points", "n_symbols", "print"])

    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(part).cast("string").alias("part"), F.col(text).alias("text"))
    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, part string, n_words bigint, n_distinct bigint, n_upper bigint, n_points bigint, n_symbols bigint, print binary")


def with_repeats(facts: DataFrame) -> DataFrame:
    """facts (a stored table) with repeats: whether a row with a smaller doc_id has the same text."""
    groups = facts.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    groups = _base.staged(groups, "repeats")
    known = _base.looked_up(facts, groups.select("print", "first"), "print", counts=groups.select("print", "n"))
    return known.withColumn("repeats", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")


def op11_audit(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every source, order and step."""
    facts = _base.staged(text_facts(_base.table(spark, sf_dir, "documents")), "facts")
    marks = _base.table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = _base.staged(marks.where("good OR toxic"), "marks")
    rows = _base.looked_up(with_repeats(facts), marks, "doc_id")
    filters = {"A": F.col("n_words") < 200, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"), "C": 100 * F.col("n_upper") > 2 * F.col("n_points"), "D": F.col("n_symbols") > 0, "E": F.col("repeats")}
    return audit(rows, filters, part=F.col("part"), losses={"good": F.col("good"), "toxic": F.col("toxic")}).drop("filter")


#: DuckDB SQL for the same rows, order by order.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END) || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[: step - 1] AS before FROM o, range(1, 6) r(step)),
y AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, fails = own AS only_own, translate(fails, before, '') <> fails AS gone FROM m, s),
z AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN only_own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z
"""
