"""Periodic runs, near-duplicate vectors and the filter audit, each against a plain Python version."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import filteraudit, periodic, pivots

# -- periodic runs ------------------------------------------------------------------------------------------------


def plain_runs(w, exponent, least):
    """Stretches equal to themselves one period on, without those that a smaller period explains."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, exponent * q):
                out.append((start, i - start + q, q))
            i += 1 if i == start else 0
    return sorted((r for r in out if not any(p < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, p in out)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("exponent", "least"), [(2, 2), (3, 5), (4, 6)])
def test_runs_of_random_words(exponent, least):
    r = random.Random(exponent)
    for _ in range(3000):
        n, kinds = r.randrange(60), r.randrange(1, 5)
        w = [r.randrange(kinds) for _ in range(n)]
        if n and r.random() < 0.6:
            at, p = r.randrange(n), r.randrange(1, 9)
            w = w[:at] + [(w[at:] * n)[k % min(p, n - at)] for k in range(n - at)]
        assert periodic.runs_of(w, exponent=exponent, least=least) == plain_runs(w, exponent, least), w


def test_runs_of_structured_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a  # Fibonacci's word: as many runs as a text can nearly have
    thue = [k.bit_count() & 1 for k in range(512)]
    nested = ([1, 2] * 6 + [3]) * 5 + [1, 2, 1, 2]
    for w in (b, thue, nested, [7] * 500, list(range(9)) * 60, [*range(50), *[1, 2, 3] * 40, *range(50)]):
        for exponent, least in ((2, 2), (4, 6)):
            assert periodic.runs_of(w, exponent=exponent, least=least) == plain_runs(w, exponent, least)


def test_words_decide_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(periodic, "_PRIME", 7)  # hashes of 7 values agree all the time
    r = random.Random(3)
    for _ in range(400):
        w = [r.randrange(2) for _ in range(80)]
        assert periodic.runs_of(w) == plain_runs(w, 2, 2)


def test_exponent_below_two():
    with pytest.raises(ValueError):
        periodic.runs_of([1, 1], exponent=1)


def test_op13(spark, tmp_path):
    r = random.Random(13)
    texts = [None, "", " \t\n ", "one", "a a a a a a", "x " * 5, "b a a a a a a b", "é à b " * 9, "A a " * 6, "line of five words here\n" * 4 + "tail", "k m " * 4000]
    texts += [" ".join(r.choice("pqrstuvw") * r.randrange(1, 3) for _ in range(r.randrange(120))) for _ in range(150)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(3, "other text of one id " * 4, "x"), (None, "null id " * 7, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(path)
    expected = []
    for i, t, _ in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + math.floor((n - a) / (3 + g % 8))
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        runs = plain_runs(w, 4, 6)
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = periodic.op13_periodic(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert sum(x[1] > 0 for x in expected) > 10


def test_periodic_runs_of_no_rows(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


# -- filter audit -------------------------------------------------------------------------------------------------


def test_polynomials_against_orders():
    r = random.Random(11)
    for k in (1, 2, 3, 4):
        counts = [r.randrange(9) for _ in range(1 << k)]
        f = filteraudit.Removals(counts, k)
        for on in range(1 << k):
            assert f.corners[on] == sum(n for m, n in enumerate(counts) if m & on)
        for i in range(k):
            total = 0
            for order in itertools.permutations(range(k)):
                before = sum(1 << x for x in order[: order.index(i)])
                total += sum(n for m, n in enumerate(counts) if m >> i & 1 and not m & before)
            assert f.shapley(i) == Fraction(total, math.factorial(k))


def plain_audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[at] == 1 and i is not None} for at in (0, 1))
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = t.encode().split()
        same = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": same}
        docs.append((source or "", {x for x, bad in fails.items() if bad}, i in good, i in toxic))
    out = []
    for part in sorted({d[0] for d in docs}):
        own, found, total = [d for d in docs if d[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, rest = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                total[x] += len(gone)
                found.append(("".join(order), step, x, len(rest), len(gone), sum(x in d[1] for d in own) - len(gone), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
                left = rest
        out += [(part, order, step, *numbers, total[x]) for order, step, x, *numbers in found]
    return out


def test_op11(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    texts = [None, "", "  \n", "SHOUTING words", "a#b", "é" * 300, " ".join("x" for _ in range(300)), " ".join(f"u{k}" for k in range(400)), " ".join(f"u{k}" for k in range(199)), " ".join(f"u{k}" for k in range(200)), "Q" * 3 + "q" * 147]
    texts += [" ".join(word() for _ in range(r.randrange(150, 260))) + r.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ", " $ ZZ"]) for _ in range(40)]
    texts += [texts[12]] * 5 + [None, "", texts[6]]
    rows = [(k, t, [None, "", "s1", "s2"][k % 4]) for k, t in enumerate(texts)] + [(4, texts[12], "s1"), (4, texts[12], "s1"), (None, texts[12], "s2"), (None, None, None)]
    labels = [(k, k % 2, k % 3 if k % 3 < 2 else None) for k in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, source string, mask string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = filteraudit.op11_audit(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows, labels))


def test_audit_of_other_filters(spark):
    docs = spark.range(100).withColumn("part", F.lit(None).cast("int"))
    out = filteraudit.audit(docs, {"even": F.col("id") % 2 == 0, "third": F.col("id") % 3 == 0, "never": F.lit(None).cast("boolean")}, part=F.col("part"), losses={})
    rows = {(x.filter_order, x.step): x for x in out.collect()}
    assert len(rows) == 18 and {x.part for x in rows.values()} == {""}
    assert rows["eventhirdnever", 2].removed == 17 and rows["eventhirdnever", 3].kept == 33 and rows["thirdnevereven", 3].removed == 33
    assert rows["eventhirdnever", 1].shapley == 6 * 50 - 3 * 17 and rows["neverthirdeven", 1].shapley == 0
    assert filteraudit.audit(docs.where("id < 0"), {"x": F.col("id") > 0}, part=F.col("part"), losses={}).count() == 0
    with pytest.raises(ValueError):
        filteraudit.audit(docs, {}, part=F.col("part"), losses={})


# -- near-duplicate vectors ---------------------------------------------------------------------------------------


def plain_vectors(rows, cosine):
    """(n_links, component_id) of each row."""
    ok = lambda i, x, label: i is not None and label is not None and x and all(e is not None and math.isfinite(e) for e in x) and any(x)
    good = [k for k, (i, x, label) in enumerate(rows) if ok(i, x, label)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    links = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in good}
    out, seen = [(0, i) for i, *_ in rows], set()
    for k in good:
        if k in seen:
            continue
        group, stack = {k}, [k]
        while stack:
            new = [j for j in links[stack.pop()] if j not in group]
            group.update(new), stack.extend(new)
        seen |= group
        for j in group:
            out[j] = (len(links[j]), min(rows[x][0] for x in group))
    return out


def planted(r, dim, groups, noise, labels):
    out = []
    for size in groups:
        base = r.standard_normal(dim)
        base /= np.linalg.norm(base)
        label = int(r.integers(labels))
        for _ in range(size):
            x = base + noise * r.standard_normal(dim) / math.sqrt(dim)
            out.append((x * r.uniform(0.5, 2), label))
    return out


@pytest.mark.parametrize(("dim", "kind", "block"), [(64, "float", 512), (24, "double", 7)])
def test_near_vectors(spark, dim, kind, block):
    """All links of groups from two to three hundred members, chains at the threshold, copies and rows that link with nothing."""
    r = np.random.default_rng(dim)
    found = planted(r, dim, [300, 80, 9, 5] + [2] * 40 + [1] * 300, 0.13, 4)
    base = r.standard_normal(dim)
    side = r.standard_normal(dim)
    side -= (side @ base) / (base @ base) * base
    side *= np.linalg.norm(base) / np.linalg.norm(side)
    found += [(math.cos(t) * base + math.sin(t) * side, 1) for t in np.arange(30) * 0.19]  # neighbours are linked, others are not
    as_list = lambda x: [float(np.float32(e)) if kind == "float" else float(e) for e in x]
    rows = [(k, as_list(x), label) for k, (x, label) in enumerate(found)]
    rows += [(1000 + k, rows[400][1], rows[400][2]) for k in range(50)] + [rows[401], rows[401]]  # copies; repeated rows
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 1), (2003, [math.nan] + [1.0] * (dim - 1), 1), (2004, [None] + [1.0] * (dim - 1), 1), (2005, [math.inf] * dim, 1), (2006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (401, rows[3][1], rows[3][2])]
    table = spark.createDataFrame([(*x, "clash") for x in rows], f"vec_id long, embedding array<{kind}>, label int, v string").repartition(5)
    got = pivots.near_vectors(table, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    expected = [(i, n, c, i == c) if i is not None else (None, 0, None, True) for (i, *_), (n, c) in zip(rows, plain_vectors(rows, 0.98), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert max(n for _, n, *_ in expected) > 250


def test_recall_is_measured(spark):
    """Pairs right at the threshold, where the index is weakest: at least 0.9 of them are found, and never a pair below."""
    r = np.random.default_rng(1)
    rows = []
    for k in range(1500):
        x, z = r.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        y = 0.9801 * x + math.sqrt(1 - 0.9801**2) * z
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, y.tolist(), 0)]
    found = {x.vec_id: x for x in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    recall = sum(found[2 * k + 1].component_id == 2 * k for k in range(1500)) / 1500
    assert recall >= 0.999 and max(x.n_links for x in found.values()) == 1


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert pivots.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, [1.0, 0.0], "a"), (3, [1.0, 0.01], "a"), (4, [1.0, 0.0], "b"), (9, None, "a")]
    got = {tuple(x) for x in pivots.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(5, 1, 3, False), (3, 1, 3, True), (4, 0, 4, True), (9, 0, 9, True)}


def test_thinned_pivots_are_apart():
    r = np.random.default_rng(2)
    crowd = np.ones(16) + 0.01 * r.standard_normal((700, 16))
    unit = np.concatenate([crowd, r.standard_normal((600, 16))])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    kept = pivots.thinned(unit, 0.9)
    near = kept @ kept.T - 2 * np.eye(len(kept))
    assert near.max() < 0.9 and (unit @ kept.T).max(1).min() >= 0.9 and (crowd[:1] @ kept.T > 3.6).sum() == 1
