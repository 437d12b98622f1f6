"""Bounds that lose nothing, repeated rows, keys that a third of the rows share, and toxicity against a plain twin."""

from __future__ import annotations

import collections
import math
import random
import re
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import _base, lmscore, mixing, neardup, pii, secrets, toxicity

# -- mixing: repeated rows at the cut -----------------------------------------------------------------------------


def test_repeated_rows_fill_one_after_the_other(spark):
    rows = [(1, "a b c d e f g h i j", "en", "s")] * 3 + [(2, "k l m", "en", "s"), (2, "k l m n", "en", "s"), (None, "o p", "en", "s"), (None, "o p", "en", "s"), (3, None, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    for target in range(1, 2 * total + 1, 3):
        got = mixing.mixed(docs, {}, domain=F.lit("d"), target=target, max_epochs=2, seed=5, keep=("text",)).collect()
        assert sum(r.n_taken for r in got) == target, target
        assert all(0 < r.n_taken <= r.epochs * r.n_tokens and r.epochs <= 2 for r in got)


def test_columns_that_mixing_keeps(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", "mine")], "doc_id long, text string, lang string, source string, domain string")
    got = mixing.mixed(docs, {}, domain=F.lit("theirs"), fraction=1.0, keep=("domain", "lang"))
    assert sorted(got.columns) == sorted(["domain", "lang", "doc_id", "source", "n_tokens", "epochs", "n_taken"]) and got.first().domain == "mine"
    with pytest.raises(ValueError):
        mixing.mixed(docs.withColumn("epochs", F.lit(1)), {}, domain=F.lit("d"), keep=("epochs",))


# -- toxicity: the bound on labelled text, and a plain twin ----------------------------------------------------------


def test_one_long_text_costs_no_class(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice("abcdefgh") * 4 for _ in range(20)), k % 3 == 0) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows], "doc_id long, toxic int")
    plain = toxicity.training_rows(docs, labels, max_docs=40)
    first = docs.join(spark.createDataFrame([(i,) for _, y, i in plain if y], "doc_id long"), "doc_id").orderBy(F.xxhash64("doc_id")).first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 1000)).otherwise(F.col("text")))
    got = toxicity.training_rows(long, labels, max_docs=40, max_bytes=8000)
    assert {i for *_, i in got if i != first} == {i for *_, i in plain} - {first} and sum(y for _, y, _ in got) == sum(y for _, y, _ in plain) - 1
    tight = toxicity.training_rows(docs, labels, max_docs=40, max_bytes=2)  # none fits: the shortest of each class
    assert sorted(y for _, y, _ in tight) == [0, 1]
    assert toxicity.within([(3, "a", 0, 9), (1, "b", 0, 7), (2, "c", 0, 4), (5, "d", 0, 3), (4, "e", 1, 99), (6, "f", 1, 98)], 10) == ["b", "d", "f"]


def plain_model(texts, labels, rate_false=0.05, rounds=200, rate=0.05, decay=0.02):
    """Training step by step over plain lists: Fisher's exact test in whole numbers, Tarone's count, Benjamini and Hochberg's cutoff, Adam."""
    word = re.compile(r"[^\W_]+")
    grams = lambda w: [m[k : k + n] for m in [f"^{w}$"] for n in range(4, 8) for k in range(max(1, len(m) - n + 1))]
    bags = [[b for s in re.findall(r"[^.!?\n]+", t) if (b := set(word.findall(s.lower())))] for t in texts]
    holds = [{g for b in doc for w in b for g in grams(w)} for doc in bags]
    total, pos = len(texts), sum(labels)
    df, hits = collections.Counter(g for h in holds for g in h), collections.Counter(g for h, y in zip(holds, labels) if y for g in h)
    comb = math.comb

    def chance(k, n):
        return Fraction(sum(comb(pos, j) * comb(total - pos, n - j) for j in range(k, min(n, pos) + 1)), comb(total, n))

    least = {n: chance(min(n, pos), n) for n in set(df.values())}
    tests = next(t for t in range(1, len(df) + 2) if sum(least[n] <= Fraction(rate_false) / t for n in df.values()) <= t)
    p = {g: chance(hits[g], n) for g, n in df.items() if least[n] <= Fraction(rate_false) / tests}
    order = sorted(p.values())
    cut = max((x for k, x in enumerate(order, 1) if x <= Fraction(rate_false) * k / len(order)), default=None)
    vocab = sorted(g for g, x in p.items() if cut is not None and x <= cut)
    at = {g: k for k, g in enumerate(vocab)}
    sentences = [[[at[g] for w in sorted(b) for g in grams(w) if g in at] for b in doc] for doc in bags]
    w, b = [0.3] * len(vocab), -6.0
    m, v = [0.0] * (len(vocab) + 1), [0.0] * (len(vocab) + 1)
    for step in range(1, rounds + 1):
        slope = [decay * x / total for x in w] + [0.0]
        for doc, y in zip(sentences, labels):
            ps = [1 / (1 + math.exp(-max(-30, min(30, b + sum(w[k] for k in s))))) for s in doc]
            clean = math.exp(sum(math.log1p(-min(x, 1 - 1e-12)) for x in ps))
            toxic = min(max(1 - clean, 1e-9), 1)
            weight = 0.3 / pos if y else 0.7 / (total - pos)
            for s, x in zip(doc, ps):
                g = weight * (-x * clean / toxic if y else x)
                for k in s:
                    slope[k] += g
                slope[-1] += g
        for k, g in enumerate(slope):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            move = rate * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if k < len(w):
                w[k] -= move
            else:
                b -= move
    weights = {g: x for g, x in zip(vocab, w) if abs(x) > 1e-3}

    def score(text):
        clean = 1.0
        for s in re.findall(r"[^.!?\n]+", text or ""):
            if words := set(word.findall(s.lower())):
                clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, b + sum(weights.get(g, 0) for x in words for g in grams(x))))))
        return 1 - clean

    return weights, b, score


def test_toxicity_against_a_plain_twin(spark):
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randrange(2, 8))) for _ in range(150)]
    made = []
    for k in range(200):
        text = ". ".join(" ".join(r.choice(vocab) for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(1, 5)))
        made.append((k, text + (f"! {r.choice(vocab)} schuft{r.choice('xyz')} {r.choice(vocab)}." if k % 6 == 0 else "\n")))
    made += [(200, None), (201, ""), (202, ". ! \n ?"), (203, "SCHUFTX! hello_schufty")]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(200)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, max_docs=3000)
    model = toxicity.train([t for t, *_ in rows], [y for _, y, _ in rows])
    weights, bias, score = plain_model([t for t, *_ in rows], [y for _, y, _ in rows])
    assert weights and set(model.weights) == set(weights) and model.bias == pytest.approx(bias, abs=1e-6)
    assert all(model.weights[g] == pytest.approx(x, abs=1e-6) for g, x in weights.items())
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs, model).collect()}
    for i, t in made:
        assert got[i] == pytest.approx(score(t), abs=1e-6), i


# -- hot keys ------------------------------------------------------------------------------------------------------


def test_a_hot_key_fills_no_task(spark):
    """A third of the rows share one key (of one or two columns) and facts are too many to be sent: all tasks get about as much."""
    rows = spark.range(30_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("a"), F.lit("x").alias("b"), "id")
    facts = _base.staged(spark.range(30_000).select(F.col("id").alias("a"), F.lit("x").alias("b"), (F.col("id") * 2).alias("y")), "facts")
    sent, _base.SENT_ROWS = _base.SENT_ROWS, 100
    try:
        for key in ("a", ["a", "b"]):
            found = _base.looked_up(rows, facts if key != "a" else facts.drop("b"), key)
            assert found.where("y = 2 * a").count() == 30_000
            sizes = [x.n for x in found.where("a = 7").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
            assert len(sizes) >= 8 and max(sizes) <= 2 * statistics.median(sizes)
    finally:
        _base.SENT_ROWS = sent


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share a secret, a number, the words before it, and a text with few changes."""
    r = random.Random(8)
    base = [f"x{k}" for k in range(80)]
    rows = []
    for k in range(240):
        if k % 3 == 0:
            own = list(base)
            own[r.randrange(80)] = f"y{r.randrange(40)}"
            text = " ".join(own) + f" password=hunter2hunter2 mail kim@example.org serial no A{r.randrange(5)}77123"
        else:
            text = " ".join(f"w{r.randrange(10**6)}" for _ in range(30)) + f" token: {r.randrange(10**9):012d} serial no {'+49 30 1234' + str(1000 + k) if k % 4 else f'B{k}99881'}"
        rows.append((k, text, f"src{k % 5}"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).cache()


@pytest.mark.parametrize("call", [lambda d: neardup.near_duplicates(d, block=8), lambda d: secrets.secret_spans(d), lambda d: pii.personal_spans(d)])
def test_hot_values_patterns_and_buckets(hot, monkeypatch, call):
    """What is looked up by hot keys is the same whether facts are sent, split or dealt."""
    want = sorted(map(str, call(hot).collect()))
    monkeypatch.setattr(_base, "SENT_ROWS", 3)
    assert sorted(map(str, call(hot).collect())) == want


# -- names of rows in language-model scoring ------------------------------------------------------------------------


def test_rows_that_share_a_name_are_named_anew(spark, monkeypatch):
    r = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(r.paretovariate(0.8)) % 60}" for _ in range(r.randrange(30)))) for k in range(40)] + [(None, "a b"), (3, None)], "doc_id long, text string").repartition(3)
    want = sorted(map(str, lmscore.scores(docs).collect()))
    asked = []

    def weak(seed):
        asked.append(seed)
        return F.pmod(F.xxhash64("doc_id", "text"), F.lit(5)) if seed == 0 else F.xxhash64("doc_id", "text", F.lit(seed))

    monkeypatch.setattr(lmscore, "_name", weak)
    assert sorted(map(str, lmscore.scores(docs).collect())) == want and asked == [0, 1]
