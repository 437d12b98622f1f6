"""Toxicity by multiple-instance learning: a sentence's score is a logistic sum over its words
(each word: its character runs), a document's score the
noisy-or of its sentences, and only document labels train both. The sentences that carry the score are located.

Training reads at most `max_docs` labelled documents and `max_bytes` of text (the documented bounds: half of each class,
the least hashes of the id first, whole texts, so the choice does not depend on how the rows are laid out). A text that does
not fit into what is left is passed over, and the next ones are looked at; where none of a class fits, its shortest text is
read all the same, so that no class is lost. Scoring reads every text whole.

Features are chosen by an exact test against the classes' sizes, not by a fixed bar: see `selected`.

Nulls, empty texts: no sentence, score 0. Labels that are null or lack a document teach nothing; of repeated labels the
larger counts. No labelled row of either class: all scores are 0. Repeated documents are scored row by row.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def grams(word: str) -> Iterator[str]:
    """A word's features, one at a time: the runs of 4 to 7 characters of the whole word, its edges marked."""
    marked = f"^{word}$"
    return (marked[k : k + n] for n in range(4, 8) for k in range(max(1, len(marked) - n + 1)))


class Model:
    """Weights of features and a bias; a sentence's logit is the bias and the weights of its different words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self._known = weights, bias, {}

    def _word(self, word: str) -> float:
        if (z := self._known.get(word)) is None:
            z = sum(self.weights.get(g, 0.0) for g in grams(word))
            if len(word) <= 200:  # longer ones are summed anew, so that what is kept stays small
                if len(self._known) > 200_000:
                    self._known.clear()
                self._known[word] = z
        return z

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Where sentences with a word lie, and each one's probability."""
        spans, z = [], []
        for m in _SENTENCE.finditer(text):
            words = set(_WORD.findall(m.group().lower()))
            if words:
                spans.append(m.span())
                z.append(self.bias + sum(map(self._word, sorted(words))))
        return spans, 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))

    def score(self, p: np.ndarray) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def _chances(total_pos: int, total: int, n: int) -> np.ndarray:
    """Chance that of n documents drawn from total ones, total_pos of them toxic, at least k are toxic, for k from 0 on."""
    k = np.arange(max(0, n + total_pos - total), min(n, total_pos) + 1)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total + 1)))])
    choose = lambda a, b: log[a] - log[b] - log[a - b]
    tail = np.cumsum(np.exp(choose(total_pos, k) + choose(total - total_pos, n - k) - choose(total, n))[::-1])[::-1]
    return np.minimum(1.0, np.concatenate([np.ones(k[0]), tail]))


def selected(pos: Counter, df: Counter, total_pos: int, total: int, rate: float) -> list[str]:
    """Features found in toxic documents more often than chance explains, sorted: Fisher's exact test of each, the share of
    false finds held at `rate` (Benjamini and Hochberg) over those that could be significant at all (Tarone). The cutoff
    so follows from the classes' sizes and the features at hand."""
    chances = {n: _chances(total_pos, total, n) for n in set(df.values())}
    # the fewest tests that a Bonferroni level can count: features whose least possible chance reaches that level
    found = sorted((chances[n][-1], c) for n, c in Counter(df.values()).items())
    least, counts = np.array([x for x, _ in found]), np.cumsum([c for _, c in found])
    able_at = lambda tests: int(counts[k - 1]) if (k := np.searchsorted(least, rate / tests, side="right")) else 0
    low, tests = 0, max(1, len(df))
    while tests - low > 1:  # able_at falls as tests rises
        low, tests = (low, mid) if able_at(mid := (low + tests) // 2) <= mid else (mid, tests)
    able = {n for n in chances if chances[n][-1] <= rate / tests}
    p = {g: chances[n][pos[g]] for g, n in df.items() if n in able}
    order = np.sort(np.fromiter(p.values(), float, len(p)))
    under = np.flatnonzero(order <= rate * np.arange(1, len(order) + 1) / max(1, len(order)))
    return sorted(g for g, x in p.items() if len(under) and x <= order[under[-1]])


def train(texts: list[str], labels: list[int], *, rate_false: float = 0.05, rounds: int = 200, rate: float = 0.05, decay: float = 0.02) -> Model:
    """Adam on the class-balanced noisy-or likelihood, over features that `selected` finds; of them about rate_false are
    found by chance. Deterministic."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -30.0)
    bags = [[b for m in _SENTENCE.finditer(t) if (b := {sys.intern(w) for w in _WORD.findall(m.group().lower())})] for t in texts]
    df, pos = Counter(), Counter()
    for doc, label in zip(bags, labels, strict=True):
        own = set()
        for word in set().union(*doc) if doc else ():
            own.update(grams(word))
        df.update(own)
        if label:
            pos.update(own)
    vocab = {g: k for k, g in enumerate(selected(pos, df, int(y.sum()), len(y), rate_false))}
    del df, pos
    ids = {w: got for w in {w for doc in bags for bag in doc for w in bag} if (got := [vocab[g] for g in grams(w) if g in vocab])}
    cols, rows, docs = [], [], []
    for d, doc in enumerate(bags):
        for bag in doc:
            own = [k for w in sorted(bag) for k in ids.get(w, ())]
            cols += own
            rows += [len(docs)] * len(own)
            docs.append(d)
    cols, rows, docs = (np.array(x, np.int64) for x in (cols, rows, docs))
    weight = np.where(y > 0, 0.3 / y.sum(), 0.7 / (len(y) - y.sum()))
    w, b = np.full(len(vocab), 0.3), -6.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        z = np.clip(b + np.bincount(rows, w[cols], len(docs)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of the chance that no sentence is toxic
        doc_p = np.clip(-np.expm1(none), 1e-9, 1)
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        slope = weight[docs] * np.where(y[docs] > 0, -p * np.exp(none[docs]) / doc_p[docs], p)
        g = np.append(np.bincount(cols, slope[rows], len(w)) + decay * w / len(y), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({t: float(w[k]) for t, k in vocab.items() if abs(w[k]) > 1e-3}, float(b))


def training_rows(docs: DataFrame, labels: DataFrame, *, max_docs: int, max_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[str, int]]:
    """At most max_docs (text, label) and max_bytes of rows that aren't held out, half of each class; only ids are ranked, so
    no text is shuffled but those that are picked."""
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("i")).agg(F.max(F.col(label).cast("int")).alias("y"))
    order = [F.xxhash64(F.col("i")), F.col("i")]
    picked = rows.where("y = 1").orderBy(*order).limit(max_docs // 2).unionByName(rows.where("y = 0").orderBy(*order).limit(max_docs // 2))
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(picked), "i")  # max_docs ids at most
    own = _base.staged(texts.groupBy("i", "y").agg(F.min("t").alias("t")), "training")
    found = own.select("i", "y", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n"), F.xxhash64("i").alias("h")).collect()  # max_docs at most
    sized = within([(r.h, r.i, r.y, r.n) for r in found], max_bytes // 2)
    if not sized:
        return []
    chosen = docs.sparkSession.createDataFrame([(i,) for i in sized], own.select("i").schema)
    return sorted((r.t or "", r.y, r.i) for r in own.join(F.broadcast(chosen), "i").collect())


def within(rows: list[tuple[int, object, int, int]], most: int) -> list:
    """Ids of rows (hash, id, class, bytes) that fit into `most` bytes a class, in the order of their hashes: one that does not fit
    is passed over and the next are looked at. If no row of a class fits, its shortest is taken all the same."""
    out = []
    for y in (0, 1):
        own, left, taken = sorted((h, i, n) for h, i, c, n in rows if c == y), most, []
        for _, i, n in own:
            if n <= left:
                left -= n
                taken.append(i)
        out += taken or [i for *_, i in sorted((n, h, i) for h, i, n in own)[:1]]
    return out


def toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", sentence_at: float = 0.5) -> DataFrame:
    """Per document row: doc_id, score, sentences (start, end in code points, and score of each sentence at or over sentence_at; else the largest one if the document is at 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for value in batch.column(1):
                spans, p = model.sentences(value.as_py() or "")
                scores.append(score := model.score(p))
                keep = [k for k in np.flatnonzero(p >= sentence_at)] or ([int(p.argmax())] if score >= 0.5 else [])
                found.append([{"start": spans[k][0], "end": spans[k][1], "score": float(p[k])} for k in keep])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "sentences"])

    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, score double, sentences array<struct<start:bigint,end:bigint,score:double>>")


def op9_toxicity(spark, sf_dir: str, max_docs: int = 3000) -> DataFrame:
    """The contract's columns for every document; trained on at most max_docs labelled rows outside the held-out fifth."""
    docs = _base.table(spark, sf_dir, "documents")
    rows = training_rows(docs, _base.table(spark, sf_dir, "labels"), max_docs=max_docs)
    model = train([t for t, _, _ in rows], [y for _, y, _ in rows])
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_sentences"))
