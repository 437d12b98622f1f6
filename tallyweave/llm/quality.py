"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base features come from each whole text. Each rule compares a ratio with a cutoff from a fixed grid. Per stratum and rule
a cutoff may only be used if labelled good documents prove it safe: with k of n rejected, the exact binomial chance of k
or fewer at rate alpha / rules must be at most delta / (strata * rules * grid) (Clopper-Pearson, Bonferroni over all
choices), so with confidence 1 - delta no stratum loses more than alpha of its good documents to the rules. Of the safe
cutoffs the one rejecting most labelled bad documents is taken (ties: the mildest); one that rejects none stays off.

Null and empty texts: no words, all counts 0, base_failed. A null stratum is a stratum of its own. Labels that are null
or lack a document teach nothing; of repeated labels the smaller counts. No labels: no cutoff, base rules alone.
Repeated documents are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base

SYMBOLS = "#*$%&|<>"
#: Rules: a ratio of features and its grid of cutoffs, mildest first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (2.0, 1.0, 0.75, 0.5, 0.3, 0.2)),
    "dup_lines": ("n_dup_lines / n_lines", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / n_words", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "capitals": ("n_capitals / word_chars", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
}


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and, per row, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals."""
    t = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_base.SPACES)) != "")
    one = docs.select(*keep, t.alias("__t"), _base.words_of(t).alias("__w"), worded.alias("__l"))
    n = F.size("__w")
    windows = F.when(n < 3, F.array().cast("array<string>")).otherwise(F.expr("transform(sequence(0, size(__w) - 3), i -> concat_ws(' ', __w[i], __w[i + 1], __w[i + 2]))"))
    two = one.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", _base.SPACES, "")).cast("long").alias("word_chars"),
        _removed(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _removed(F.col("__t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        windows.alias("__x"),
    )
    # only texts that repeat a window are sorted; equal windows then stand side by side
    three = two.withColumn("__x", F.expr("CASE WHEN size(array_distinct(__x)) = size(__x) THEN array() ELSE sort_array(transform(__x, (x, i) -> struct(x AS x, i AS i))) END"))
    four = three.withColumn("__x", F.expr("transform(filter(__x, (s, k) -> (k > 0 AND s.x = get(__x, k - 1).x) OR coalesce(s.x = get(__x, k + 1).x, false)), s -> s.i)"))
    return four.withColumn("n_repeat_words", F.expr("size(array_union(array_union(__x, transform(__x, i -> i + 1)), transform(__x, i -> i + 2)))").cast("long")).drop("__x")


def _ratio(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom)), F.lit(0.0))


def _log_tail(k: str, n: str, rate: float) -> Column:
    """Log of the chance that a binomial of n trials at `rate` gives k or fewer; both folds have k steps."""
    odds = f"{rate / (1 - rate)!r}D"
    top = f"aggregate(sequence(1L, {k}), 0D, (a, i) -> a + ln(({n} - i + 1) / i * {odds}))"
    share = f"aggregate(sequence(1L, {k}), named_struct('t', 1D, 's', 1D), (a, i) -> named_struct('t', a.t * ({k} - i + 1) / ({n} - {k} + i) / {odds}, 's', a.s + a.t * ({k} - i + 1) / ({n} - {k} + i) / {odds}), a -> ln(a.s))"
    return F.expr(f"{n} * ln(1 - {rate!r}D) + CASE WHEN {k} = 0 THEN 0D ELSE {top} + {share} END")


def cutoffs(feats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", stratum: str = "stratum", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Per stratum: one column cut_<rule> each (null: no cutoff is safe and useful). feats has doc_id, stratum and the features."""
    good = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__i")).agg(F.min(label).alias("__y"))
    known = feats.join(good, F.col(doc_id) == F.col("__i")).select(stratum, (F.col("__y") > 0).alias("good"), *(_ratio(r).alias(r) for r in RULES))
    sums = [F.count_if("good").alias("n_good")]
    for r, (_, grid) in RULES.items():
        for k, cut in enumerate(grid):
            sums += [F.count_if(F.col("good") & (F.col(r) > cut)).alias(f"{r}_{k}_good"), F.count_if(~F.col("good") & (F.col(r) > cut)).alias(f"{r}_{k}_bad")]
    counts = known.groupBy(stratum).agg(*sums)
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("k"), F.lit(cut).alias("cut"), F.col(f"{r}_{k}_good").alias("lost"), F.col(f"{r}_{k}_bad").alias("caught")) for r, (_, grid) in RULES.items() for k, cut in enumerate(grid))))
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))  # one row
    rate, choices = alpha / len(RULES), sum(len(g) for _, g in RULES.values())
    tried = counts.select(stratum, "n_good", rules.alias("t")).select(stratum, "n_good", "t.*").join(F.broadcast(strata))
    safe = tried.where((F.col("lost") < rate * F.col("n_good")) & (F.col("caught") > 0)).where(_log_tail("lost", "n_good", rate) <= F.log(F.lit(delta) / (F.col("strata") * choices)))
    best = safe.groupBy(stratum).agg(*(F.max_by(F.when(F.col("rule") == r, F.col("cut")), F.when(F.col("rule") == r, F.struct("caught", -F.col("k")))).alias(f"cut_{r}") for r in RULES))
    return best


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, the features, base_failed, failed_rules (names), kept."""
    own = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("__text"), _base.group_key(stratum).alias("stratum"))
    feats = _base.staged(features(own, text="__text", keep=("doc_id", *keep, "stratum")), "quality")
    cuts = cutoffs(feats, labels.withColumnRenamed(doc_id, "doc_id"), doc_id="doc_id", alpha=alpha, delta=delta)
    cuts = _base.staged(cuts, "cutoffs")
    small = cuts.limit(10_001).count() <= 10_000  # strata are few; beyond that the join is left to the planner
    out = feats.join(F.broadcast(cuts) if small else cuts, "stratum", "left")
    failed = F.array_compact(F.array(*(F.when(_ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    out = judged(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def _oracle(alpha: float = 0.05, delta: float = 0.05) -> str:
    """DuckDB SQL for the same rows, binomial tails as sums of their terms."""
    rate, choices = alpha / len(RULES), sum(len(g) for _, g in RULES.values())
    ratio = {r: f"coalesce({top}::DOUBLE / nullif({bottom}, 0), 0)" for r, (x, _) in RULES.items() for top, bottom in [x.split(" / ")]}
    grid = ", ".join(f"('{r}', {k}, {cut}::DOUBLE)" for r, (_, g) in RULES.items() for k, cut in enumerate(g))
    of_rule = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in ratio.items()) + " END"
    term = f"exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({rate}::DOUBLE) + (n_good - j) * ln(1 - {rate}::DOUBLE))"
    failed = ", ".join(f"CASE WHEN {ratio[r]} > (SELECT cut FROM best WHERE best.stratum = f.stratum AND rule = '{r}') THEN '{r}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '-') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
l AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
known AS (SELECT f.*, good FROM f JOIN l ON f.doc_id = l.doc_id),
grid(rule, k, cut) AS (VALUES {grid}),
tried AS (SELECT stratum, rule, k, cut, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE good AND {of_rule} > cut) AS lost, count(*) FILTER (WHERE NOT good AND {of_rule} > cut) AS caught FROM known, grid GROUP BY stratum, rule, k, cut),
safe AS (SELECT * FROM tried WHERE lost < {rate} * n_good AND caught > 0 AND list_sum(list_transform(range(0, lost + 1), lambda j: {term})) <= {delta}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM known) * {choices})),
best AS (SELECT stratum, rule, cut FROM safe QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught DESC, k) = 1),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([{failed}], lambda x: x IS NOT NULL) AS fails FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(fails) = 0 AS kept, coalesce(array_to_string(fails, ','), '') AS failed_rules FROM j
"""


ORACLE_SQL = _oracle()
