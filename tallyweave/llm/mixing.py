"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

Sources form a tree of domain, language and source. A node can give at most its texts' tokens times max_epochs. From the
root down, each parent's budget is dealt to its children by weight; a child that cannot take its share is filled and what
it leaves goes to its siblings by weight. As a parent's budget never exceeds what its children hold together, a shortage
leaves a family only after all siblings are full. The level at which a family saturates is found in closed form: children
stand by capacity per weight, and the first k are full where filling them leaves the rest too little.

Each leaf then spends its budget in epochs: whole passes over its documents, and of the last pass the token prefix in the
order of a seeded hash of epoch and document. The cut is found without sorting a leaf: documents fall into about
sqrt(documents of the leaf) hash ranges, range sums say which range holds the cut, and only that range is ordered.

Tokens are words. Null domain, language and source are nodes of their own. Null and empty texts have no tokens and are
not selected. Rows with one id have one hash and follow by tokens; rows that are equal in both (repeated rows) are filled one
after the other, so a budget is never overspent. A column of keep that is called like one of the tree's stands for it; n_tokens, epochs and
n_taken cannot be kept. An empty table gives no rows. Weights not listed are 1; a node without tokens is left out. Fractions
of a token in a leaf's budget are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import _base

LEVELS = ("domain", "lang", "source")


def _weight(column: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for value, w in weights.items():
        out = F.when(F.col(column) == value, F.lit(float(w))).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def _dealt(nodes: DataFrame, parents: list[str], budget: str) -> DataFrame:
    """nodes with cap and weight under parents with a budget -> column share: what each child gets."""
    w = Window.partitionBy(*parents).orderBy((F.col("cap") / F.col("weight")), *[c for c in nodes.columns if c.startswith("k_")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*parents)
    one = nodes.withColumns({"c_before": F.sum("cap").over(w), "w_upto": F.sum("weight").over(w), "w_all": F.sum("weight").over(whole)})
    full = F.col("c_before") + F.col("cap") / F.col("weight") * (F.col("w_all") - F.col("w_upto")) <= F.col(budget)
    two = one.withColumn("full", full)
    rest = F.col(budget) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return two.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("weight") / free)).drop("c_before", "w_upto", "w_all", "full")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], *, target: int | None, fraction: float, max_epochs: int) -> DataFrame:
    """One row per leaf (k_domain, k_lang, k_source, tokens, docs): its budget in whole tokens. Rows are nodes of the tree, not documents."""
    level = leaves.where("tokens > 0").withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    keys = [f"k_{c}" for c in LEVELS]
    total = level.agg(F.sum("cap").alias("cap_all"), F.sum("tokens").alias("tokens_all"))
    goal = F.least(F.col("cap_all"), F.lit(float(target)) if target is not None else F.floor(F.col("tokens_all") * fraction).cast("double"))
    out = total.select(goal.alias("budget"))
    for depth in range(3):
        own = keys[: depth + 1]
        nodes = level.groupBy(*own, *LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(LEVELS[depth], weights.get(LEVELS[depth], {}))).where("weight > 0")
        nodes = nodes.join(F.broadcast(out)) if depth == 0 else nodes.join(out, keys[:depth])
        # a family of weighted nodes may hold less than it is given when weights of 0 leave nodes out
        nodes = nodes.withColumn("budget", F.least(F.col("budget"), F.sum("cap").over(Window.partitionBy(*keys[:depth]))))
        out = _dealt(nodes, keys[:depth], "budget").select(*own, F.col("share").alias("budget"))
    return level.select(*keys, "tokens", "docs").join(out, keys).withColumn("budget", F.floor(F.round("budget", 6)).cast("long"))


def _place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of md5 of seed:epoch:doc_id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mixed(
    docs: DataFrame, weights: Mapping[str, Mapping[str, float]], *, domain: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    target: int | None = None, fraction: float = 0.5, max_epochs: int = 4, seed: int = 0, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Selected document rows: keep, doc_id, domain, lang, source, n_tokens, epochs (passes that include it) and n_taken (tokens over all passes; the cut document gives a part)."""
    if clash := {"n_tokens", "epochs", "n_taken"} & set(keep):
        raise ValueError(f"keep cannot name {sorted(clash)}")
    keys = [f"k_{c}" for c in LEVELS]
    own = docs.select(F.col(doc_id).alias("doc_id"), domain.cast("string").alias("domain"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)))
    own = own.select("*", *(_base.group_key(c).alias(k) for c, k in zip(LEVELS, keys, strict=True)))
    facts = _base.staged(own.select("doc_id", *LEVELS, *keys, "n_tokens").where("n_tokens > 0"), "facts")
    leaves = facts.groupBy(*keys, *LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = budgets(leaves, weights, target=target, fraction=fraction, max_epochs=max_epochs)
    plan = plan.withColumns({"passes": F.floor(F.col("budget") / F.col("tokens")).cast("long"), "ranges": F.ceil(F.sqrt("docs")).cast("long")}).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens")).drop("tokens", "docs", "budget")
    plan = _base.staged(plan, "plan")
    small = plan.limit(20_001).count() <= 20_000
    near = (lambda x: F.broadcast(x)) if small else (lambda x: x)  # beyond that, joins are dealt by key and split if skewed
    place = _place(seed, F.col("passes"), F.col("doc_id"))
    spot = facts.join(near(plan), keys).where("rest > 0").withColumn("place", place).withColumn("range", F.floor(F.col("place") / F.lit(float(2**60)) * F.col("ranges")).cast("long"))
    sums = spot.groupBy(*keys, "range", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = sums.withColumn("before", upto - F.col("t")).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))).select(*keys, F.col("range").alias("cut"), (F.col("rest") - F.col("before")).alias("left"))
    inside = spot.join(near(cuts), keys).where(F.col("range") == F.col("cut"))
    # rows of one place, id and length (repeated rows) are one step of the walk, however many they are
    inside = inside.groupBy(*keys, "left", "place", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("m"))
    walk = Window.partitionBy(*keys).orderBy("place", "doc_id", "n_tokens")
    inside = inside.withColumn("got", F.sum(F.col("n_tokens") * F.col("m")).over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens") * F.col("m"))
    last = inside.where(F.col("got") < F.col("left")).withColumn("given", F.least(F.col("n_tokens") * F.col("m"), F.col("left") - F.col("got"))).groupBy(*keys).agg(F.max(F.struct("place", "doc_id", "n_tokens", "m", "given")).alias("last"))
    full = _base.staged(plan.join(last, keys, "left"), "cuts")
    e = F.col("last")
    spot_key = F.struct(place.alias("place"), F.col("doc_id"), F.col("n_tokens"))
    last_key = F.struct(e["place"].alias("place"), e["doc_id"].alias("doc_id"), e["n_tokens"].alias("n_tokens"))
    part = F.when(e.isNull() | (spot_key > last_key), F.lit(0)).when(spot_key == last_key, e["given"]).otherwise(F.col("n_tokens"))
    out = own.where("n_tokens > 0").join(near(full), keys).withColumn("part", part.cast("long"))
    if not full.where("last.m > 1").isEmpty():
        tied = (spot_key == last_key) & (e["m"] > 1)
        out = out.where(~F.coalesce(tied, F.lit(False))).unionByName(_shared_out(out.where(tied), keys))
    out = out.withColumns({"epochs": F.col("passes") + (F.col("part") > 0).cast("long"), "n_taken": F.col("passes") * F.col("n_tokens") + F.col("part")}).where("epochs > 0")
    return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), *(c for c in ("doc_id", *LEVELS) if c not in keep), "n_tokens", "epochs", "n_taken")


def _shared_out(tied: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated rows at a leaf's cut: what is given to them fills one after the other. They are numbered where they lie, and
    each partition starts at the sum of those before it, so no leaf's rows meet in one task."""
    rows = _base.staged(tied.withColumn("__row", F.monotonically_increasing_id()), "tied").withColumn("__at", F.shiftright("__row", 33))
    upto = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = rows.groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(upto) - F.col("__n")).drop("__n")  # a row per leaf and partition
    number = F.row_number().over(Window.partitionBy(*keys, "__at").orderBy("__row")) - 1
    left = F.col("part") - (F.col("__before") + F.col("__number")) * F.col("n_tokens")
    out = rows.withColumn("__number", number).join(starts, [*keys, "__at"])
    return out.withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_tokens"), left)).cast("long")).select(*tied.columns)


#: What the query and the pipeline ask for: weights of the three levels; sources are dealt to domains by their number.
DOMAIN_SQL = "concat('domain', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4, 0))"
WEIGHTS = {"domain": {"domain0": 1.0, "domain1": 3.0, "domain2": 2.0, "domain3": 2.0}, "lang": {"en": 2.0, "de": 1.5, "fr": 1.0, "es": 1.0}, "source": {"src0": 0.5}}


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Documents selected for 60 percent of the corpus's tokens, at most 4 epochs a source."""
    docs = _base.table(spark, sf_dir, "documents")
    return mixed(docs, WEIGHTS, domain=F.expr(DOMAIN_SQL), fraction=0.6, max_epochs=4, seed=17)


def _cases(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{v}' THEN {w}" for v, w in WEIGHTS[column].items()) + " ELSE 1.0 END::DOUBLE"


def _level(depth: int) -> str:
    own, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
    part = f"PARTITION BY {up}" if up else ""
    source = f"n{depth - 1}_out" if depth else "goal"
    join = f"JOIN {source} USING ({up})" if up else f", {source}"
    return f"""
n{depth}_in AS (SELECT l.*, {source}.budget FROM (SELECT {own}, sum(cap) AS cap, {_cases(LEVELS[depth])} AS weight FROM leaves GROUP BY {own}) l {join}),
n{depth}_w AS (SELECT *, sum(cap) OVER (w ROWS UNBOUNDED PRECEDING) AS c_before, sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) AS w_upto, sum(weight) OVER ({part}) AS w_all FROM n{depth}_in WINDOW w AS ({part} ORDER BY cap / weight, {own})),
n{depth}_f AS (SELECT *, c_before + cap / weight * (w_all - w_upto) <= budget AS sat FROM n{depth}_w),
n{depth}_out AS (SELECT {own}, CASE WHEN sat THEN cap ELSE (budget - coalesce(sum(CASE WHEN sat THEN cap END) OVER ({part}), 0)) * weight / sum(CASE WHEN NOT sat THEN weight END) OVER ({part}) END AS budget FROM n{depth}_f)"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, 'domain' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4, 0) AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * 4 AS cap FROM d WHERE n_tokens > 0 GROUP BY ALL),
goal AS (SELECT least(sum(cap), floor(sum(tokens)::DOUBLE * 0.6)) AS budget FROM leaves),{_level(0)},{_level(1)},{_level(2)},
p AS (SELECT domain, lang, source, floor(round(budget, 6))::BIGINT // tokens AS passes, floor(round(budget, 6))::BIGINT % tokens AS rest FROM n2_out JOIN leaves USING (domain, lang, source)),
o AS (SELECT d.*, passes, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || passes || ':' || doc_id)[:15], doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS got FROM d JOIN p USING (domain, lang, source) WHERE n_tokens > 0),
t AS (SELECT *, greatest(0, least(n_tokens, rest - got))::BIGINT AS part FROM o)
SELECT doc_id, domain, lang, source, n_tokens, (passes + (part > 0)::BIGINT)::BIGINT AS epochs, (passes * n_tokens + part)::BIGINT AS n_taken FROM t WHERE passes + (part > 0)::BIGINT > 0
"""
