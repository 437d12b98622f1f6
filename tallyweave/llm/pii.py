"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Checked base spans (addresses, numbers) are the seeds. The one and two words before an instance are its lexical patterns.
Round by round a pattern is scored by the share of its distinct instances that are known (and needs `support` known
ones); an unknown identifier-like token whose patterns' noisy-or reaches `accept` becomes known and feeds the next round.
Its occurrences are added as kind found. The graph holds one edge per distinct pattern and instance, counted after
map-side distinct, so a frequent word before numbers is folded before it is shuffled. What is known of a pattern or an instance is
sent to its edges where these are many.

The words before an instance are looked for back to the match of its kind before it. Such a match holds a digit or an at
sign, and no pattern may, so no pattern is lost there.

Nulls, empty texts: no spans. Repeated rows are scanned row by row. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm._spans import Kind, apart, joined, located, located_sql

_BYTE = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LUHN = (
    "aggregate(sequence(1, length(regexp_replace(x.text, '[ -]', ''))), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN int(substr(reverse(regexp_replace(x.text, '[ -]', '')), i, 1)) "
    "ELSE int(substr('0246813579', int(substr(reverse(regexp_replace(x.text, '[ -]', '')), i, 1)) + 1, 1)) END) % 10 = 0"
)
#: The base kinds, in the order in which equal starts are listed. Possessive groups and run starts keep long runs linear.
BASE = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(__t, '@')"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "__t RLIKE '[0-9][.][0-9]'", 0, f"x.text RLIKE '^{_BYTE}([.]{_BYTE}){{3}}$'"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "__t RLIKE '([0-9][ -]?){13}[0-9]'", 0, f"CASE WHEN length(regexp_replace(x.text, '[ -]', '')) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(__t, '+')", 0, "length(regexp_replace(x.text, '[^0-9]', '')) BETWEEN 10 AND 15"),
]


def token(least: int = 6) -> Kind:
    """Identifier-like tokens: words with a digit or an at sign, of `least` characters at least."""
    return Kind("token", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+", "__t RLIKE '[0-9@]'", 0, f"length(x.text) >= {least}")


def personal_spans(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rounds: int = 3, support: int = 3, precision: float = 0.6, accept: float = 0.8, least: int = 6) -> DataFrame:
    """Per document row: keep, base (array of SPAN), spans (base ones and those of kind found).

    least: characters of the shortest unseen identifier. Base kinds have lengths of their own.
    """
    own = docs.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(text).alias("__x"))
    names = [f"__k{i}" for i in range(len(keep))]
    raw = located(own, [*BASE, token(least)], text="__x", keep=names, left_words=2)
    base = f"concat({', '.join(k.name for k in BASE)})"
    free = F.expr(apart("token", base))
    scanned = _base.staged(raw.select(*names, F.expr(base).alias("base"), free.alias("more")).withColumn("__id", F.monotonically_increasing_id()), "personal")
    inst = F.sha2(F.regexp_replace(F.lower("s.text"), "[^a-z0-9@]", ""), 256)
    seen = scanned.where((F.size("base") > 0) | (F.size("more") > 0)).select("__id", F.explode(F.concat("base", "more")).alias("s")).select("__id", inst.alias("i"), (F.col("s.rank") < len(BASE)).alias("seed"), F.col("s.left").alias("left"), "s.start", "s.end", "s.text")
    # patterns: both words if there are two, and the nearer one alone; without digits, so that no identifier is a pattern
    pattern = F.expr("filter(CASE WHEN contains(left, ' ') THEN array(left, concat('* ', element_at(split(left, ' '), -1))) ELSE array(concat('* ', left)) END, p -> left != '' AND NOT p RLIKE '[0-9@]')")
    edges = _base.staged(seen.select("i", "seed", F.explode(pattern).alias("p")).groupBy("p", "i").agg(F.max("seed").alias("seed")), "graph")
    seeds = _base.staged(edges.where("seed").select("i").distinct(), "seeds")
    known = seeds
    for k in range(rounds):
        marked = _base.looked_up(edges, known.withColumn("known", F.lit(True)), "i").withColumn("known", F.coalesce("known", F.lit(False)))
        scored = marked.groupBy("p").agg(F.count_if("known").alias("pos"), F.count(F.lit(1)).alias("n")).where((F.col("pos") >= support) & (F.col("pos") >= precision * F.col("n")))
        scored = _base.staged(scored, "patterns")
        weighed = _base.looked_up(marked.where(~F.col("known")), scored, "p").where("pos IS NOT NULL").groupBy("i").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("pos") / F.col("n"), F.lit(0.999)))))).alias("score"))
        new = _base.staged(weighed.where(F.round("score", 9) >= accept).select("i", F.lit(k).alias("round")), "discovered")
        if new.isEmpty():
            break
        known = known.unionByName(new.select("i"))
    # what became known beyond the seeds, wherever it stands
    extra = _base.staged(known.join(seeds, "i", "left_anti").distinct().withColumn("extra", F.lit(True)), "extra")
    hits = _base.looked_up(seen.where(~F.col("seed")), extra, "i").where("extra").groupBy("__id").agg(F.collect_list(F.struct(F.col("start"), F.lit(len(BASE)).alias("rank"), F.col("end"), F.lit("found").alias("kind"), F.col("text").alias("value"), F.col("text"), F.lit("").alias("left"))).alias("found"))
    out = scanned.join(hits, "__id", "left")
    return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), "base", F.when(F.col("found").isNull(), F.sort_array("base")).otherwise(F.sort_array(F.concat("base", "found"))).alias("spans"))


def op4_personal(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    out = personal_spans(_base.table(spark, sf_dir, "documents"))
    count = lambda column, kind: F.expr(f"CAST(size(filter({column}, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    return out.select("doc_id", *(count("base", k.name) for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), count("spans", "found"))


def _oracle(rounds: int = 3, support: int = 3, precision: float = 0.6, accept: float = 0.8, least: int = 6) -> str:
    digits = "regexp_replace(text, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE ('0246813579')[reverse({digits})[i]::INT + 1]::INT END)) % 10 = 0"
    found = located_sql(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, "true"),
            ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0, "list_max(list_transform(string_split(text, '.'), lambda x: try_cast(x AS DOUBLE))) <= 255"),
            ("card", r"[0-9](?:[\x20-]?[0-9])+", 0, f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({digits}) BETWEEN 10 AND 15"),
            ("token", r"[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*", 0, f"length(text) >= {least}"),
        ],
        "d",
        "doc_id",
    )
    n = len(BASE)
    steps = ""
    for k in range(rounds):
        known = " UNION ".join(["SELECT inst FROM edges WHERE seed", *(f"SELECT inst FROM new{j}" for j in range(k))])
        steps += f"""known{k} AS ({known}),
marked{k} AS (SELECT p, inst, inst IN (SELECT inst FROM known{k}) AS known FROM edges),
scored{k} AS (SELECT p, count(*) FILTER (WHERE known) AS pos, count(*) AS n FROM marked{k} GROUP BY p HAVING count(*) FILTER (WHERE known) >= {support} AND count(*) FILTER (WHERE known) >= {precision} * count(*)),
new{k} AS (SELECT inst FROM marked{k} JOIN scored{k} USING (p) WHERE NOT known GROUP BY inst HAVING round(1 - exp(sum(ln(1 - least(pos::DOUBLE / n, 0.999)))), 9) >= {accept}),
"""
    extra = " UNION ".join(f"SELECT inst FROM new{j}" for j in range(rounds))
    count = lambda kind: f"(SELECT count(*) FROM kept k WHERE k.doc_id = d.doc_id AND kind = '{kind}')::BIGINT AS n_{kind}"
    listed = lambda table: f"(SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM {table} GROUP BY doc_id)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
c AS (SELECT *, rank < {n} AS seed, regexp_replace(lower(text), '[^a-z0-9@]', '', 'g') AS inst FROM m WHERE rank < {n} OR NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = m.doc_id AND b.rank < {n} AND b.start < m.stop AND m.start < b.stop)),
edges AS (SELECT p, inst, bool_or(seed) AS seed FROM (SELECT inst, seed, unnest(CASE WHEN len(lead) > 1 THEN [lead[-2] || ' ' || lead[-1], '* ' || lead[-1]] WHEN len(lead) = 1 THEN ['* ' || lead[-1]] ELSE [] END) AS p FROM c) WHERE NOT regexp_matches(p, '[0-9@]') GROUP BY p, inst),
{steps}extra AS (SELECT inst FROM ({extra}) WHERE inst NOT IN (SELECT inst FROM edges WHERE seed)),
kept AS (SELECT doc_id, rank, start, stop, kind FROM c WHERE seed UNION ALL SELECT doc_id, {n}, start, stop, 'found' FROM c WHERE NOT seed AND inst IN (SELECT inst FROM extra))
SELECT d.doc_id, {", ".join(count(k.name) for k in BASE)}, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans, {count("found")}
FROM d LEFT JOIN {listed("kept")} a ON a.doc_id = d.doc_id LEFT JOIN {listed(f"(SELECT * FROM kept WHERE rank < {n})")} b ON b.doc_id = d.doc_id
"""


#: DuckDB SQL for the same rows, the rounds written out.
ORACLE_SQL = _oracle()
