"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are found in every whole text. Further candidates (other key words, bearer and signed tokens, key blocks) are
only kept if they look live. A candidate's value is hashed; the distinct repositories and owners holding each hash are
counted over the whole corpus, first per (hash, owner, repository), then per owner, then per hash, so a value that a third
of the rows holds is folded before it is shuffled, and its verdict is sent to its rows. A value of at most `live_owners` owners is live, one of `copied_owners`
or more is a widely copied example, the rest is shared.

Nulls, empty texts: no spans. Null owners or repositories count as one owner or repository of their own. Repeated rows
are scanned row by row. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm._spans import Kind, apart, joined, located, located_sql, redacted  # noqa: F401

_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base kinds, in the order in which equal starts are listed.
BASE = [
    Kind("assign", r"(?i:(password|passwd|secret|token|api_?key))" + _VALUE, "contains(__low, 'passw') OR contains(__low, 'secret') OR contains(__low, 'token') OR contains(__low, 'api')", 2, "length(x.value) >= 8"),
    Kind("access", r"AKIA[A-Z0-9]+", "contains(__t, 'AKIA')", 0, "length(x.text) >= 16"),
    Kind("hex", r"[0-9a-f]{32,}", "__t RLIKE '[0-9a-f]{32}'"),
]
#: Candidates that the frequency must bear out.
MORE = [
    Kind("credential", r"(?i:(pwd|passphrase|credentials?|private_?key|access_?key|auth_?key|client_?id))" + _VALUE, "__low RLIKE '(pwd|passphrase|credentials?|_?key|client_?id)[\"'']? *[:=]'", 2, "length(x.value) >= 8 AND x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Za-z]'"),
    Kind("bearer", r"(?i:(bearer))\x20+([A-Za-z0-9._~+/=-]+)", "contains(__low, 'bearer ')", 2, "length(x.value) >= 20 AND x.value RLIKE '[0-9]'"),
    Kind("signed", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "contains(__t, 'eyJ')", 0, "length(x.text) >= 40"),
    Kind("block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*", "contains(__t, 'PRIVATE KEY-----')"),
]


def secret_spans(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), owner: str | None = "source", repository: str | None = "doc_id", live_owners: int = 1, copied_owners: int = 3) -> DataFrame:
    """Per document row: keep, base (array of SPAN), spans (array of start, rank, end, kind, value, text, verdict, owners, repositories: base ones and live further ones)."""
    own = docs.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), (_base.group_key(owner) if owner else F.lit("")).alias("__o"), (_base.group_key(repository) if repository else F.lit("")).alias("__p"), F.col(text).alias("__x"))
    names = [f"__k{i}" for i in range(len(keep))]
    raw = located(own, BASE + MORE, text="__x", keep=[*names, "__o", "__p"])
    base = F.concat(*(F.col(k.name) for k in BASE))
    free = F.expr(apart(f"concat({', '.join(k.name for k in MORE)})", f"concat({', '.join(k.name for k in BASE)})"))
    scanned = _base.staged(raw.select(*names, "__o", "__p", base.alias("base"), free.alias("more")).withColumn("__id", F.monotonically_increasing_id()), "secrets")
    found = scanned.where((F.size("base") > 0) | (F.size("more") > 0)).select("__id", "__o", "__p", F.explode(F.concat("base", "more")).alias("s")).withColumn("h", F.sha2(F.col("s.value"), 256))
    per_owner = found.select("h", "__o", "__p").distinct().groupBy("h", "__o").agg(F.count(F.lit(1)).alias("n"))
    freq = _base.staged(per_owner.groupBy("h").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners")), "owners")
    verdict = F.when(F.col("owners") <= live_owners, "live").when(F.col("owners") >= copied_owners, "example").otherwise("shared")
    judged = _base.looked_up(found, freq, "h").select("__id", "s", verdict.alias("verdict"), "owners", "repositories").where((F.col("s.rank") < len(BASE)) | (F.col("verdict") == "live"))
    kept = judged.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.rank", "s.end", "s.kind", "s.value", "s.text", "verdict", "owners", "repositories"))).alias("spans"))
    kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,text:string,verdict:string,owners:bigint,repositories:bigint>>"
    empty = F.array().cast(kind)
    any_span = (F.size("base") > 0) | (F.size("more") > 0)
    # only rows with a candidate are joined; the others keep their place
    some = scanned.where(any_span).join(kept, "__id", "left").select(*names, "base", F.coalesce("spans", empty).cast(kind).alias("spans"))
    out = scanned.where(~any_span).select(*names, "base", empty.alias("spans")).unionByName(some)
    return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), "base", "spans")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; owner: source, repository: the document."""
    out = secret_spans(_base.table(spark, sf_dir, "documents"))
    count = lambda kind: F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    verdicts = [F.expr(f"CAST(size(filter(spans, x -> x.verdict = '{v}')) AS BIGINT)").alias(f"n_{v}") for v in ("live", "shared", "example")]
    return out.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *verdicts)


def _oracle() -> str:
    length = {"assign": "length(value) >= 8", "access": "length(text) >= 16", "hex": "true", "signed": "length(text) >= 40", "block": "true"}
    length |= {"credential": "length(value) >= 8 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')", "bearer": "length(value) >= 20 AND regexp_matches(value, '[0-9]')"}
    found = located_sql([(k.name, k.pattern, k.group, length[k.name]) for k in BASE + MORE], "d", "doc_id, source")
    listed = lambda table: f"(SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM {table} GROUP BY doc_id)"
    count = lambda test: f"coalesce((SELECT count(*) FROM kept k WHERE k.doc_id = d.doc_id AND {test}), 0)::BIGINT"
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({found}),
c AS (SELECT * FROM m WHERE rank < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = m.doc_id AND b.rank < {len(BASE)} AND b.start < m.stop AND m.start < b.stop)),
v AS (SELECT value, count(DISTINCT coalesce('=' || source, '-')) AS owners FROM c GROUP BY value),
kept AS (SELECT c.*, CASE WHEN owners <= 1 THEN 'live' WHEN owners >= 3 THEN 'example' ELSE 'shared' END AS verdict FROM c JOIN v USING (value) WHERE rank < {len(BASE)} OR owners <= 1)
SELECT d.doc_id, {count("kind = 'assign'")} AS n_assign, {count("kind = 'access'")} AS n_access, {count("kind = 'hex'")} AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans,
  {count("verdict = 'live'")} AS n_live, {count("verdict = 'shared'")} AS n_shared, {count("verdict = 'example'")} AS n_example
FROM d LEFT JOIN {listed("kept")} a ON a.doc_id = d.doc_id LEFT JOIN {listed(f"(SELECT * FROM kept WHERE rank < {len(BASE)})")} b ON b.doc_id = d.doc_id
"""


#: DuckDB SQL for the same rows.
ORACLE_SQL = _oracle()
