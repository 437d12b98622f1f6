"""Where a pattern matches, in code points, by DataFrame functions only: what a pattern splits off and what it extracts alternate.

Running sums and maxima over an array take log n rounds of one pass each (`scan`), so a text with n matches costs n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string,text:string,left:string>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its Java pattern, the group that holds the value, a cheap test that must hold first, and a test of the match."""

    name: str
    pattern: str
    guard: str  #: SQL over __t (the text) and __low (its lower case)
    group: int = 0
    check: str = "true"  #: SQL over x.value and x.text


def located(docs: DataFrame, kinds: list[Kind], *, text: str, keep: list[str], left_words: int = 0) -> DataFrame:
    """keep and, per kind, an array column named by it of SPAN (leftmost non-overlapping matches that pass the check).

    rank is the kind's place in `kinds`; left holds up to left_words words before the match, lower-cased.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(*keep, t.alias("__t"), F.lower(t).alias("__low"))
    parts: list[Column] = []
    for k, kind in enumerate(kinds):
        p = F.lit(kind.pattern)
        none = F.array().cast("array<string>")
        use = F.expr(kind.guard)
        parts += [
            F.when(use, F.regexp_extract_all("__t", p, F.lit(0))).otherwise(none).alias(f"__m{k}"),
            (F.when(use, F.regexp_extract_all("__t", p, F.lit(kind.group))).otherwise(none) if kind.group else F.lit(None)).alias(f"__v{k}"),
            F.when(use, F.split("__t", kind.pattern, -1)).otherwise(none).alias(f"__g{k}"),
        ]
    two = one.select(*keep, *parts)
    spans = []
    for k, kind in enumerate(kinds):
        values = f"__v{k}" if kind.group else f"__m{k}"
        gap, word = "[\\\\x20\\\\x09-\\\\x0D]", "[^\\\\x20\\\\x09-\\\\x0D]"
        # the last words of the gap are the first ones of its reverse
        near = f"regexp_replace(lower(reverse(regexp_extract(reverse(z.g[i]), '^{gap}*+({word}++(?:{gap}++{word}++){{0,{left_words - 1}}})', 1))), '{gap}+', ' ')" if left_words else "''"
        ends = scan("transform(z.m, (m, i) -> CAST(length(z.g[i]) + length(m) AS BIGINT))", "x + y")
        each = f"named_struct('start', e[i] - length(m), 'rank', {k}, 'end', e[i], 'kind', '{kind.name}', 'value', z.v[i], 'text', m, 'left', {near})"
        found = let(f"named_struct('m', __m{k}, 'v', {values}, 'g', __g{k})", "z", let(ends, "e", f"filter(transform(z.m, (m, i) -> {each}), x -> {kind.check})"))
        spans.append(F.expr(f"CASE WHEN size(__m{k}) = 0 THEN CAST(array() AS array<{SPAN}>) ELSE {found} END").alias(kind.name))
    return two.select(*keep, *spans)


def let(value: str, name: str, body: str) -> str:
    """SQL: body with value under a name, evaluated once a row wherever the planner puts it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(array: str, step: str) -> str:
    """SQL: each element folded with all before it by an associative step of x and y."""
    one = f"CASE WHEN i >= shiftleft(1, k) THEN {step.replace('x', 'a[i - shiftleft(1, k)]', 1)} ELSE y END"
    return let(array, "s", f"aggregate(sequence(0, greatest(0, CAST(ceil(log2(greatest(size(s), 1))) AS INT) - 1)), s, (a, k) -> transform(a, (y, i) -> {one}))")


def apart(more: str, base: str) -> str:
    """SQL: the spans of `more` that overlap none of `base`. At each one's end stands the largest end of all base spans that
    began before; it overlaps one if that lies beyond its start."""
    events = (
        f"sort_array(concat(transform(n.b, b -> named_struct('at', b.start, 'o', 1, 'e', b.end, 'x', CAST(NULL AS {SPAN}))), "
        f"transform(n.m, m -> named_struct('at', m.end, 'o', 0, 'e', -1L, 'x', m))))"
    )
    free = "transform(filter(transform(v, (q, i) -> named_struct('x', q.x, 'r', r[i])), q -> q.x IS NOT NULL AND q.r <= q.x.start), q -> q.x)"
    lots = let(events, "v", let(scan("transform(v, q -> q.e)", "greatest(x, y)"), "r", free))
    return let(f"named_struct('b', {base}, 'm', {more})", "n", f"CASE WHEN size(n.b) = 0 OR size(n.m) = 0 THEN n.m ELSE {lots} END")


def redacted(text: str, spans: str, block: int = 4096) -> str:
    """SQL: the text with each span's own characters replaced by [kind]; spans by start, of overlapping ones the first covers.

    The text is cut into blocks of code points first, so that each cut looks into one block and not through the whole text."""
    cut = lambda a, e: (
        f"CASE WHEN {e} <= {a} THEN '' WHEN {a} DIV {block} = ({e} - 1) DIV {block} THEN substr(n.t[CAST({a} DIV {block} AS INT)], CAST({a} % {block} + 1 AS INT), CAST({e} - {a} AS INT)) "
        f"ELSE concat(substr(n.t[CAST({a} DIV {block} AS INT)], CAST({a} % {block} + 1 AS INT)), array_join(slice(n.t, CAST({a} DIV {block} + 2 AS INT), CAST(({e} - 1) DIV {block} - {a} DIV {block} - 1 AS INT)), ''), "
        f"substr(n.t[CAST(({e} - 1) DIV {block} AS INT)], 1, CAST(({e} - 1) % {block} + 1 AS INT))) END"
    )
    before = "(CASE WHEN i = 0 THEN 0L ELSE r[i - 1] END)"
    body = f"concat(array_join(transform(n.s, (q, i) -> CASE WHEN q.start < {before} THEN '' ELSE concat({cut(before, 'q.start')}, '[', q.kind, ']') END), ''), {cut('r[size(r) - 1]', 'n.l')})"
    bound = f"named_struct('t', regexp_extract_all({text}, '(?s).{{1,{block}}}', 0), 's', {spans}, 'l', CAST(length({text}) AS BIGINT))"
    return let(bound, "n", f"CASE WHEN size(n.s) = 0 THEN {text} ELSE {let(scan('transform(n.s, q -> q.end)', 'greatest(x, y)'), 'r', body)} END")


def joined(spans: str) -> Column:
    """kind:start:end of an array of SPAN by start, then kind as listed."""
    return F.expr(f"array_join(transform(sort_array({spans}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def located_sql(kinds: list[tuple[str, str, int, str]], docs: str, key: str) -> str:
    """DuckDB SQL: rows (key, rank, kind, start, stop, text, value, lead) of all matches that pass; kinds are (name, pattern,
    group, test of m.text and m.value), lead the words since the match before."""
    each = " UNION ALL ".join(
        f"SELECT {key}, {k} AS rank, '{name}' AS kind, unnest(range(1, len(ms) + 1)) AS i, ms, vs, gs FROM (SELECT {key}, regexp_extract_all(t, '{q}') AS ms, regexp_extract_all(t, '{q}', {group}) AS vs, string_split_regex(t, '{q}') AS gs FROM {docs})"
        for k, (name, p, group, _) in enumerate(kinds)
        for q in [p.replace("'", "''")]
    )
    tests = " OR ".join(f"(kind = '{name}' AND {test})" for name, _, _, test in kinds)
    before = "(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda g: length(g))), 0))::BIGINT"
    return (
        f"SELECT * FROM (SELECT {key}, rank, kind, {before} AS start, {before} + length(ms[i]) AS stop, ms[i] AS text, vs[i] AS value, "
        f"list_filter(string_split_regex(lower(gs[i]), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS lead FROM ({each})) m WHERE {tests}"
    )
