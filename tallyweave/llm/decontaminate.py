"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, each text scanned once.

Normalising lower-cases A-Z and turns every run of other ASCII signs into one space; characters from U+0080 on belong to
words. A window is `size` consecutive words of an item (a shorter item is one window). Every word of a document inside an
occurrence of a window is hit. The automaton only ever holds a block of items of at most `block_bytes` of text, so what
each worker keeps is bounded however many items there are; blocks are scanned one after the other and united per document row.

Nulls, empty texts: no words, no hits. Null item ids count as the id 'null'. Repeated items with one id count once.
Repeated documents are scored row by row. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base

_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_BUILT: dict = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FLAT).split()


def item_windows(items: list[tuple[str, str | None]], size: int) -> dict[str, tuple[int, list[int]]]:
    """Window text (between spaces, one character a byte) -> its number of words and the indices of its items."""
    out: dict[str, tuple[int, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        words = normal_words(text)
        n = min(size, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            owners = out.setdefault((b" " + b" ".join(words[at : at + n]) + b" ").decode("latin-1"), (n, []))[1]
            if not owners or owners[-1] != k:
                owners.append(k)
    return out


def _automaton(items: list[tuple[str, str | None]], size: int, key: str):
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()  # one block at a time
        a = ahocorasick.Automaton()
        for pattern, value in item_windows(items, size).items():
            a.add_word(pattern, value)
        if len(a):
            a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def _spans(text: str, hit: np.ndarray, each: bool = False) -> list[dict]:
    """Hit words as maximal runs of code points of the text as it came, or each hit word by itself."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FLAT))]
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    if each:
        return [{"start": int(lead[at[k][0]]), "end": int(lead[at[k][1]])} for k in np.flatnonzero(hit)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(lead[at[a][0]]), "end": int(lead[at[b - 1][1]])} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_RESULT = [("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
_RESULT_SQL = "n_words bigint, hit_words array<int>, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def _scan(docs: DataFrame, text: str, items: list[tuple[str, str | None]], size: int, each: bool = False) -> DataFrame:
    key = hashlib.sha256(repr((items, size)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, size, key)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            cols: list[list] = [[], [], [], []]
            for value in batch.column(at):
                value = value.as_py() or ""
                words = normal_words(value)
                hit, found = None, set()
                if words and len(automaton):
                    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
                    for end, (n, owners) in automaton.iter(flat):
                        if hit is None:
                            hit, gaps = np.zeros(len(words), bool), np.cumsum(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
                        last = int(gaps[end]) - 1
                        hit[last - n : last] = True
                        found.update(owners)
                cols[0].append(len(words))
                cols[1].append([] if hit is None else np.flatnonzero(hit).astype(np.int32))
                cols[2].append(sorted({items[k][0] for k in found}))
                cols[3].append([] if hit is None else _spans(value, hit, each))
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, (_, t) in zip(cols, _RESULT, strict=True))], names=[*names, *(n for n, _ in _RESULT)])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, (rest + ", " if rest else "") + _RESULT_SQL)


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most block_bytes of text (or one item): all at once if they are one block, else read one
    partition at a time."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).distinct()
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text) + F.lit(16)), F.lit(0)).alias("n")).first().n
    for r in rows.collect() if size <= block_bytes else rows.toLocalIterator():
        n = len((r.t or "").encode())
        if block and held + n > block_bytes:
            yield sorted(block, key=lambda x: (x[0], x[1] or ""))
            block, held = [], 0
        block.append((r.i, r.t))
        held += n
    yield sorted(block, key=lambda x: (x[0], x[1] or ""))


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document row: doc_id, n_words, hit_words (indices of hit words), items (ids with an occurrence), spans (of code points in the text)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocks = blocks_of(benchmark, item_id, item_text, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _scan(docs, "text", first, size)
    # rows keep an id of their own, so that equal ones stay apart; hit words are united first, then joined to runs
    docs = _base.staged(docs.withColumn("rid", F.monotonically_increasing_id()), "rows")
    out = _scan(docs, "text", first, size, each=True)
    for block in [second, *blocks]:
        out = out.unionByName(_scan(docs, "text", block, size, each=True))
    words = F.expr("transform(hit_words, (w, i) -> named_struct('w', w, 'start', spans[i].start, 'end', spans[i].end))")
    united = out.withColumn("words", words).groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    heads = united.withColumn("heads", F.expr("filter(words, (x, i) -> i = 0 OR words[greatest(i - 1, 0)].w != x.w - 1)"))
    both = heads.withColumn("tails", F.expr("filter(words, (x, i) -> i = size(words) - 1 OR words[least(i + 1, size(words) - 1)].w != x.w + 1)"))
    return both.select("doc_id", "n_words", F.expr("words.w").alias("hit_words"), "items", F.expr("transform(heads, (x, i) -> named_struct('start', x.start, 'end', tails[i].end))").alias("spans"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, as they are, without an occurrence of any window; blocks of items filter one after the other."""
    for items in blocks_of(benchmark, item_id, item_text, block_bytes):
        docs = _clean(docs, text, items, size)
    return docs


def _clean(docs: DataFrame, text: str, items: list[tuple[str, str | None]], size: int) -> DataFrame:
    key = hashlib.sha256(repr((items, size)).encode()).hexdigest()

    def free(value: str | None, automaton) -> bool:
        words = normal_words(value)
        return not words or not len(automaton) or next(automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")), None) is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, size, key)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array([free(v.as_py(), automaton) for v in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of contamination() over whole documents and benchmark."""
    found = contamination(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


#: DuckDB SQL for the same rows (window join on word positions).
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)) d JOIN win ON d.n = win.n AND d.w = win.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""
