"""Substring dedup: suffixes of all texts, partitioned by their prefixes, and the deep internal nodes of each part's tree.

A suffix matters to the depth of `window` words, and it is those words that travel: a group gets the text of its suffixes,
and two suffixes are only ever taken as equal after their bytes were compared. To send every suffix with its own words
would cost over nine times the input, so a group is named not by the first words of the prefix but by the least hashed
piece of four words within it. Equal prefixes still always meet, and neighbouring suffixes mostly share that piece, so a run
of them travels as one stretch of text, at about three words a suffix.

Groups are memory-sized: pieces are of variable length. Those that would name more suffixes than a quarter of a group
(counted over all documents, one in so many suffixes by a hash of its place) are not used as names; a suffix whose
four-word pieces are all such ones is named by a piece of eight words, and then by all its words. At most a million such
pieces are sent to the tasks, the largest; they set the size of groups, never what is found.

In a group, suffixes are sorted by the hash of their depth-`window` node and confirmed on their words, those that differ
being set apart and sorted again. A node with suffixes of two documents or more is a deep internal node: its words repeat,
and every occurrence outside the least doc_id is removed. Adjacent removed windows of a document join into one maximal
repeat. Before anything is shuffled, each batch of documents folds its own suffixes by the same comparison: only those of
the least doc_id of a node claim it, the others are known to be repeats already. A passage that a third of all documents
hold so reaches its group once a batch, not once a document. Long texts are read in overlapping stretches. Nothing is
capped: all windows of whole texts take part.

Words are split at ASCII white space, unchanged. Null or blank texts: no words, nothing removed. Null doc_ids: neither
smaller nor larger than others, kept as they are. Rows sharing one doc_id don't remove each other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm._text import U, Words, equal_runs, mix, slices

_PIECES = (4, 8)
_MOST = U(2**64 - 1)
_STRETCH = 1 << 20  # bytes of one text that are read at once
_CLAIM = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("text", pa.binary())])
_REPEAT = pa.schema([("home", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])


def _squeezed(raw: bytes, level: int = 1) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _full(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return pa.decompress(b[8:], n, codec="zstd", asbytes=True) if n else b""


def _packed(a: np.ndarray) -> bytes:
    return _squeezed(np.ascontiguousarray(a).tobytes())


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_full(b), kind)


def _steps(place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places as differences within a document (the first as it is)."""
    d = np.diff(place, prepend=0)
    d[starts] = place[starts]
    return d.astype(np.uint32)


def _places(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    run = np.cumsum(steps, dtype=np.int64)
    starts = np.cumsum(counts) - counts
    base = np.where(starts > 0, run[np.maximum(starts, 1) - 1], 0) if len(run) else np.zeros(len(counts), np.int64)
    return run - np.repeat(base, counts)


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


class Stretches:
    """Texts of a batch with single spaces between words: ids and keys of their documents, and the place of each one's first word."""

    def __init__(self):
        self.texts, self.ids, self.keys, self.places, self.bytes = [], [], [], [], 0

    def add(self, doc_id: int, key: int, text: bytes, window: int) -> None:
        words = b" ".join(text.split())
        at, place = 0, 0
        while at < len(words):
            end = len(words)
            if end - at > 2 * _STRETCH and (cut := words.find(b" ", at + _STRETCH)) >= 0:
                end = cut
                for _ in range(window - 1):  # the windows that begin before the cut are whole
                    end = words.find(b" ", end + 1) if end < len(words) else end
                    end = len(words) if end < 0 else end
                own = words[at:cut].count(b" ") + 1
            else:
                cut, own = end, 0
            self.texts.append(words[at:end])
            self.ids.append(doc_id), self.keys.append(key), self.places.append(place)
            self.bytes += end - at
            at, place = cut + 1, place + own

    def words(self) -> tuple[Words, bytes]:
        raw = b"\n".join(self.texts)
        return Words(raw=(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t) + 1 for t in self.texts[:-1]), len(self.texts[-1])]))), raw


def _batches(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[Stretches]:
    """Texts of about `most` words, one stretch at least."""
    held = Stretches()
    for batch in batches:
        ids, keys = (batch.column(k).to_pylist() for k in (0, 1))
        for k, text in enumerate(batch.column(2)):
            if text.is_valid:
                held.add(ids[k], keys[k], text.as_py().encode("utf-8", "surrogatepass"), window)
            if held.bytes >= 6 * most:
                yield held
                held = Stretches()
    if held.texts:
        yield held


def _inside(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def _names(words: Words, window: int, at: np.ndarray, large: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at the words `at`: the piece that names each, and its length (0: all its words)."""
    name, length = np.full(len(at), _MOST), np.zeros(len(at), np.int32)
    todo = np.arange(len(at))
    for size in _PIECES:
        if size >= window or not len(todo):
            continue
        pieces, _ = words.windows(size)
        pieces = np.where(_inside(large[size], pieces), _MOST, pieces) if size in large else pieces
        least = np.full(len(todo), _MOST)
        for k in range(window - size + 1):
            np.minimum(least, pieces[at[todo] + k], out=least)
        name[todo], length[todo] = least, size
        todo = todo[least == _MOST]
    if len(todo):
        labels, _ = words.windows(window)
        name[todo], length[todo] = labels[at[todo]], 0
    return name, length


def _sampled(batches: Iterator[pa.RecordBatch], window: int, most: int, rate: int, large: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(piece, length, n): what one in `rate` suffixes is named by."""
    for held in _batches(batches, window, most):
        words, _ = held.words()
        n = len(words.hash) - window + 1
        if n <= 0:
            continue
        inside = words.row[:n] == words.row[window - 1 :]
        place = np.array(held.places)[words.row[:n]] + np.arange(n) - words.first[words.row[:n]]
        at = np.flatnonzero(inside & (mix(np.array(held.ids, np.int64).view(U)[words.row[:n]] ^ mix(place.view(U))) % U(rate) == 0))
        if not len(at):
            continue
        name, length = _names(words, window, at, large)
        name, where, count = np.unique(name, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(length[where]), pa.array(count.astype(np.int64))], names=["piece", "length", "n"])


def _again(raw: np.ndarray, label: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which suffixes have the words of a suffix with a smaller id. Nodes are runs of one label, split where words differ."""
    out = np.zeros(len(label), bool)
    order = np.lexsort((ids, label))
    while len(order):
        s, i = label[order], ids[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        same = np.ones(len(order), bool)
        at = np.flatnonzero(i > i[head])
        for k in range(0, len(at), 50_000):
            a, b = order[at[k : k + 50_000]], order[head[at[k : k + 50_000]]]
            same[at[k : k + 50_000]] = equal_runs(raw, start[a], end[a], start[b], end[b])
        out[order[at[same[at]]]] = True
        if same.all():
            break
        # words that differ under one label: what isn't the head's goes round again, with those of the head's own id
        mixed = np.unique(s[~same])
        rest = _inside(mixed, s) & ~first & ~out[order]
        order = order[rest]
    return out


def _claims(batches: Iterator[pa.RecordBatch], window: int, parts: int, most: int, large: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for held in _batches(batches, window, most):
        words, raw = held.words()
        labels, inside = words.windows(window)
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        ids, keys = np.array(held.ids, np.int64), np.array(held.keys, np.int64)
        row = words.row[at]
        place = at - words.first[row] + np.array(held.places, np.int64)[row]
        part = (mix(_names(words, window, at, large)[0]) % U(parts)).astype(np.int32)
        start, end = words.start[at], words.end[at + window - 1]
        again = _again(words.data, labels[at], ids[row], start, end)
        # runs of neighbours that go to one group are one stretch of text
        cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1]) | (again[1:] != again[:-1])])
        head = np.flatnonzero(cut & ~again)
        tail = np.append(np.flatnonzero(cut)[1:], len(at))[np.searchsorted(np.flatnonzero(cut), head)] - 1
        by = head[np.argsort(part[head], kind="stable")]
        tail = tail[np.argsort(part[head], kind="stable")]
        known = np.flatnonzero(again)
        known = known[np.argsort(part[known], kind="stable")]
        rows = {f.name: [] for f in _CLAIM}
        p_by, p_known = part[by], part[known]
        for p in np.union1d(p_by, p_known).tolist():
            tables, text = [], b""
            for x, column in ((by, p_by), (known, p_known)):
                a, b = np.searchsorted(column, p), np.searchsorted(column, p, side="right")
                mine = x[a:b]
                starts = np.flatnonzero(np.concatenate([[True], row[mine][1:] != row[mine][:-1]])) if len(mine) else np.zeros(0, np.int64)
                tables.append((row[mine][starts], np.diff(np.append(starts, len(mine))), _steps(place[mine], starts)))
                if x is by:
                    text = b"\n".join([raw[s:e] for s, e in zip(start[mine].tolist(), end[tail[a:b]].tolist(), strict=True)])
            who = np.concatenate([t[0] for t in tables])
            rows["part"].append(p)
            rows["docs"].append(_packed(np.concatenate([[len(tables[0][0])], ids[who], keys[who]]).astype(np.int64)))
            rows["counts"].append(_packed(np.concatenate([t[1] for t in tables]).astype(np.uint32)))
            rows["places"].append(_packed(np.concatenate([t[2] for t in tables])))
            rows["text"].append(_squeezed(text, 5))
        yield pa.RecordBatch.from_pydict(rows, schema=_CLAIM)


def _repeats(claims: pa.Table, window: int, homes: int) -> pa.Table:
    """One group: which suffixes repeat, by the home of their document."""
    ids, keys, places, labels, starts, ends, texts, base = [], [], [], [], [], [], [], 0
    known: list[list[np.ndarray]] = [[], [], []]
    for _, docs, counts, steps, text in zip(*(c.to_pylist() for c in claims.columns), strict=True):
        table, count = _unpacked(docs, np.int64), _unpacked(counts, np.uint32).astype(np.int64)
        claimed, who = int(table[0]), (len(table) - 1) // 2
        place = _places(_unpacked(steps, np.uint32), count)
        doc, key = np.repeat(table[1 : 1 + who], count), np.repeat(table[1 + who :], count)
        n = int(count[:claimed].sum())
        for x, y in zip(known, (doc, key, place), strict=True):
            x.append(y[n:])
        if n:
            raw = _full(text)
            data = np.frombuffer(raw, np.uint8)
            words = Words(raw=(data, np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])))
            label, inside = words.windows(window)
            at = np.flatnonzero(inside)
            run = words.row[at]
            ids.append(doc[run]), keys.append(key[run]), places.append(place[run] + at - words.first[run])
            labels.append(label[at]), starts.append(words.start[at] + base), ends.append(words.end[at + window - 1] + base)
            texts.append(raw)
            base += len(raw)
    if texts:
        ids, keys, places, labels, starts, ends = (np.concatenate(x) for x in (ids, keys, places, labels, starts, ends))
        done = _again(np.frombuffer(b"".join(texts), np.uint8), labels, ids, starts, ends)
        for x, y in zip(known, (ids, keys, places), strict=True):
            x.append(y[done])
    ids, keys, places = (np.concatenate(x) for x in known)
    home = (mix(ids.view(U)) % U(homes)).astype(np.int32)
    by = np.lexsort((places, keys, ids, home))
    ids, keys, places, home = (x[by] for x in (ids, keys, places, home))
    rows = {f.name: [] for f in _REPEAT}
    for a, b in _runs(home):
        i, k = ids[a:b], keys[a:b]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])]))
        rows["home"].append(int(home[a]))
        rows["docs"].append(_packed(np.concatenate([i[first], k[first]])))
        rows["counts"].append(_packed(np.diff(np.append(first, b - a)).astype(np.uint32)))
        rows["places"].append(_packed(_steps(places[a:b], first)))
    return pa.Table.from_pydict(rows, schema=_REPEAT)


def _by_document(found: pa.Table, window: int) -> pa.Table:
    """Maximal repeats per document: arrays of first words and of ends."""
    ids, keys, places = [], [], []
    for _, docs, counts, steps in zip(*(c.to_pylist() for c in found.columns), strict=True):
        table, count = _unpacked(docs, np.int64), _unpacked(counts, np.uint32).astype(np.int64)
        ids.append(np.repeat(table[: len(count)], count))
        keys.append(np.repeat(table[len(count) :], count))
        places.append(_places(_unpacked(steps, np.uint32), count))
    ids, keys, places = (np.concatenate(x) for x in (ids, keys, places))
    by = np.lexsort((places, keys, ids))
    ids, keys, places = ids[by], keys[by], places[by]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
    gap = new | np.concatenate([[True], places[1:] > places[:-1] + window])
    start = np.flatnonzero(gap)
    end = np.append(start[1:], len(ids)) - 1
    doc = np.flatnonzero(new)
    offsets = np.append(np.searchsorted(start, doc), len(start)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (places[start], places[end] + window)]
    return pa.table({"doc_id": ids[doc], "tkey": keys[doc], "starts": lists[0], "ends": lists[1]})


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_squeezed((x.as_py() or "").encode("utf-8", "surrogatepass"), 5) for x in part.column(2)], pa.binary())], names=["doc_id", "tkey", "z"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        n, spans, texts = [], [], []
        for z, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            words = _full(z).split()
            n.append(len(words))
            out, at = [], 0
            for a, b in zip(starts or (), ends or (), strict=True):
                out += words[at:a]
                at = b
            texts.append(b" ".join(out + words[at:]).decode("utf-8", "surrogatepass"))
            spans.append([{"start": a, "end": b} for a, b in zip(starts or (), ends or (), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "repeats", "kept"])


def large_pieces(own: DataFrame, window: int, part_windows: int, most: int = 1_000_000) -> dict[int, np.ndarray]:
    """Pieces that would name over a quarter of a group's suffixes, by length, sorted: found until no further one turns up."""
    large: dict[int, np.ndarray] = {}
    rate = max(1, part_windows // 1024)
    for _ in range(8):  # what is left after that makes a group larger, and nothing else
        now = dict(large)
        named = own.mapInArrow(lambda it: _sampled(it, window, part_windows, rate, now), "piece bigint, length int, n bigint")  # noqa: B023
        found = named.groupBy("length", "piece").agg(F.sum("n").alias("n")).where((F.col("n") * rate > part_windows // 4) & (F.col("length") > 0))
        new = found.orderBy(F.desc("n"), "piece").limit(most - sum(map(len, large.values()))).collect()
        if not new:
            break
        for size in {r.length for r in new}:
            large[size] = np.unique(np.concatenate([large.get(size, np.zeros(0, U)), np.array([r.piece for r in new if r.length == size], np.int64).view(U)]))
    return large


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 13, part_windows: int = 1_000_000) -> DataFrame:
    """Per document row: doc_id, n_words, repeats (maximal removed runs of words, ends exclusive), kept (the other words joined by one space).

    part_windows: about how many suffixes a group and a batch hold; it sets memory, not results.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(16, int(size / 6 / part_windows) + 1)
    known = own.where("doc_id IS NOT NULL")
    large = large_pieces(known, window, part_windows)
    claims = known.mapInArrow(lambda it: _claims(it, window, parts, part_windows, large), "part int, docs binary, counts binary, places binary, text binary")
    found = claims.groupBy("part").applyInArrow(lambda t: _repeats(t, window, parts), "home int, docs binary, counts binary, places binary")
    removed = found.groupBy("home").applyInArrow(lambda t: _by_document(t, window), "doc_id bigint, tkey bigint, starts array<int>, ends array<int>")
    texts = own.mapInArrow(_zipped, "doc_id bigint, tkey bigint, z binary")
    both = texts.join(removed, ["doc_id", "tkey"], "left").select("doc_id", "z", "starts", "ends")
    return both.mapInArrow(_kept, "doc_id bigint, n_words bigint, repeats array<struct<start:int,end:int>>, kept string")


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, windows of 13 words."""
    out = without_repeats(_base.table(spark, sf_dir, "documents"))
    removed = F.expr("CAST(aggregate(repeats, 0, (a, x) -> a + x.end - x.start) AS BIGINT)")
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for the same rows.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > first),
k AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM x GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
