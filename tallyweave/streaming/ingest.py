"""Streams: upserts of a change feed per micro-batch, and a watched markdown tree that syncs when files arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyweave.config import SyncOptions
from tallyweave.operators import mutate
from tallyweave.operators.sync import sync
from tallyweave.schema import NODE_KEY
from tallyweave.session import kept
from tallyweave.sources import tree
from tallyweave.sources.store import Store


def upsert_stream(feed: DataFrame, store: Store, checkpoint: str, order: str) -> StreamingQuery:
    """feed: a stream of label, name, properties and an ordering column. Each micro-batch folds to its last row per key and
    is written as one change (folded now and then); a batch that is replayed after a failure gives the same graph."""

    def apply(batch: DataFrame, _: int) -> None:
        last = mutate.latest(batch, NODE_KEY, order).select(*NODE_KEY, "properties")
        if not last.isEmpty():
            near = store.staged(mutate.near_nodes(store.nodes(), last))
            store.apply((near, mutate.upsert_nodes(near, last, F.localtimestamp())))
            store.compact()

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, *, every: str = "500 milliseconds", embed: Callable | None = None, dim: int = 512, once: bool = False) -> StreamingQuery:
    """Sync what arrives below root, and what goes. The tree is a stream of its own (sources.tree): a micro-batch names the files that came,
    changed or went since the last one, and only these are synced; all changes within `every` are one sync, and a quiet tree is none. A batch
    that is run again finds the same graph: hashes that are stored already change nothing."""
    SyncOptions(watch=True)
    tree.register(spark)
    files = spark.readStream.format("file_tree").option("path", root).option("state", f"{checkpoint}/listings").load()

    def apply(batch: DataFrame, _: int) -> None:
        moved = kept(batch.select("path", "change"), "moved")
        gone = moved.where("change = 'gone'").select("path")
        if not moved.isEmpty():
            sync(spark, store, root, embed=embed, dim=dim, only=moved.select("path"), removed=gone)
            store.compact()

    out = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


class _Bursts(StatefulProcessor):
    """Merges pieces of bursts (first, last, shard, events, paths) of one key; a burst is given once `gap` has passed after its last event.

    Pieces that lie before the watermark as they come in are dropped. Others wait in a list state. A timer at the end of the earliest open burst looks through them: what is over by the watermark is
    emitted, one row per burst and shard, and leaves the state."""

    def __init__(self, gap_us: int, window_us: int):
        self._gap, self._window = gap_us, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "first bigint, last bigint, shard int, events bigint, paths array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(r.first_us), int(r.last_us), int(r.shard), int(r.events), list(r.paths)) for r in rows if (r.first_us // self._window + 1) * self._window > now]
        if not new:
            return iter(())
        self._open.appendList(new)
        self._handle.registerTimer(self._when(min(last for _, last, *_ in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        bursts: list[list[tuple]] = []
        end = None
        for piece in sorted(tuple(x) for x in self._open.get()):
            if end is None or piece[0] >= end + self._gap:
                bursts.append([])
                end = piece[1]
            end = max(end, piece[1])
            bursts[-1].append(piece)
        left: list[tuple] = []
        for burst in bursts:
            first, last = burst[0][0], max(p[1] for p in burst)
            if last + self._gap > now:
                left += burst
                continue
            by: dict[int, list[tuple]] = {}
            for p in burst:
                by.setdefault(p[2], []).append(p)
            for shard, own in sorted(by.items()):
                yield Row(key=key[0], first_us=first, last_us=last, shard=shard, events=sum(p[3] for p in own), paths=sorted({x for p in own for x in p[4]}))
        if left:
            self._open.put(left)
            self._handle.registerTimer(max(now // 1000 + 1, self._when(min(p[1] for p in left))))
        else:
            self._open.clear()

    def _when(self, last_us: int) -> int:
        """The first millisecond at which a burst that ends there is over."""
        return -(-(last_us + self._gap) // 1000)

    def close(self) -> None:
        pass


_PIECE = "key string, first_us bigint, last_us bigint, shard int, events bigint, paths array<string>"


def _pieces(batches: Iterator[pa.RecordBatch], window_us: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, at in microseconds, shard, path) of one key, shard and window as one piece, within what a task is sent at once."""
    for batch in batches:
        at = batch.column(1).to_numpy()
        rows = pa.table({"key": batch.column(0), "w": at // window_us, "us": at, "shard": batch.column(2), "path": batch.column(3)})
        one = rows.group_by(["key", "shard", "w"]).aggregate([("us", "min"), ("us", "max"), ("us", "count"), ("path", "distinct")])
        paths = one.column("path_distinct").combine_chunks()
        if paths.null_count or paths.flatten().null_count:  # events without a path count, and name none
            paths = pa.array([[p for p in x if p is not None] for x in paths.to_pylist()], pa.list_(pa.string()))
        own = [one.column("key"), one.column("us_min"), one.column("us_max"), one.column("shard"), one.column("us_count"), pc.cast(paths, pa.list_(pa.string()))]
        yield from pa.table(own, names=["key", "first_us", "last_us", "shard", "events", "paths"]).to_batches()


def settled(changes: DataFrame, at: str, gap: str, late: str | None = "0 seconds", *, key: str | None = None, shards: int = 1) -> DataFrame:
    """A trailing debounce of a stream of changed paths (column path, a time `at`): bursts of changes (of each key; of all paths, if there is
    none), given once `gap` has passed without another change (and `late` for what comes out of order; None:
    the stream has a watermark already).

    Rows are start, end (last change plus gap), shard, events and paths (distinct, sorted), with the key if there is one: one row per burst and
    shard of paths; with many paths, several shards keep a row from holding all. Two levels: what a task reads is combined per shard and window of
    an eighth of the gap; only these summaries meet in the state that joins them, in the batch they came with. (A windowed aggregation would hold
    them back until its window closes, and a burst that goes on in an open window would look as if it were over.) The state stores need RocksDB.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    gap_us = int(spark.range(1).select((F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {gap}")) - F.unix_micros(F.timestamp_micros(F.lit(0)))).alias("us")).first().us)
    window_us = max(1, gap_us // 8)
    part = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")
    own = (changes if late is None else changes.withWatermark(at, late)).where(F.col(at).isNotNull())
    own = own.select((F.col(key).cast("string") if key else F.lit("")).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), part.alias("shard"), "path")
    piece = own.mapInArrow(lambda it: _pieces(it, window_us), _PIECE)
    found = piece.groupBy("key").transformWithState(_Bursts(gap_us, window_us), _PIECE, "Append", "EventTime")
    out = found.select(*([F.col("key").alias(key)] if key else []), F.timestamp_micros("first_us").alias("start"), F.timestamp_micros(F.col("last_us") + gap_us).alias("end"), "shard", "events", "paths")
    return out


def followed_by(left: DataFrame, right: DataFrame, key: str, at: tuple[str, str], within: str, late: str = "0 seconds", *, how: str = "inner") -> DataFrame:
    """Stream-stream join: rows of left with the rows of right of the same key that come after them, by `within` at most. Both sides have a
    watermark, so state is kept for `within` plus `late` only; how="leftOuter": left rows that nothing follows come too, once that is certain.
    Columns of the two must have different names but for the key. Works on tables as well."""
    a, b = left.withWatermark(at[0], late), right.withWatermark(at[1], late).withColumnRenamed(key, "__key")
    close = (F.col(key) == F.col("__key")) & (F.col(at[1]) > F.col(at[0])) & (F.col(at[1]) <= F.col(at[0]) + F.expr(f"INTERVAL {within}"))
    return a.join(b, close, how).drop("__key")


def once(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """A stream without repeats: of the events of one key within the watermark the first stays, so an input that is replayed changes nothing."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def in_time(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream whose windows may forget: events more than `late` behind the latest seen are dropped by sessions and windows."""
    return events.withWatermark(at, late)


def latest_by_key(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Running state of a stream: the value of each key's latest event and how many there were, emitted as it changes. Late
    events count but never replace a later value. Works on a stream in update mode, and on a table (one row a key)."""
    return events.groupBy(key).agg(F.max(F.struct(at, value)).alias("m"), F.count(F.lit(1)).alias("events")).select(key, F.col(f"m.{at}").alias(at), F.col(f"m.{value}").alias(value), "events")


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Bursts of events of one key with no pause of `gap` or more: key, start, end (last event plus gap), events. Streams
    need a watermark on `at` first."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windows(events: DataFrame, at: str, size: str, slide: str | None = None) -> DataFrame:
    """Events per tumbling (or sliding) window: start, end, events."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")
