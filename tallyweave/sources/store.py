"""Versioned graphs: a base of whole snapshots, change files that overlay it by key, and a pointer to the current version.

A version is one folder with a manifest: which base it stands on and which change folders overlay that base, in order. `commit`
writes a new base. `apply` writes only the rows that differ and the keys that are gone, so its cost follows the change.
Readers drop the base's rows whose keys changed (an anti join; only keys of changed rows travel) and add the last change of each
key. `compact` folds changes: many into one, or all into a new base. The pointer is replaced last, the only step that readers
notice; a failed job leaves the old version in force. One writer at a time: a writer that finds another version than it started
from gives up before the pointer moves.

Bases of an older schema are read through the steps that were added since (`schema.STEPS`); the next base has the new one.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave import schema as S
from tallyweave.schema import EDGE_KEY, NODE_KEY, NODES, RELATIONSHIPS

_PARTS = {"nodes": (NODES, NODE_KEY), "relationships": (RELATIONSHIPS, EDGE_KEY)}


class Store:
    """A graph below `root`, on any file system that Spark reaches. at: a version to read instead of the current one."""

    def __init__(self, spark: SparkSession, root: str, at: str | None = None):
        self.spark, self.root, self._at = spark, root.rstrip("/"), at

    def at(self, version: str) -> Store:
        """The same store as it was at a version that is still there."""
        return Store(self.spark, self.root, version)

    # -- files and manifests

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> dict | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, path: str, content: dict) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(json.dumps(content).encode())
        out.close()

    def version(self) -> str | None:
        if self._at is not None:
            return self._at
        found = self._read(f"{self.root}/CURRENT")
        return found["version"] if found else None

    def manifest(self, version: str | None = None) -> dict:
        """base, changes and schema of a version (the current one); folders without a manifest are bases, their columns tell the schema."""
        v = version or self.version()
        if v is None:
            return {"base": None, "changes": [], "schema": S.VERSION}
        if (found := self._read(f"{self.root}/{v}/manifest.json")) is not None:
            return found
        return {"base": v, "changes": [], "schema": S.version_of("nodes", self.spark.read.parquet(f"{self.root}/{v}/nodes").columns)}

    def size(self, version: str) -> int:
        """Bytes of a version's own folder."""
        fs, p = self._fs(f"{self.root}/{version}")
        return fs.getContentSummary(p).getLength()

    def _publish(self, version: str, manifest: dict, started: str | None) -> str:
        self._write(f"{self.root}/{version}/manifest.json", manifest)
        if self.version() != started:
            raise RuntimeError(f"the graph has moved from {started} to {self.version()} meanwhile")
        self._write(f"{self.root}/CURRENT.{version}", {"version": version})
        new, old = (self._fs(f"{self.root}/{n}")[1] for n in (f"CURRENT.{version}", "CURRENT"))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, old, options)
        return version

    # -- reading

    def nodes(self) -> DataFrame:
        return self._relation("nodes")

    def relationships(self) -> DataFrame:
        return self._relation("relationships")

    def _relation(self, part: str) -> DataFrame:
        shape, key = _PARTS[part]
        m = self.manifest()
        if m["base"] is None:
            return self.spark.createDataFrame([], shape)
        had = S.as_of(part, m["schema"])
        base = S.migrated(self.spark.read.schema(had).parquet(f"{self.root}/{m['base']}/{part}"), part, m["schema"])
        last = self._changes(part, m["changes"])
        if last is None:
            return base
        # nothing but keys of changed rows meets the base
        return base.join(last.select(*key), key, "left_anti").select(*shape.names).unionByName(last.where("NOT gone").select(*shape.names))

    def _changes(self, part: str, changes: list[str]) -> DataFrame | None:
        """The last change of each key: the relation's columns and gone."""
        shape, key = _PARTS[part]
        there = [c for c in changes for fs, p in [self._fs(f"{self.root}/{c}/{part}_changed")] if fs.exists(p)]
        if not there:
            return None
        rest = [c for c in shape.names if c not in key]
        changed = T.StructType([*shape.fields, T.StructField("gone", T.BooleanType())])
        rows = self.spark.read.schema(changed).parquet(*(f"{self.root}/{c}/{part}_changed" for c in there))
        if len(there) == 1:
            return rows.select(*shape.names, "gone")
        # folders are named by time, so the greatest name is the last change
        own = rows.select(*key, F.struct(*rest, "gone").alias("row"), F.regexp_extract("_metadata.file_path", f"/(v[^/]*)/{part}_changed/", 1).alias("place"))
        return own.groupBy(*key).agg(F.max_by("row", "place").alias("row")).select(*key, *(F.col(f"row.{c}").alias(c) for c in rest), F.col("row.gone").alias("gone"))

    def views(self) -> None:
        """Temporary views nodes and relationships for raw SQL."""
        self.nodes().createOrReplaceTempView("nodes")
        self.relationships().createOrReplaceTempView("relationships")

    # -- writing

    def staged(self, df: DataFrame) -> DataFrame:
        """df written once below the store and read back: a plan that several results share is run once and cut."""
        at = f"{self.root}/staging/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def commit(self, nodes: DataFrame, relationships: DataFrame) -> str:
        """Write both relations whole as a new base and make it current; missing columns become null."""
        started, version = self.version(), _new()
        at = f"{self.root}/{version}"
        S.shaped(nodes, NODES).sortWithinPartitions("label", "name").write.partitionBy("label").parquet(f"{at}/nodes")
        S.shaped(relationships, RELATIONSHIPS).sortWithinPartitions("source_label", "source_name").write.parquet(f"{at}/relationships")
        return self._publish(version, {"base": version, "changes": [], "schema": S.VERSION}, started)

    def apply(self, nodes: tuple[DataFrame, DataFrame] | None = None, relationships: tuple[DataFrame, DataFrame] | None = None) -> str | None:
        """Make a change current: of each relation the rows it touches, before and after. Only rows that differ and keys that are
        gone are written, below the same base. Nothing to write: no new version. Rows must be unique by key."""
        started, version = self.version(), _new()
        m = self.manifest(started)
        if m["base"] is None:
            return self.commit(*(pair[1] if pair else self.spark.createDataFrame([], shape) for pair, (shape, _) in zip((nodes, relationships), _PARTS.values(), strict=True)))
        wrote = False
        for part, pair in (("nodes", nodes), ("relationships", relationships)):
            if pair is None:
                continue
            shape, key = _PARTS[part]
            rest = [c for c in shape.names if c not in key]
            whole = lambda df, name: S.shaped(df, shape).select(*key, F.struct(*rest).alias(name))  # noqa: B023, E731
            both = whole(pair[0], "old").join(whole(pair[1], "new"), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
            row = F.coalesce("new", "old")
            out = both.select(*key, *(row[c].alias(c) for c in rest), F.col("new").isNull().alias("gone")).select(*shape.names, "gone")
            at = f"{self.root}/{version}/{part}_changed"
            out.hint("rebalance").write.parquet(at)
            if self.spark.read.parquet(at).isEmpty():
                fs, p = self._fs(at)
                fs.delete(p, True)
            else:
                wrote = True
        if not wrote:
            fs, p = self._fs(f"{self.root}/{version}")
            fs.delete(p, True)
            return started
        return self._publish(version, {**m, "changes": [*m["changes"], version]}, started)

    def compact(self, *, share: float = 0.25, most: int = 16, whole: bool | None = None) -> str | None:
        """Fold what readers have to overlay. Changes that hold over `share` of the base's bytes (or whole) become a new base;
        otherwise more than `most` changes become one. None of both: nothing happens."""
        started = self.version()
        m = self.manifest(started)
        if not m["changes"]:
            return started
        if whole is None:
            whole = sum(map(self.size, m["changes"])) > share * self.size(m["base"])
        if whole:
            return self.commit(self.nodes(), self.relationships())
        if len(m["changes"]) <= most:
            return started
        version = _new()
        for part in _PARTS:
            if (last := self._changes(part, m["changes"])) is not None:
                last.hint("rebalance").write.parquet(f"{self.root}/{version}/{part}_changed")
        return self._publish(version, {**m, "changes": [version]}, started)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete staged tables and all versions but the current one and the `keep` - 1 before it, with the folders these stand
        on. No sync may be running and nobody may be reading an older version."""
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return []
        now = self.version()
        names = sorted((f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()), reverse=True)
        versions = [n for n in names if n.startswith("v")]
        stay = [now, *[v for v in versions if now is not None and v < now][: max(0, keep - 1)]]
        needed = set(stay)
        for v in stay:
            if v is not None:
                m = self.manifest(v)
                needed |= {m["base"], *m["changes"]}
        gone = [n for n in names if n == "staging"] + [v for v in versions if v not in needed]
        for n in gone:
            fs.delete(self._fs(f"{self.root}/{n}")[1], True)
        return gone

    # -- indexes

    def save_index(self, index: DataFrame, name: str = "vectors") -> None:
        """Keep a vector index of the current version; one that is there stays."""
        at = f"{self.root}/{self.version()}/index-{name}"
        fs, p = self._fs(at)
        if not fs.exists(p):
            index.write.mode("overwrite").parquet(at)

    def index(self, name: str = "vectors") -> DataFrame | None:
        """The index of the current version, if one was kept."""
        at = f"{self.root}/{self.version()}/index-{name}"
        fs, p = self._fs(at)
        return self.spark.read.parquet(at) if fs.exists(p) else None


def _new() -> str:
    """Names sort by time."""
    return f"v{datetime.now(UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
