"""Markdown trees: scan, front matter, parsed documents with an error channel, and front matter written back."""

from __future__ import annotations

import datetime
import json
import posixpath
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text as t
from tallyweave.session import file_system

_ENTITY = "array<struct<name:string,type:string,description:string>>"
_RELATION = "array<struct<source:string,relation:string,target:string>>"
FRONT_SQL = f"json string, error string, title string, summary string, topic string, created string, updated string, status string, tags array<string>, entities {_ENTITY}, relationships {_RELATION}, graph struct<importance:string,domain:string>, problems array<string>"
#: Values of importance: fixed values.
IMPORTANCE = ("high", "medium", "low")


#: Values of status: fixed values.
STATUS = ("draft", "ongoing", "complete")


def local_path(column: str) -> Column:
    """A file's name without the scheme of the local file system."""
    return F.regexp_replace(F.col(column), "^file:/+", "/")


def scan(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """path, content of every .md file below root, but for node_modules and .git; of some paths only (a table with a column path), if they are
    given. Names that begin with _ or . are passed over, as Spark's readers do; paths that aren't there give no row.

    Tasks list the folders, one each of those right below root, and then read the files that are dealt to them one after the other: contents
    meet no shuffle, and neither names nor contents pass the driver. A file system that only Spark can open is read by Spark.
    """
    if _opened(root):
        names = _listed(spark, root) if paths is None else paths.select(local_path("path").alias("path")).distinct()
        dealt = names.where(_WANTED).repartition(4 * spark.sparkContext.defaultParallelism, "path")
        return dealt.mapInArrow(_read, "path string, content binary").select("path", F.col("content").cast("string").alias("content"))
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    found = files.select(local_path("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(_WANTED)
    return found if paths is None else found.join(paths.select(local_path("path").alias("path")).distinct(), "path", "left_semi")


_WANTED = r"path LIKE '%.md' AND NOT path RLIKE '/(node_modules|[.]git)/' AND NOT path RLIKE '/([.][^/]*|_[^=/]*)$'"
_HELD = 4 << 20  # bytes of contents that a task holds at once, or one file


def _opened(root: str) -> bool:
    """Whether tasks can open a folder's file system by themselves."""
    from tallyweave.sources.sinks import _store

    try:
        _store(root)
    except (ValueError, OSError, NotImplementedError):  # pyarrow's errors are kinds of these
        return False
    return True


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """path of all files below root."""
    from pyarrow import fs

    from tallyweave.sources.sinks import _store

    root = root.rstrip("/")

    def walk(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
        for here in (x for b in batches for x in b.column(0).to_pylist()):
            store, at = _store(here)
            prefix, todo = "" if here == at or here.startswith("file:") else here.rstrip("/").removesuffix(at), [at]
            while todo:
                inside = store.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=deep))
                hidden = lambda n: n.startswith(".") or (n.startswith("_") and "=" not in n)
                own = [x for x in inside if not hidden(x.base_name)]
                folders = [x.path for x in own if x.type == fs.FileType.Directory and x.base_name != "node_modules"]
                files = [prefix + x.path for x in own if x.type == fs.FileType.File]
                if deep:
                    todo += folders
                rows = files + ([] if deep else [prefix + x for x in folders])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([deep or k < len(files) for k in range(len(rows))], pa.bool_())], names=["path", "file"])

    top = spark.createDataFrame([(root,)], "path string").coalesce(1).mapInArrow(lambda it: walk(it, False), "path string, file boolean")
    below = top.where("NOT file").select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(lambda it: walk(it, True), "path string, file boolean")
    return top.where("file").union(below).select("path")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path and content (bytes) of files; those that are gone are left out."""
    from tallyweave.sources.sinks import _store

    held: list[tuple[str, bytes]] = []
    opened: dict[str, tuple] = {}

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], names=["path", "content"])
        held.clear()
        return out

    size = 0
    for path in (x for b in batches for x in b.column(0).to_pylist()):
        folder, _, name = path.rpartition("/")
        if folder not in opened:
            opened.clear()
            opened[folder] = _store(folder or "/")
        store, at = opened[folder]
        try:
            with store.open_input_stream(f"{at}/{name}") as f:
                held.append((path, f.read()))
        except FileNotFoundError:
            continue
        size += len(held[-1][1])
        if size > _HELD or len(held) >= 1000:
            yield given()
            size = 0
    yield given()


def split_front(content: Column) -> tuple[Column, Column]:
    """(header without fences or null, body)."""
    full = r"(?s)^---[ \t]*\r?\n((?:.*?\r?\n)?)---[ \t]*(?:\r?\n|$)"
    fenced = content.rlike(full)
    return F.when(fenced, F.regexp_extract(content, full, 1)), F.when(fenced, F.regexp_replace(content, full, "")).otherwise(content)


def _plain(x):
    """Dates as YYYY-MM-DD, at any depth."""
    if isinstance(x, datetime.datetime | datetime.date):
        return x.isoformat()[:10]
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _word(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x)


def _record(header: str | None) -> dict:
    import yaml

    out: dict = dict.fromkeys(("json", "error", "title", "summary", "topic", "created", "updated", "status", "tags", "entities", "relationships", "graph"))
    out["problems"] = []
    if header is None:
        return out | {"problems": ["No frontmatter found"]}
    try:
        data = _plain(yaml.safe_load(header) or {})
    except yaml.YAMLError as e:
        return out | {"error": f"YAML parsing error: {e}"}
    except (ValueError, OverflowError) as e:  # a date that doesn't exist
        return out | {"error": f"YAML parsing error: {e}"}
    if not isinstance(data, dict):
        return out | {"error": "YAML parsing error: front matter is not a mapping"}
    structs = lambda x, *fields: [{f: _word(i.get(f)) for f in fields} for i in x if isinstance(i, dict)] if isinstance(x, list) else None
    graph = data.get("graph")
    ok = isinstance(graph, dict) and graph.get("importance") in (None, *IMPORTANCE) and isinstance(graph.get("domain"), str | None)
    return out | {
        "json": json.dumps(data, separators=(",", ":"), ensure_ascii=False),
        **{k: _word(data.get(k)) for k in ("title", "summary", "topic", "created", "updated", "status")},
        "tags": [_word(x) for x in data["tags"]] if isinstance(data.get("tags"), list) else None,
        "entities": structs(data.get("entities"), "name", "type", "description"),
        "relationships": structs(data.get("relationships"), "source", "relation", "target"),
        "graph": {"importance": graph.get("importance"), "domain": graph.get("domain")} if ok else None,
        "problems": header_problems(data),
    }


def _kind(x) -> str:
    return "undefined" if x is _ABSENT else "null" if x is None else {bool: "boolean", int: "number", float: "number", str: "string", list: "array"}.get(type(x), "object")


_ABSENT = object()


def header_problems(data: Mapping) -> list[str]:
    """One "field.path: message" per fault of a header; unknown keys are fine. The messages are fixed values."""
    from tallyweave.schema import ENTITY_TYPES

    out: list[str] = []

    def text(path: str, x, *, optional: bool = False, least: int = 0, one_of: tuple[str, ...] = (), date: bool = False) -> None:
        if x is _ABSENT and optional:
            return
        if one_of:
            if x not in one_of:
                out.append(f"{path}: Invalid option: expected one of " + "|".join(f'"{v}"' for v in one_of))
        elif not isinstance(x, str):
            out.append(f"{path}: Invalid input: expected string, received {_kind(x)}")
        elif len(x) < least:
            out.append(f"{path}: Too small: expected string to have >={least} characters")
        elif date and not _real_date(x):
            out.append(f"{path}: Date must be in YYYY-MM-DD format")

    def each(field: str, kinds: dict[str, dict]) -> None:
        x = data.get(field, _ABSENT)
        if x is _ABSENT:
            return
        if not isinstance(x, list):
            out.append(f"{field}: Invalid input: expected array, received {_kind(x)}")
            return
        for k, item in enumerate(x):
            if not kinds:
                text(f"{field}.{k}", item)
            elif not isinstance(item, dict):
                out.append(f"{field}.{k}: Invalid input: expected object, received {_kind(item)}")
            else:
                for name, rule in kinds.items():
                    text(f"{field}.{k}.{name}", item.get(name, _ABSENT), **rule)

    for field in ("created", "updated"):
        text(field, data.get(field, _ABSENT), date=True)
    text("status", data.get("status", _ABSENT), optional=True, one_of=STATUS)
    for field in ("topic", "summary"):
        text(field, data.get(field, _ABSENT), optional=True)
    each("tags", {})
    each("entities", {"name": {"least": 1}, "type": {"one_of": tuple(k for k in ENTITY_TYPES if k != "Question")}, "description": {"least": 1}})
    each("relationships", {"source": {"least": 1}, "relation": {"one_of": ("REFERENCES",)}, "target": {"least": 1}})
    graph = data.get("graph", _ABSENT)
    if graph is not _ABSENT and not isinstance(graph, dict):
        out.append(f"graph: Invalid input: expected object, received {_kind(graph)}")
    elif graph is not _ABSENT:
        text("graph.importance", graph.get("importance", _ABSENT), optional=True, one_of=IMPORTANCE)
        text("graph.domain", graph.get("domain", _ABSENT), optional=True)
    return out


def _real_date(x: str) -> bool:
    try:
        return len(x) == 10 and x.isascii() and datetime.datetime.strptime(x, "%Y-%m-%d").date().isoformat() == x
    except ValueError:
        return False


def front(header: Column) -> Column:
    """A struct of FRONT_SQL. YAML needs Python; whole Arrow batches go there, headers only."""

    @F.pandas_udf(FRONT_SQL)
    def parse(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for headers in it:
            yield pd.DataFrame([_record(h) for h in headers])

    return parse(header)


def parsed(files: DataFrame) -> DataFrame:
    """path, title, content, content_hash, frontmatter_hash, the header's fields, error (null if the file is sound)."""
    header, body = split_front(F.col("content"))
    one = files.select("path", "content", body.alias("body"), header.alias("header")).withColumn("f", front(F.col("header")))
    return one.select(
        "path",
        F.coalesce(t.present(F.col("f.title")), t.title_of(F.col("content"), F.col("path"))).alias("title"),
        F.col("body").alias("content"),
        t.content_hash(F.col("content")).alias("content_hash"),
        t.content_hash(F.coalesce("f.json", F.lit("{}"))).alias("frontmatter_hash"),
        *(F.col(f"f.{c}").alias(c) for c in ("summary", "topic", "created", "updated", "status", "tags", "entities", "relationships", "graph", "error", "problems")),
    )


def documents(found: DataFrame) -> DataFrame:
    return found.where("error IS NULL").drop("error", "problems")


def errors(found: DataFrame) -> DataFrame:
    return found.where("error IS NOT NULL").select("path", "error")


def front_problems(found: DataFrame) -> DataFrame:
    """path, problem of parsed documents: a header that is missing, or one "field.path: message" per fault."""
    return found.where("error IS NULL").select("path", F.explode("problems").alias("problem"))


def resolved(spark: SparkSession, paths: list[str], root: str, *, inside: bool = True, exists: bool = True) -> list[str]:
    """Paths as they were named by a user, absolute or below root. One that lies outside, or isn't there, raises."""
    out, base = [], root.rstrip("/")
    for p in paths:
        scheme, mark, rest = (p if p.startswith("/") or "://" in p else f"{base}/{p}").rpartition("://")
        at = scheme + mark + posixpath.normpath(rest)
        if inside and at.rstrip("/") != base and not at.startswith(base + "/"):
            raise ValueError(f'Path "{p}" resolves to "{at}" which is outside the docs directory ({root})')
        fs, there = file_system(spark, at)
        if exists and not fs.exists(there):
            raise FileNotFoundError(f'Path "{p}" does not exist (resolved to: {at})')
        out.append(at)
    return out


def header_of(data: Mapping) -> str:
    """Front matter text of a mapping, which scan and parsed read back to the same values."""

    def scalar(v) -> str:
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        if isinstance(v, int | float):
            return str(v)
        v = str(v)
        special = set(':#[]{}!&*,|>\'"?%@`\\') & set(v)
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if not v or v != v.strip() or special or v[0] == "-" or v.lower() in t.RESERVED or "\n" in v else v

    def lines(value, indent: str) -> list[str] | str:
        if isinstance(value, Mapping):
            return [row for k, v in value.items() for row in entry(str(k), v, indent)]
        if isinstance(value, list) and value and isinstance(value[0], Mapping):
            rows = []
            for item in value:
                inner = lines(item, indent + "  ")
                rows += [indent + "- " + inner[0].lstrip(), *inner[1:]] if inner else [indent + "- {}"]
            return rows
        return "[" + ", ".join(map(scalar, value)) + "]" if isinstance(value, list) else scalar(value)

    def entry(k: str, v, indent: str) -> list[str]:
        got = lines(v, indent + "  ")
        return [f"{indent}{k}: {got}"] if isinstance(got, str) else [f"{indent}{k}:", *got]

    return "\n".join(["---", *lines(dict(data), ""), "---"])
