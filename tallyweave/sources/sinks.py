"""What leaves the engine as files: trees of markdown, JSON results, the index page."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import file_system
from tallyweave.sources.markdown import header_of


def _store(root: str):
    """pyarrow's file system of a folder that driver and executors share, and the folder's path on it."""
    from pyarrow import fs

    parts = urlsplit(root)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path.rstrip("/")
    return fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1).rstrip("/"))


def write_tree(files: DataFrame, root: str) -> int:
    """Write path and content of every row to a file below root (a folder that all executors reach); null contents are left
    out. Each task writes its own rows, and a task that is run again writes the same files. Gives the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(root)
        made: set[str] = set()
        for batch in batches:
            n = 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path is None or content is None:
                    continue
                to = f"{at}/{path.lstrip('/')}"
                if (folder := to.rsplit("/", 1)[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(to) as out:
                    out.write(content.encode())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def delete_files(files: DataFrame, root: str) -> int:
    """Delete the files (column path, below root) that are there. Each task deletes its own. Gives their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(root)
        for batch in batches:
            n = 0
            for path in batch.column(0).to_pylist():
                if path is not None:
                    try:
                        store.delete_file(f"{at}/{path.lstrip('/')}")
                        n += 1
                    except FileNotFoundError:
                        pass
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def with_header(front: Column, body: Column) -> Column:
    """Front matter (a JSON object) and body as one markdown text; a null header leaves the body as it is."""

    @F.pandas_udf("string")
    def head(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for headers in it:
            yield headers.map(lambda h: None if h is None else header_of(json.loads(h)))

    header = head(front)
    return F.when(front.isNull(), body).otherwise(F.concat(header, F.lit("\n"), F.coalesce(body, F.lit(""))))


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls included."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def result_json(df: DataFrame, most: int = 100_000) -> str:
    """A result as a printed answer: its columns and all its rows. More than `most` rows are refused, not cut: they belong into json_lines,
    which tasks write."""
    rows = [json.loads(r.j) for r in df.limit(most + 1).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).collect()]
    if len(rows) > most:
        raise ValueError(f"the result has more than {most} rows; write it with json_lines")
    return json.dumps({"columns": df.columns, "resultSet": rows}, indent=2, ensure_ascii=False)


def write_page(spark, text: str, path: str) -> None:
    """One text file, replaced as a whole."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(text.encode())
    out.close()
