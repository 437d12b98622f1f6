"""Entities and relationships of a document's text: a seam for any extractor, with a rule-based one that needs no network.

An extractor takes path and content and returns path and the fields of EXTRACTED_SQL.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text as t
from tallyweave.schema import EXTRACTED_SQL

Extractor = Callable[[DataFrame], DataFrame]


def problems(got: dict | None) -> list[str]:
    """What is wrong with one answer: as entities.extraction_errors, for a value that hasn't reached a table yet."""
    got = got or {}
    if not isinstance(got.get("entities"), list):
        return ["Entities array is missing or invalid"]
    if not isinstance(got.get("relationships"), list):
        return ["Relationships array is missing or invalid"]
    names = {e.get("name") for e in got["entities"]}
    ends = [(kind, r.get(kind)) for r in got["relationships"] for kind in ("source", "target")]
    return [f'Relationship {kind} "{end}" not found in extracted entities' for kind, end in ends if end not in names and not (kind == "source" and end == "this")]


def rule_based(docs: DataFrame) -> DataFrame:
    """Headings below the first are topics, code spans technologies, [[names]] concepts, links to .md files references of the
    document; the summary is the first paragraph. Equal texts give equal results."""
    content = F.coalesce(F.col("content"), F.lit(""))
    plain = F.regexp_replace(content, r"(?s)```.*?(```|$)", "")  # code blocks name nothing
    found = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)))
    entity = lambda kind, names, told: F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), F.concat(F.lit(told), n).alias("description")))
    listed = F.concat(entity("Topic", found(r"(?m)^#{2,6}[ \t]+(.+?)[ \t#]*$"), "Section "), entity("Technology", found(r"`([^`\n]{1,80})`"), "Mentioned as code: "), entity("Concept", found(r"\[\[([^\]|\n]{1,120})"), "Linked name "))
    once = F.expr("filter(__e, (x, i) -> i = array_position(transform(__e, y -> y.name), x.name) - 1)")  # the first type of a name counts
    rel = F.transform("entities", lambda e: F.struct(F.lit("this").alias("source"), F.lit("REFERENCES").alias("relation"), e["name"].alias("target")))
    first = F.regexp_extract(F.regexp_replace(plain, r"(?m)^#.*$", ""), r"(?s)^\s*(.+?)(?:\n[ \t]*\n|\s*$)", 1)
    out = docs.select("path", listed.alias("__e"), t.truncated_summary(first).alias("summary")).withColumn("entities", once)
    return out.select("path", "entities", rel.alias("relationships"), "summary", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))


def calling(call: Callable[[str, str, list[str]], dict], *, turns: int = 3, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Extractor:
    """An extractor that asks a service: call(path, content, errors of the turn before) gives entities, relationships and
    summary. An invalid answer is asked for again, `turns` times at most; calls of one task are `pause` seconds apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                errors: list[str] = []
                for _ in range(turns):
                    if (wait := pause - (time.monotonic() - last)) > 0 and last:
                        sleep(wait)
                    last = time.monotonic()
                    try:
                        got = call(path, content, errors)
                        errors = problems(got)
                    except Exception as e:  # one document's failure is its own row
                        got, errors = {}, [str(e)]
                    if not errors:
                        break
                ok = not errors
                rows.append({"path": path, "entities": got.get("entities") if ok else [], "relationships": got.get("relationships") if ok else [], "summary": got.get("summary") if ok else "", "success": ok, "error": None if ok else "; ".join(errors)})
            yield pd.DataFrame(rows, columns=["path", "entities", "relationships", "summary", "success", "error"])

    return lambda docs: docs.select("path", "content").mapInPandas(run, f"path string, {EXTRACTED_SQL}")


def filled(docs: DataFrame, extractor: Extractor) -> DataFrame:
    """Parsed documents whose header names no entities get those that the extractor finds, and its summary if they have none."""
    bare = F.size(F.coalesce("entities", F.array().cast("array<struct<name:string,type:string,description:string>>"))) == 0
    x = extractor(docs.where(bare).select("path", "content")).where("success").select("path", F.col("entities").alias("__e"), F.col("relationships").alias("__r"), F.col("summary").alias("__s"))
    out = docs.join(x, "path", "left")
    either = {"entities": F.coalesce("__e", "entities"), "relationships": F.coalesce("__r", "relationships"), "summary": F.coalesce(t.present(F.col("summary")), F.col("__s"))}
    return out.withColumns(either).select(*docs.columns)
