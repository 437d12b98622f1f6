"""The engine's functions under names that raw SQL can call: scalar ones as SQL functions, which the optimizer sees through, and
extraction as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from tallyweave.functions.text import ACRONYMS

_ACRONYMS = ", ".join(f"'{a}'" for a in ACRONYMS)
#: name: (parameters, result, SQL). Each means the same as the column expression it is called after.
SCALARS = {
    "tw_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "tw_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) THEN try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END"),
    "tw_slug": ("path STRING", "STRING", "nullif(regexp_extract(path, '(?i)/docs/([^/]+)/README[.]md$', 1), '')"),
    "tw_slug_title": ("slug STRING", "STRING", f"array_join(transform(split(slug, '-'), w -> CASE WHEN lower(w) IN ({_ACRONYMS}) THEN upper(w) ELSE concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) END), ' ')"),
    "tw_title": ("raw STRING, path STRING", "STRING", r"CASE WHEN raw RLIKE '(?m)^#\\s+(.+)$' THEN regexp_extract(raw, '(?m)^#\\s+(.+)$', 1) ELSE regexp_replace(element_at(split(path, '/'), -1), '^(.*?)[.]md', '$1') END"),
    "tw_field": ("properties STRING, name STRING", "STRING", "get_json_object(properties, concat('$.', name))"),
}

_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_FOUND = [("Topic", re.compile(r"(?m)^#{2,6}[ \t]+(.+?)[ \t#]*$")), ("Technology", re.compile(r"`([^`\n]{1,80})`")), ("Concept", re.compile(r"\[\[([^\]|\n]{1,120})"))]


@udtf
class Entities:
    """Entities of documents (a table with path and content, any further columns): path, pos, type and name, in the order of the rules. Its
    input is dealt by path; documents are read one by one."""

    @staticmethod
    def analyze(docs: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name for f in docs.dataType.fields} if docs.isTable else set()
        if not {"path", "content"} <= names:
            raise Exception("tw_entities takes a table with the columns path and content")
        schema = StructType().add("path", StringType()).add("pos", IntegerType()).add("type", StringType()).add("name", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("path")])

    def eval(self, row) -> Iterator[tuple]:
        plain = _FENCED.sub("", row["content"] or "")
        seen, pos = set(), 0
        for kind, pattern in _FOUND:
            for m in pattern.finditer(plain):
                name = m.group(1).strip(" ")
                if name and name not in seen:  # the first type of a name counts
                    seen.add(name)
                    pos += 1
                    yield row["path"], pos, kind, name


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to a session's SQL; returns their names."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("tw_entities", Entities)
    return [*SCALARS, "tw_entities"]
