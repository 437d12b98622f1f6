"""What the operators share: staging tables in the cluster's shared folder, and safe column handling."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import shared_dir

#: Separators of words, as a Java character class and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


_SCOPES: list[list[str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: cuts the lineage, fixes row ids, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if _SCOPES:
        _SCOPES[-1].append(path)
    return out


def drop_staged(*frames: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more (as staged() gave them; anything else is left alone)."""
    for df in frames:
        if (path := getattr(df, "staged_at", None)) is not None:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes what is staged inside, once it is left; what is still to be read must be taken from the list."""
    mine: list[str] = []
    _SCOPES.append(mine)
    try:
        yield mine
    finally:
        _SCOPES.remove(mine)
        for path in mine:
            _delete(spark, path)


#: Rows of a few numbers that are sent to every task at most (about 5 MB).
SENT_ROWS = 100_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str | list[str], *, counts: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """rows left-joined with facts (one row a key at most, a few numbers each), whatever share of the rows a key has.

    Up to SENT_ROWS facts are sent to every task. Beyond that, keys with over one `share`th of all rows are joined where
    they lie: there are fewer than `share` of them, so their facts are sent. All other keys are dealt by hash.
    counts: (key, n) where it is known already. facts and counts are read more than once: better stored tables.
    """
    keys = [key] if isinstance(key, str) else key
    if facts.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        return rows.join(F.broadcast(facts), keys, "left")
    most = max(1, rows.count() // share)
    known = lambda df: df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    counts = counts if counts is not None else known(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = known(counts.where(F.col("n") > most)).select(*keys)
    found = hot.collect()  # fewer than `share` keys
    if not found:
        return rows.join(facts, keys, "left")
    mark = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema).withColumn("__hot", F.lit(True)))
    marked = rows.join(mark, keys, "left")
    near = marked.where("__hot").drop("__hot").join(F.broadcast(facts.join(mark, keys, "left_semi")), keys, "left")
    return near.unionByName(marked.where("__hot IS NULL").drop("__hot").join(facts, keys, "left"))


def dealt(pairs: DataFrame, facts: DataFrame, value: str, names: tuple[str, str] = ("a", "b"), most: int = 512) -> DataFrame:
    """pairs (two keys) joined with the large `value` that facts hold for each key, as z<key>. A key of more than `most`
    pairs is dealt to several tasks by the hash of its partner, and its value goes to each of them: too large to be sent
    everywhere, it travels once a `most` pairs. pairs should be a stored table, as it is read several times."""
    out = pairs
    fans = {}
    for key in names:
        fan = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        fans[key] = staged(fan.select(key, F.ceil(F.col("n") / most).cast("int").alias(f"__k{key}")), "fans")
        out = looked_up(out, fans[key], key)
    for key, other in (names, names[::-1]):
        out = out.withColumn(f"__s{key}", F.pmod(F.xxhash64(other), F.coalesce(f"__k{key}", F.lit(1))).cast("int"))
    for key in names[::-1]:
        own = facts.select(F.col(facts.columns[0]).alias(key), F.col(value).alias(f"z{key}")).join(fans[key], key, "left")
        own = own.withColumn(f"__s{key}", F.explode(F.sequence(F.lit(0), F.coalesce(f"__k{key}", F.lit(1)) - 1))).drop(f"__k{key}")
        out = out.drop(f"__k{key}").join(own, [key, f"__s{key}"])
    return out.select(*names, *(f"z{key}" for key in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def group_key(column: str) -> Column:
    """A text key that keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def words_of(text: Column) -> Column:
    """array<string> of the words between separators; empty for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))
