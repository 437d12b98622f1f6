"""Joins that are not equalities: the last row before, intervals, conditions, and the best rows of each key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import kept


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: list[str], *, strict: bool = False, parts: int | None = None) -> DataFrame:
    """left with the value columns of right's last row of the same key at or before (strict: before) its time, null if there
    is none. Of right's rows at one time the greatest counts. Rows whose key or time is null match nothing.

    Both sides are dealt by ranges of key and time, whatever share of the rows a key has; each range is walked by itself, and
    the last row of right that a key has in a range is carried over to the key's later ranges. Only rows of one key and one
    time must meet in a task. parts: how many ranges; the shuffle partitions by default.
    """
    spark = left.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.struct(*(F.col(c).alias(f"r_{c}") for c in value)).alias("__v"), F.lit(1 if strict else 0).alias("__o"))
    li = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.struct(*left.columns).alias("__row"), F.lit(0 if strict else 1).alias("__o"))
    both = li.where(F.col(key).isNotNull() & F.col(at).isNotNull()).unionByName(r, allowMissingColumns=True)
    dealt = kept(both.repartitionByRange(parts, "__key", "__at").withColumn("__part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__part", "__key").orderBy("__at", "__o", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("__here", F.last("__v", ignorenulls=True).over(within)).where("__row IS NOT NULL")
    # the last row of each key and range, and what a range inherits: rows are keys and ranges, not data
    last = dealt.groupBy("__key", "__part").agg(F.max(F.when(F.col("__v").isNotNull(), F.struct("__at", "__v"))).alias("m"))
    spread = kept(last.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("__key"))).where("n > 1"), "carried")
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.select("__key", "__part", F.last("m", ignorenulls=True).over(earlier)["__v"].alias("__before"))
    # a key of several ranges ends or begins in each: there are fewer such rows than twice the ranges
    out = seen.join(F.broadcast(carried), ["__key", "__part"], "left").withColumn("__v", F.coalesce("__here", "__before"))
    found = out.select("__row.*", *(F.col(f"__v.r_{c}").alias(f"last_{c}") for c in value))
    rest = left.where(F.col(key).isNull() | F.col(at).isNull())
    return found.unionByName(rest.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(f"last_{c}") for c in value)))


def _number(df: DataFrame, column: str) -> Column:
    """A column as double, in seconds or days if it is a time; order is kept."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "date":
        return F.unix_date(c).cast("double")
    return (c.cast("timestamp") if kind == "timestamp_ntz" else c).cast("double")


def in_interval(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval with start <= at < end, for intervals of any length side by side.

    An interval stands at the level whose bins (2^level wide) are at least as long as itself, so in two bins, three at most where
    rounding has it. A point looks into its bin at each level that is in use: an equi-join on level and bin, then the exact test.
    Levels are few (as many as powers of two between the shortest and the longest). Null ends and empty intervals hold nothing.
    """
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    low, high = _number(intervals, start), _number(intervals, end)
    # ends that are one number as doubles are one bin of the finest level
    length = F.greatest(high - low, F.lit(2.0**-30))
    b = intervals.where(F.col(start) < F.col(end)).withColumn("__level", F.ceil(F.log2(length)).cast("int"))
    b = b.withColumn("__bin", F.explode(F.sequence(cell(low), cell(high))))
    used = kept(b.select("__level").distinct(), "levels").collect()  # some tens
    a = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*(F.lit(r[0]) for r in sorted(used))).cast("array<int>"))).withColumn("__bin", cell(_number(points, at)))
    return a.join(b, ["__level", "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__level", "__bin")


def overlapping(a: DataFrame, b: DataFrame, start: tuple[str, str], end: tuple[str, str]) -> DataFrame:
    """Pairs of intervals (start <= t < end) of two tables that share a moment: one of them begins within the other."""
    a, b = a.where(F.col(start[0]) < F.col(end[0])), b.where(F.col(start[1]) < F.col(end[1]))
    late = in_interval(a, b, start[0], start[1], end[1])  # a begins in b, at the same moment included
    early = in_interval(b, a, start[1], start[0], end[0]).where(F.col(start[1]) > F.col(start[0]))
    return late.select(*a.columns, *b.columns).unionByName(early.select(*a.columns, *b.columns))


def where_pairs(left: DataFrame, right: DataFrame, condition: Column, *, pairs: int = 50_000_000) -> DataFrame:
    """Pairs under any condition, of tables of any size. There is no way but to look at all pairs: rows of left are dealt to the
    rows of a grid, rows of right to its columns, and each pair meets in one cell. The grid has as many cells as tasks of about
    `pairs` comparisons take, in the shape that sends the fewest copies. Rows are dealt by a hash of all their columns.
    """
    n, m = left.count(), right.count()
    if not n or not m:
        return left.limit(0).join(right.limit(0), F.lit(True))
    cells = max(1, math.ceil(n * m / pairs))
    tall = min(max(1, round(math.sqrt(cells * n / m))), cells)  # rows of the grid: copies are n * wide + m * tall
    wide = math.ceil(cells / tall)
    place = lambda df, k: F.pmod(F.xxhash64(*df.columns, F.lit(k)), F.lit(tall if k == 0 else wide)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    a = left.withColumn("__r", place(left, 0)).withColumn("__c", every(wide))
    b = right.withColumn("__c", place(right, 1)).withColumn("__r", every(tall))
    return a.join(b, ["__r", "__c"]).where(condition).drop("__r", "__c")


def totals_below(asked: DataFrame, rows: DataFrame, bound: str, at: str, value: str, *, key: str | None = None, part: int = 200_000) -> DataFrame:
    """asked with n, filled and total: how many rows have at < bound (of the same key, if one is given), how many of these have a value, and
    the sum of their values (null if none has). What a join on that inequality and a grouping would give, without its pairs.

    Rows are folded by key and at; these and the bounds are dealt by ranges of key and place, each range is summed up by itself, and what a
    range holds of a key is added to the key's later ranges: work and memory follow the rows, never the pairs. part: rows of a range.
    Doubles are summed as decimals of ten places, so that differences of totals are exact to these. Rows of asked whose bound or key is
    null are left out. Columns at and bound must be of one type.
    """
    spark = asked.sparkSession
    own = F.col(key) if key else F.lit(0)
    v = F.col(value).cast("decimal(28,10)") if rows.schema[value].dataType.typeName() in ("double", "float") else F.col(value)
    sums = ["n", "filled", "total"]
    r = rows.where(F.col(at).isNotNull() & own.isNotNull()).groupBy(own.alias("__key"), F.col(at).alias("__at")).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("filled"), F.sum(v).alias("total"))
    a = asked.where(F.col(bound).isNotNull() & own.isNotNull()).select(own.alias("__key"), F.col(bound).alias("__at"), F.struct(*asked.columns).alias("__row"))
    # at one place bounds come before rows; they are told apart by a number, so that many equal bounds may lie in several ranges
    both = kept(a.withColumns({"__o": F.lit(0), "__id": F.monotonically_increasing_id()}).unionByName(r.withColumns({"__o": F.lit(1), "__id": F.lit(0).cast("long")}), allowMissingColumns=True), "bounds")
    order = ["__at", "__o", "__id"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(both.count() / part))
    dealt = kept(both.repartitionByRange(parts, "__key", *order).withColumn("__part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__part", "__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.repartition(parts, "__part").select("__key", "__part", "__row", *(F.sum(c).over(within).alias(c) for c in sums)).where("__row IS NOT NULL")
    # what each range holds of a key, and what a key's later ranges inherit: rows are keys and ranges, not data
    held = dealt.groupBy("__key", "__part").agg(*(F.sum(c).alias(c) for c in sums))
    spread = kept(held.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__key"))).where("__n > 1"), "carried")
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.select("__key", "__part", *(F.sum(c).over(earlier).alias(f"__{c}") for c in sums))
    # a key of several ranges ends or begins in each: there are fewer such rows than twice the ranges
    out = seen.join(F.broadcast(carried), ["__key", "__part"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    both_ = lambda c: none(F.col(c)) + none(F.col(f"__{c}"))
    return out.select("__row.*", both_("n").alias("n"), both_("filled").alias("filled"), F.when(both_("filled") > 0, both_("total")).alias("total"))


def signed_totals(asked: DataFrame, by: str) -> DataFrame:
    """by, n and total (double) of what totals_below gave for bounds with a column sign: those of 1 less those of -1. Without any row left, no group."""
    sign = F.col("sign")
    out = asked.groupBy(by).agg(F.sum(sign * F.col("n")).alias("n"), F.sum(sign * F.col("filled")).alias("filled"), F.sum(sign * F.coalesce("total", F.lit(0))).cast("double").alias("total"))
    return out.where("n > 0").select(by, "n", F.when(F.col("filled") > 0, F.col("total")).alias("total"))


def best_of_each(left: DataFrame, right: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """left with its key's k first rows of right (as a lateral subquery would give): ranked once per key, then joined."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return left.join(right.withColumn("rank", rank).where(F.col("rank") <= k), key)
