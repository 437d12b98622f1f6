"""Summaries that can be merged: distinct counts, quantiles and most frequent values, kept per group and rolled up later.

One row of sketches a group (label and day, say) is stored; any coarser group, cubes included, merges these rows and never
reads the data again. All three are built-in aggregates with partial aggregation, so a hot group is combined before
the shuffle. Errors, whatever is merged: distinct counts have a standard error of 1.04 / sqrt(2^bits) (1.6 percent at 12 bits);
ranks of quantiles are off by 1.33 percent at k = 200, and less in proportion to 1 / k; counts of frequent values are exact while a group has
fewer than `items` different ones, beyond that they are never too low, by at most about 3.5 rows in `items`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sketched(df: DataFrame, keys: list[str], *, distinct: str, quantiles: str, frequent: str, bits: int = 12, k: int = 400, items: int = 10_000) -> DataFrame:
    """One row per group: keys, rows, and a sketch of the column to count distinct values of, of the numbers, and of the values to
    rank. Nulls are left out of all three."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg(F.col(distinct), bits).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(quantiles).cast("double"), k).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(`{frequent}`, {items})").alias("frequent_sketch"),
    )


def _merged(items: int) -> list[Column]:
    return [F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"), F.expr(f"approx_top_k_combine(frequent_sketch, {items})").alias("frequent_sketch")]


def rolled_up(sketches: DataFrame, keys: list[str], *, items: int = 10_000) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones; no keys: of everything."""
    return sketches.groupBy(*keys).agg(*_merged(items))


def cube(sketches: DataFrame, keys: list[str], *, items: int = 10_000) -> DataFrame:
    """Sketches of every combination of keys, from finest to whole: keys (null: all of them) and level, the bits of the keys that are rolled up."""
    return sketches.cube(*keys).agg(F.grouping_id().alias("level"), *_merged(items))


def estimates(sketches: DataFrame, *, at: tuple[float, ...] = (0.5,), top: int = 10) -> DataFrame:
    """What sketches say: distinct_count, quantiles (at the given ranks) and frequent (item, count; the most frequent first)."""
    ranks = F.array(*(F.lit(float(x)) for x in at))
    rest = [c for c in sketches.columns if not c.endswith("_sketch")]
    return sketches.select(*rest, F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"), F.kll_sketch_get_quantile_double("quantile_sketch", ranks).alias("quantiles"), F.expr(f"approx_top_k_estimate(frequent_sketch, {top})").alias("frequent"))
