"""Dense numbering and prefix sums over integer keys, without a single-task window.

Keys are cut into ranges of about equal numbers of rows, at quantiles of the keys, so
sparse, clustered and dense keys are alike. Ranges are summed, the range sums, at most
MOST_RANGES, get a prefix sum, and rows are numbered within their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, and the number of ranges at most.
ROWS, MOST_RANGES = 1_000_000, 1 << 14
#: Tasks that ``dealt`` makes at most, where the cluster has fewer cores than a quarter of it. To so many Spark writes
#: a shuffle row by row; for more, a task that reads keeps all of its rows in memory or spills them.
MOST_TASKS = 200


def range_of(key: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds a key has reached: a bisection of fixed depth."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    held = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(key >= F.get(held, at + step - 1), at + step).otherwise(at))


def key_bounds(df: DataFrame, key: str, rows: int = ROWS) -> list[float]:
    """Keys at which ranges of about ``rows`` rows begin."""
    n = df.select(key).count()
    ranges = min(MOST_RANGES, -(-n // rows))
    if ranges < 2:
        return []
    found = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first().q
    return sorted(set(found))


def prefix_sum(df: DataFrame, key: str, value: str, out: str = "offset", rows: int = ROWS) -> DataFrame:
    """Each row with the sum of ``value`` over smaller keys; keys are unique integers."""
    bounds = key_bounds(df, key, rows)
    within = F.sum(value).over(W.partitionBy("_range").orderBy(key)) - F.col(value)
    ranged = df.withColumn("_range", range_of(F.col(key), bounds))
    numbered = ranged.withColumn("_within", within)
    if not bounds:  # one range, which one task may hold
        return numbered.withColumn(out, F.col("_within")).select(*df.columns, out)
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.col("_range").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    numbered = numbered.join(F.broadcast(bases), F.col("_range") == F.col("_b"))
    return numbered.withColumn(out, F.col("_base") + F.col("_within")).select(*df.columns, out)


def dense_index(df: DataFrame, key: str, out: str = "idx", rows: int = ROWS) -> DataFrame:
    """Each row with its rank from 0 in the order of a unique integer key."""
    return prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", out, rows).drop("_one")


def with_total(df: DataFrame, key: str, value: str, out: str = "offset", rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(the prefix sums, one row with the trailing total)."""
    return prefix_sum(df, key, value, out, rows), df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(out))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df over as many tasks as its rows make, ``rows`` each: for long work on few bytes, which
    would else stay in the few tasks that read it. Beyond MOST_TASKS (or four a core) tasks get more rows."""
    most = max(MOST_TASKS, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(min(most, max(1, -(-df.count() // rows))), *keys)
