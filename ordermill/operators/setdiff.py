"""Differences between two tables of the same columns, in one shuffle each.

Both sides are unioned with a mark and grouped by whole row, so equal rows are combined
before the shuffle. NULLs compare equal, as in EXCEPT.
"""

from pyspark.sql import functions as F


def set_diff(left, right):
    """Distinct rows found on one side only, with that `side`."""
    columns = left.columns
    marked = left.select(*columns, F.lit(True).alias("_left")).unionByName(
        right.select(*columns, F.lit(False).alias("_left"))
    )
    return (
        marked.groupBy(*columns)
        .agg(F.bool_or("_left").alias("_in_left"), F.bool_and("_left").alias("_only_left"))
        .filter(F.col("_only_left") | ~F.col("_in_left"))
        .select(*columns, F.when(F.col("_in_left"), "left").otherwise("right").alias("side"))
    )


def bag_diff(left, right):
    """Rows with unequal multiplicity: the richer `side` and its `surplus` of copies."""
    columns = left.columns
    signed = left.select(*columns, F.lit(1).alias("_sign")).unionByName(
        right.select(*columns, F.lit(-1).alias("_sign"))
    )
    return (
        signed.groupBy(*columns)
        .agg(F.sum("_sign").alias("_net"))
        .filter("_net <> 0")
        .select(
            *columns,
            F.when(F.col("_net") > 0, "left").otherwise("right").alias("side"),
            F.abs("_net").alias("surplus"),
        )
    )
