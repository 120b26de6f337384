"""Whole-row expressions."""

from pyspark.sql import functions as F


def same_row(left, right):
    """NULL-safe equality over two equally long column lists."""
    return F.struct(*left).eqNullSafe(F.struct(*right))


def fail_where(frame, reason):
    """Pass the frame through, failing the job where `reason` is not NULL.

    The check sits in a filter, so pruning unused columns cannot remove it.
    """
    return frame.filter(
        F.when(reason.isNotNull(), F.raise_error(reason).cast("boolean")).otherwise(F.lit(True))
    )
