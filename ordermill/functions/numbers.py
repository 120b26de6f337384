"""Number helpers."""

from pyspark.sql import functions as F


def ratio(numerator, denominator):
    """Division that answers 0 for a zero, NULL or missing part."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def amount_when(flag, amount):
    """The amount where the flag holds, else 0, in the amount's own type."""
    return F.when(flag, amount).otherwise(F.lit(0).cast("decimal(18,2)"))
