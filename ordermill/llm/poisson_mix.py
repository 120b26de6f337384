"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

Source s with `size` characters shall make up the share `weight` of a mixture of `total`
characters, so each of its documents is wanted weight * total / size times. A hash of the id and a
seed gives each document a fixed number u in [0, 1); the count is the inverse of the Poisson
distribution with that mean at u. Means may have fractions and exceed one, and no state is shared
between tasks. Each document is exploded by its count and all copies are dealt out by a hash of id
and copy number, then ordered by that hash inside each partition: a global shuffle in which no
source, however large, is in one task.

The inversion starts near the mean: the steps of the distribution from 12 standard deviations and 30
below it to as many above it are rows, summed by a window, so a mean of m takes time and memory in
proportion to its square root. The steps of a source become one sorted array, which each document
searches by halving. The table of arrays is broadcast if it has at most `BROADCAST_STEPS` numbers
in all, so that texts move once; a larger one is joined.

Defined results: a null source is a source of its own; a source without characters, or with weight
zero, is left out; a null id is hashed as the text `null`; rows that repeat an id get the same
count; an empty table gives an empty result; other columns are carried along.
"""

import math

from pyspark.sql import Window, functions as F

from ordermill.llm.frames import packed, saved

SEED = 20
TEMPER = 0.5
BROADCAST_STEPS = 1 << 22


def source_sizes(rows):
    return rows.groupBy("source").agg(F.sum(F.length("text")).alias("size")).where("size > 0")


def tempered(sizes, power=TEMPER):
    """Weights in proportion to a power of the size: below one, small sources gain."""
    return sizes.withColumn("weight", F.pow("size", F.lit(power)))


def _log_chance(k, mean):
    """The logarithm of the chance of k.

    k! is a product up to 16 and the series of Stirling beyond, exact to 15 digits; large terms that cancel are left out.
    """
    factors = F.sequence(F.lit(1), F.least(F.greatest(k, F.lit(1)), F.lit(16)).cast("int"))
    small = k * F.log(mean) - mean - F.aggregate(factors, F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    x = k.cast("double")
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    large = x * F.log1p((mean - x) / x) - (mean - x) - F.log(2 * math.pi * x) / 2 - series
    return F.when(k <= 16, small).otherwise(large)


def poisson_steps(means):
    """(name, below, steps) for each row (name, mean): steps has the distribution function at below, below + 1, ...

    Until nothing is left above, and from where nothing is below yet.
    """
    spread = 12 * F.sqrt("mean") + 30
    below = F.greatest(F.lit(0), F.floor(F.col("mean") - spread))
    each = means.withColumn("below", below.cast("long"))
    each = each.withColumn("k", F.explode(F.sequence("below", F.ceil(F.col("mean") + spread).cast("long"))))
    # Each chance is the one before times mean / k, so only the first of a source is computed anew.
    inside = Window.partitionBy("name").orderBy("k")
    first = F.when(F.col("k") == F.col("below"), _log_chance(F.col("k"), F.col("mean")))
    log = F.sum(first.otherwise(F.log(F.col("mean") / F.col("k")))).over(inside)
    each = each.withColumn("log", log).withColumn("step", F.sum(F.exp("log")).over(inside))
    lists = each.groupBy("name", "below").agg(F.sort_array(F.collect_list(F.struct("k", "step"))).alias("steps"))
    return lists.select("name", "below", F.col("steps.step").alias("steps"))


def _steps_up_to(steps, u):
    """How many of the sorted steps are at most u, by halving."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(steps).alias("high"))

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        up = (state["low"] < state["high"]) & (F.get(steps, middle) <= u)
        stay = state["low"] >= state["high"]
        return F.struct(
            F.when(up, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(up | stay, state["high"]).otherwise(middle).alias("high"),
        )

    return F.aggregate(rounds, start, halve, lambda state: state["low"])


def _fraction(*parts):
    """A number in [0, 1) from a hash of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_sources(docs, weights=None, id_col="doc_id", text_col="text", source_col="source", total=None, seed=SEED):
    """row, doc_id, source, copy (from 0) and place for each copy, dealt out and ordered by place.

    `weights` is a DataFrame (source, weight) in any scale; without one, weights are tempered.
    `total` is the wanted size in characters; without one, that of the input.
    """
    rows = packed(docs, doc_id=id_col, source=source_col, text=text_col)
    sizes = source_sizes(rows)
    if weights is None:
        wanted = tempered(sizes)
    else:
        wanted = sizes.join(weights.select(F.col("source").alias("name"), "weight"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    wanted = saved(wanted.where("weight > 0"))  # one row for each source
    sums = wanted.agg(F.sum("weight").alias("weights"), F.sum("size").alias("all")).first()
    whole = float(total if total is not None else sums["all"] or 0)
    mean = F.col("weight") / F.lit(float(sums["weights"] or 1)) * whole / F.col("size")
    rates = saved(poisson_steps(wanted.select(F.col("source").alias("name"), mean.alias("mean"))))
    if (rates.agg(F.sum(F.size("steps"))).first()[0] or 0) <= BROADCAST_STEPS:
        rates = F.broadcast(rates)
    known = rows.drop("text").join(rates, F.col("source").eqNullSafe(F.col("name")))
    u = _fraction(F.col("doc_id"), F.lit(seed))
    found = _steps_up_to(F.col("steps"), u)
    count = F.when(found > 0, F.col("below") + found).otherwise(F.lit(0)).cast("int")
    copies = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    each = known.withColumn("copies", copies).select("row", "doc_id", "source", F.explode("copies").alias("copy"))
    each = each.withColumn("place", _fraction(F.col("doc_id"), F.col("copy"), F.lit(seed), F.lit("place")))
    return each.repartition("place").sortWithinPartitions("place")
