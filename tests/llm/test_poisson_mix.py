"""Poisson mixing: counts by the inverse distribution, shares near the weights, defined results."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ordermill.llm.poisson_mix import mix_sources, poisson_steps


def fraction(*parts):
    text = "|".join("null" if p is None else str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def inverse(mean, u):
    k, term = 0, math.exp(-mean)
    total = term
    while total <= u:
        k += 1
        term *= mean / k
        total += term
    return k


def test_counts_are_the_inverse_distribution(spark):
    rows = [(k, "ab" * (1 + k % 3), f"s{k % 5 if k % 3 else 0}") for k in range(900)] + [(None, "abc", None), (7, "abc", "s1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 5.0), ("s2", 0.0), (None, 2.0), ("gone", 3.0)], "source string, weight double")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text)
    taken = {"s0": 1.0, "s1": 5.0, None: 2.0}
    whole = sum(sizes[k] for k in taken)
    wanted = []
    for i, _, source in rows:
        if source in taken:
            mean = taken[source] / 8 * whole / sizes[source]
            wanted += [(str(i), str(source), c) for c in range(inverse(mean, fraction(i, 20)))]
    found = mix_sources(frame, weights).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["copy"]) for r in found) == sorted(wanted)
    assert {(r["doc_id"], r["copy"], r["place"]) for r in found} == {(r["doc_id"], r["copy"], fraction(r["doc_id"], r["copy"], 20, "place")) for r in found}


def test_shares_follow_the_weights(spark):
    frame = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    mixed = {r["source"]: r["count"] for r in mix_sources(frame).groupBy("source").count().collect()}
    sizes = {r["source"]: r["count"] for r in frame.groupBy("source").count().collect()}
    scale = sum(sizes.values()) / sum(math.sqrt(n) for n in sizes.values())
    for source, n in sizes.items():
        wanted = math.sqrt(n) * scale
        assert abs(mixed[source] - wanted) < 5 * math.sqrt(wanted)


@pytest.mark.parametrize("mean", [0.001, 1.0, 30.0, 200.0, 2000.0, 1e6])
def test_distribution_function(spark, mean):
    found = poisson_steps(spark.createDataFrame([("s", mean), (None, mean / 2)], "name string, mean double"))
    found = {r["name"]: r for r in found.collect()}["s"]
    steps, below = found["steps"], found["below"]
    assert abs(steps[-1] - 1) < 1e-9 and all(a <= b for a, b in zip(steps, steps[1:], strict=False))
    assert steps[0] < 1e-12 or below == 0
    middle = int(mean)
    exact = sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(below, middle + 1))
    assert abs(steps[middle - below] - exact) < 1e-9


def test_a_mean_of_a_million(spark):
    """A source of one character beside one of a million."""
    rows = [(1, "x", "tiny"), (2, "y" * 1_000_000, "large")]
    weights = spark.createDataFrame([("tiny", 1.0), ("large", 1e-9)], "source string, weight double")
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["source"]: r["count"] for r in mix_sources(frame, weights).groupBy("source").count().collect()}
    mean, u = 1_000_001 / (1 + 1e-9), fraction(1, 20)
    assert abs(found["tiny"] - mean) < 6 * math.sqrt(mean)
    around = range(int(mean) - 8000, found["tiny"] + 1)
    terms = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in around]
    assert sum(terms[:-1]) - 1e-6 <= u <= sum(terms) + 1e-6


def test_defined_results(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "text", None), (4, "t" * 2_000_000, "b"), (4, "t", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"COPY": F.lit(1), "steps": F.lit(2)})
    found = mix_sources(frame, total=40_000_000).select("row.*", F.col("copy").alias("n")).collect()
    assert {r["source"] for r in found} == {None, "b"}
    by_row = [sum(len(r["text"]) == n for r in found) for n in (2_000_000, 1)]
    assert by_row[0] == by_row[1] > 0
    assert mix_sources(frame.limit(0)).collect() == []
    plan = mix_sources(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
