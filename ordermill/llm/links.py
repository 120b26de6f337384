"""Connected components of links between nodes."""

import pyarrow as pa
from pyspark.sql import functions as F

from ordermill.llm.frames import reread, ship

TASK_LINKS = 500_000


def components(links, task_links=TASK_LINKS):
    """(node, label) for every node of `links` (a, b): label is the smallest node it reaches.

    Each task first joins up to `task_links` links into trees of depth one. Rounds of joins follow
    until one changes nothing: each points every node to the smallest node near it, first from the larger neighbours, then from the smaller ones, so
    that each component shrinks to a star; the number of rounds grows with the logarithm of the
    longest chain. A round sums per node before it shuffles, saves the sums in the shared folder
    and joins them back, so that a component with a third of all nodes is in no single task.
    """
    ship(links.sparkSession)
    edges = reread(links.select("a", "b").where("a <> b"))
    tasks = max(1, -(-edges.count() // task_links))
    return _labels(_joined(edges.coalesce(tasks).mapInArrow(_stars, "a long, b long")))


def _stars(batches):
    """Links of one task as (node, smallest node that it reaches)."""
    root = {}

    def top(node):
        path = []
        while (above := root.setdefault(node, node)) != node:
            path.append(node)
            node = above
        for k in path:
            root[k] = node
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    found = [(node, top(node)) for node in list(root)]
    found = [x for x in found if x[0] != x[1]]
    columns = list(zip(*found, strict=True)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _joined(stars):
    edges = reread(stars.distinct())
    before = _sums(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = reread(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = reread(large)
        small = reread(large.groupBy("a").agg(F.min("b").alias("m")))
        pointed = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = reread(pointed.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        after = _sums(edges)
        if after == before:
            return edges
        before = after


def _labels(stars):
    """A star's nodes and its centre, each with its label."""
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)


def _sums(edges):
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(mixed.bitwiseAND((1 << 31) - 1))).first())
