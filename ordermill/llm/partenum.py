"""Exact Jaccard self-join of word n-gram sets by PartEnum signatures.

Sizes are cut into bands [l, r] with r = floor(l / 0.85); linked sets are in the same band or in
adjacent ones, so a set takes part in the signatures of its own band and of the next. Two sets
of one band that link differ in at most k = floor(2r(1-t)/(1+t)) elements. The domain of element
hashes is cut into k + shared + slack ranges: then at least shared + slack ranges hold the same
elements in both sets. The hash of what a set holds in one range is a signature.

A range whose elements are all frequent in the corpus, such as those of a shared passage, would
meet many sets, and an empty one most of a band. So a set drops `slack` ranges: empty ones first,
then those whose rarest element is most frequent (equal numbers in the order of a hash of the
content). Frequencies are counted over all sets, in hash buckets. This loses no pair: both sets
order the shared + slack or more equal ranges in the same way, so each drops the first ones of
them, at most `slack`, and at least `shared` signatures are left that both have. Only pairs with
so many are verified; a passage in common seldom gives more than a few.

Equal sets are one node, known by a 64-bit hash and its size. Buckets of a signature are not
expanded into pairs. First a sketch of each node, its least signatures under `SKETCH` hashes, goes
into buckets: nodes with many signatures in common share some of these. In a few rounds each such
bucket names a pivot, the node with the least hash of the round, and each node is compared with
the pivots that it meets most often; links join nodes to components. Then the buckets of all
signatures that still hold several components compare nodes across components, all of them: first
with one node of `HEADS`, which joins most of a large group of near copies, then, when these links
are known, the other nodes. A pair is made in as many buckets as it must share, not in all. So
most links are found on a few numbers for each node, a bucket full of near copies costs a few
comparisons for each. Two nodes that are both in a bucket of the band above theirs are in the same
band, and meet in buckets of their own; so only there. Of the pairs that are left, only those are
made that can link by the marks of their sets, bits in which they may differ no more than in
elements; no other pair is dropped. There are at least `MARKS` bits for each element in which linked
sets may differ, so few pairs below the threshold pass, and sets of all sizes are told apart.

Signatures are 64-bit hashes of the elements: a collision adds a comparison, never a link, as
links are verified on the sets.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from ordermill.llm import bloom, words
from ordermill.llm.counts import bucket, bucket_counts
from ordermill.llm.frames import packed, reread, saved, ship
from ordermill.llm.links import components

U = words.U
BUCKET_BITS = 19
SKETCH = 8
ROUNDS = 3
PIVOTS = 2
MARKS = 16
HEADS = 32


class Threshold:
    """Jaccard similarity of at least `part` / `whole`, in whole numbers."""

    def __init__(self, part, whole=100):
        self.part, self.whole = part, whole
        self.bands = [1]

    def band(self, sizes):
        """The band of each size; `bands` has their smallest sizes, up to that of the next band but one."""
        while len(self.bands) < 3 or self.bands[-3] <= sizes.max(initial=1):
            self.bands.append(self.bands[-1] * self.whole // self.part + 1)
        starts = np.array(self.bands)
        return np.searchsorted(starts, sizes, side="right") - 1

    def most_different(self, bands):
        """How many elements two linked sets of a band (or of it and the one below) may differ in."""
        largest = np.array(self.bands) * self.whole // self.part
        return (2 * largest * (self.whole - self.part) // (self.whole + self.part))[bands]


def _sets(column, size):
    """For blocks of texts the sorted distinct hashes of their word n-grams, and how many each has."""
    data, places = words.text_bytes(column)
    for first, last in words.blocks(places):
        begin, end = places[first], places[last]
        _, _, hashes, cuts = words.hash_words(data[begin:end], places[first : last + 1] - begin, lower=True)
        counts = np.diff(cuts)
        short = np.flatnonzero((counts > 0) & (counts < size))
        grams = words.windows(hashes, size)
        grams = np.concatenate((grams, np.zeros(len(hashes) - len(grams), dtype=U)))
        for row in short:
            grams[cuts[row]] = words.windows(hashes[cuts[row] : cuts[row + 1]], counts[row])[0]
        held = np.where(counts < size, np.minimum(counts, 1), counts - size + 1)
        for at, n in zip(cuts[:-1].tolist(), held.tolist(), strict=True):
            grams[at : at + n].sort()
        rows = np.repeat(np.arange(last - first), held)
        grams = grams[np.arange(held.sum()) + np.repeat(cuts[:-1] - np.cumsum(held) + held, held)]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        yield grams[new], np.bincount(rows[new], minlength=last - first)


def marks(elements, counts):
    """128 bits of each set, in two numbers: whether the elements that fall on a bit are odd in number.

    Two sets differ in at least as many elements as their marks differ in bits.
    """
    some = np.flatnonzero(counts)
    at = words.mix(elements) & U(127)
    found = []
    for part in (0, 1):
        bits = np.where(at >> U(6) == U(part), U(1) << (at & U(63)), U(0))
        one = np.zeros(len(counts), dtype=U)
        if len(some):
            one[some] = np.bitwise_xor.reduceat(bits, (np.cumsum(counts) - counts)[some])
        found.append(one.view(np.int64))
    return found


def wide_marks(elements, counts, most):
    """As `marks`, a list of numbers for each set: at least `MARKS` bits for each of the `most` elements in which it may differ."""
    longs = 1 << np.ceil(np.log2(np.maximum(1, MARKS * most / 64))).astype(np.int64)
    cuts = np.concatenate(([0], np.cumsum(longs)))
    at = words.mix(elements) & np.repeat((64 * longs - 1).astype(U), counts)
    found = np.zeros(cuts[-1], dtype=U)
    np.bitwise_xor.at(found, np.repeat(cuts[:-1], counts) + (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found.view(np.int64)))


def _nodes(elements, counts):
    """A hash of each whole set; null for an empty one."""
    some = np.flatnonzero(counts)
    found = np.zeros(len(counts), dtype=U)
    if len(some):
        found[some] = np.add.reduceat(elements, (np.cumsum(counts) - counts)[some])
    return pa.array(words.mix(found + words.mix(counts.astype(U))).view(np.int64), mask=counts == 0)


def shared_signatures(most):
    """How many signatures two sets have in common if they differ in at most so many elements."""
    return 1 + most // 16


def _signatures(elements, counts, threshold, step, frequency):
    """Signatures of all sets for their own band (step 0) or the next (1), and the set of each."""
    bands = threshold.band(counts) + step
    bands = np.maximum(bands, 0)
    most = threshold.most_different(bands)
    most[counts == 0] = 0  # where nothing may differ, linked sets are equal and one node
    slack = 1 + most // 4
    ranges = np.where(most > 0, most + shared_signatures(most) + slack, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    taken = most[rows] > 0
    rows, elements = rows[taken], elements[taken]
    if not len(rows):
        return np.zeros(0, dtype=U), rows
    at = ((elements >> U(11)).astype(np.float64) * (ranges[rows] / 2.0**53)).astype(np.int64)
    cuts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(rows, prepend=-1) != 0))
    held = words.mix(np.add.reduceat(elements, cuts))
    rarest = np.minimum.reduceat(frequency[bucket(elements, BUCKET_BITS)], cuts)
    rows, at = rows[cuts], at[cuts]
    empty = ranges - np.bincount(rows, minlength=len(counts))
    signatures = words.mix(held + words.mix(at.astype(U) + (bands[rows].astype(U) << U(40))))
    order = np.lexsort((held, -rarest, rows))
    rank = np.arange(len(order)) - np.searchsorted(rows, rows[order])  # most frequent first, within each set
    kept = order[rank >= np.maximum(0, slack - empty)[rows[order]]]
    found = [signatures[kept]], [rows[kept]]
    for row in np.flatnonzero(empty > slack):  # more empty ranges than may be dropped: they are signatures too
        left = np.setdiff1d(np.arange(ranges[row]), at[rows == row])
        found[0].append(words.mix(~words.mix(left.astype(U) + (U(bands[row]) << U(40)))))
        found[1].append(np.full(len(left), row))
    return np.concatenate(found[0]), np.concatenate(found[1])


def _first_of_each(elements, counts, nodes):
    """Without the sets of a block that another one before equals."""
    _, first = np.unique(nodes.to_numpy(zero_copy_only=False), return_index=True)
    kept = np.zeros(len(counts), dtype=bool)
    kept[first] = True
    return elements[np.repeat(kept, counts)], counts[kept], nodes.filter(pa.array(kept))


def _described(batches, size):
    for batch in batches:
        sets = [(_nodes(elements, counts), counts) for elements, counts in _sets(batch.column("text"), size)]
        nodes = pa.concat_arrays([x for x, _ in sets]) if sets else pa.array([], pa.int64())
        sizes = np.concatenate([x for _, x in sets]) if sets else np.zeros(0)
        columns = [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), nodes]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "node"])


def _elements(batches, size):
    for batch in batches:
        for elements, _ in _sets(batch.column("text"), size):
            yield elements


def _signed(batches, size, threshold, shared):
    for batch in batches:
        for elements, counts in _sets(batch.column("text"), size):
            nodes = _nodes(elements, counts)
            elements, counts, nodes = _first_of_each(elements, counts, nodes)
            for step in (0, 1):
                signatures, rows = _signatures(elements, counts, threshold, step, shared.value)
                columns = [pa.array(signatures.view(np.int64)), nodes.take(pa.array(rows)), pa.array(np.full(len(rows), step == 0))]
                yield pa.RecordBatch.from_arrays(columns, ["signature", "node", "own"])


def _with_sets(batches, size, threshold):
    for batch in batches:
        for elements, counts in _sets(batch.column("text"), size):
            cuts = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(elements.view(np.int64)))
            band = threshold.band(counts)
            marked = [*map(pa.array, marks(elements, counts))]
            marked += [wide_marks(elements, counts, threshold.most_different(np.maximum(0, band + step))) for step in (0, 1)]
            names = ["node", "elements", "low", "high", "own_marks", "next_marks"]
            yield pa.RecordBatch.from_arrays([_nodes(elements, counts), lists, *marked], names)


def _shared_signatures(texts, size, threshold):
    """(signature, node, own): the nodes under each signature that occurs at least twice, and in its own band at least once."""
    frequency = bucket_counts(texts, lambda b: _elements(b, size), BUCKET_BITS)
    shared = texts.sparkSession.sparkContext.broadcast(frequency)
    entries = texts.mapInArrow(lambda b: _signed(b, size, threshold, shared), "signature long, node long, own boolean")
    met = entries.groupBy("signature").agg(F.count("*").alias("count"), F.max("own").alias("own"))
    common = reread(met.where("count > 1 AND own").select("signature"))
    # Only entries that may have a signature in common are shuffled with their nodes.
    maybe = bloom.of_keys(common, "signature", common.count()).tested(entries, "signature", "maybe").where("maybe")
    return reread(maybe.select("signature", "node", "own").join(common, "signature").distinct())


def _sketch(members):
    """(signature, node): a few hashes of each node, the least ones of its signatures."""
    hashed = [F.min(F.xxhash64("signature", F.lit(k))).alias(f"s{k}") for k in range(SKETCH)]
    least = members.groupBy("node").agg(*hashed)
    return reread(least.select(F.explode(F.array(*[f"s{k}" for k in range(SKETCH)])).alias("signature"), "node"))


def _node_sets(rows, described, nodes, size, threshold):
    """(node, elements, marks, n) for the given nodes, from one text of each."""
    chosen = described.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    chosen = reread(chosen.select("key").distinct())
    maybe = bloom.of_keys(chosen, "key", chosen.count()).tested(rows.select("key", "text"), "key", "maybe")
    texts = maybe.where("maybe").join(chosen, "key", "left_semi").select("text")
    schema = "node long, elements array<long>, low long, high long, own_marks array<long>, next_marks array<long>"
    sets = texts.mapInArrow(lambda b: _with_sets(b, size, threshold), schema)
    return reread(sets.dropDuplicates(["node"]).withColumn("n", F.size("elements")))


def fits(a, b, threshold):
    """Whether sets of these sizes can link at all: the smaller one must make up enough of the larger."""
    return F.least(a, b).cast("long") * threshold.whole >= F.greatest(a, b).cast("long") * threshold.part


def near(a, b, *marked, threshold):
    """Whether sets of these sizes may link by their marks, given as pairs of numbers."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in marked), F.lit(0))
    return differ.cast("long") * (threshold.whole + threshold.part) <= (a + b).cast("long") * (threshold.whole - threshold.part)


def all_near(a, b, left, right, threshold):
    """As `near`, by marks given as two lists of the same length."""
    differ = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return differ.cast("long") * (threshold.whole + threshold.part) <= (a + b).cast("long") * (threshold.whole - threshold.part)


def _wanted(n, threshold):
    """How many signatures linked sets must have in common if the larger one has n elements."""
    # The least number that may differ in a band of the larger set: a bound from below.
    most = F.floor(2 * n.cast("long") * (threshold.whole - threshold.part) / (threshold.whole + threshold.part))
    return (1 + F.floor(most / 16)).cast("int")


def _often_enough(pairs, threshold):
    """Pairs (a, b) of sizes n, m that have as many signatures in common as linked sets of these sizes must have."""
    counted = pairs.groupBy("a", "b", "n", "m").count()
    return counted.where(F.col("count") >= _wanted(F.greatest("m", "n"), threshold)).select("a", "b")


def verified(pairs, sets, threshold):
    """The pairs (a, b) of nodes whose sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"), F.col("n").alias("m"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"), "n")
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("left", "right")).cast("long")
    links = threshold.whole * shared >= threshold.part * (F.col("m") + F.col("n") - shared)
    return both.where(fits(F.col("m"), F.col("n"), threshold)).where(links).select("a", "b")


def _mixed(members, labels, salt):
    """Members with component and pivot, without the buckets that are all in one component."""
    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = known.withColumn("rank", F.xxhash64("node", F.lit(salt)))
    ends = known.groupBy("signature").agg(
        F.min("label").alias("least"), F.max("label").alias("greatest"), F.min("rank").alias("pivot")
    )
    return reread(known.join(reread(ends.where("least < greatest")), "signature"))


def _stars(mixed):
    """Pairs (a, b): b and each of the few pivots of other components that it meets most often."""
    heads = mixed.where("rank = pivot").select("signature", F.col("node").alias("a"), F.col("label").alias("other"))
    met = mixed.join(heads, "signature").where("label <> other").groupBy("a", F.col("node").alias("b")).count()
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))
    return met.withColumn("place", place).where(F.col("place") <= PIVOTS).select("a", "b")


def _is_head(node):
    return F.pmod(F.col(node), F.lit(HEADS)) == 0


def _across(mixed, sizes, heads, threshold):
    """Pairs (a, b) of different components that may link: with `heads` those that hold a head, else all of `mixed`."""
    own_or_next = F.when(F.col("own"), F.col("own_marks")).otherwise(F.col("next_marks")).alias("marks")
    # The least signatures of each node: pairs need not be made again in a bucket if they share enough lesser ones.
    lists = mixed.groupBy("node", "own").agg(F.sort_array(F.collect_list("signature")).alias("least_ones"))
    lists = lists.join(sizes, "node").withColumn("least_ones", F.slice("least_ones", 1, 4 * _wanted(F.col("n"), threshold)))
    lists = reread(lists.select("node", "own", "n", "low", "high", own_or_next, "least_ones"))
    left = reread(mixed.select("signature", "node", "label", "own").join(lists, ["node", "own"]))
    others = {"node": "b", "label": "other", "own": "other_own", "n": "m", "low": "other_low", "high": "other_high"}
    others |= {"marks": "other_marks", "least_ones": "other_ones"}
    first = (left.where(_is_head("node")) if heads else left).withColumnRenamed("node", "a")
    across = first.join(left.withColumnsRenamed(others), "signature").where("own OR other_own")
    # Each bucket that such a pair shares holds several components, so enough of them are counted here.
    once = F.col("label") < F.col("other")
    across = across.where(once | ((F.col("label") > F.col("other")) & ~_is_head("b")) if heads else once)
    across = across.where(fits(F.col("n"), F.col("m"), threshold))
    marked = [(F.col("low"), F.col("other_low")), (F.col("high"), F.col("other_high"))]
    across = across.where(near(F.col("n"), F.col("m"), *marked, threshold=threshold))
    across = across.where(all_near(F.col("n"), F.col("m"), F.col("marks"), F.col("other_marks"), threshold))
    lesser = F.filter(F.array_intersect("least_ones", "other_ones"), lambda x: x < F.col("signature"))
    across = across.where(F.size(lesser) < _wanted(F.greatest("m", "n"), threshold))
    return _often_enough(across.select("a", "b", "n", "m"), threshold)


def _node_labels(rows, described, size, threshold):
    """(node, label) of every node that links to another one."""
    members = _shared_signatures(rows.select("text"), size, threshold)
    sets = _node_sets(rows, described, members.select("node").distinct(), size, threshold)
    sizes, sketch = sets.drop("elements"), _sketch(members)
    links, labels = None, sets.select("node", F.col("node").alias("label")).limit(0)
    for salt in range(ROUNDS):
        stars = verified(_stars(_mixed(sketch, labels, salt)), sets, threshold)
        links = reread(stars if links is None else links.unionByName(stars))
        labels = components(links)
    for heads in (True, False):
        taken = members if heads else members.where(~_is_head("node"))
        pairs = _across(_mixed(taken, labels, ROUNDS), sizes, heads, threshold)
        links = reread(links.unionByName(verified(pairs, sets, threshold)))
        labels = components(links)
    return labels


def jaccard_components(docs, id_col="doc_id", text_col="text", size=4, threshold=85):
    """doc_id, key, n_shingles, component_id for each document; key is a hash of id and text.

    Two documents link when their sets of distinct word n-grams have a Jaccard similarity of at
    least `threshold` hundredths; component_id is the smallest doc_id reachable by links.

    Defined results: a text with fewer than `size` words is one element, its whole word sequence;
    null and wordless texts have an empty set and link with nothing, so component_id is doc_id;
    repeated rows link with each other; null ids take no part in the smallest id; an empty table
    gives an empty result; other columns are ignored.
    """
    known = _labelled(docs, id_col, text_col, size, threshold)
    # Saved, so that the join deals out both sides itself and can split a large group.
    first = saved(known.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("first")))
    return known.join(first, "label", "left").select(
        "doc_id", "key", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id")
    )


def _labelled(docs, id_col, text_col, size, threshold):
    """doc_id, key, n_shingles, label of each document; label names its component, null without one."""
    ship(docs.sparkSession)
    limits = Threshold(threshold)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = packed(docs, doc_id=id_col, key=key, text=text_col).drop("row")
    described = rows.select("doc_id", "key", "text").mapInArrow(
        lambda b: _described(b, size),
        f"doc_id {dict(docs.dtypes)[id_col]}, key long, n_shingles long, node long",
    )
    described = saved(described)
    labels = _node_labels(rows, described, size, limits)
    return described.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def one_of_each(docs, id_col="doc_id", text_col="text", size=4, threshold=85):
    """The input rows of one document of each group; rows that repeat id and text are one document.

    It is the one with the smallest doc_id, null last, and of these with the smallest key, so one
    stays where ids are null or repeat over different texts.
    """
    known = _labelled(docs, id_col, text_col, size, threshold).where("label IS NOT NULL")
    known = saved(known.select("label", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key").alias("document")))
    first = saved(known.groupBy("label").agg(F.min("document").alias("first")))
    gone = known.join(first, "label").where(F.col("document.key") != F.col("first.key"))
    gone = saved(gone.select(F.col("document.key").alias("key")).distinct())
    rows = packed(docs, key=F.xxhash64(F.col(id_col), F.col(text_col)))
    return bloom.without(rows, "key", gone).select("row.*")
