"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, ordered by rarity: by how often words of the same hash
bucket occur in the corpus (a table of fixed size), then by hash. Two lines of n tokens with a
Jaccard similarity of at least 0.8 share one of their n - ceil(0.8 n) + 1 first tokens, so only
these are joined. The length filter drops pairs whose sizes alone rule a match out, the position
filter those with too few tokens left after the shared one, 128 marked bits of each set those that
differ in too many tokens; the rest are verified on the sets. A line goes when it matches an earlier line, whether that one stays or not; order is by doc_id, then
by place in the document.

Lines with equal sets, by a 64-bit hash, are one node, and nodes are numbered in the order of their
first lines. For each token the earliest node is compared with the others first; only nodes that
this leaves unmatched are compared with all earlier nodes that share a token, the earliest of which
they have met. So a frequent token or a group of thousands of near copies does not bring all its
pairs. Sets are cut from the first line of each node alone, and move only where a pair names them.
No token, node or pair is dropped.

Defined results: lines end at line feeds; a line without words is never compared and stays; null
and empty texts have one empty line; a null id comes after all others; rows that repeat an id and
text are one document and keep the same lines; an empty table gives an empty result;
other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ordermill.llm import bloom, words
from ordermill.llm.counts import bucket, bucket_counts
from ordermill.llm.frames import packed, reread, ship
from ordermill.llm.partenum import Threshold, fits, marks, near, verified

U = words.U
BUCKET_BITS = 18
THRESHOLD = 80


def _line_words(column):
    """For blocks of texts: first row, hashes of the words of all lines, the line of each word,
    and for each line its row and its number in the text."""
    data, places = words.text_bytes(column)
    for first, last in words.blocks(places):
        begin, end = places[first], places[last]
        feeds = np.flatnonzero(data[begin:end] == 10) + 1
        starts = places[first:last] - begin
        row = np.concatenate((np.arange(last - first), np.searchsorted(starts, feeds - 1, side="right") - 1))
        at = np.concatenate((starts, feeds))
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        _, _, hashes, cuts = words.hash_words(data[begin:end], np.append(at, end - begin))
        yield first + row, number, hashes, np.diff(cuts)


def rarity_order(counts):
    """For each bucket its place among all, rarest first, as the high bits of a hash."""
    places = np.empty(len(counts), dtype=U)
    places[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=U)
    return places << U(64 - BUCKET_BITS)


def _line_sets(column, order):
    """As above, with the distinct words of each line, rarest first.

    A word's hash has its bucket's place in the order instead of the bucket, so that the order of
    the numbers is the order of rarity.
    """
    low = U((1 << (64 - BUCKET_BITS)) - 1)
    for row, number, hashes, sizes in _line_words(column):
        tokens = order[bucket(hashes, BUCKET_BITS)] | (hashes & low)
        ends = np.cumsum(sizes)
        for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            tokens[begin:end].sort()
        line = np.repeat(np.arange(len(sizes)), sizes)
        new = np.ones(len(line), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (line[1:] != line[:-1])
        yield row, number, tokens[new], np.bincount(line[new], minlength=len(sizes))


def _nodes(tokens, sizes):
    some = np.flatnonzero(sizes)
    sums = np.zeros(len(sizes), dtype=U)
    if len(some):
        sums[some] = np.add.reduceat(words.mix(tokens), (np.cumsum(sizes) - sizes)[some])
    return words.mix(sums + words.mix(sizes.astype(U))).view(np.int64)


def _word_hashes(batches):
    for batch in batches:
        for _, _, hashes, _ in _line_words(batch.column("text")):
            yield hashes


def _lines(batches, shared):
    for batch in batches:
        for row, number, tokens, sizes in _line_sets(batch.column("text"), shared.value):
            columns = [batch.column("doc_id").take(pa.array(row)), batch.column("key").take(pa.array(row))]
            columns += [pa.array(number.astype(np.int32)), pa.array(_nodes(tokens, sizes), mask=sizes == 0)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "line", "node"])


def _first_sets(batches, shared, threshold):
    """Node, set, size, marks and length of the prefix of each line that `wanted` names with its node."""
    for batch in batches:
        wanted = [{x["line"]: x["node"] for x in found} for found in batch.column("wanted").to_pylist()]
        for row, number, tokens, sizes in _line_sets(batch.column("text"), shared.value):
            found = [wanted[r].get(k) for r, k in zip(row.tolist(), number.tolist(), strict=True)]
            at = np.flatnonzero([x is not None for x in found])
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            lists = pa.array([tokens[cuts[k] : cuts[k + 1]].view(np.int64) for k in at], pa.list_(pa.int64()))
            n = sizes[at]
            prefix = n - -(-n * threshold.part // threshold.whole) + 1
            columns = [pa.array([found[k] for k in at], pa.int64()), lists, pa.array(n.astype(np.int32)), pa.array(prefix.astype(np.int32))]
            columns += [pa.array(x[at]) for x in marks(tokens, sizes)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "elements", "n", "prefix", "low", "high"])


def _able(member, other, threshold):
    """Whether two lines that share a token can match, by their sizes, the token's positions and their marks.

    They can still share the tokens before it at most, and those from it on; and they differ in as
    many tokens at least as their marks differ in bits.
    """
    n, position, low, high = (F.col(f"{member}{c}") for c in ("n", "position", "low", "high"))
    other_n, other_position, other_low, other_high = (F.col(f"{other}{c}") for c in ("n", "position", "low", "high"))
    left = F.least(position, other_position) + F.least(n - position, other_n - other_position)
    both = (n + other_n).cast("long")
    able = left.cast("long") * (threshold.whole + threshold.part) >= both * threshold.part
    marked = near(n, other_n, (low, other_low), (high, other_high), threshold=threshold)
    return fits(n, other_n, threshold) & able & marked


def _matched(pairs, sets, threshold):
    """The later node of each pair (a, b) whose sets match; only sets that a pair names are moved."""
    pairs = reread(pairs.distinct())
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    named = named.distinct().select(F.xxhash64("node").alias("name"))
    tested = bloom.of_keys(named, "name", 2 * pairs.count()).tested(sets.withColumn("name", F.xxhash64("node")), "name", "maybe")
    return verified(pairs, tested.where("maybe").select("node", "elements", "n"), threshold).select(F.col("b").alias("node")).distinct()


def _late_nodes(rows, firsts, shared, threshold):
    """Nodes whose first line matches an earlier line of another node."""
    chosen = firsts.groupBy("first.key").agg(F.collect_list(F.struct("first.line", "node")).alias("wanted"))
    chosen = reread(chosen)
    texts = bloom.of_keys(chosen, "key", chosen.count()).tested(rows.select("key", "text"), "key", "maybe").where("maybe")
    texts = texts.join(chosen, "key").dropDuplicates(["key"]).select("text", "wanted")
    schema = "node long, elements array<long>, n int, prefix int, low long, high long"
    sets = reread(texts.mapInArrow(lambda b: _first_sets(b, shared, threshold), schema))

    prefix = F.posexplode(F.slice("elements", 1, F.col("prefix"))).alias("position", "token")
    entries = sets.select("node", "n", "low", "high", prefix)
    common = entries.groupBy("token").agg(F.count("*").alias("count"), F.min("node").alias("head"))
    common = reread(common.where("count > 1"))
    maybe = bloom.of_keys(common, "token", common.count()).tested(entries, "token", "maybe").where("maybe").drop("maybe")
    members = reread(maybe.join(common, "token"))

    others = members.where("node <> head").drop("head")
    heads = members.where("node = head").select("token", *[F.col(c).alias("a_" + c) for c in ("node", "n", "position", "low", "high")])
    stars = heads.join(others, "token").where(_able("", "a_", threshold))
    late = reread(_matched(stars.select(F.col("a_node").alias("a"), F.col("node").alias("b")), sets, threshold))
    # The earliest node of a token has met all others; only tokens of more nodes bring more pairs.
    others = others.where("count > 2").drop("count").withColumn("name", F.xxhash64("node"))
    open_ = bloom.without(others, "name", late.select(F.xxhash64("node").alias("name"))).drop("name")
    open_ = open_.select(*[F.col(c).alias("b_" + c) for c in open_.columns])
    pairs = others.join(open_, F.col("token") == F.col("b_token")).where("node < b_node")
    pairs = pairs.where(_able("", "b_", threshold))
    pairs = pairs.select(F.col("node").alias("a"), F.col("b_node").alias("b"))
    return late.unionByName(_matched(pairs, sets, threshold)).distinct()


def _kept(batches):
    for batch in batches:
        totals, removed, digests = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines, gone = (text or "").split("\n"), set(gone or ())
            kept = [x for k, x in enumerate(lines) if k not in gone]
            totals.append(len(lines))
            removed.append(len(lines) - len(kept))
            digests.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        columns = [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_removed", "kept_sha256"])


def drop_similar_lines(docs, id_col="doc_id", text_col="text", threshold=THRESHOLD):
    """doc_id, n_lines, n_removed and kept_sha256 (of the kept lines, joined by line feeds) of each document."""
    spark = docs.sparkSession
    ship(spark)
    limits = Threshold(threshold)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = packed(docs, doc_id=id_col, text=text_col, key=key).drop("row")
    order = rarity_order(bucket_counts(rows.select("text"), _word_hashes, BUCKET_BITS))
    shared = spark.sparkContext.broadcast(order)
    kind = dict(docs.dtypes)[id_col]
    lines = rows.mapInArrow(lambda b: _lines(b, shared), f"doc_id {kind}, key long, line int, node long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line")
    lines = reread(lines.where("node IS NOT NULL").withColumnRenamed("node", "content")).withColumn("first", place)
    firsts = lines.groupBy("content").agg(F.min("first").alias("first"))
    firsts = reread(firsts.orderBy("first").withColumn("node", F.monotonically_increasing_id()))
    late = _late_nodes(rows, firsts, shared, limits).withColumn("late", F.lit(True))
    state = firsts.join(late, "node", "left").select("content", F.col("first").alias("head"), "late")
    gone = lines.join(reread(state), "content").where("late OR first <> head")
    gone = reread(gone.groupBy("key").agg(F.collect_list("line").alias("gone")))  # no more than a text has lines
    tested = bloom.of_keys(gone, "key", gone.count()).tested(rows, "key", "maybe")
    straight = tested.where("NOT maybe").withColumn("gone", F.lit(None).cast("array<int>"))
    joined = tested.where("maybe").join(gone, "key", "left")
    schema = f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string"
    both = [x.select("doc_id", "text", "gone").mapInArrow(_kept, schema) for x in (straight, joined)]
    return both[0].unionByName(both[1])
