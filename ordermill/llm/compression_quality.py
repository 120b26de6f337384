"""Quality classifier by compression.

Two zstandard dictionaries are built, one from labelled good and one from labelled bad texts. A
text is compressed with both, in pieces of `PIECE` bytes, so that a long text cannot serve as its
own dictionary. The difference of the two sizes, divided by the larger, tells which side a text
resembles. A logistic curve over that difference and over the logarithm of the compressed share
(a text that only repeats itself fits both dictionaries alike) turns it into a chance of label 1;
the curve is fitted on labelled rows that the dictionaries have not seen.

Bounds of the fit, which are its parameters: the first `dictionary_rows` labelled rows of each
label in the order of a hash of the id, of these the texts up to `MOST_BYTES`, and `curve_rows`
other ones for the curve. One dictionary is built in one task from its label's rows. The driver gets
the dictionaries, two numbers for each row of the curve, and counts. Whole texts of any length are
scored, a piece at a time.

Defined results: a null text counts as empty and gets the curve at difference 0; labels other than 0 and 1
count as none, and an id with both counts for both; without labelled rows of both kinds every text gets
(good + 1) / (good + bad + 2) over the labelled rows; of rows that repeat an id the greatest text is learned from;
a null id is never learned from; an empty table gives an empty result; other columns are carried along.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from ordermill.llm import words
from ordermill.llm.frames import packed, reread, ship

PIECE = 512
LEVEL = 3
DICTIONARY_BYTES = 112_640
MOST_BYTES = 1 << 16
BAD, GOOD = 0, 1
RIDGE = 1e-3


def pieces(view):
    """The pieces of a text; an empty one has one empty piece."""
    return [view[at : at + PIECE] for at in range(0, len(view), PIECE)] or [view]


def build_dictionary(texts):
    """A dictionary from texts; where they are too few to train one, their own bytes are the dictionary."""
    samples = [p for text in texts for p in pieces(text)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of texts with each of two dictionaries."""

    def __init__(self, dictionaries):
        self.dictionaries = dictionaries
        self._tools = None

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.__init__(state)

    def _compressors(self):
        if self._tools is None:
            plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            known = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries]
            self._tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **plain) for d in known]
            self._frame = min(len(tool.compress(b"")) for tool in self._tools)  # bytes that carry no content
        return self._tools

    def measure(self, column):
        """For each text the normalised difference, positive if nearer to good, and the log of the compressed share."""
        bad, good = self._compressors()
        data, places = words.text_bytes(column)
        view = memoryview(data)
        out = np.empty((len(places) - 1, 2))
        for k in range(len(out)):
            cut = pieces(view[places[k] : places[k + 1]])
            frames = self._frame * len(cut)
            a = max(1, sum(len(bad.compress(p)) for p in cut) - frames)
            b = max(1, sum(len(good.compress(p)) for p in cut) - frames)
            size = int(places[k + 1] - places[k])
            out[k] = (a - b) / max(a, b), np.log((a + b + 2) / (2 * size + 8))
        return out


def fit_curve(measures, labels, rounds=50):
    """Weights of a logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack((measures, np.ones(len(measures))))
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        chance = curve(measures, weights)
        slope = x.T @ (labels - chance) - RIDGE * weights
        bend = (x * (chance * (1 - chance))[:, None]).T @ x + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def curve(measures, weights):
    at = measures @ weights[:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


class Model:
    """Score of a text: the curve over its measures, or one chance for all."""

    def __init__(self, sizes=None, weights=None, chance=0.5):
        self.sizes, self.weights, self.chance = sizes, weights, chance

    def score(self, column):
        if self.sizes is None:
            return np.full(len(column), self.chance)
        return curve(self.sizes.measure(column), self.weights)


def _learnable(frame, id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def _sampled(labels, dictionary_rows, curve_rows):
    """Ids with label and part: a bounded number of rows, whatever the number of labels."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.where(_learnable(known, "doc_id") & F.col("quality").isin(BAD, GOOD)).distinct()
    key = F.col("doc_id").cast("string")
    known = known.withColumns({"place": F.xxhash64(key, F.lit("quality")), "side": F.xxhash64(key, F.lit("side")) % 2})
    first = lambda frame, n: frame.orderBy("place", "doc_id", "quality").limit(n)
    parts = [
        first(known.where((F.col("side") == 0) & (F.col("quality") == q)), dictionary_rows).withColumn("part", F.lit(q))
        for q in (BAD, GOOD)
    ]
    parts.append(first(known.where(F.col("side") != 0), curve_rows).withColumn("part", F.lit(2)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "quality", "part")


def _dictionary(table: pa.Table) -> pa.Table:
    texts = sorted(x for x in table.column("text").cast(pa.large_binary()).to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "dictionary": pa.array([build_dictionary(texts)], pa.binary())})


def fit(docs, labels, dictionary_rows=1000, curve_rows=4000):
    """A model from `docs` (doc_id, text) and `labels` (doc_id, quality)."""
    spark = docs.sparkSession
    ship(spark)
    sample = _sampled(labels, dictionary_rows, curve_rows)  # at most 2 * dictionary_rows + curve_rows rows
    texts = docs.where(_learnable(docs, "doc_id")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "quality", "part").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    texts = reread(texts)
    seen = {r["quality"]: r["n"] for r in texts.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    short = texts.where((F.col("part") != 2) & (F.octet_length("text") <= MOST_BYTES)).select("part", "text")
    built = short.groupBy("part").applyInArrow(_dictionary, "part int, dictionary binary").collect()
    built = {r["part"]: bytes(r["dictionary"]) for r in built}
    good, bad = seen.get(GOOD, 0), seen.get(BAD, 0)
    if len(built) < 2:
        return Model(chance=(good + 1) / (good + bad + 2))
    sizes = Sizes((built[BAD], built[GOOD]))
    shared = spark.sparkContext.broadcast(sizes)

    def measured(batches):
        for batch in batches:
            found = shared.value.measure(batch.column("text"))
            columns = [batch.column("quality"), *(pa.array(x) for x in found.T)]
            yield pa.RecordBatch.from_arrays(columns, ["quality", "difference", "share"])

    rows = texts.where("part = 2").select("quality", "text")
    found = rows.mapInArrow(measured, "quality int, difference double, share double").toArrow()
    found = found.sort_by([(x, "ascending") for x in found.column_names])  # sums in one order, whatever the tasks
    measures = np.column_stack([found[x].to_numpy() for x in ("difference", "share")])
    return Model(sizes, fit_curve(measures, found["quality"].to_numpy().astype(float)))


def score_quality(docs, labels, id_col="doc_id", text_col="text", **bounds):
    """row, doc_id, held_out, score, predicted for each document.

    Rows whose crc32 of the id leaves 1 modulo 3 are held out of the training.
    """
    model = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text))

    rows = packed(docs, doc_id=id_col, held_out=F.coalesce(~_learnable(docs, id_col), F.lit(False)), text=text_col)
    rows = rows.withColumn("score", scored("text"))
    return rows.select("row", "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
