"""Language ID by error-correcting output codes.

Each language has a codeword of +1/-1 bits. For each bit one binary classifier over byte n-grams
of the letters of a text says on which side the text lies: a naive Bayes score, averaged over the
n-grams. Decoding takes the codeword with the least loss over all bits, each bit weighted by how
well it did on the training rows; a text whose two nearest codewords are about as near is
flagged as ambiguous.

A text is rejected if no codeword is near: if the loss of the nearest is beyond `limit`, the middle
between the greatest one that a training row has and log 2, which is that of a text without any
evidence, such as one in a script that no training row has.

The classifiers are fitted on about `train_rows` labelled rows for each language (a bounded
sample, chosen by a hash of the id); whole texts are used in training and prediction. The model,
`CODES` floats for each bit, is sent to the tasks once; n-gram counts of the sample, at most `CODES`
for each language, are all that the driver gets.

Defined results: a text that is null or has no letter gets `und`, score 0, and is rejected; without
labelled rows every text gets `und`, and those with letters are not rejected; with one language
every text with letters gets it, score 1, and is not rejected; ids may be
null or repeat; an empty table gives an empty result; other columns are carried along.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ordermill.llm import words
from ordermill.llm.frames import packed, reread, ship

ORDERS = (2, 3, 4)
TABLE_BITS = 15
TABLE = 1 << TABLE_BITS
CODES = len(ORDERS) * TABLE
PAD = "    "
AMBIGUOUS = 0.05
UNDECIDED = "und"


def letters(text):
    """Lower-case words of letters between single spaces; empty if there is no letter."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " "))


def codewords(count):
    """One row of +1/-1 for each language.

    Up to five languages: every two-sided split of them. More: of 64 seeded random codes with
    about 10 log2(count) bits the one whose nearest two codewords are farthest apart.
    """
    if count <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=count) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.float64).T.reshape(count, -1)
    bits, random, best = int(np.ceil(10 * np.log2(count))), np.random.default_rng(7), (-1, None)
    for _ in range(64):
        code = random.choice([-1.0, 1.0], (count, bits))
        code = code[:, np.abs(code.sum(axis=0)) < count]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(count) * bits).min()
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


def _grams(data, ends=()):
    """For each byte the table places of the n-grams that begin there; bytes beyond the end of its text are zero."""
    b = np.concatenate((data, np.zeros(max(ORDERS), dtype=np.uint8))).astype(np.uint32)
    n = len(data)
    ends = np.asarray(ends, dtype=np.int64)
    beyond = []  # for each distance, the bytes whose text ends within it
    for j in range(1, max(ORDERS)):
        near = (ends[:, None] - np.arange(1, j + 1)).ravel()
        beyond.append(near[(near >= 0) & (near < n)])
    for k, order in enumerate(ORDERS):
        value = b[:n].copy()
        for j in range(1, order):
            value = (value << np.uint32(8)) | b[j : j + n]
            value[beyond[j - 1]] &= np.uint32(0xFFFFFF00)
        yield k * TABLE + ((value * np.uint32(2654435769)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def _text_sums(column, weights):
    """Sum of the weights of all n-grams of each padded text, and the number of n-grams."""
    data, places = words.text_bytes(column)
    sums = np.zeros((len(places) - 1, weights.shape[1]))
    for first, last in words.blocks(places, words.BLOCK // 2):
        for at in range(places[first], places[last], words.BLOCK):  # more than one step only for a long text
            end = min(places[last], at + words.BLOCK)
            piece = data[at : min(places[last], end + max(ORDERS) - 1)]
            starts = np.maximum(places[first:last], at) - at
            some = np.flatnonzero(places[first + 1 : last + 1] > np.maximum(places[first:last], at))
            if not len(some):
                continue
            for codes in _grams(piece, places[first + 1 : last + 1] - at):
                found = weights[codes[: end - at]]
                sums[first + some] += np.add.reduceat(found, starts[some], axis=0, dtype=np.float64)
    return sums, np.maximum(1, np.diff(places)) * len(ORDERS)


def _training_rows(rows, languages, counts, train_rows):
    """About `train_rows` rows of each language."""
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, train_rows / counts[k])))])
    chance = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), 11) / F.lit(float(1 << 53))
    return rows.where((F.col("letters") != "") & (chance < share[F.col("lang")])).select("lang", "padded")


def _count_grams(batches, languages):
    counts = np.zeros((len(languages), CODES), dtype=np.int64)
    for batch in batches:
        data, places = words.text_bytes(batch.column("padded"))
        named = [languages.index(x) for x in batch.column("lang").to_pylist()]
        for row, language in enumerate(named):
            for at in range(places[row], places[row + 1], words.BLOCK):
                end = min(places[row + 1], at + words.BLOCK)
                for codes in _grams(data[at : min(places[row + 1], end + max(ORDERS) - 1)]):
                    counts[language] += np.bincount(codes[: end - at], minlength=CODES)
    for language, one in enumerate(counts):
        some = np.flatnonzero(one)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), language)), pa.array(some), pa.array(one[some])], ["language", "code", "n"]
        )


class Model:
    """Languages, their codewords, n-gram weights, scale and weight of each bit, and the greatest loss of a known text."""

    def __init__(self, languages, code, weights, scale, trust, limit=np.inf):
        self.languages, self.code, self.weights, self.scale, self.trust = languages, code, weights, scale, trust
        self.limit = limit

    def sides(self, column):
        sums, grams = _text_sums(column, self.weights)
        return sums / grams[:, None]

    def decode(self, sides):
        """Best language, its score, how much farther the second codeword is, and the loss of the best."""
        loss = np.logaddexp(0, -2 * (sides / self.scale)[:, None, :] * self.code[None])
        away = (loss * self.trust).sum(axis=2) / self.trust.sum()
        near = np.sort(away, axis=1)
        chance = np.exp(-4 * (away - near[:, :1]))
        return away.argmin(axis=1), 1 / chance.sum(axis=1), near[:, 1] - near[:, 0], near[:, 0]


def fit(labelled, train_rows=1500):
    """Fit on rows with `lang`, `doc_id`, `letters`, `padded`; None without any."""
    spark = labelled.sparkSession
    ship(spark)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    sample = _training_rows(labelled, languages, counts, train_rows)
    schema = "language long, code long, n long"
    sample = reread(sample.repartition(4 * len(languages)))  # read in three passes
    found = sample.mapInArrow(lambda b: _count_grams(b, languages), schema)
    found = found.groupBy("language", "code").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((len(languages), CODES))
    seen[found["language"].to_numpy(), found["code"].to_numpy()] = found["n"].to_numpy()
    code = codewords(len(languages))
    share = seen / np.maximum(1, seen.sum(axis=1, keepdims=True))
    floor = 1 / CODES / 20
    plus, minus = (code > 0).T @ share, (code < 0).T @ share  # for each bit, languages count alike
    plus = plus / np.maximum(1, (code > 0).sum(axis=0))[:, None]
    minus = minus / np.maximum(1, (code < 0).sum(axis=0))[:, None]
    weights = np.ascontiguousarray((np.log(plus + floor) - np.log(minus + floor)).T.astype(np.float32))
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
    if len(languages) < 2:
        return model
    shared = spark.sparkContext.broadcast(model)
    bits = code.shape[1]

    def rate(batches):
        total = np.zeros((3, bits))
        for batch in batches:
            sides = shared.value.sides(batch.column("padded"))
            wanted = code[[languages.index(x) for x in batch.column("lang").to_pylist()]]
            total += [np.abs(sides).sum(axis=0), (sides * wanted > 0).sum(axis=0), np.full(bits, len(sides))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(bits)), *(pa.array(x) for x in total)], ["bit", "size", "right", "n"]
        )

    bit = sample.mapInArrow(rate, "bit long, size double, right double, n double").groupBy("bit")
    bit = bit.agg(*[F.sum(x).alias(x) for x in ("size", "right", "n")]).orderBy("bit").collect()
    if bit and bit[0]["n"]:
        model.scale = np.array([max(1e-6, r["size"] / r["n"]) for r in bit])
        hit = np.array([min(0.999, max(0.501, r["right"] / r["n"])) for r in bit])
        model.trust = np.log(hit / (1 - hit))
    rated = spark.sparkContext.broadcast(model)

    def worst(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(rated.value.decode(rated.value.sides(batch.column("padded")))[3])], ["loss"])

    most = sample.mapInArrow(worst, "loss double").agg(F.max("loss")).first()[0]
    if most is not None:
        model.limit = max(most, (most + np.log(2)) / 2)
    return model


def identify(docs, id_col="doc_id", text_col="text", lang_col="lang", train_rows=1500, margin=AMBIGUOUS):
    """row, doc_id, held_out, lang_pred, score, ambiguous, rejected for each document.

    Rows whose crc32 of the id leaves 2 modulo 4 are held out of the training.
    """
    rows = packed(
        docs,
        doc_id=id_col,
        lang=lang_col,
        held_out=F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False)),
        letters=letters(F.col(text_col)),
    ).withColumn("padded", F.concat(F.lit(" "), "letters", F.lit(PAD)))
    model = fit(rows.where(~F.col("held_out") & F.col("lang").isNotNull()), train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, margin double, beyond boolean")
    def decoded(padded: pa.Array) -> pa.Array:
        return _decoded(shared.value, padded)

    nothing = F.col("letters") == ""
    return rows.withColumn("found", decoded("padded")).select(
        "row",
        "doc_id",
        "held_out",
        F.when(nothing, UNDECIDED).otherwise(F.col("found.lang_pred")).alias("lang_pred"),
        F.when(nothing, 0.0).otherwise(F.col("found.score")).alias("score"),
        (nothing | (F.col("found.margin") < margin)).alias("ambiguous"),
        (nothing | F.col("found.beyond")).alias("rejected"),
    )


def _decoded(model, padded):
    rows, beyond = len(padded), np.zeros(len(padded), dtype=bool)
    if model is None:
        named, score, margin = np.full(rows, UNDECIDED), np.zeros(rows), np.zeros(rows)
    elif len(model.languages) == 1:
        named, score, margin = np.full(rows, model.languages[0]), np.ones(rows), np.ones(rows)
    else:
        best, score, margin, loss = model.decode(model.sides(padded))
        named, beyond = np.array(model.languages, dtype=object)[best], loss > model.limit
    columns = [pa.array(named.tolist(), pa.string()), pa.array(score), pa.array(margin), pa.array(beyond)]
    return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "margin", "beyond"])
