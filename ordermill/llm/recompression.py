"""Exact removal of long repeated word sequences by recompression.

The words of all documents are rewritten in rounds, as recompression does: a maximal run of one
symbol becomes one symbol, and a pair becomes one symbol if a coin flipped by its first member's
name says left and by its second's says right. A new symbol's name is a 64-bit hash of its parts
and the round, so equal parts get equal names in every task without a common dictionary, and
equal word sequences get equal symbols everywhere but near their ends.

With each symbol goes the range of words that it depends on: all words that, if they were others,
could have led to another symbol at this place. So a window of 35 words that occurs twice has the
same symbols, in the same places, wherever a symbol's range is inside the window. A Spark job
counts the high-level symbols of the corpus; a window around a symbol that occurs once is
therefore alone. The windows left, which have only shared symbols, are verified: their hashes are
counted over the corpus, and those met at least twice are repeats. Nothing is decided by symbols
alone, so results do not depend on the number of rounds.

The names of shared symbols go to the tasks in a Bloom filter of bounded size; a fuller filter
leaves more windows to verify and changes no result. Counts are combined in each task before they
shuffle, and joined back, so a sequence with a third of all rows is split.

Names are 64-bit hashes; windows with equal hashes are taken as equal.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ordermill.llm import bloom, words
from ordermill.llm.frames import packed, saved, ship

U = words.U
WINDOW = 35
ROUNDS = 6
RUN_ROUNDS = (0, 3)
_LEFT, _RIGHT = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)


class Symbols:
    """Names, and by word number: first word, next symbol's first word, and the range depended on."""

    def __init__(self, names, texts):
        at = np.arange(len(names))
        self.names, self.first, self.low, self.high, self.text = names, at, at.copy(), at.copy(), texts

    def _joined(self):
        """Whether each symbol and the next are in the same text."""
        return self.text[:-1] == self.text[1:]

    def _keep(self, heads, names, low, high):
        self.names, self.first, self.text, self.low, self.high = names, self.first[heads], self.text[heads], low, high

    def _with_next(self):
        """Ranges of each symbol and the next one; at the end of a text, with a word outside of it."""
        joined = self._joined()
        low, high = self.low.copy(), self.high + 1
        low[:-1] = np.where(joined, np.minimum(low[:-1], self.low[1:]), low[:-1])
        high[:-1] = np.where(joined, np.maximum(self.high[:-1], self.high[1:]), high[:-1])
        return low, high

    def _with_last(self):
        """Ranges of each symbol and the one before; at the start of a text, with a word outside of it."""
        joined = self._joined()
        low, high = self.low - 1, self.high.copy()
        low[1:] = np.where(joined, np.minimum(self.low[1:], self.low[:-1]), low[1:])
        high[1:] = np.where(joined, np.maximum(high[1:], self.high[:-1]), high[1:])
        return low, high

    def runs(self, salt):
        same = np.concatenate(([False], (self.names[1:] == self.names[:-1]) & self._joined()))
        heads = np.flatnonzero(~same)
        (low, high), (low2, high2) = self._with_last(), self._with_next()
        lengths = np.diff(np.append(heads, len(self.names)))
        names, long = self.names[heads], lengths > 1
        names[long] = words.mix(names[long] + words.mix(lengths[long].astype(U) + U(salt)))
        low, high = np.minimum(low, low2), np.maximum(high, high2)
        self._keep(heads, names, np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads))

    def pairs(self, salt):
        coin = (words.mix(self.names + U(salt)) >> U(63)).astype(bool)  # True: first of a pair
        opens = np.zeros(len(self.names), dtype=bool)
        opens[:-1] = coin[:-1] & ~coin[1:] & self._joined()
        closes = np.concatenate(([False], opens[:-1]))
        # A pair depends on its members; alone, a first member depends on what follows and a second
        # one on what came before.
        (low, high), (low2, high2) = self._with_next(), self._with_last()
        low, high = np.where(coin, low, low2), np.where(coin, high, high2)
        at, heads = np.flatnonzero(opens), np.flatnonzero(~closes)
        names = self.names.copy()
        names[at] = words.mix(self.names[at] * _LEFT + words.mix(self.names[at + 1] * _RIGHT + U(salt)))
        self._keep(heads, names[heads], low[heads], high[heads])


def parse(hashes, texts, rounds=ROUNDS):
    """Symbols of the words of several texts after all rounds."""
    found = Symbols(hashes.copy(), texts)
    for k in range(rounds if len(hashes) else 0):
        if k in RUN_ROUNDS:
            found.runs(2 * k + 1)
        found.pairs(2 * k + 2)
    return found


def _blocks(batch):
    """For blocks of rows of a batch: first row, last row, word hashes, the row of each word."""
    data, places = words.text_bytes(batch.column("text"))
    for first, last in words.blocks(places):
        begin, end = places[first], places[last]
        _, _, hashes, cuts = words.hash_words(data[begin:end], places[first : last + 1] - begin)
        yield first, last, hashes, np.repeat(np.arange(first, last), np.diff(cuts)), cuts[:-1]


def _usable(symbols, texts, size):
    """Symbols whose range is inside their text and fits into a window."""
    last = len(texts) - 1
    inside = (symbols.low >= 0) & (symbols.high <= last)
    inside &= texts[np.clip(symbols.low, 0, last)] == texts[np.clip(symbols.high, 0, last)]
    return inside & (symbols.high - symbols.low < size)


def _symbol_names(batches, size, rounds):
    for batch in batches:
        for _, _, hashes, texts, _ in _blocks(batch):
            if len(hashes):
                symbols = parse(hashes, texts, rounds)
                names = symbols.names[_usable(symbols, texts, size)]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64))], ["name"])


def _candidates(batches, size, rounds, shared):
    """Hash, document key and place of each window without a symbol that occurs once."""
    table, bits = shared.value
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for _, _, hashes, texts, starts in _blocks(batch):
            windows = words.rolling(hashes, size)
            if not len(windows):
                continue
            symbols = parse(hashes, texts, rounds)
            alone = _usable(symbols, texts, size) & ~bloom.holds(table, bits, symbols.names)
            first, last = symbols.high[alone] - size + 1, symbols.low[alone]  # windows around them
            marks = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(marks, np.maximum(first, 0), 1)
            np.add.at(marks, last + 1, -1)
            inside = texts[: len(windows)] == texts[size - 1 :]
            at = np.flatnonzero((np.cumsum(marks)[: len(windows)] == 0) & inside)
            rows = texts[at]
            begins = np.zeros(int(texts[-1]) + 1, dtype=np.int64)
            begins[texts[::-1]] = np.arange(len(texts))[::-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows[at].view(np.int64)), pa.array(keys[rows]), pa.array((at - begins[rows]).astype(np.int32))],
                ["hash", "key", "place"],
            )


def _kept(batches, size):
    """n_words, n_removed and kept_sha256 of each document, given the places of its repeated windows."""
    for batch in batches:
        totals, removed, digests = [], [], []
        for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
            split = (text.as_py() or "").encode().split()
            at = np.asarray(places.values, dtype=np.int64) if places.is_valid else np.zeros(0, dtype=np.int64)
            marks = np.zeros(len(split) + 1, dtype=np.int64)
            np.add.at(marks, at, 1)
            np.add.at(marks, np.minimum(at + size, len(split)), -1)
            keep = np.cumsum(marks[:-1]) == 0
            kept = [w for w, k in zip(split, keep, strict=True) if k] if len(at) else split
            totals.append(len(split))
            removed.append(len(split) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        columns = [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(rows, size=WINDOW, rounds=ROUNDS):
    """(key, place) of every window of rows (key, text) whose word sequence also starts elsewhere."""
    ship(rows.sparkSession)
    names = rows.select("text").mapInArrow(lambda b: _symbol_names(b, size, rounds), "name long")
    shared = saved(names.groupBy("name").count().where("count > 1").select("name"))
    table = bloom.of_keys(shared, "name", shared.count())
    sent = rows.sparkSession.sparkContext.broadcast((table.bitmap(), table.bits))
    found = rows.mapInArrow(lambda b: _candidates(b, size, rounds, sent), "hash long, key long, place int")
    # Saved, so that the join deals out both sides itself and can split a frequent window.
    again = saved(found.groupBy("hash").count().where("count > 1").select("hash"))
    return found.join(again, "hash").select("key", "place")


def drop_repeats(docs, id_col="doc_id", text_col="text", size=WINDOW, rounds=ROUNDS):
    """doc_id, n_words, n_removed, kept_sha256 of each document without its repeated windows.

    A window is `size` consecutive words; every word that a repeated window covers goes, the first
    occurrence too. kept_sha256 is of the kept words, joined by one space.

    Defined results: null, empty and short texts lose nothing; a row that repeats id and text is
    another document, so both lose their windows; ids may be null; an empty table gives an empty
    result; other columns are ignored.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = packed(docs, doc_id=id_col, text=text_col, key=key).drop("row")
    places = repeated_windows(rows.select("key", "text"), size, rounds)
    places = saved(places.groupBy("key").agg(F.collect_set("place").alias("places")))  # no more than the text has words
    tested = bloom.of_keys(places, "key", places.count()).tested(rows, "key", "maybe")
    straight = tested.where("NOT maybe").withColumn("places", F.lit(None).cast("array<int>"))
    joined = tested.where("maybe").join(places, "key", "left")
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string"
    columns = ["doc_id", "text", "places"]
    kept = [x.select(*columns).mapInArrow(lambda b: _kept(b, size), schema) for x in (straight, joined)]
    return kept[0].unionByName(kept[1])
