"""A Bloom filter as a small table of 64-bit words, made and tested by built-in functions.

A 64-bit hash names one word by its high bits and three bits of that word by its low bits. The
table has at most `MOST_WORDS` rows (two longs each, some 50 MB as a broadcast), whatever the
input: a larger input fills it more densely, which lets more rows through the test and changes no
result. On large machines `most_words` may be raised. The table is saved when it is made, so that
a plan with several branches behind a test reads its keys once.
"""

import numpy as np
from pyspark.sql import functions as F

from ordermill.llm.frames import saved

MOST_WORDS = 1 << 21
BITS_PER_ROW = 16


def _place(key, bits):
    return F.shiftrightunsigned(key, 64 - bits).alias("word")


def _mask(key):
    one = F.lit(1).cast("long")
    a, b, c = (
        F.call_function("shiftleft", one, F.shiftright(key, 6 * n).bitwiseAND(63).cast("int")) for n in range(3)
    )
    return a.bitwiseOR(b).bitwiseOR(c).alias("mask")


def holds(bitmap, bits, keys):
    """For numpy arrays: whether the bitmap of a filter may hold each unsigned 64-bit key."""
    one = np.uint64(1)
    mask = np.zeros(len(keys), dtype=np.uint64)
    for n in range(3):
        mask |= one << ((keys >> np.uint64(6 * n)) & np.uint64(63))
    return bitmap[keys >> np.uint64(64 - bits)] & mask == mask


class Bloom:
    """`table` is (word, bits); `bits` the number of bits that name a word."""

    def __init__(self, table, bits):
        self.table, self.bits = table, bits

    def bitmap(self):
        """All words as one numpy array, for use in tasks; at most `MOST_WORDS` of them."""
        found = self.table.toArrow()
        words = np.zeros(1 << self.bits, dtype=np.uint64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return words

    def tested(self, frame, key, name):
        """`frame` with a boolean: false if the key is surely not in the filter."""
        joined = frame.withColumns({"_word": _place(F.col(key), self.bits), "_mask": _mask(F.col(key))}).join(
            F.broadcast(self.table.withColumnsRenamed({"word": "_word", "bits": "_bits"})), "_word", "left"
        )
        found = F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")
        return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop("_word", "_mask", "_bits")


def word_bits(rows, most_words=MOST_WORDS):
    """Bits that name a word of a filter for so many rows."""
    wanted = max(16, min(most_words, rows * BITS_PER_ROW // 64))
    return (wanted - 1).bit_length()


def of_keys(frame, key, rows, most_words=MOST_WORDS):
    """A filter that holds every key of `frame`."""
    bits = word_bits(rows, most_words)
    entries = frame.select(_place(F.col(key), bits), _mask(F.col(key)))
    return Bloom(saved(entries.groupBy("word").agg(F.bit_or("mask").alias("bits"))), bits)


def of_repeats(frame, key, rows, most_words=MOST_WORDS):
    """A filter that holds every key that `frame` has at least twice.

    Keys are entered by their word and mask alone; entries met a second time go into the filter.
    Both groupings combine in each task before they shuffle, so one frequent key costs nothing.
    """
    bits = word_bits(rows, most_words)
    entries = frame.select(_place(F.col(key), bits), _mask(F.col(key)))
    again = entries.groupBy("word", "mask").count().where("count > 1")
    return Bloom(saved(again.groupBy("word").agg(F.bit_or("mask").alias("bits"))), bits)


def without(frame, key, gone):
    """Rows of `frame` whose key is not among the keys of `gone` (same column name).

    Rows that the filter of `gone` does not hold pass straight through; only the others are
    shuffled and joined.
    """
    tested = of_keys(gone, key, gone.count()).tested(frame, key, "_maybe")
    straight = tested.where(~F.col("_maybe"))
    return straight.unionByName(tested.where("_maybe").join(gone.select(key), key, "left_anti")).drop("_maybe")
