"""How often hashes of words or n-grams occur in the corpus, in a table of fixed size."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

U = np.uint64
BLOCK = 1 << 10
SALTS = 64


def bucket(hashes, bits):
    """The bucket of each hash: its high bits."""
    return (hashes >> U(64 - bits)).astype(np.int64)


def bucket_counts(texts, hashes_of, bits):
    """A numpy array of 2^bits counts over all rows; hashes_of gives arrays of hashes of Arrow batches.

    Each task sums its own rows; blocks of the table are then summed over tasks in two steps, so
    that no group grows with the number of tasks.
    """

    def one_task(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for hashes in hashes_of(batches):
            total += np.bincount(bucket(hashes, bits), minlength=len(total))
        parts = total.reshape(-1, BLOCK)
        some = np.flatnonzero(parts.any(axis=1))
        salt = np.full(len(some), TaskContext.get().partitionId() % SALTS)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(salt), _lists(parts[some])], ["block", "salt", "n"])

    parts = texts.mapInArrow(one_task, "block long, salt long, n array<long>")
    parts = parts.groupBy("block", "salt").applyInArrow(_summed, "block long, n array<long>")
    found = parts.groupBy("block").applyInArrow(_summed, "block long, n array<long>").toArrow()
    total = np.zeros((1 << bits) // BLOCK * BLOCK, dtype=np.int64).reshape(-1, BLOCK)
    if len(found):
        total[found["block"].to_numpy()] = _rows(found)
    return total.reshape(-1)


def _lists(rows):
    cuts = np.arange(len(rows) + 1, dtype=np.int32) * BLOCK
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(rows.reshape(-1)))


def _rows(table):
    return table.column("n").combine_chunks().flatten().to_numpy().reshape(-1, BLOCK)


def _summed(table: pa.Table) -> pa.Table:
    total = _rows(table).sum(axis=0, keepdims=True)
    return pa.table({"block": table.column("block").slice(0, 1), "n": _lists(total)})
