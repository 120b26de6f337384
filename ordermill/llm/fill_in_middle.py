"""Fill-in-the-middle training texts by a piece table.

A document is a list of descriptors (buffer, start, end) over two buffers that never change: the
bytes of its text and the bytes of the three sentinels. Cutting splits descriptors, an arrangement
puts the parts into another order with sentinels between, and the inverse arrangement gives the
text back. Nothing is copied before the output is written; hashes run over the descriptors.

Where a text is cut and which form it takes follows from a hash of its id: forms `psm`
(prefix, suffix, middle), `spm` (suffix, prefix, middle) or `plain`.

Defined results: a null text counts as empty; an empty text, and one that contains a sentinel, is
plain; a null id counts as the text `null`; rows that repeat an id and text give equal outputs; an
empty table gives an empty result; other columns are carried along in `row`. A text of any length
is looked through in blocks; a task holds one Arrow batch and its outputs.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ordermill.llm import words
from ordermill.llm.frames import packed, ship

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
_MARKS = "".join(SENTINELS).encode()
PLAIN, PSM, SPM = "plain", "psm", "spm"
TEXT, MARKS = 0, 1  # the two buffers
# For each form: sentinel and part of a text (0 prefix, 1 middle, 2 suffix), in the order of the output.
ARRANGEMENTS = {PSM: ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), SPM: ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


class PieceTable:
    """A byte string as descriptors (buffer, start, end) over shared buffers."""

    def __init__(self, buffers, pieces):
        self.buffers, self.pieces = buffers, pieces

    def cut(self, places):
        """The parts between ascending places, counted in bytes of the string; descriptors are split where needed."""
        parts, part, left = [], [], [b - a for a, b in zip([0, *places], places)]
        for buffer, start, end in self.pieces:
            while left and end - start >= left[0]:
                middle = start + left.pop(0)
                parts.append(part + [(buffer, start, middle)] * (middle > start))
                part, start = [], middle
            if end > start:
                part.append((buffer, start, end))
                if left:
                    left[0] -= end - start
        for _ in left:  # places at the end of a string without descriptors
            parts, part = [*parts, part], []
        return [PieceTable(self.buffers, p) for p in [*parts, part]]

    def views(self):
        for buffer, start, end in self.pieces:
            yield self.buffers[buffer][start:end]

    def sha256(self):
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def bytes(self):
        return b"".join(self.views())


def _mark(sentinel):
    at = _MARKS.index(sentinel.encode())
    return (MARKS, at, at + len(sentinel))


def arrange(parts, form):
    """The parts prefix, middle and suffix in the order of a form, each after its sentinel."""
    pieces = []
    for sentinel, part in ARRANGEMENTS[form]:
        pieces += [_mark(sentinel), *parts[part].pieces]
    return PieceTable(parts[0].buffers, pieces)


def restore_pieces(output, form):
    """The descriptors of the text over the bytes of an output: the sentinels go, the parts return to their order.

    A text that contains a sentinel is never arranged, so each occurs once, at a border.
    """
    whole = PieceTable((output, _MARKS), [(TEXT, 0, len(output))])
    if form == PLAIN:
        return whole
    marks = [(s.encode(), part) for s, part in ARRANGEMENTS[form]]
    starts = [output.index(m) for m, _ in marks]
    places = [p for start, (m, _) in zip(starts, marks) for p in (start, start + len(m))]
    cut = whole.cut(places)
    parts = {part: cut[2 * k + 2] for k, (_, part) in enumerate(marks)}
    return PieceTable(whole.buffers, [p for k in sorted(parts) for p in parts[k].pieces])


def byte_place(data, points):
    """The byte at which code point number `points` begins, looking through a block at a time."""
    for at in range(0, len(data), words.BLOCK):
        heads = (data[at : at + words.BLOCK] & 0xC0) != 0x80
        here = int(np.count_nonzero(heads))
        if points < here:
            return at + int(np.flatnonzero(heads)[points])
        points -= here
    return len(data)


def _arranged(text, form, first, last):
    data, places = words.text_bytes(text)
    view = memoryview(data)
    outputs, digests = [], []
    for k, (f, a, b) in enumerate(zip(form.to_pylist(), first.to_pylist(), last.to_pylist())):
        begin, end = places[k], places[k + 1]
        table = PieceTable((view, _MARKS), [(TEXT, int(begin), int(end))])
        if f != PLAIN:
            own = data[begin:end]
            table = arrange(table.cut([byte_place(own, a), byte_place(own, b)]), f)
        outputs.append(table.bytes())
        digests.append(table.sha256())
    columns = [pa.array(outputs, pa.large_binary()).cast(pa.large_string()).cast(pa.string()), pa.array(digests, pa.string())]
    return pa.StructArray.from_arrays(columns, ["output", "output_sha256"])


def _numbers(id_col):
    """The first four 8-digit groups of the hash of an id, as numbers."""
    key = F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    digits = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs, id_col="doc_id", text_col="text", plain_percent=10, spm_percent=20):
    """row, doc_id, n, form, first_cut, last_cut (code points), output, output_sha256 for each document."""
    ship(docs.sparkSession)
    h = _numbers(id_col)
    rows = packed(docs, doc_id=id_col, text=F.coalesce(F.col(text_col), F.lit("")), h=F.array(*h))
    rows = rows.withColumn("n", F.length("text").cast("long"))
    taken = [F.contains("text", F.lit(s)) for s in SENTINELS]
    plain = (F.col("n") == 0) | taken[0] | taken[1] | taken[2] | (F.col("h")[2] % 100 >= 100 - plain_percent)
    cuts = [F.col("h")[k] % (F.col("n") + 1) for k in range(2)]
    rows = rows.withColumns(
        {
            "form": F.when(plain, PLAIN).when(F.col("h")[3] % 100 < spm_percent, SPM).otherwise(PSM),
            "first_cut": F.least(*cuts),
            "last_cut": F.greatest(*cuts),
        }
    )

    @F.arrow_udf("output string, output_sha256 string")
    def arranged(text: pa.Array, form: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        return _arranged(text, form, first, last)

    made = rows.withColumn("made", arranged("text", "form", "first_cut", "last_cut"))
    return made.select("row", "doc_id", "n", "form", "first_cut", "last_cut", "made.output", "made.output_sha256")


def _each_restored(output, form, result):
    data, places = words.text_bytes(output)
    for k, f in enumerate(form.to_pylist()):
        yield result(restore_pieces(data[places[k] : places[k + 1]].tobytes(), f))


@F.arrow_udf(StringType())
def _restored_text(output: pa.Array, form: pa.Array) -> pa.Array:
    return pa.array(_each_restored(output, form, lambda t: t.bytes().decode()), pa.string())


@F.arrow_udf(StringType())
def _restored_sha256(output: pa.Array, form: pa.Array) -> pa.Array:
    return pa.array(_each_restored(output, form, PieceTable.sha256), pa.string())


def restored_text(output="output", form="form"):
    """Column: the text of an output."""
    return _restored_text(F.col(output), F.col(form))


def restored_sha256(output="output", form="form"):
    """Column: the SHA-256 of the text of an output, which is not put together for it."""
    return _restored_sha256(F.col(output), F.col(form))
