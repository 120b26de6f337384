"""Words of whole Arrow string columns as numpy arrays, without one Python object per word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. It is known by a 64-bit hash: the mixed sum of its pieces of eight bytes, each mixed with
its place in the word, and of its length. No word is built from another so that their hashes are
equal, as words of a polynomial modulo 2^64 can be; different words are taken as equal by chance
alone, two of them with probability about 2^-64. Work goes over blocks of about `BLOCK` bytes,
so memory does not grow with the length of a text.
"""

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
PIECE = 8
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x):
    """Spread 64-bit values evenly; a bijection."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column):
    """The bytes of all strings of an Arrow column, one after the other, and where each begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    places = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, places


def blocks(places, limit=BLOCK):
    """Row ranges whose texts hold about `limit` bytes; a longer text is alone in its range."""
    row, rows = 0, len(places) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(places, places[row] + limit, side="right")) - 1)
        yield row, end
        row = end


def hash_words(data, places, lower=False):
    """Where the words of each text start and end, their hashes, and each text's first word.

    `places` says where each text begins in `data`; a word does not reach into the next text.
    """
    word = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[places] = True
    after = np.concatenate(([False], word[:-1])) if len(word) else word
    starts = np.flatnonzero(word & (~after | begins[:-1]))
    before = np.concatenate((word[1:], [False])) if len(word) else word
    ends = np.flatnonzero(word & (~before | begins[1:])) + 1
    hashes = np.empty(len(starts), dtype=U)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, side="right")))
        begin, end = starts[first], ends[last - 1]
        if last == first + 1:
            hashes[first] = _long_word(data[begin:end], lower)
        else:
            s, lengths = starts[first:last] - begin, ends[first:last] - starts[first:last]
            counts = -(-lengths // PIECE)
            heads = np.cumsum(counts) - counts
            place = np.arange(counts.sum()) - np.repeat(heads, counts)
            left = np.repeat(lengths, counts) - PIECE * place
            pieces = _pieces(data[begin:end], np.repeat(s, counts) + PIECE * place, left, place, lower)
            hashes[first:last] = mix(np.add.reduceat(pieces, heads) + mix(lengths.astype(U)))
        first = last
    return starts, ends, hashes, np.searchsorted(starts, places)


def _pieces(data, at, left, place, lower):
    """For each place `at` the mixed number of its eight bytes, or of the `left` ones if fewer."""
    data = np.concatenate((_LOWER[data] if lower else data, np.zeros(PIECE, dtype=np.uint8)))
    eight = np.ndarray(len(data) - PIECE + 1, dtype="<u8", buffer=data, strides=(1,))
    beyond = (8 * (PIECE - np.minimum(left, PIECE))).astype(U)
    value = (eight[at] << beyond) >> beyond
    return mix(mix(value) + mix(place.astype(U) + U(1)))


def _long_word(data, lower):
    total = np.zeros(1, dtype=U)
    for begin in range(0, len(data), BLOCK):
        at = np.arange(0, min(BLOCK, len(data) - begin), PIECE)
        part = _pieces(data[begin : begin + BLOCK], at, len(data) - begin - at, (begin + at) // PIECE, lower)
        total += part.sum(dtype=U)
    return mix(total + mix(np.array([len(data)])))[0]


def windows(hashes, size):
    """A hash of each `size` consecutive words, by the place of the first."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(count, dtype=U)
    for k in range(size):
        out = mix(out + hashes[k : k + count] + _STEP)
    return out


def rolling(hashes, size):
    """As `windows`, with a time that grows with the logarithm of `size` only.

    The hash of twice as many words is made of the hashes of both halves; those for the powers
    of two in `size` are put together.
    """
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=U)
    out, done, doubled, length = None, 0, hashes, 1
    while length <= size:
        if size & length:
            part = doubled[done : done + count]
            out = part if out is None else mix(mix(out + _STEP) + part)
            done += length
        doubled, length = mix(mix(doubled[:-length] + _STEP) + doubled[length:]), 2 * length
    return out
