"""Alignment of the tokens of two tokenizers by coalescing intervals.

A token is an interval of bytes of space + text. The tokens of both sides are sorted by start, the
running maximum of their ends is taken, and a group breaks where a start reaches that maximum: there
tokens of both sides end. Within a group the overlapping pairs are expanded; a link is a pair whose
intervals end together. Blocks of texts are laid end to end and treated at once.

Corpus counts of linked id pairs take one pass: a text is tokenized once, its distinct pairs are
written beside its digests, and summed. The most frequent pairs, as many as `most_pairs` allows, go
to the tasks as a table of proven size; the remaining pairs of a text are joined with their counts,
and texts without such pairs pass that join by. The highest count of each B id is a table no longer
than B's vocabulary.

Defined results: a text that is null or empty, or whose joined token bytes of either side differ from
space + text, has no tokens; ids may be null or repeat, each row is treated by itself; an empty table gives
an empty result; other columns are carried along in `row` (`align_tokens`) or ignored (`link_statistics`).
Whole texts are tokenized; a task holds the tokens of one block of about `BLOCK` bytes, or of one longer text.

Neither vocabulary has a token with a space after something other than white space, so a text falls into
chunks, each with the space before it, whose tokens do not depend on the others: side A splits there before it
merges, and no merge of side B goes over such a place. A task tokenizes a chunk once for each side and remembers
its tokens, up to `REMEMBERED` chunks; a vocabulary that does not allow this is given whole texts.
"""

import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ordermill.llm import words
from ordermill.llm.frames import packed, reread, ship

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 1 << 19
MOST_PAIRS = 1 << 20
REMEMBERED = 1 << 17
_GAPS = tuple(f"{chr(k)} " for k in range(0x3001) if chr(k).isspace())  # all white space, each before a space
_SPACE_MARK = "▁"


def _byte_level():
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _crosses(token):
    """Whether a token has a space after something other than white space."""
    return re.search(r"\S ", token.decode(errors="replace")) is not None


def chunks(text):
    """A text cut at its spaces; a space after white space belongs to the chunk before, as does one at the end."""
    cut = text.split(" ")
    if text.startswith(" ") or any(gap in text for gap in _GAPS):
        parts, cut = cut, cut[:1]
        for part in parts[1:]:
            if cut[-1] and not cut[-1][-1].isspace():
                cut.append(part)
            else:
                cut[-1] = f"{cut[-1]} {part}"
    if len(cut) > 1 and not cut[-1]:  # side B gives an empty text no space
        cut[-2:] = [f"{cut[-2]} "]
    return cut


class ByteBpe:
    """Ids of space + text, and the bytes of each id."""

    def __init__(self, content):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tool = Tokenizer.from_str(content.decode())
        self._tool.encode_special_tokens = True
        level = _byte_level()
        known = self._tool.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(known.values()) + 1)
        for token, k in known.items():
            self.bytes_of[k] = bytes(level[c] for c in token) if set(token) <= level.keys() else token.encode()

        # The pattern that splits a text before merging puts a space at the start of a piece only.
        self.by_chunk = not any(map(_crosses, self.bytes_of))

    def encode(self, texts):
        found = self._tool.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in found]


class PieceBpe:
    """Ids of text, to which the model adds the space, and the bytes of each id."""

    def __init__(self, content):
        import sentencepiece

        self._tool = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes_of = [self._bytes(k) for k in range(self._tool.get_piece_size())]
        self.by_chunk = not any(map(_crosses, self.bytes_of))  # merges make pieces of the vocabulary only

    def _bytes(self, k):
        piece = self._tool.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self._tool.is_byte(k) else piece.replace(_SPACE_MARK, " ").encode()

    def encode(self, texts):
        return self._tool.encode(texts, num_threads=1)


class Side:
    """A tokenizer with tables by id; made in the task from the content of its file."""

    def __init__(self, kind, content):
        self.kind, self.content, self._tool = kind, content, None

    def __getstate__(self):
        return self.kind, self.content

    def __setstate__(self, state):
        self.__init__(*state)

    def tool(self):
        if self._tool is None:
            self._tool = self.kind(self.content)
            # Each known chunk's number; of each number how many tokens (-1: none) and where they begin in the pool.
            self._known, self._held, self._first, self._pool = {}, *(np.zeros(0, dtype=np.int64) for _ in range(3))
            self.sizes = np.array([len(b) for b in self._tool.bytes_of])
            names = [f"{k}{end}" for end in _ENDS for k in range(len(self.sizes))]
            self.names = np.array(names, dtype=object).reshape(len(_ENDS), -1)
        return self._tool

    def _checked(self, texts):
        table = self.tool().bytes_of
        for text, ids in zip(texts, self.tool().encode(texts)):
            yield ids if b"".join([table[k] for k in ids]) == b" " + text.encode() else None

    def _chunk_tokens(self, new, apart):
        """Ids of some chunks in one array, and how many each has (-1: none): all are tokenized as one text, whose tokens
        are cut at the ends of the chunks, or `apart` where tokens may not end with each chunk."""
        found = None if apart else next(self._checked([" ".join(new)]))
        if found is None:
            return _laid(list(self._checked(new)))
        ids = np.array(found, dtype=np.int64)
        ends = np.cumsum([1 + len(c.encode()) for c in new])
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        return ids, np.diff(cuts, prepend=0)

    def _remember(self, new, apart):
        if not new:
            return
        ids, held = self._chunk_tokens(new, apart)
        some = np.maximum(held, 0)
        self._known.update(zip(new, range(len(self._held), len(self._held) + len(new))))
        self._first = np.concatenate((self._first, len(self._pool) + np.cumsum(some) - some))
        self._held, self._pool = np.concatenate((self._held, held)), np.concatenate((self._pool, ids))

    def _forget(self, met):
        """All chunks but those that are met."""
        kept = [c for c in met if c in self._known]
        at = np.fromiter(map(self._known.__getitem__, kept), np.int64, len(kept))
        held = self._held[at]
        self._pool, some = _gathered(self._pool, self._first[at], held), np.maximum(held, 0)
        self._known, self._held, self._first = dict(zip(kept, range(len(kept)))), held, np.cumsum(some) - some

    def laid(self, texts, cut):
        """Ids of all texts in one array, and how many each has: -1 where the bytes of its tokens are not space + text.

        `cut` has the chunks of each text.
        """
        if not self.tool().by_chunk or not texts:
            return _laid(list(self._checked(texts)))
        flat = list(itertools.chain.from_iterable(cut))
        met = dict.fromkeys(flat)
        if len(self._known) > REMEMBERED:
            self._forget(met)
        new = [c for c in met if c not in self._known]
        odd = [c for c in new if not c or c[-1].isspace()]
        self._remember([c for c in new if c and not c[-1].isspace()] if odd else new, apart=False)
        self._remember(odd, apart=True)
        at = np.fromiter(map(self._known.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(c) for c in cut])
        begins, held = np.cumsum(sizes) - sizes, self._held[at]
        whole = np.minimum.reduceat(held, begins) >= 0
        counts = np.where(whole, np.add.reduceat(held, begins), -1)
        return _gathered(self._pool, self._first[at], np.where(np.repeat(whole, sizes), held, 0)), counts

    def tokens(self, texts):
        """Ids of each text, or None where the bytes of its tokens are not space + text."""
        ids, counts = self.laid(texts, [chunks(t) for t in texts])
        ends = np.cumsum(np.maximum(counts, 0))
        return [None if n < 0 else ids[end - n : end].tolist() for end, n in zip(ends, counts)]


def _laid(found):
    """Lists of ids in one array, and their lengths, -1 for None."""
    counts = np.array([-1 if x is None else len(x) for x in found], dtype=np.int64)
    ids = itertools.chain.from_iterable(x for x in found if x is not None)
    return np.fromiter(ids, np.int64, int(np.maximum(counts, 0).sum())), counts


def _gathered(values, first, counts):
    """Runs of values, one after the other: `counts` values (none if negative) from each place on."""
    counts = np.maximum(counts, 0)
    before = np.cumsum(counts) - counts
    return values[np.repeat(first - before, counts) + np.arange(counts.sum())]


# What may follow an id in the text of groups: the next id of its side, the other side, the next group, nothing.
_ENDS = (",", "|", ";", "")
_NEXT, _SIDE, _GROUP, _LAST = range(len(_ENDS))


class Block:
    """The tokens of some texts, laid end to end: ids, interval ends and groups of both sides."""

    def __init__(self, sides, texts):
        kept = [k for k, t in enumerate(texts) if t]
        some = [texts[k] for k in kept]
        cut = [chunks(t) for t in some]
        found = [side.laid(some, cut) for side in sides]
        both = (found[0][1] >= 0) & (found[1][1] >= 0)
        self.ids = [ids[np.repeat(both, np.maximum(n, 0))] for ids, n in found]
        self.counts = [np.zeros(len(texts), dtype=np.int64) for _ in sides]
        for counts, (_, n) in zip(self.counts, found):
            counts[kept] = np.where(both, n, 0)
        self.cuts = [np.concatenate(([0], np.cumsum(c))) for c in self.counts]
        self.ends = [np.cumsum(side.sizes[x]) if len(x) else x for side, x in zip(sides, self.ids)]
        self.starts = [e - side.sizes[x] for side, x, e in zip(sides, self.ids, self.ends)]
        self._coalesce()

    def _coalesce(self):
        side = np.repeat([0, 1], [len(x) for x in self.ids])
        start, end = np.concatenate(self.starts), np.concatenate(self.ends)
        order = np.lexsort((side, start))
        side, start = side[order], start[order]
        reach = np.maximum.accumulate(end[order]) if len(order) else end
        breaks = np.ones(len(order), dtype=bool)
        breaks[1:] = start[1:] >= reach[:-1]
        group = np.cumsum(breaks) - 1
        self.group = [group[side == k] for k in (0, 1)]
        # Where the next token starts elsewhere, the pair of tokens that lie over this place is complete.
        whole = np.ones(len(order), dtype=bool)
        whole[:-1] = start[1:] != start[:-1]
        at = [np.cumsum(side == k)[whole] - 1 for k in (0, 1)]
        self.pairs = at  # overlapping tokens, by their place on each side
        together = self.ends[0][at[0]] == self.ends[1][at[1]]
        self.links = [x[together] for x in at]
        self.link_text = np.searchsorted(self.cuts[0], self.links[0], side="right") - 1

    def n_groups(self):
        last = np.concatenate((self.group[0][1:] != self.group[0][:-1], [True])) if len(self.group[0]) else self.group[0]
        return np.add.reduceat(np.append(last.astype(np.int64), 0), self.cuts[0][:-1]) * (self.counts[0] > 0)

    def group_texts(self, sides):
        """`a1,a2|b1;a3|b2,b3` for each text."""
        total = [len(x) for x in self.ids]
        groups = int(self.group[0][-1]) + 1 if total[0] else 0
        before = [np.concatenate(([0], np.cumsum(np.bincount(g, minlength=groups)))) for g in self.group]
        place = [np.arange(total[k]) + before[1 - k][self.group[k] + k] for k in (0, 1)]
        out = np.empty(sum(total), dtype=object)
        for k, close in ((0, _SIDE), (1, _GROUP)):
            end = np.full(total[k], _NEXT)
            end[before[k][1:] - 1] = close
            if k:
                end[self.cuts[1][1:][self.counts[1] > 0] - 1] = _LAST
            out[place[k]] = sides[k].names[end, self.ids[k]]
        cuts = self.cuts[0] + self.cuts[1]
        return ["".join(out[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _sides(a_path, b_path):
    # The driver alone opens the files; tasks get their content.
    return Side(ByteBpe, _content(a_path)), Side(PieceBpe, _content(b_path))


def _content(path):
    with open(path, "rb") as file:
        return file.read()


def _blocks(sides, column):
    """(first row, Block) of about `BLOCK` bytes of text each."""
    _, places = words.text_bytes(column)
    texts = column.to_pylist()
    for first, last in words.blocks(places, BLOCK):
        yield first, Block(sides, [t or "" for t in texts[first:last]])


def _lists(values, cuts):
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)


_GROUPS = "array<struct<start:long,end:long,a:array<int>,b:array<int>>>"
_OVERLAPS = "array<struct<a:int,b:int,linked:boolean>>"


def _structures(sides, column):
    parts = []
    for _, block in _blocks(sides, column) if len(column) else [(0, Block(sides, []))]:
        opens = [np.flatnonzero(np.diff(g, prepend=-1)) for g in block.group]
        cuts = [np.append(o, len(g)) for o, g in zip(opens, block.group)]
        lists = [_lists(pa.array(ids.astype(np.int32)), c) for ids, c in zip(block.ids, cuts)]
        start = block.starts[0][opens[0]]
        end = np.append(start[1:], block.ends[0][-1:])
        text = np.searchsorted(block.cuts[0], opens[0], side="right") - 1
        base = np.concatenate(([0], block.ends[0]))[block.cuts[0][:-1]]  # where each text begins in the block
        spans = [pa.array(x - base[text]) for x in (start, end)]
        groups = pa.StructArray.from_arrays([*spans, *lists], ["start", "end", "a", "b"])
        over = np.searchsorted(block.cuts[0], block.pairs[0], side="right") - 1
        linked = block.ends[0][block.pairs[0]] == block.ends[1][block.pairs[1]]
        own = [pa.array((x - c[over]).astype(np.int32)) for x, c in zip(block.pairs, block.cuts)]
        pairs = pa.StructArray.from_arrays([*own, pa.array(linked)], ["a", "b", "linked"])
        rows = np.arange(len(block.counts[0]) + 1)
        columns = [_lists(groups, np.searchsorted(text, rows)), _lists(pairs, np.searchsorted(over, rows))]
        parts.append(pa.StructArray.from_arrays(columns, ["groups", "overlaps"]))
    return pa.concat_arrays(parts)


def align_tokens(docs, text_col="text", a_path=BYTE_BPE, b_path=PIECE_BPE):
    """row; groups: byte span and ids of both sides; overlaps: places of overlapping tokens of a text, and whether they end together."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_sides(a_path, b_path))

    @F.arrow_udf(f"struct<groups:{_GROUPS},overlaps:{_OVERLAPS}>")
    def aligned(text: pa.Array) -> pa.Array:
        return _structures(shared.value, text)

    found = packed(docs, text=text_col).withColumn("found", aligned("text"))
    return found.select("row", "found.groups", "found.overlaps")


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _digests(sides, batches, width, kind):
    """For each document its numbers, the digest of its groups, and its distinct linked pairs with their times."""
    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("doc_id")
        for first, block in _blocks(sides, batch.column("text")):
            rows = len(block.counts[0])
            key = _pair_key(block, width)
            span = int(key.max()) + 1 if len(key) else 1
            found, times = np.unique(block.link_text * span + key, return_counts=True)
            cuts = np.searchsorted(found, np.arange(rows + 1) * span)
            sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in block.group_texts(sides)]
            numbers = [*block.counts, block.n_groups(), np.bincount(block.link_text, minlength=rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((task << 33) + row + np.arange(rows)),
                    ids.slice(first, rows),
                    *(pa.array(x.astype(np.int64)) for x in numbers),
                    pa.array(sha, pa.string()),
                    _lists(pa.array(found % span).cast(kind), cuts),
                    _lists(pa.array(times.astype(np.int32)), cuts),
                ],
                ["row_id", "doc_id", *_NUMBERS, "groups_sha256", "pairs", "times"],
            )
            row += rows


def _pair_key(block, width):
    """One number for the two ids of each link."""
    return block.ids[0][block.links[0]] * width + block.ids[1][block.links[1]]


def _frequent(counts, most_pairs):
    """The least count such that at most `most_pairs` pairs have it, among powers of two."""
    sizes = counts.groupBy(F.length(F.bin("count")).alias("bits")).agg(F.count("*").alias("n")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["bits"]):  # at most 64 rows
        total += r["n"]
        if total > most_pairs:
            break
        least = 1 << (r["bits"] - 1)
    return least if least is not None else 1 << 62


class Counts:
    """Counts of the frequent pairs, by sorted key, and the highest count of each B id."""

    def __init__(self, key, count, best, width):
        self.key, self.count, self.best, self.width = key, count, best, width

    def rate(self, pairs, times):
        """Per text: sum of counts, links with the highest count of their B id; pairs that are not in the table."""
        cuts = pairs.offsets.to_numpy().astype(np.int64)
        cuts, low = cuts - cuts[0], cuts[0]
        key = pairs.values.to_numpy()[low : low + cuts[-1]].astype(np.int64)
        n = times.flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), dtype=bool)
        count = np.where(known, self.count[at] if len(self.key) else 0, 0)
        best = known & (count == self.best[key % self.width])
        sums = [np.concatenate(([0], np.cumsum(x)))[cuts] for x in (count * n, best * n, ~known)]
        rest = pa.StructArray.from_arrays([pa.array(key[~known]), pa.array(n[~known])], ["pair", "times"])
        columns = [pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1])), _lists(rest, sums[2])]
        return pa.StructArray.from_arrays(columns, ["count_sum", "n_best", "rest"])


def link_statistics(docs, id_col="doc_id", text_col="text", a_path=BYTE_BPE, b_path=PIECE_BPE, most_pairs=MOST_PAIRS):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document."""
    spark = docs.sparkSession
    ship(spark)
    sides = _sides(a_path, b_path)
    shared = spark.sparkContext.broadcast(sides)
    sizes = [len(side.kind(side.content).bytes_of) for side in sides]
    width = sizes[1]
    kind = "int" if sizes[0] * width < 1 << 31 else "long"
    arrow = pa.int32() if kind == "int" else pa.int64()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"row_id long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
    schema += ", ".join(f"{n} long" for n in _NUMBERS) + f", groups_sha256 string, pairs array<{kind}>, times array<int>"
    texts = reread(rows.mapInArrow(lambda batches: _digests(shared.value, batches, width, arrow), schema))

    pairs = texts.select(F.inline(F.arrays_zip("pairs", "times")))
    counts = pairs.groupBy(F.col("pairs").cast("long").alias("pair")).agg(F.sum("times").alias("count"))
    counts = reread(counts)
    least = _frequent(counts, most_pairs)
    known = counts.where(F.col("count") >= least).toArrow().sort_by("pair")
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("highest"))
    best = np.zeros(width, dtype=np.int64)
    for r in highest.collect():  # at most B's vocabulary
        best[r["b"]] = r["highest"]
    table = spark.sparkContext.broadcast(Counts(known["pair"].to_numpy(), known["count"].to_numpy(), best, width))

    @F.arrow_udf("count_sum long, n_best long, rest array<struct<pair:long,times:long>>")
    def rated(pairs: pa.Array, times: pa.Array) -> pa.Array:
        return table.value.rate(pairs, times)

    found = texts.withColumn("found", rated("pairs", "times")).drop("pairs", "times")
    found = reread(found.select("*", "found.*").drop("found"))
    numbers = ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]
    whole = found.where(F.size("rest") == 0).select(*numbers)
    part = found.where(F.size("rest") > 0)
    rare = part.select("row_id", F.inline("rest")).join(counts.where(F.col("count") < least), "pair")
    top = F.broadcast(highest.withColumnRenamed("b", "b_id"))  # at most B's vocabulary
    rare = rare.withColumn("b_id", F.col("pair") % width).join(top, "b_id")
    more = rare.groupBy("row_id").agg(
        F.sum(F.col("count") * F.col("times")).alias("more_sum"),
        F.sum(F.when(F.col("count") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"),
    )
    part = part.join(more, "row_id").withColumns(
        {"count_sum": F.col("count_sum") + F.col("more_sum"), "n_best": F.col("n_best") + F.col("more_best")}
    )
    return whole.unionByName(part.select(*numbers))
