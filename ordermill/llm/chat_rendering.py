"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing is known about
it: the conversation's prefixes of 1, 2, 3, ... turns are rendered, and each output is compared
with the one before. What is new is the turn's span. Inside it the text is located by rendering
the turn again with two probe texts, "a" and "b": the outputs agree up to the text and after it.
If an output does not begin with the one before, the template has rewritten history (such as
dropping earlier reasoning); this is flagged, and the turn has no span.

The conversations are grouped once, by id, with the turns sorted inside their group; rendering
is per conversation and keeps only two outputs. A conversation is one training example and must
fit into a task, as its rendering does; many conversations are spread by id, whatever their
contents. Prefixes of a conversation of n turns are rendered from n lists, so time grows with n
times its length.

Defined results: a null text or role is empty; a null turn comes last; rows that repeat a turn
are turns of their own, in the order of role and text; rows without an id are one conversation;
an empty table gives an empty result; other columns are ignored.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ordermill.llm.frames import packed, ship

# The control strings of the template below.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)


def escape(text):
    """A text without control strings: a backslash is put into each `<|` and doubled elsewhere."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text):
    return re.sub(r"\\([\\|])", r"\1", text)


def escape_line(text):
    """A role is one line."""
    return escape(text).replace("\n", "\\n")


def unescape_line(line):
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], line)


def marked_turns(turns):
    """The default template: each turn between its marks."""
    return "".join(f"{OPEN}{escape_line(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def common_start(a, b):
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low if low == high or a[low:high] != b[low:high] else high


def locate(template, turns):
    """The rendering of all turns, and for each turn (start, text start, text end, end) or None."""
    spans, before = [], ""
    for k, (role, _) in enumerate(turns):
        output = template(turns[: k + 1])
        if not output.startswith(before):
            spans.append(None)
        else:
            probes = [template([*turns[:k], (role, probe)]) for probe in "ab"]
            head = common_start(*probes)
            tail = common_start(probes[0][:head - 1 : -1] if head else probes[0][::-1], probes[1][:head - 1 : -1] if head else probes[1][::-1])
            if head < len(before) or head + tail > len(output) or output[:head] != probes[0][:head]:
                spans.append(None)
            else:
                spans.append((len(before), head, len(output) - tail, len(output)))
        before = output
    return before, spans


def _rendered(batches, template, trained):
    names = ["conv_id", "formatted", "starts", "text_starts", "text_ends", "ends", "roles", "trained", "rewrites_history"]
    for batch in batches:
        columns = [[] for _ in names[1:]]
        for turns in batch.column("turns").to_pylist():
            turns = [(t["role"], t["text"]) for t in turns]
            text, spans = locate(template, turns)
            known = [s or (None,) * 4 for s in spans]
            parts = [list(x) for x in zip(*known, strict=True)] if known else [[]] * 4
            roles = [role for role, _ in turns]
            values = [text, *parts, roles, [r in trained for r in roles], None in spans]
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        lists = [pa.array(c, pa.list_(pa.int64())) for c in columns[1:5]]
        arrays = [pa.array(columns[0], pa.string()), *lists, pa.array(columns[5], pa.list_(pa.string()))]
        arrays += [pa.array(columns[6], pa.list_(pa.bool_())), pa.array(columns[7], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], names)


def render(rows, template=marked_turns, trained=TRAINED, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """One row per conversation: conv_id, formatted, and lists by turn.

    The lists are starts, text_starts, text_ends, ends (code points of `formatted`; null for a turn
    without a span), roles, and trained, which is true where the text is under the loss mask.
    """
    ship(rows.sparkSession)
    empty = F.lit("")
    turns = packed(
        rows, conv_id=conv_col, turn=turn_col, role=F.coalesce(F.col(role_col), empty), text=F.coalesce(F.col(text_col), empty)
    ).drop("row")
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    lists = "starts array<long>, text_starts array<long>, text_ends array<long>, ends array<long>"
    schema = f"conv_id {dict(rows.dtypes)[conv_col]}, formatted string, {lists}, roles array<string>, trained array<boolean>, rewrites_history boolean"
    return grouped.mapInArrow(lambda b: _rendered(b, template, trained), schema)


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def read_turns(formatted):
    """(role, text) of each turn, read back from an output of the default template."""
    return [(unescape_line(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _digests(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            turns = read_turns(row["formatted"])
            spans = zip(row["trained"], row["text_starts"], row["text_ends"], strict=True)
            loss = "".join(unescape(row["formatted"][a:b]) for on, a, b in spans if on and a is not None)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
            rows.append((len(turns), digest(whole), len(loss), digest(loss), len(row["formatted"]), row["rewrites_history"]))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], names)


def digests(rendered):
    """What the outputs of the default template say, read back: one row of digests per conversation."""
    ship(rendered.sparkSession)
    schema = f"conv_id {dict(rendered.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    return rendered.mapInArrow(_digests, schema)
