"""Secret scans with the ownership of each value over the whole corpus.

Values are found by fixed patterns (the base kinds) and, beyond those, as opaque tokens: runs of 20
or more key characters with a lower-case letter, a capital and a digit that no base match covers.
Of each value only a 64-bit hash leaves the scan. A Spark job counts in how many repositories and
for how many owners each hash occurs. A value that several owners have is a widely copied
example; one that a single owner has looks live. Base matches are always reported, whatever their
ownership; opaque tokens only where they look live, since common ones are identifiers, not keys.

Counts are summed by (value, owner, repository) in each task before they shuffle, so a value in a
third of all rows is no hot group; the scan's spans, a small table, are saved, so texts are read
once.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends
exclusive; a null owner or repository is one of its own; ids may be null or repeat; an empty table
gives an empty result; other columns are carried along.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ordermill.llm.frames import packed, saved, ship

# The patterns of the base kinds, in their order; the group with the value, and the least length.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
OPAQUE = "opaque"
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ORDER = {kind: k for k, kind in enumerate([*KINDS, OPAQUE])}
EXAMPLE_OWNERS = 2


def base_matches(text):
    """(kind, start, end, value) of every base match, by start and kind."""
    found = []
    for kind, (pattern, group, least) in KINDS.items():
        if kind == "hex":
            pattern = _LONG_HEX  # the same runs: shorter ones would be dropped
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end(), m[group]))
    return sorted(found, key=lambda x: (x[1], _ORDER[x[0]]))


def opaque_matches(text, base):
    """Opaque tokens that overlap no base match."""
    found = []
    for m in _OPAQUE.finditer(text):
        token = m[0]
        mixed = token.lower() != token and token.upper() != token and any(c.isdigit() for c in token)
        if mixed and not any(start < m.end() and m.start() < end for _, start, end, _ in base):
            found.append((OPAQUE, m.start(), m.end(), token))
    return found


def _hash(value):
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])


def _scan(column):
    out = []
    for text in column:
        text = text.as_py() or ""
        base = base_matches(text)
        found = base + opaque_matches(text, base)
        out.append([{"kind": k, "start": s, "end": e, "value": _hash(v)} for k, s, e, v in found])
    return pa.array(out, pa.list_(_SPAN))


def find_secrets(docs, id_col="doc_id", text_col="text", owner_col="source", repository_col="doc_id", example_owners=EXAMPLE_OWNERS):
    """key, doc_id and found for each document: an array of (start, rank, kind, end, owners, repositories, live)."""
    ship(docs.sparkSession)
    scan = F.arrow_udf("array<struct<kind:string,start:int,end:int,value:long>>")(_typed_scan)
    rows = packed(docs, doc_id=id_col, text=text_col, owner=owner_col, repository=repository_col)
    rows = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "owner", "repository", scan("text").alias("spans"))
    rows = saved(rows)
    each = rows.select("key", "owner", "repository", F.inline("spans"))
    apart = each.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = apart.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    owned = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    owned = saved(owned)  # so that the join deals out both sides itself and can split a frequent value
    known = each.join(owned, "value").withColumn("live", F.col("owners") < example_owners)
    known = known.where(F.col("live") | (F.col("kind") != OPAQUE))
    rank = F.element_at(F.create_map(*[x for kind, k in _ORDER.items() for x in (F.lit(kind), F.lit(k))]), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", "end", "owners", "repositories", "live")
    spans = known.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("found"))
    return rows.select("key", "doc_id").join(spans, "key", "left").withColumn("found", F.coalesce("found", F.array().cast(spans.schema["found"].dataType)))


def _typed_scan(text: pa.Array) -> pa.Array:
    return _scan(text)


def span_text(spans):
    """`kind:start:end` of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
