"""Token alignment against a plain walk over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermill.llm import queries, token_alignment as ta

SF = "/root/testdata/sf0.001"
SIDES = ta._sides(ta.BYTE_BPE, ta.PIECE_BPE)


def ends(side, ids):
    return list(np.cumsum([len(side.tool().bytes_of[k]) for k in ids]))


def aligned(text):
    """(ids of A, ids of B, groups, links) of one text, by the definition."""
    if not text:
        return [], [], [], []
    a, b = SIDES[0].tool().encode([text])[0], SIDES[1].tool().encode([text])[0]
    if any(b"".join(s.tool().bytes_of[k] for k in ids) != b" " + text.encode() for s, ids in zip(SIDES, (a, b))):
        return [], [], [], []
    ea, eb = ends(SIDES[0], a), ends(SIDES[1], b)
    groups, shared, i, j = [], sorted(set(ea) & set(eb)), 0, 0
    for cut in shared:
        p, q = ea.index(cut, i) + 1, eb.index(cut, j) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    by_end = dict(zip(eb, b))
    return a, b, groups, [(k, by_end[e]) for k, e in zip(a, ea) if e in by_end]


def wanted(texts):
    found = [aligned(t) for t in texts]
    counts = Counter(pair for f in found for pair in f[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, groups, links in found:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == best[p[1]] for p in links)
        out.append((len(a), len(b), len(groups), len(links), n_best, sum(counts[p] for p in links), sha))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", "a", " ", "  two  spaces ", "▁mark", "<s> </s> <unk> <0x41> <|endoftext|>", "é é ﬁ Å", "🤦🏼‍♂️ 漢字",
    "\x00a\tb\r\n\n", "x" * 300, "word " * 30_000, "same text", "same text", "Zażółć gęślą jaźń", "﻿start",
]


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in rows), wanted([r["text"] for r in rows])))
    got = queries.QUERIES["op12_token_alignment"](spark, SF)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


@pytest.mark.parametrize("most_pairs", [0, 3, 40, 1 << 20])
def test_rare_pairs_are_joined(spark, most_pairs):
    frame = spark.createDataFrame(list(enumerate(ODD)), "id long, body string").repartition(3)
    got = ta.link_statistics(frame, "id", "body", most_pairs=most_pairs).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == dict(enumerate(wanted(ODD)))


def test_remembered_chunks_give_the_tokens_of_whole_texts(monkeypatch):
    side = ta._sides(ta.BYTE_BPE, ta.PIECE_BPE)[0]
    assert side.tool().by_chunk and ta._crosses(b"a b") and not ta._crosses("\u00a0 x".encode())
    pieces = ["word", "it's", " ", "  ", "\n", "\t ", "\u00a0", " \u2003", "1,200.5", "é", "漢字", "!?", "\x1c", "\x85", "<|endoftext|>", "don't", "end."]
    random = np.random.default_rng(5)
    texts = ["".join(random.choice(pieces, 12)) for _ in range(300)] + [" ".join(random.choice(pieces, 12)) for _ in range(300)] + [t for t in ODD if t]
    whole = list(side._checked(texts))
    assert all("".join([" " + c for c in ta.chunks(t)]) == " " + t for t in texts)
    monkeypatch.setattr(ta, "REMEMBERED", 20)
    assert [x for k in range(0, len(texts), 7) for x in side.tokens(texts[k : k + 7])] == whole


def test_side_b_tokenizes_a_chunk_once(monkeypatch):
    side = ta._sides(ta.BYTE_BPE, ta.PIECE_BPE)[1]
    assert side.tool().by_chunk
    pieces = ["word", "it's", " ", "  ", "\n", "\t ", "\u00a0", "\u2003", "é", "ﬁ", "漢字", "▁", "\x1c", "<s>", "<0x41>", "don't", "end."]
    random = np.random.default_rng(6)
    texts = ["".join(random.choice(pieces, 9)) for _ in range(300)] + [" ".join(random.choice(pieces, 5)) for _ in range(300)] + [t for t in ODD if t]
    whole = list(side._checked(texts))
    assert any(x is None for x in whole) and any(x for x in whole)
    monkeypatch.setattr(ta, "REMEMBERED", 20)
    assert [x for k in range(0, len(texts), 7) for x in side.tokens(texts[k : k + 7])] == whole
    given, encode = [], side.tool().encode
    monkeypatch.setattr(side.tool(), "encode", lambda texts: given.extend(texts) or encode(texts))
    side.tokens(["fresh words here"] * 50)
    side.tokens(["fresh here words"] * 50)
    assert sum(map(len, given)) == len("fresh words here")


def test_blocks_do_not_matter(monkeypatch):
    whole = ta.Block(SIDES, [t or "" for t in ODD])
    for text, shown, count in zip(ODD, whole.group_texts(SIDES), whole.n_groups()):
        alone = ta.Block(SIDES, [text or ""])
        assert alone.group_texts(SIDES) == [shown] and alone.n_groups()[0] == count
        assert count == len(aligned(text)[2])


def test_groups_and_overlaps(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumns({"groups": F.lit(1), "FOUND": F.lit(2)})
    for r in ta.align_tokens(frame).collect():
        a, b, groups, links = aligned(r["row"]["text"])
        assert [(list(g["a"]), list(g["b"])) for g in r["groups"]] == groups and r["row"]["groups"] == 1
        assert [g["end"] for g in r["groups"]] == sorted(set(ends(SIDES[0], a)) & set(ends(SIDES[1], b)))
        assert [g["start"] for g in r["groups"]] == [0, *[g["end"] for g in r["groups"]]][: len(groups)]
        assert [(a[p["a"]], b[p["b"]]) for p in r["overlaps"] if p["linked"]] == links
        ea, eb = [0, *ends(SIDES[0], a)], [0, *ends(SIDES[1], b)]
        if len(a) < 400:
            over = [(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] < eb[j + 1] and eb[j] < ea[i + 1]]
            assert sorted((p["a"], p["b"]) for p in r["overlaps"]) == over


def test_empty_and_ids(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None), (7, "a b")], "doc_id int, text string")
    assert ta.link_statistics(frame.limit(0)).collect() == [] and ta.align_tokens(frame.limit(0)).collect() == []
    got = sorted(((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in ta.link_statistics(frame).collect()))
    assert got == [(0, 2, 6), (0, 2, 6), (7, 0, 0), (7, 2, 6)]


def test_paths_are_parameters(spark, tmp_path):
    for name, path in (("a.json", ta.BYTE_BPE), ("b.model", ta.PIECE_BPE)):
        (tmp_path / name).write_bytes(ta._content(path))
    frame = spark.createDataFrame([(1, "other folder")], "doc_id long, text string")
    found = ta.link_statistics(frame, a_path=str(tmp_path / "a.json"), b_path=str(tmp_path / "b.model"))
    assert found.first()["n_a"] == len(aligned("other folder")[0])
