"""Removal of repeated windows against a direct count of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermill.llm import queries, words
from ordermill.llm.recompression import drop_repeats, parse

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts, size=35):
    """[(n_words, n_removed, kept_sha256)] in the order of the texts."""
    found = [split(x) for x in texts]
    seen = Counter(tuple(w[k : k + size]) for w in found for k in range(len(w) - size + 1))
    out = []
    for w in found:
        gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def result(frame):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect()}


def test_query_against_all_windows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    wanted = brute([r["text"] for r in rows])
    assert result(queries.QUERIES["op5_recompression"](spark, SF)) == {r["doc_id"]: w for r, w in zip(rows, wanted, strict=True)}


@pytest.mark.parametrize("size", [5, 35])
def test_planted_passages_runs_and_periods(spark, size):
    dice = random.Random(size)
    word = lambda n: f"w{dice.randrange(n)}"
    passages = [[word(50) for _ in range(n)] for n in (size - 1, size, size + 1, 3 * size, 200)]
    passages += [["a"] * (2 * size), ["a", "b"] * size, ["x"] * (size - 1)]
    texts = []
    for _ in range(120):
        parts = [[word(5000) for _ in range(dice.randrange(30))]]
        for _ in range(dice.randrange(3)):
            parts += [dice.choice(passages), [word(5000) for _ in range(dice.randrange(12))]]
        texts.append(dice.choice([" ", "\n", "\t "]).join(x for p in parts for x in p))
    texts += [texts[0], None, "", " \n", "one", " ".join(["a"] * 60_000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert result(drop_repeats(frame, size=size)) == dict(enumerate(brute(texts, size)))


def test_defined_results(spark):
    long = " ".join(f"t{k}" for k in range(40))
    frame = spark.createDataFrame([(None, long), (1, long), (1, long), (2, "B b")], "doc_id long, text string")
    frame = frame.withColumns({"KEY": F.lit(1), "places": F.lit(2)})
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in drop_repeats(frame).collect())
    assert found == [(0, 40, 40), (1, 40, 40), (1, 40, 40), (2, 2, 0)]
    assert drop_repeats(frame.limit(0)).collect() == []


def test_symbols_depend_on_their_range_only():
    """Words outside of a symbol's range may be others without changing the symbol."""
    dice = random.Random(3)
    text = np.array([dice.randrange(6) for _ in range(400)], dtype=words.U)
    symbols = parse(words.mix(text), np.zeros(400, dtype=int))
    known = dict(zip(symbols.first.tolist(), symbols.names.tolist(), strict=True))
    for at, low, high in list(zip(symbols.first, symbols.low, symbols.high, strict=True))[12:-12]:
        other = np.array([dice.randrange(6) for _ in range(400)], dtype=words.U)
        other[low : high + 1] = text[low : high + 1]
        changed = parse(words.mix(other), np.zeros(400, dtype=int))
        assert dict(zip(changed.first.tolist(), changed.names.tolist(), strict=True))[at] == known[at]


def test_words_are_split_at_the_six_spaces_only():
    texts = ["a\x0bb\x0cc", "\x1cd e f", "", "g" * 3_000_000 + " h", "G g"]
    import pyarrow as pa

    data, places = words.text_bytes(pa.array(texts))
    starts, ends, hashes, cuts = words.hash_words(data, places)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in split(t)]
    assert np.diff(cuts).tolist() == [3, 2, 0, 2, 2]
    assert len(set(hashes.tolist())) == 9
    assert len(set(words.hash_words(data, places, lower=True)[2].tolist())) == 8
