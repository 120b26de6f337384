"""Hashes of words and windows: built words that polynomials modulo 2^64 take as equal are told apart."""

import numpy as np
import pyarrow as pa
import pytest

from ordermill.llm import words
from ordermill.llm.line_dedup import drop_similar_lines
from ordermill.llm.partenum import jaccard_components
from ordermill.llm.recompression import drop_repeats

FLIP = str.maketrans("ab", "ba")


def thue_morse(length):
    word = "a"
    while len(word) < length:
        word += word.translate(FLIP)
    return word


def hashes(texts, **kind):
    return words.hash_words(*words.text_bytes(pa.array(texts)), **kind)[2].tolist()


@pytest.mark.parametrize("length", [512, 1024, 2048, 4096])
def test_built_words_differ(length):
    word = thue_morse(length)
    found = hashes([word, word.translate(FLIP), f"x {word} y"])
    assert found[0] != found[1] and found[3] == found[0]


def test_a_hash_does_not_depend_on_place_or_block():
    texts = ["é" * n for n in range(1, 30)] + ["Z" * n for n in (words.BLOCK - 1, words.BLOCK, words.BLOCK + 1, 3 * words.BLOCK)]
    together = hashes([" ".join(texts)])
    assert together == hashes(texts) and len(set(together)) == len(texts)
    assert hashes([x.lower() for x in texts[29:]]) == hashes(texts[29:], lower=True)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 8, 35])
def test_rolling_names_windows_alike(size):
    given = np.random.default_rng(size).integers(0, 2, 3000).astype(words.U)
    named = {}
    found = words.rolling(given, size).tolist()
    assert len(found) == 3001 - size
    for at, name in enumerate(found):
        named.setdefault(tuple(given[at : at + size].tolist()), set()).add(name)
    assert all(len(x) == 1 for x in named.values()) and len(set(found)) == len(named)


def test_operators_tell_built_words_apart(spark):
    word = thue_morse(2048)
    rest = " ".join(f"w{k}" for k in range(34))
    one = spark.createDataFrame([(1, word), (2, word.translate(FLIP))], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard_components(one).orderBy("doc_id").collect()] == [1, 2]
    assert {r["n_removed"] for r in drop_similar_lines(one).collect()} == {0}
    many = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{word.translate(FLIP)} {rest}")], "doc_id long, text string")
    assert {r["n_removed"] for r in drop_repeats(many).collect()} == {0}
