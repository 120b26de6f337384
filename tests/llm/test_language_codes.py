"""Language ID: accuracy on rows that training never saw, codewords, and defined results."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordermill.llm import queries
from ordermill.llm.language_codes import PAD, Model, codewords, fit, identify, letters

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_language_codes"](spark, SF).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert len(held) > 200 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


@pytest.mark.parametrize("count", [2, 3, 4, 5, 6, 12])
def test_codewords_are_apart(count):
    code = codewords(count)
    apart = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
    assert set(np.unique(code)) == {-1.0, 1.0} and min(apart) >= max(1, code.shape[1] // 4)


def test_decoding_corrects_one_wrong_bit():
    code = codewords(4)
    model = Model(list("abcd"), code, None, np.ones(7), np.ones(7))
    for k, word in enumerate(code):
        for bit in range(7):
            wrong = word.copy()
            wrong[bit] *= -0.5
            assert model.decode(wrong[None])[0][0] == k
    assert model.decode(np.zeros((1, 7)))[2][0] == 0  # all codewords are as near


def test_sums_do_not_depend_on_the_batch():
    texts = [" one two" + PAD, " " + "ab " * 700_000 + PAD, " three" + PAD]
    model = Model(list("ab"), codewords(2), np.random.default_rng(1).normal(size=(3 << 15, 1)).astype(np.float32), np.ones(1), np.ones(1))
    together = model.sides(pa.array(texts))
    assert np.allclose(together, np.concatenate([model.sides(pa.array([x])) for x in texts]), atol=1e-9)


def test_short_texts_in_one_block_do_not_reach_into_each_other():
    texts = [f" {x}{PAD}" for x in ("a", "one two", "", "xyz", "é", "w " * 40, "b")]
    model = Model(list("ab"), codewords(2), np.random.default_rng(1).normal(size=(3 << 15, 1)).astype(np.float32), np.ones(1), np.ones(1))
    together = model.sides(pa.array(texts))
    assert np.allclose(together, np.concatenate([model.sides(pa.array([x])) for x in texts]), rtol=0, atol=1e-12)


def test_defined_results(spark):
    words = {"aa": "mara tala nara ", "bb": "xix vox pyx "}
    rows = [(k, words[lang] * 5, lang) for k, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(100, None, "aa"), (101, "", "aa"), (102, "123 !? \n", None), (103, "xix" * 500_000, None), (None, "tala nara", None), (104, "VOX PYX", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"LETTERS": F.lit(1), "padded": F.lit(2)})
    found = {r["doc_id"]: (r["lang_pred"], r["score"] > 0, r["ambiguous"]) for r in identify(frame).where("doc_id IS NULL OR doc_id >= 100").collect()}
    assert found == {100: ("und", False, True), 101: ("und", False, True), 102: ("und", False, True), 103: ("bb", True, False), None: ("aa", True, False), 104: ("bb", True, False)}
    assert identify(frame.limit(0)).collect() == []
    one = identify(frame.where("lang IS NULL OR lang = 'aa'"))
    assert {r["lang_pred"] for r in one.collect()} == {"aa", "und"}
    none = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(none).collect()} == {"und"}


def test_held_out_rows_are_not_learned(spark):
    frame = spark.createDataFrame([(k, "abc", "x" if zlib.crc32(str(k).encode()) % 4 == 2 else "y") for k in range(200)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in identify(frame).collect()} == {"y"}
    assert fit(frame.limit(0).withColumn("letters", letters(F.col("text"))).withColumn("padded", F.col("letters"))) is None
