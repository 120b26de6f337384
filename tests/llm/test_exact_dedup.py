"""Exact dedup: groups by hand, and a filter so small that it lets everything through."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ordermill.llm import bloom
from ordermill.llm.exact_dedup import exact_dedup, first_copies


def wanted(rows):
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, (_, t) in enumerate(rows)}
    out = []
    for k, (i, _) in enumerate(rows):
        same = [j for j in norm if norm[j] == norm[k]]
        ids = [rows[j][0] for j in same if rows[j][0] is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(same), hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (4, "a b"), (7, None), (8, ""), (8, ""), (1, "é"), (2, "É"), (None, "a b"),
        (10, "\x0b\x0c"), (11, " "), (12, " "), (13, "long " * 300_000), (6, "long  " * 300_000), (None, "alone"), (14, "x\x1cy"), (15, "x y")]


@pytest.mark.parametrize("most_words", [1, bloom.MOST_WORDS])
def test_groups(spark, most_words, monkeypatch):
    monkeypatch.setattr(bloom.of_repeats, "__defaults__", (most_words,))
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({"KEY": F.lit(1), "kept": F.lit("x")})
    found = exact_dedup(frame).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == wanted(ROWS)
    kept = {}
    for r in found:
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    first = first_copies(frame)
    assert first.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in first.collect()) == sorted(str(r["doc_id"]) for r in found if r["kept"])


def test_a_large_group_and_an_empty_table(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup(frame)
    assert found.where("kept").count() == 2001
    assert found.where("group_size = 1000 AND keep_id = 0").count() == 1000
    assert exact_dedup(frame.limit(0)).collect() == [] and first_copies(frame.limit(0)).collect() == []


def test_only_possible_copies_are_shuffled(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 19_990).cast("string").alias("text"))
    rows = frame.select("doc_id", F.xxhash64("text").alias("key"))
    maybe = bloom.of_repeats(rows, "key", 20_000).tested(rows, "key", "maybe").where("maybe").count()
    assert 20 <= maybe < 400
