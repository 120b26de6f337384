"""Exact dedup by two passes over a Bloom filter.

Texts are equal when identical after each run of space, tab, line feed, vertical tab, form feed
or carriage return has become one space. Pass one hashes every text and enters the hashes that
come up again into a Bloom filter of bounded size. Pass two tests every text: those that the
filter does not hold are surely alone and go straight through; only the others are shuffled, by
the SHA-256 of the text. Groups are summed before they shuffle and joined back, where adaptive
execution splits a large group, so a text with a third of all rows takes no single task.

Defined results: a null text counts as empty, and all empty texts are one group; the smallest
doc_id of a group stays and a null one counts as the largest; of rows that repeat both doc_id and
text exactly one stays; an empty table gives an empty result; other columns are carried along.
"""

from pyspark.sql import Window, functions as F

from ordermill.llm import bloom
from ordermill.llm.frames import packed, saved


def normal_text(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _split(docs, id_col, text_col):
    """Rows that are surely alone, and those that may have a copy."""
    rows = packed(docs, doc_id=id_col, text=normal_text(F.col(text_col))).withColumn("key", F.xxhash64("text"))
    repeats = bloom.of_repeats(rows, "key", docs.count())
    tested = repeats.tested(rows, "key", "again").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    tested = tested.select("row", "doc_id", "text_sha256", "again")
    return tested.where(~F.col("again")).drop("again"), tested.where("again").drop("again")


def _grouped(again):
    """Each row with the id that stays and the size of its group."""
    groups = again.groupBy("text_sha256").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"),
        F.count("*").alias("group_size"),
    )
    # Saved, so that the join deals out both sides itself and can split a large group.
    groups = saved(groups.select("text_sha256", F.col("first.doc_id").alias("keep_id"), "group_size"))
    return again.join(groups, "text_sha256")


def _first_of_its_id():
    # One struct, so that rows of a large group are dealt out anew and the join before can be split.
    return F.row_number().over(Window.partitionBy(F.struct("text_sha256", "doc_id")).orderBy(F.lit(0))) == 1


def exact_dedup(docs, id_col="doc_id", text_col="text"):
    """One row per document: row, doc_id, keep_id, group_size, kept, text_sha256."""
    alone, again = _split(docs, id_col, text_col)
    alone = alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    again = _grouped(again).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & _first_of_its_id())
    return alone.unionByName(again)


def first_copies(docs, id_col="doc_id", text_col="text"):
    """The input rows that stay, in the columns of the input."""
    alone, again = _split(docs, id_col, text_col)
    first = _grouped(again).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = first.withColumn("one", _first_of_its_id()).where("one")
    return alone.select("row").unionByName(kept.select("row")).select("row.*")
