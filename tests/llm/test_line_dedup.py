"""Line dedup against the comparison of every line with all earlier ones."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ordermill.llm import queries
from ordermill.llm.line_dedup import drop_similar_lines

SF = "/root/testdata/sf0.001"


def brute(texts):
    """[(n_lines, n_removed, kept_sha256)] of texts in the order of their ids."""
    earlier, out = [], []
    for text in texts:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            own = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            match = own and any(
                min(len(own), len(x)) * 10 >= max(len(own), len(x)) * 8 and len(own & x) * 10 >= len(own | x) * 8 for x in earlier
            )
            if own:
                earlier.append(own)
            if not match:
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def result(frame):
    return {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in frame.collect()}


def test_query_against_all_lines(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    wanted = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows]), strict=True))
    assert result(queries.QUERIES["op6_line_dedup"](spark, SF)) == wanted


def test_near_copies_of_lines(spark):
    dice = random.Random(5)
    bases = [[f"w{dice.randrange(300)}" for _ in range(dice.choice([1, 2, 3, 4, 5, 6, 10, 25, 60]))] for _ in range(40)]
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(dice.randrange(6)):
            line = list(dice.choice(bases))
            for _ in range(dice.choice([0, 0, 1, 2])):
                line[dice.randrange(len(line))] = f"w{dice.randrange(300)}"
            dice.shuffle(line)
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "a\rb\n a  b \n", "x" * 2_000_000, " ".join(f"u{k}" for k in range(50_000)) + "\n" + texts[1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert result(drop_similar_lines(frame)) == dict(enumerate(brute(texts)))


def test_defined_results(spark):
    line = "one two three four five"
    frame = spark.createDataFrame([(None, line), (7, line), (7, line), (9, line + " six\nother")], "doc_id long, text string")
    frame = frame.withColumns({"KEY": F.lit(1), "gone": F.lit(2)})
    found = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in drop_similar_lines(frame).collect())
    assert found == [(0, 1, 1), (7, 1, 0), (7, 1, 0), (9, 2, 1)]
    assert drop_similar_lines(frame.limit(0)).collect() == []


def test_sets_move_only_for_lines_that_can_match(spark, monkeypatch):
    from ordermill.llm import line_dedup

    compared = []
    whole = line_dedup.verified

    def counted(pairs, sets, threshold):
        compared.append(pairs.distinct().count())
        return whole(pairs, sets, threshold)

    monkeypatch.setattr(line_dedup, "verified", counted)
    # All lines begin with the rarest word, but their sizes rule a match out, but for the last two.
    lines = ["rare " + " ".join(f"w{k}" for k in range(n)) for n in (2, 6, 14, 30, 62)]
    texts = [(0, "\n".join(lines)), (1, lines[-1] + " more"), (2, "\n".join(f"w{k}" for k in range(62)))]
    found = line_dedup.drop_similar_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()} == {0: 0, 1: 1, 2: 0}
    assert sum(compared) <= 2


def test_only_sets_that_a_pair_names_move(spark, monkeypatch):
    from ordermill.llm import line_dedup

    moved = []
    whole = line_dedup.verified

    def counted(pairs, sets, threshold):
        moved.append(sets.count())
        return whole(pairs, sets, threshold)

    monkeypatch.setattr(line_dedup, "verified", counted)
    # Two words at each place of a line's prefix tie all lines together, but only two are near to each other.
    lines = [f"left right {' '.join(f'v{k}x{j}' for j in range(30))}" for k in range(40)]
    texts = [(k, x) for k, x in enumerate(lines)] + [(40, lines[3] + " more")]
    found = line_dedup.drop_similar_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert [r["doc_id"] for r in found.collect() if r["n_removed"]] == [40]
    assert sum(moved) <= 8
