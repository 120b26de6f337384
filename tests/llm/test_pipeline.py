"""The pipeline: its stages, and each stage's decisions on its own input."""

import corpus_pipeline
from tests_llm_helpers import jaccard_groups, norm

from ordermill.llm.frames import reread

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "poisson_mix"]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs, rows = given, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = reread(stage(spark, docs, SF))
        rows[name] = docs.collect()
        if name != "poisson_mix":
            assert docs.columns == given.columns
    texts = lambda name: {r["doc_id"]: r["text"] for r in rows[name]}
    first = {r["doc_id"]: r["text"] for r in given.collect()}
    assert texts("language_id") == {k: x for k, x in first.items() if x and any(c.isalpha() for c in x)}
    least = {}
    for k, x in sorted(texts("language_id").items()):
        least.setdefault(norm(x), k)
    assert set(texts("exact_dedup")) == set(least.values())
    groups = jaccard_groups(texts("exact_dedup"), 5, 80)
    assert set(texts("ngram_jaccard_join")) == {k for k, top in groups.items() if k == top}
    items = [norm(r["text"]).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(texts("ngram_jaccard_join")) - set(texts("decontamination"))
    hold = {k for k, x in texts("ngram_jaccard_join").items() if any(i in norm(x).lower() for i in items)}
    assert hold and hold <= gone
    ids = {r["doc_id"] for r in rows["poisson_mix"]}
    assert ids <= set(texts("decontamination"))
    for r in rows["poisson_mix"]:
        assert r["text"] == first[r["doc_id"]]


def through(spark, docs, benchmark, folder):
    """The results of all stages on given rows."""
    docs.write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, folder)


KIND = "doc_id long, text string, lang string, source string, copy int, Place string"
WORDS = {"aa": "mara tala nara ", "bb": "xix vox pyx "}


def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_without_a_labelled_row_nothing_with_letters_goes(spark, tmp_path):
    given = spark.createDataFrame([(1, "one two three", None, "s", 5, "x"), (2, "12", None, "s", 5, "x"), (3, None, None, None, None, None)], KIND)
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, given, SF).collect()] == [1]
    found = through(spark, given, benchmark(spark), str(tmp_path))
    assert found.columns == ["doc_id", "text", "lang", "source", "copy", "Place", "copy_", "place_"]
    assert {(r["doc_id"], r["copy"], r["Place"]) for r in found.collect()} <= {(1, 5, "x")}


def test_texts_far_from_all_known_languages_go(spark):
    rows = [(k, f"{WORDS[lang] * 5} {k}", lang, "s", 1, "x") for k, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100, "世界 你好 " * 9, None, "s", 1, "x"), (101, WORDS["aa"] * 2, None, "s", 1, "x"), (None, WORDS["bb"] * 9, None, None, 1, "x")]
    found = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, KIND), SF)
    assert {r["doc_id"] for r in found.collect()} == {k for k, *_ in rows} - {100}


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, WORDS["aa"] * 40, "aa", "s", 1, "x")] * 3 + [(None, WORDS["bb"] * 40, "bb", None, 1, "x")] * 2
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, spark.createDataFrame(rows, KIND), SF), SF)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1]
    empty = through(spark, spark.createDataFrame([], KIND), benchmark(spark).limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns[-2:] == ["copy_", "place_"]
