"""From raw documents to a training mixture in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next stage's docs. All but the last return the
columns of documents.

Defined results: documents whose text is null or has no letter go in the first stage, as do those
that are near to no language of the labelled rows; where no row is labelled, all with letters stay.
Of rows that repeat id and text one stays. Ids, languages and sources may be null. Other columns
are carried along; where one is named `copy` or `place`, the last stage's own column of that name
gets an underscore at its end. An empty table gives an empty result with all columns.
"""

from ordermill.llm.exact_dedup import first_copies
from ordermill.llm.frames import beside, reread, table
from ordermill.llm.language_codes import identify
from ordermill.llm.partenum import one_of_each
from ordermill.llm.poisson_mix import mix_sources
from ordermill.llm.template_decontamination import without_benchmark


def language_id(spark, docs, sf_dir):
    """Documents near a language that the classifiers know; the others and those without a letter go."""
    return identify(docs).where("NOT rejected").select("row.*")


def exact_dedup(spark, docs, sf_dir):
    """The first of each group of equal texts."""
    return first_copies(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies: word 5-grams, Jaccard similarity of at least 0.8."""
    return one_of_each(docs, size=5, threshold=80)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item, in the same or other numbers and names."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """Documents repeated by source towards tempered weights, shuffled over the whole corpus."""
    return beside(mix_sources(docs), "copy", "place")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("decontamination", decontamination),
    ("poisson_mix", source_mix),
]
# The classifiers of the first stage and the signatures of the third have no form in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = reread(stage(spark, docs, sf_dir))
    return docs
