"""Decontamination against a direct comparison of all windows, and re-parameterised questions."""

import random
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from ordermill.llm import queries
from ordermill.llm.template_decontamination import CONTAINED, LITERALS, UNITS, WINDOW, contaminated, without_benchmark

SF = "/root/testdata/sf0.001"


def tokens(text):
    text = regex.sub(r"\p{Lu}(?<=[\p{Ll},;] .)\p{Ll}+", lambda m: "\x01" + m[0], text or "").lower()
    text = regex.sub(r"\p{Nd}+", lambda m: f" \x02{m[0]} ", text)
    text = regex.sub(rf"(\x02\p{{Nd}}+) +({'|'.join(UNITS)})(?![\p{{L}}\p{{Nd}}])", "\\1 \x03\\2", text)
    return regex.sub(r"[^\p{L}\p{Nd}\x01\x02\x03]+", " ", text).split()


def shape(window):
    return tuple(t[0] if t < " " else t for t in window)


def brute(docs, items):
    """{(doc, item): (matched windows, windows of the item)} of contaminated pairs."""
    index, count = defaultdict(list), {}
    for i, text in items.items():
        t = tokens(text)
        size = min(WINDOW, len(t))
        own = [k for k in range(len(t) - size + 1) if size and sum(x >= " " for x in t[k : k + size]) >= min(LITERALS, (size + 1) / 2)]
        count[i] = len(own)
        for k in own:
            index[shape(t[k : k + size])].append((i, k, t[k : k + size]))
    found = {}
    for d, text in docs.items():
        t = tokens(text)
        by = defaultdict(list)
        for size in {len(w) for w in index}:
            for k in range(len(t) - size + 1):
                for i, at, window in index.get(shape(t[k : k + size]), ()):
                    slots = [(a, b) for a, b in zip(window, t[k : k + size], strict=True) if a < " "]
                    by[i, k - at].append((at, slots))
        matched = defaultdict(set)
        for (i, _), windows in by.items():
            pairs = {p for _, slots in windows for p in slots}
            fine = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
            matched[i] |= {at for at, slots in windows if fine or not slots}
        for i, at in matched.items():
            if len(at) / count[i] >= CONTAINED:
                found[d, i] = (len(at), count[i])
    return found


def result(frame):
    return {(r["doc_id"], r["item_id"]): (r["matched_windows"], r["item_windows"]) for r in frame.collect()}


def test_query_against_all_windows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = result(queries.QUERIES["op1_template_decontamination"](spark, SF))
    assert found == brute(docs, items)
    assert found


QUESTION = "On monday the farmer Tom sells 12 apples for 3 dollars each, then Tom buys 12 kg of feed. How much money does he have left?"


def test_other_numbers_names_and_units(spark):
    other = QUESTION.replace("Tom", "Anna").replace("12", "40").replace("3 dollars", "7 euros")
    mixed = QUESTION.replace("12 apples", "5 apples").replace("12 kg", "9 kg")  # one value became two
    dice = random.Random(2)
    docs = {1: f"Intro text here. {QUESTION} And more.", 2: f"so it goes, {other.upper()}", 3: other, 4: mixed, 5: "clean text about apples and 12 dollars",
            6: None, 7: "", 8: "w " * 3_000 + QUESTION, 9: QUESTION[:40], 10: "seven words", 11: "1 2 3 4 5 6 7 8 9 10 11 12"}
    docs |= {k: " ".join(f"w{dice.randrange(90)}" for _ in range(50)) for k in range(20, 40)}
    items = {1: QUESTION, 2: "Two short words", 3: "seven words", 4: None, 5: "9 8 7 6 5 4 3 2 1 0 11"}
    documents = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({"TOKENS": F.lit(1), "item_id": F.lit(2)})
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = contaminated(documents, benchmark)
    assert result(found) == brute(docs, items)
    rows = {(r["doc_id"], r["item_id"]): (r["n_slots"], r["n_changed"]) for r in found.collect()}
    assert set(rows) >= {(1, 1), (3, 1), (8, 1), (10, 3)} and not set(rows) & {(5, 1), (9, 1), (11, 5)}
    assert rows[1, 1][1] == 0 and rows[3, 1][1] > 0
    assert (4, 1) not in rows or rows[4, 1][1] == 0
    kept = without_benchmark(documents, benchmark)
    assert kept.columns == documents.columns
    gone = {d for d, _ in rows}
    assert {r["doc_id"] for r in kept.collect()} == set(docs) - gone
    assert contaminated(documents, benchmark.limit(0)).collect() == []
    assert contaminated(documents.limit(0), benchmark).collect() == []
    assert without_benchmark(documents, benchmark.limit(0)).count() == len(docs)


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op1_template_decontamination"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def found_in(spark, item, *texts):
    """Number of each text that holds the item: (matched windows, windows of the item, slots, changed slots)."""
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = contaminated(documents, spark.createDataFrame([(1, item)], "item_id long, text string"))
    return {r["doc_id"]: (r["matched_windows"], r["item_windows"], r["n_slots"], r["n_changed"]) for r in found.collect()}


def test_names_that_open_a_sentence(spark):
    two = "{0} has {1} apples and buys {2} more. {0} gives {3} apples to a friend."
    forms = [two, two + " How many apples does {0} have now?", "\"{0} has {1} apples\", said the man.\n{0} buys {2} more (and {0} gives away {3} of them)."]
    for form in forms:
        item = form.format("Tom", 12, 7, 5)
        found = found_in(spark, item, form.format("Anna", 30, 9, 4), "Intro. " + form.format("Anna Maria", 30, 9, 4), "Anna sells pears and plums on the market.")
        assert set(found) == {0, 1}
        assert all(matched == windows and changed == 4 for matched, windows, _, changed in found.values())


def test_numbers_and_names_of_several_parts_are_one_slot(spark):
    form = "a shop sells {} apples to the trader {} for a total of {} coins, what is left of the goods then?"
    item = form.format("950", "Tom", "3")
    for amount in ("1,200", "2.50", "-7", "1'200,000.75", ".5", "1\u202f200"):
        assert found_in(spark, item, form.format(amount, "Mary Ann Jones", "8"))[0][2:] == (3, 3), amount
    listed = found_in(spark, "the numbers 1, 2 and 3-4 are on the list of the teacher", "the numbers 5, 6 and 7-8 are on the list of the teacher")
    assert listed[0][2] == 4
    assert found_in(spark, form.format("12 5", "Tom", "3"), form.format("30 9", "Tom", "3"))[0][2:] == (4, 2)  # two numbers


def test_items_made_of_slots_match_unchanged_copies(spark):
    sums = "What is 12 + 34 * 56 - 78?"
    found = found_in(spark, sums, sums, f"Solve this, please: {sums} Good luck.", sums.replace("34", "35"), "1 2 3 4 5 6 7 8 9 10 11 12")
    assert set(found) == {0, 1} and found[0][:2] == (1, 1) and found[0][3] == 0
    table = "Year 2001 2002 2003 2004 2005 2006 2007 2008 2009 2010"
    assert set(found_in(spark, table, f"see: {table}", table.replace("200", "199"))) == {0}
    title = "The Great Book Of Ancient Roman Garden Plants And Other Small Wonders"
    assert set(found_in(spark, title, f"He said: {title}", "The Small Lamp On Wooden Kitchen Tables And Other Large Objects")) == {0}


def test_only_windows_with_an_inconsistent_value_are_dropped(spark):
    item = "the old farmer on the hill keeps 3 hens and 4 goats in the yard behind his house and sells the eggs"
    same = item.replace("3", "5").replace("4", "5")
    windows = found_in(spark, item, item)[0][1]
    assert found_in(spark, item, same)[0] == (windows, windows, 2, 2)
    item = "the farmer keeps 3 hens and 4 goats in the yard behind his house, of the hens 3 are brown and the man sells their eggs on the market of the town"
    odd = item.replace("3 hens", "5 hens").replace("3 are", "6 are").replace("4", "9")
    (matched, windows, slots, changed), bad = found_in(spark, item, odd)[0], (3, 15)  # places of the value that became two
    assert matched == sum(all(not at <= x < at + WINDOW for x in bad) for at in range(windows)) and (slots, changed) == (1, 1)


def test_texts_of_200000_words(spark):
    docs = ["w " * 200_000 + QUESTION, QUESTION + " one two three. Four" * 50_000, " ".join(f"word{n}, Name" for n in range(100_000))]
    assert {k: v[:2] for k, v in found_in(spark, QUESTION, *docs).items()} == {d: f for (d, _), f in brute(dict(enumerate(docs)), {1: QUESTION}).items()}


def test_first_pass_loses_no_document(spark):
    """Exactly half of the windows match, at either end; rows that share an id hold them together; words beyond ASCII."""
    dice = random.Random(8)
    words = ["ab", "of", "münchen", "straße", "überlängenmaß", "İzmir", "ΟΔΟΣ", "x9y", "stone-wall", "12kg", "o'clock", "naïveté", "Tom Lee", "4.5", "a"]
    item = [f"{dice.choice(words)} {dice.choice(words).lower()}" for _ in range(20)]
    cut = len(item) // 2 + 2
    docs = {1: " ".join(item[:cut]) + " other things", 2: "other things " + " ".join(item[-cut:]), 3: " ".join(item), 4: " ".join(item[:4])}
    items = {1: " ".join(item), 2: "Σας ΛΟΓΟΣ 3 ς Σ of the in a b of", 3: "the of in to a is it"}
    docs |= {5: "so " + items[2], 6: "now the of in to a is it was"}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    everything = contaminated(rows, benchmark, contained=1e-9).collect()
    half = {(r["doc_id"], r["item_id"]) for r in contaminated(rows, benchmark).collect()}
    assert half == {(r["doc_id"], r["item_id"]) for r in everything if r["containment"] >= 0.5}
    assert half >= {(3, 1), (5, 2), (6, 3)} and (4, 1) not in half
    parts = [(7, " ".join(item[:12])), (7, " ".join(item[8:])), (None, docs[1]), (None, docs[4])]
    parts = spark.createDataFrame(parts, "doc_id long, text string")
    shared, whole = result(contaminated(parts, benchmark)), contaminated(parts, benchmark, contained=1e-9).collect()
    assert shared == {(r["doc_id"], r["item_id"]): (r["matched_windows"], r["item_windows"]) for r in whole if r["containment"] >= 0.5}
    assert (7, 1) in shared
