"""Benchmark decontamination by template windows; DataFrame functions only.

A text becomes a sequence of lower-case words in which numbers, names and units are typed
placeholders: a numeric literal with its sign, grouping and decimals, a run of capitalised words,
and a unit after a number. Capitals also open texts, sentences, lines, quotations and brackets, so
a text is read twice: in the first reading a capitalised word is a name only after a lower-case
letter, comma or semicolon and one space, in the second one everywhere.

Windows of eight such tokens are hash-joined with those of the benchmark items, so a question
with other numbers or names still matches. Three passes, each over the texts that the one before
leaves. The first marks nothing: a text with a window of an item also has that window's words, so
each window gives one run of at most three adjacent words, the longest in letters. Only documents
with a run of an item's windows go on; as half of these must match, nearly half of them, those with
the shortest runs, need not be looked for. The second takes hashes of windows, of both readings, and finds the texts
with a window of an item; the third takes the windows of these texts with their values. Hashes go
through Bloom filters of bounded size, then an exact join.

The slots of matching windows must then be consistent: under one alignment of document and item, a
value of the item stands for one value of the document; two values of the item may stand for the
same one. Windows with a value that stands for several do not count. A document is contaminated by an item when
the matching windows, of either reading of the document, are at least half of those of one reading
of the item. The figures are of the first reading of the item for which that holds.

Windows with fewer than four literal tokens (or, in an item of fewer tokens, fewer than half) say
too little as templates: they match only with the same values. A document is contaminated when half
of the other windows match or half of all windows; the figures are of the first of the two that
holds. An item of fewer than eight tokens is one window of its own length.

A reading is one for the whole text: a window that would match only with one opening capital as a
name and another one as a plain word does not match.

Defined results: null and empty texts match nothing; an item without informative windows matches
unchanged copies only; repeated documents or items each give their rows, counted once for each pair of ids; rows
with a null id take part under the null id; very long texts are read whole; empty tables give an empty result.
"""

from functools import reduce

from pyspark.sql import Window, functions as F

from ordermill.llm import bloom
from ordermill.llm.frames import packed, saved

WINDOW = 8
LITERALS = 4
CONTAINED = 0.5
RUN = 3
# Units of measure that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams t ton tons lb lbs oz pound pounds "
    "ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years kb mb gb tb k c f w kw v a hz khz mhz ghz dollar dollars euro euros cent cents percent"
).split()
_NAME, _NUMBER, _UNIT, _OPENING = "\x01", "\x02", "\x03", "\x04"
_JOINT, _POINT, _GROUP, _MINUS = "\x05", "\x06", "\x07", "\x08"
_MARKS = "".join((_NAME, _NUMBER, _UNIT, _OPENING, _JOINT, _POINT, _GROUP, _MINUS))
_DIGITS = rf"[\p{{Nd}}{_POINT}{_GROUP}{_MINUS}]"


def marked(text):
    """Tokens of a text between single spaces; those that fill a slot carry the mark of its type before their value.

    A name that may be an opening capital has a mark of its own; the words of a name are joined.
    """
    plain = F.translate(text, _MARKS, " " * len(_MARKS))
    joined = F.regexp_replace(plain, r"(\p{Lu}(?<!\p{L}.)\p{Ll}\p{L}*)[ -](?=\p{Lu}\p{Ll})", f"$1{_JOINT}")
    named = F.regexp_replace(joined, r"\p{Lu}(?<=[\p{Ll},;] .)\p{Ll}", f"{_NAME}$0")
    named = F.regexp_replace(named, rf"\p{{Lu}}(?<![\p{{L}}{_NAME}{_JOINT}].)\p{{Ll}}", f"{_OPENING}$0")
    signed = F.regexp_replace(F.lower(named), r"[-\u2212](?<![\p{L}\p{Nd}].)(?=\.?\p{Nd})", _MINUS)
    grouped = F.regexp_replace(signed, r"[,'\u2019\u00a0\u202f](?<=\p{Nd}.)(?=\p{Nd})", _GROUP)
    pointed = F.regexp_replace(grouped, r"\.(?<![\p{L}.].)(?=\p{Nd})", _POINT)
    numbered = F.regexp_replace(pointed, rf"{_DIGITS}+", f" {_NUMBER}$0 ")
    units = rf"({_NUMBER}{_DIGITS}+) +{_OPENING}?({'|'.join(UNITS)})(?![\p{{L}}\p{{Nd}}])"
    measured = F.regexp_replace(numbered, units, f"$1 {_UNIT}$2")
    return F.trim(F.regexp_replace(measured, rf"[^\p{{L}}\p{{Nd}}{_MARKS}]+", " "))


def _readings(text):
    """A marked text with opening capitals as plain words, and with all of them as names."""
    plain = F.regexp_replace(text, rf"{_OPENING}(\p{{L}}+){_JOINT}", f"$1 {_NAME}")
    return F.translate(plain, _OPENING, ""), F.translate(text, _OPENING, _NAME)


def _tokens(text):
    return F.array_remove(F.split(text, " "), "")


def _is_slot(token):
    return token < " "


def _template(tokens):
    """Tokens with the values of slots taken out."""
    return F.transform(tokens, lambda t: F.when(_is_slot(t), F.substring(t, 1, 1)).otherwise(t))


def _places(tokens, size):
    """First places of the windows of so many tokens."""
    last = F.size(tokens) - size
    return F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))


def _read(rows, *kept):
    """The kept columns with number and tokens of each reading; the second one only where it differs."""
    rows = rows.select(*kept, marked(F.col("text")).alias("marked"))
    first, second = _readings(F.col("marked"))
    rows = rows.select(*kept, first.alias("first"), second.alias("second"))
    both = F.when(F.col("first") == F.col("second"), F.array("first")).otherwise(F.array("first", "second"))
    return rows.select(*kept, F.posexplode(both).alias("reading", "read")).select(*kept, "reading", _tokens("read").alias("tokens"))


def _windows(rows, *kept):
    """The kept columns with place, tokens, template, hash and whether the template is informative, of each window of `size` tokens.

    The hash is that of the template where it is informative, and of the tokens where it is not.
    """
    cut = F.transform(_places("tokens", F.col("size")), lambda at: F.slice("tokens", at, F.col("size")))
    rows = rows.select(*kept, "size", F.posexplode(cut).alias("place", "window"))
    rows = rows.withColumn("template", _template("window"))
    literals = F.size(F.filter("template", lambda t: ~_is_slot(t)))
    informative = literals >= F.least(F.lit(LITERALS), (F.col("size") + 1) / 2)
    rows = rows.withColumn("informative", informative)
    return rows.withColumn("hash", F.when(F.col("informative"), F.xxhash64("template")).otherwise(F.xxhash64("window")))


def _item_windows(items):
    """(item_id, item_reading, size, item_place, item_window, item_template, informative, hash, item_windows, all_windows) of each window.

    item_windows is the number of informative ones.
    """
    rows = _read(items, "item_id").where(F.size("tokens") > 0).withColumn("size", F.least(F.lit(WINDOW), F.size("tokens")))
    rows = _windows(rows, "item_id", "reading")
    rows = saved(rows.withColumnsRenamed({"reading": "item_reading", "place": "item_place", "window": "item_window", "template": "item_template"}))
    counts = rows.groupBy("item_id", "item_reading").agg(
        F.count_distinct(F.when(F.col("informative"), F.col("item_place"))).alias("item_windows"),
        F.count_distinct("item_place").alias("all_windows"),
    )
    same = rows.item_id.eqNullSafe(counts.item_id) & (rows.item_reading == counts.item_reading)
    return saved(rows.join(counts, same).drop(counts.item_id).drop(counts.item_reading))


def _pieces(text):
    """Runs of letters and runs of digits. Those of a text are those of its tokens, one token after the other."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0))


def _run(pieces, at, length):
    """A hash of so many pieces from place `at` on, counted from 0."""
    return F.xxhash64(*[F.get(pieces, at + k) for k in range(length)])


def _starts(pieces, length):
    return F.when(F.size(pieces) >= length, F.sequence(F.lit(0), F.size(pieces) - length)).otherwise(F.array().cast("array<int>"))


def _best_run(pieces):
    """(letters, length, run) of the longest run without a gap (an empty piece), in letters, among those of most pieces."""

    def of_length(length):
        def described(at):
            sizes = [F.length(F.get(pieces, at + k)) for k in range(length)]
            letters = F.when(F.least(*sizes, F.lit(1)) > 0, reduce(lambda x, y: x + y, sizes))
            return F.struct(letters.alias("letters"), F.lit(length).alias("length"), _run(pieces, at, length).alias("run"))

        return F.array_max(F.filter(F.transform(_starts(pieces, length), described), lambda x: x["letters"].isNotNull()))

    return F.coalesce(*[of_length(length) for length in range(RUN, 0, -1)])


def _runs(windows, contained):
    """(length, run) such that every contaminated text has one of them.

    Each window gives pieces that a text with this window has one after the other: a template that
    is informative says its literals only, so a run does not go over a slot; the other windows match
    with their values. Of n windows at least n * contained must match, so windows can be left out as
    long as fewer than that are: those whose runs have the fewest letters.
    """
    literal = F.transform("item_template", lambda t: F.when(_is_slot(t), F.array(F.lit(""))).otherwise(_pieces(t)))
    valued = F.transform("item_window", _pieces)
    rows = windows.withColumn("pieces", F.flatten(F.when(F.col("informative"), literal).otherwise(valued)))
    rows = rows.withColumn("best", _best_run(F.col("pieces")))
    item = ["item_id", "item_reading", "item_windows", "all_windows"]
    # An item that repeats with other words has several windows at a place; they count as one.
    places = rows.groupBy(*item, "item_place").agg(
        F.max("informative").alias("informative"), F.min("best.letters").alias("letters"), F.collect_set("best").alias("runs")
    )
    order = [F.desc("letters"), "item_place"]
    places = places.withColumn("of_all", F.row_number().over(Window.partitionBy(*item).orderBy(*order)))
    places = places.withColumn("of_own", F.row_number().over(Window.partitionBy(*item, "informative").orderBy(*order)))
    enough = lambda n: n - F.ceil(n * contained - 1e-9) + 1
    kept = (F.col("of_all") <= enough(F.col("all_windows"))) | (F.col("informative") & (F.col("of_own") <= enough(F.col("item_windows"))))
    return saved(places.where(kept).select(F.explode("runs").alias("best")).select("best.length", "best.run").distinct())


def _candidates(docs, runs):
    """A hash of the id of each document that has one of the runs; rows that share an id are one document."""
    lengths = sorted(r["length"] for r in runs.select("length").distinct().collect())  # at most RUN numbers
    rows = docs.select(F.xxhash64("doc_id").alias("id"), _pieces(F.lower("text")).alias("pieces"))

    def hashed(length):
        return F.transform(_starts(F.col("pieces"), length), lambda at: _run(F.col("pieces"), at, length))

    rows = rows.select("id", F.explode(F.concat(*map(hashed, lengths))).alias("run"))
    rows = bloom.of_keys(runs, "run", runs.count()).tested(rows, "run", "maybe").where("maybe")
    return saved(rows.join(runs, "run", "left_semi").select("id").distinct())


def _having(docs, keys, key):
    """The rows with these keys, and those that a filter of them lets through by chance."""
    return bloom.of_keys(keys, key, keys.count()).tested(docs, key, "maybe").where("maybe").drop("maybe")


def _touched(docs, sizes, hashes, known):
    """Key of each text with a window of an item, in either reading; values do not count here.

    The tokens are columns below the generator: an expression inside the lambda would be computed
    once for each window. A row of the generator is a key and a hash.
    """
    rows = docs.select("key", F.regexp_replace(marked(F.col("text")), rf"([{_NAME}{_NUMBER}{_UNIT}])[^ ]+", "$1").alias("marked"))
    # The value of an opening name is still there: it is the word of the first reading.
    first, second = _readings(F.col("marked"))
    second = F.regexp_replace(second, rf"{_NAME}[^ ]+", _NAME)
    first = F.regexp_replace(first, rf"{_NAME}[^ ]+", _NAME)
    rows = rows.select("key", _tokens(first).alias("first"), _tokens(second).alias("second"))
    hashed = lambda tokens, size: F.transform(_places(tokens, size), lambda at: F.xxhash64(F.slice(tokens, at, size)))
    all_hashes = reduce(F.array_union, [hashed(tokens, F.lit(size)) for size in sizes for tokens in ("first", "second")])
    rows = known.tested(rows.select("key", F.explode(all_hashes).alias("hash")), "hash", "maybe").where("maybe")
    return saved(rows.join(hashes, "hash", "left_semi").select("key").distinct())


def _matches(docs, windows, contained):
    """Windows of documents that are windows of items, with the tokens of both."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW numbers
    if not sizes:
        return None
    templates = windows.select(F.xxhash64("item_template").alias("hash")).distinct()
    docs = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("key"), "text")
    some = _candidates(docs, _runs(windows, contained))
    some = _having(docs.withColumn("id", F.xxhash64("doc_id")), some, "id").drop("id")
    touched = _touched(some, sizes, templates, bloom.of_keys(templates, "hash", windows.count()))
    # Texts that a filter lets through by chance match nothing below.
    rows = _read(_having(docs, touched, "key"), "doc_id", "key").select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    known = bloom.of_keys(windows, "hash", windows.count())
    own = known.tested(_windows(rows, "doc_id", "key", "reading"), "hash", "maybe").where("maybe")
    alike = (F.col("template") == F.col("item_template")) & (F.col("informative") | (F.col("window") == F.col("item_window")))
    return own.drop("maybe", "size", "informative").join(windows, "hash").where(alike)


def contaminated(docs, items, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", contained=CONTAINED):
    """doc_id, item_id, matched_windows, item_windows, containment, n_slots, n_changed of each contaminated pair."""
    windows = _item_windows(packed(items, item_id=item_id_col, text=item_text_col).drop("row"))
    rows = packed(docs, doc_id=id_col, text=text_col).drop("row")
    found = _matches(rows, windows, contained)
    if found is None:
        ids = rows.select("doc_id", F.lit(None).cast(dict(windows.dtypes)["item_id"]).alias("item_id")).limit(0)
        return ids.selectExpr("*", "0L matched_windows", "0L item_windows", "0D containment", "0L n_slots", "0L n_changed")
    slots = F.filter(F.arrays_zip("item_window", "window"), lambda t: _is_slot(t["item_window"]))
    found = found.withColumn("slots", slots)
    found = found.withColumn("shift", F.col("place") - F.col("item_place"))
    # An alignment with one text has no more windows than the item, so its lists are bounded by the item.
    aligned = found.groupBy("doc_id", "key", "reading", "item_id", "item_reading", "item_windows", "all_windows", "shift").agg(
        F.collect_set(F.struct("item_place", "informative", "slots")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"),
    )
    # Tokens carry the type of their slot, so values of different types are different values.
    aligned = aligned.withColumn("values", F.sort_array(F.transform("pairs", lambda p: p["item_window"])))
    repeated = F.filter("values", lambda v, at: (at > 0) & v.eqNullSafe(F.get("values", at - 1)))
    aligned = aligned.withColumn("odd", F.array_distinct(repeated))
    aligned = aligned.withColumn("sound", F.filter("pairs", lambda p: ~F.array_contains("odd", p["item_window"])))
    kept = F.filter("windows", lambda w: ~F.exists(w["slots"], lambda p: F.array_contains("odd", p["item_window"])))
    aligned = aligned.select(
        "doc_id",
        "item_id",
        "item_reading",
        "item_windows",
        "all_windows",
        F.explode(kept).alias("kept"),
        F.size("sound").alias("n_slots"),
        F.size(F.filter("sound", lambda p: p["item_window"] != p["window"])).alias("n_changed"),
    )
    pairs = aligned.groupBy("doc_id", "item_id", "item_reading", "item_windows", "all_windows").agg(
        F.count_distinct(F.when(F.col("kept.informative"), F.col("kept.item_place"))).alias("matched_windows"),
        F.count_distinct("kept.item_place").alias("all_matched"),
        F.max("n_slots").cast("long").alias("n_slots"),
        F.max("n_changed").cast("long").alias("n_changed"),
    )
    counted = [("matched_windows", "item_windows"), ("all_matched", "all_windows")]
    ways = F.array(*[F.struct(F.lit(way).alias("way"), F.col(m).alias("m"), F.col(n).alias("n")) for way, (m, n) in enumerate(counted)])
    # An item may have no informative window.
    ways = F.filter(ways, lambda w: (w["n"] > 0) & (w["m"] / F.nullif(w["n"], F.lit(0)) >= contained))
    pairs = pairs.withColumn("way", F.get(ways, 0)).where("way IS NOT NULL")
    first = F.min(F.struct("item_reading", "way", "n_slots", "n_changed")).alias("first")
    return pairs.groupBy("doc_id", "item_id").agg(first).select(
        "doc_id",
        "item_id",
        F.col("first.way.m").alias("matched_windows"),
        F.col("first.way.n").alias("item_windows"),
        (F.col("first.way.m") / F.col("first.way.n")).alias("containment"),
        "first.n_slots",
        "first.n_changed",
    )


def without_benchmark(docs, items, id_col="doc_id", text_col="text", **named):
    """The input rows that no item contaminates; rows are told apart by id and text."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.col(text_col).alias("text"), key.alias("key"))
    gone = contaminated(keyed, items, "key", "text", **named).select(F.col("doc_id").alias("key")).distinct()
    return bloom.without(packed(docs, key=key), "key", saved(gone)).select("row.*")
