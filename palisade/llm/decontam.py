"""Benchmark decontamination by templates, with DataFrame functions only.

Words are canonicalised: numbers (in digits or in words; number words in a row are one number), names (a capitalised word
inside a sentence) and units (also glued to their number) become typed placeholders. Texts are read in two ways: with each
name a word of its own, and, by templates only, with a run of capitalised words as one name, so that a name of two words
meets one of a single word without a shift. Windows of one reading meet windows of the same.
Windows of template words are joined by hash between documents and benchmark items, and beside them windows in which
names are plain words, so that a copy in other letter case is found too. A window must have literal words to count; one
that is all placeholders counts only with its own values, so numbers in a row do not match other numbers in a row. An
item shorter than a window is looked for whole, word for word. Windows that lie on one diagonal
(same shift between document and item) form a match; a match counts if it is long enough and if its slots agree: one
value in the item always stands for one value in the document (or most values are the item's own), so a question with
other numbers is found, and a text that merely has the same shape is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8  # words hashed together
LEAST = 13  # matched words that make a match, or the whole item if it is shorter
LITERAL = 2  # words of a window that are no placeholders
SHORT = 4  # words of the shortest item that is looked for
#: Words that count as units of measure.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "mg", "g", "kg", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees", "volt", "volts", "watt", "watts")
#: Numbers as words, and what they stand for.
NUMBERS = {w: n for n, w in enumerate(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"))}
NUMBERS |= {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}
#: Characters of the private use area: marks of a name, a number, a unit, a joint inside a number, and a name after a name.
_NAME, _NUM, _UNIT, _MARK, _RUN = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_NUMBER_WORD = "(?i:" + "|".join(NUMBERS) + ")"
_FIRST = "[" + "".join(sorted({c for w in NUMBERS for c in (w[0], w[0].upper())})) + "]"
_WORD_ENDS = r"(?![\p{L}\p{N}])"
#: Benchmark windows up to this many rows (about 24 bytes each) are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Words in lower case; a name keeps a mark in front, and another one if it follows a capitalised word. A number with inner
    points or of several words is one word that starts with a digit, a unit glued to a number is a word of its own."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d)[.,](?=\d)", "$1" + _MARK)
    t = F.regexp_replace(t, rf"(\d)(?=(?i:{'|'.join(UNITS)}){_WORD_ENDS})", "$1 ")
    t = F.regexp_replace(t, rf"(?={_FIRST})(?<![\p{{L}}\p{{N}}])({_NUMBER_WORD})[\s-]+(?={_NUMBER_WORD}{_WORD_ENDS})", f"0{_MARK}$1{_MARK}")
    t = F.regexp_replace(t, r"([\p{Ll}\d,;]\s+[\"'`(\[{<]*)(?=\p{Lu})", "$1" + _NAME)
    t = F.regexp_replace(t, rf"(\p{{Lu}}[^\s\p{{Punct}}]*\s+){_NAME}", "$1" + _RUN)
    return F.filter(F.split(F.lower(t), r"[\s\p{Punct}]+"), lambda w: w != "")


def joined(words: Column) -> Column:
    """The words in the other reading: of names in a row only the first."""
    return F.filter(words, lambda w: F.substring(w, 1, 1) != _RUN)


def word(w: Column) -> Column:
    return F.when(F.substring(w, 1, 1).isin(_NAME, _RUN), F.substring(w, 2, 1 << 30)).otherwise(w)


def template(w: Column) -> Column:
    c = F.substring(w, 1, 1)
    named = F.when(F.substring(w, 2, 1 << 30).isin(*NUMBERS), _NUM).otherwise(_NAME)
    return F.when(c.between("0", "9"), _NUM).when(c.isin(_NAME, _RUN), named).when(w.isin(*NUMBERS, *UNITS), F.when(w.isin(*UNITS), _UNIT).otherwise(_NUM)).otherwise(w)


def plain(w: Column) -> Column:
    """The template of a word that is no name: what it would be in small letters."""
    return template(word(w))


def is_slot(w: Column) -> Column:
    return template(w).isin(_NAME, _NUM, _UNIT)


def value(w: Column) -> Column:
    """What fills a slot: a name without its mark, a number word in digits."""
    digits = F.create_map(*[F.lit(x) for k, n in NUMBERS.items() for x in (k, str(n))])
    return F.coalesce(F.try_element_at(digits, word(w)), word(w))


def itself(w: Column) -> Column:
    return F.xxhash64(F.lit("="), word(w))


def _hashed(texts: DataFrame, key: str, sides: str) -> DataFrame:
    """texts (key, text) -> key, _w (the words), and for each side the array of the hashes of
    every WINDOW words.

    Sides are hashes of a word's template (t), of what that would be in small letters (p), of the word itself (x), and of the
    template in the other reading (r). A hash of two words, then of two of those, and so on: the last WINDOW - 1 elements
    lack words and mean nothing. Each array is a column of its own; inside another expression it would be made again for
    every element.
    """
    h = texts.select(key, tokens(F.col("text")).alias("_w"))
    h = h.select(key, "_w", F.transform("_w", lambda w: F.xxhash64(template(w))).alias("t"))
    first = lambda i: F.substring(F.get(F.col("_w"), i), 1, 1) != _RUN
    made = {"t": F.col("t"), "p": F.zip_with("_w", "t", lambda w, t: F.when(F.substring(w, 1, 1).isin(_NAME, _RUN), F.xxhash64(plain(w))).otherwise(t)), "x": F.transform("_w", itself), "r": F.filter("t", lambda _, i: first(i))}
    h = h.select(key, "_w", *[made[s].alias(s) for s in sides])
    step = 1
    while step < WINDOW:
        pair = lambda s, k=step: F.transform(s, lambda v, i: F.xxhash64(v, F.get(F.col(s), i + k))).alias(s)
        h, step = h.select(key, "_w", *[pair(s) for s in sides]), 2 * step
    return h


def _starts(array: str) -> Column:
    """The elements of an array that begin a whole window; null if there are none."""
    return F.when(F.size(array) >= WINDOW, F.slice(array, 1, F.size(array) - WINDOW + 1))


def windows(texts: DataFrame, exact: bool, runs: bool, lengths: list[int]) -> DataFrame:
    """(doc_id, pos, w): hashes of every WINDOW template words, of plain words where they differ, and if asked for, of
    the words themselves, also of so many words as `lengths` says. Texts with fewer words have none. The other reading's
    template hashes are told apart by turning their bits over; a text in which both readings are one has them only if some
    item has a run of names (`runs`), as else its windows meet the same ones in both."""
    h = _hashed(texts, "doc_id", "tprx" if exact else "tpr")
    p, more = lambda i: F.get(F.col("p"), i), lambda i: [F.get(F.col("x"), i)] if exact else []
    all_ = lambda v, i: F.when(v == p(i), F.array(v, *more(i))).otherwise(F.array(v, p(i), *more(i)))
    # both readings in one array: those of the other one keep their own positions
    apart = F.transform(_starts("t"), lambda v, i: F.struct(i.alias("pos"), all_(v, i).alias("_w")))
    other = F.transform(_starts("r"), lambda v, i: F.struct(i.alias("pos"), F.array(F.bitwise_not(v)).alias("_w")))
    needed = F.lit(True) if runs else F.size("r") < F.size("t")
    both = F.concat(F.coalesce(apart, F.array()), F.when(needed, F.coalesce(other, F.array())).otherwise(F.array()))
    out = h.select("doc_id", F.inline(both)).select("doc_id", "pos", F.explode("_w").alias("w"))
    if lengths:
        x = texts.select("doc_id", tokens(F.col("text")).alias("_w")).select("doc_id", F.transform("_w", itself).alias("x"))
        short = lambda v, i: F.array(*[F.when(i + k <= F.size("x"), _run("x", i, k)) for k in lengths])
        x = x.select("doc_id", F.posexplode(F.transform("x", short)).alias("pos", "_w")).select("doc_id", "pos", F.explode("_w").alias("w"))
        out = out.unionByName(x.where("w is not null"))
    return out


def _run(array: str, i: Column, n: int) -> Column:
    """Hash of n elements from the i-th on."""
    return F.xxhash64(*[F.get(F.col(array), i + k) for k in range(n)])


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, runs, at, n, exact, w): the windows of n words by which an item is found, in both readings (runs: a run
    of names is one word; templates only). Template and plain windows need LITERAL words; where the plain one lacks them, or the item is shorter than a window, the words themselves count."""
    t = _hashed(items, "item_id", "tpx")
    literal = lambda f: lambda i: F.size(F.filter(F.slice("_w", i + 1, WINDOW), lambda w: ~F.substring(f(w), 1, 1).isin(_NAME, _NUM, _UNIT)))
    row = lambda i, ok, side: F.when(ok, F.struct(F.lit(side == "x").alias("exact"), F.get(F.col(side), i).alias("w")))
    at = lambda _, i: F.array_compact(F.array(row(i, literal(template)(i) >= LITERAL, "t"), row(i, literal(plain)(i) >= LITERAL, "p"), row(i, literal(plain)(i) < LITERAL, "x")))
    long = t.select("item_id", F.posexplode(F.transform(_starts("t"), at)).alias("at", "_w"))
    long = long.select("item_id", "at", F.lit(WINDOW).alias("n"), F.explode("_w").alias("_w")).select("item_id", "at", "n", "_w.*").dropDuplicates(["item_id", "at", "w"])
    x = items.select("item_id", tokens(F.col("text")).alias("_w")).select("item_id", F.transform("_w", itself).alias("x"), F.size("_w").alias("n"))
    whole = F.coalesce(*[F.when(F.col("n") == k, _run("x", F.lit(0), k)) for k in range(SHORT, WINDOW)])
    # a window of the other reading is made of as many words of its own
    r = _hashed(items, "item_id", "r").withColumn("_w", joined(F.col("_w")))
    some = lambda v, i: F.when(literal(template)(i) >= LITERAL, F.bitwise_not(v))
    r = r.select("item_id", F.posexplode(F.transform(_starts("r"), some)).alias("at", "w")).where("w is not null")
    r = r.select("item_id", F.lit(True).alias("runs"), "at", F.lit(WINDOW).alias("n"), F.lit(False).alias("exact"), "w")
    apart = long.unionByName(x.where(F.col("n").between(SHORT, WINDOW - 1)).select("item_id", F.lit(0).alias("at"), "n", F.lit(True).alias("exact"), whole.alias("w")))
    return apart.withColumn("runs", F.lit(False)).unionByName(r)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, exact): one row for each document and item that match.

    n_windows and n_slots are those of the longest match of the pair (the one with more slots at ties); exact is false
    where a slot has another value. Items of SHORT to WINDOW - 1 words match word for word. Null or empty texts, items
    of fewer words and null ids match nothing; a repeated row changes nothing. A pair that matches in both readings of names
    has one row, of the longer match. Slots compare by value: "twelve" is 12; numbers of several words compare as text.
    """
    items = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    bench = C.save(item_windows(items), "items")
    n, exact, lengths = bench.agg(F.count("*"), F.max(F.col("exact") & (F.col("n") == WINDOW)), F.collect_set(F.when(F.col("n") < WINDOW, F.col("n")))).first()
    runs = not items.where(F.exists(tokens(F.col("text")), lambda w: F.substring(w, 1, 1) == _RUN)).isEmpty()
    few = n <= BROADCAST_ROWS
    bench = bench.select("item_id", "runs", "at", "w")
    docs = docs.where("doc_id is not null")
    hits = windows(docs.select("doc_id", "text"), bool(exact), runs, sorted(lengths)).join(F.broadcast(bench) if few else bench, "w")
    runs = hits.select("doc_id", "item_id", "runs", (F.col("pos") - F.col("at")).alias("shift"), "at").distinct()
    runs = runs.groupBy("doc_id", "item_id", "runs", "shift").agg(F.count("*").alias("n_windows"), F.min("at").alias("lo"), (F.max("at") + WINDOW).alias("hi"))
    read = lambda text: F.when(F.col("runs"), joined(tokens(text))).otherwise(tokens(text))
    # every item here has a window, so there are at most WINDOW - 1 words more than windows for each
    sizes = items.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("runs")).select("item_id", "runs", read(F.col("text")).alias("it")).where(F.size("it") >= SHORT).withColumn("need", F.greatest(F.lit(1), F.least(F.lit(LEAST - WINDOW + 1), F.size("it") - WINDOW + 1)))
    runs = runs.join(F.broadcast(sizes) if few else sizes, ["item_id", "runs"]).where("n_windows >= need").withColumn("hi", F.least("hi", F.size("it"))).drop("need", "it")
    runs = C.small(C.save(runs, "runs"))
    words = docs.select("doc_id", "text").join(runs.select("doc_id", "item_id", "runs", "shift", "n_windows", "lo", "hi"), "doc_id").join(F.broadcast(sizes) if few else sizes, ["item_id", "runs"])
    length = F.col("hi") - F.col("lo")
    item, own = F.slice("it", F.col("lo") + 1, length), F.slice(read(F.col("text")), F.col("lo") + F.col("shift") + 1, length)
    # zip_with makes both arrays once a row; inside a transform the words would be made again for every element
    pairs = F.filter(F.zip_with(item, own, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: is_slot(p["a"]) & is_slot(p["b"]))
    pairs = F.transform(pairs, lambda p: F.struct(value(p["a"]).alias("a"), value(p["b"]).alias("b")))
    words = words.select("doc_id", "item_id", "n_windows", pairs.alias("slots"))
    # one value of the item stands for one value of the document, unless most values are the item's own
    one = F.size(F.array_distinct("slots")) == F.size(F.array_distinct(F.col("slots")["a"]))
    kept = F.size(F.filter("slots", lambda p: p["a"] == p["b"]))
    words = words.withColumns({"n_slots": F.size("slots"), "exact": kept == F.size("slots")}).where(one | (2 * kept > F.size("slots")))
    best = words.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "n_slots", "exact")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_windows", "m.n_slots", "m.exact")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item; rows with a null id stay."""
    return C.without(docs, contaminated(docs, benchmark))
