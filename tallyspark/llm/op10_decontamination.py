"""Benchmark decontamination by template canonicalisation (operator 10).

Texts become tokens at white space.  A token's template is ``<num>`` when it
begins with a digit, ``<name>`` for a capitalised word (not all capitals) inside a sentence,
``<unit>`` for a unit right after a number, and else the lower-case word
without the punctuation at its end.  Windows of ``WINDOW`` templates (of the whole
item, where it is shorter) are hash-joined between benchmark and documents, so
a question whose numbers, names and units were changed still matches.

Matches on one diagonal (same distance between place in the document and place
in the item) are then checked for slot consistency: a value of the item must
stand for one and the same value of the document wherever it recurs.  An item
counts as found in a document when at least ``COVERAGE`` of its windows match
on a consistent diagonal.

Documents are not exploded into windows before the join: a bitmap of fixed
size (2**``BITMAP_LOG2`` bits) of the benchmark's windows is tested first, with
the hash of a window's two end tokens and then with that of all its tokens,
and only windows that pass both become rows.

Windows with fewer than ``LITERALS`` literal words are not used, so items with
fewer never match.  Null texts count as empty; rows that repeat a document id
or an item id are taken as one text each and reported once per id pair; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, whole_text

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
BITMAP_LOG2 = 18
#: Punctuation that is cut off the end of a token.
MARKS = ".,;:!?\"')]}"
#: For the stage: more of these, what is cut off the beginning of a token, and the quotes and brackets among that.
WIDE_MARKS = MARKS + "”’»%"
QUOTES = "([{\"'`“”„‘’«»¿¡"
LEADS = QUOTES + "$€£¥₹#<>=+-−–±~≈*_/&@"
#: Capitalised words that are never names.
FUNCTION_WORDS = tuple("""a about above after all also although am an and another any are as at be because been before being below
 between both but by can could did do does during each either else every few first five for four from given had has have he
 her here hers him his how however i if in into is it its last let many may me more most much must my neither next no nor not
 now of off on once one only or other our out over per second shall she should since so some such ten than that the their them
 then there these they third this those three through to two under until up us was we were what when where whether which while
 who whom whose why will with without would yet you your""".split())
#: FIXED VALUES: words that are units when they follow a number.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram",
         "grams", "ton", "tons", "ounce", "ounces", "pound", "pounds", "lb", "lbs", "ml", "l", "liter", "liters", "litre", "litres",
         "second", "seconds", "s", "minute", "minutes", "min", "hour", "hours", "h", "day", "days", "week", "weeks", "month",
         "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh")


def with_tokens(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``raw`` (the text between white space) and ``low`` (the same in lower case)."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return df.withColumn("raw", F.array_remove(F.split(plain, " "), "")) \
        .withColumn("low", F.array_remove(F.split(F.lower(plain), " "), ""))


def template(t: Column, i: Column) -> Column:
    """Template of the lower-case token ``t`` at index ``i``; reads the columns ``raw`` and ``low`` beside it.

    A capital, a digit and a number before are told by comparing strings: digits sort before capitals and
    these before small letters.
    """
    units = F.array(*[F.lit(u) for u in UNITS])
    own, before = F.get(F.col("raw"), i), F.get(F.col("raw"), i - 1)
    word = F.rtrim(t, F.lit(MARKS))
    name = (own < "[") & (own >= "A") & (i > 0) & (own != F.upper(own)) & ~F.right(before, F.lit(1)).isin(".", "!", "?")
    unit = (before < ":") & (before >= "0") & F.array_contains(units, word)
    return F.when((t < ":") & (t >= "0"), F.lit("<num>")).when(name, F.lit("<name>")).when(unit, F.lit("<unit>")).otherwise(word)


def _slots(t: Column) -> Column:
    return F.startswith(t, F.lit("<"))


def _rows_of(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """A row per entry.  (``explode`` itself would have the array built once more for a filter on its size.)"""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, place, size, hash, raw, kind, n_windows): the windows of every item with enough literal words."""
    items = benchmark.select(F.col("item_id").alias("item"), whole_text().alias("t")).dropDuplicates()
    items = with_tokens(items, F.col("t")).drop("t").withColumn("kinds", F.transform("low", template))
    size = F.least(F.lit(WINDOW), F.size("kinds"))
    places = F.when(F.size("kinds") >= LITERALS, F.sequence(F.lit(0), F.size("kinds") - size))
    w = _rows_of(items, places, "place", "item", F.xxhash64("raw").alias("text_key"), "raw", "kinds", size.alias("size"))
    w = w.select("item", "text_key", "place", "size", F.slice("raw", F.col("place") + 1, F.col("size")).alias("raw"),
                 F.slice("kinds", F.col("place") + 1, F.col("size")).alias("kinds"))
    w = w.filter(F.size(F.filter("kinds", lambda t: ~_slots(t))) >= LITERALS) \
        .withColumn("hash", F.xxhash64(F.transform("kinds", lambda t: F.xxhash64(t)))) \
        .withColumn("ends", F.xxhash64(F.xxhash64(F.get("kinds", F.lit(0))), F.xxhash64(F.get("kinds", F.col("size") - 1))))
    totals = w.groupBy("item", "text_key").agg(F.count("*").alias("n_windows"))
    return w.join(totals, ["item", "text_key"])


def bitmap(windows: DataFrame) -> DataFrame:
    """One row with 2**BITMAP_LOG2 bits as an array of longs, set for the hash of each window and that of its two ends."""
    keys = windows.select(F.explode(F.array("hash", "ends")).alias("key")).withColumn("bit", F.col("key").bitwiseAND((1 << BITMAP_LOG2) - 1))
    words = keys.select(F.shiftright("bit", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")) \
        .groupBy("w").agg(F.bit_or("mask").alias("mask"))
    every = windows.sparkSession.range(1 << (BITMAP_LOG2 - 6)).select(F.col("id").cast("int").alias("w"))
    full = every.join(words, "w", "left").select("w", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "mask"))), lambda x: x["mask"]).alias("bits"))


def window_hits(docs: DataFrame, bits: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, at, hash, raw): the documents' windows that pass the bitmap, for each window size in use."""
    rows = with_tokens(docs.select(F.col("doc_id"), whole_text().alias("t")), F.col("t")).drop("t") \
        .withColumn("codes", F.transform("low", lambda t, i: F.xxhash64(template(t, i)))).drop("low") \
        .withColumn("bits", bits.scalar())

    def passes(h: Column) -> Column:
        low = h.bitwiseAND((1 << BITMAP_LOG2) - 1)
        word = F.get(F.col("bits"), F.shiftright(low, 6).cast("int"))
        return F.getbit(word, low.bitwiseAND(63).cast("int")) == 1

    for n in sizes:
        places = F.when(F.size("codes") >= n, F.sequence(F.lit(1), F.size("codes") - (n - 1)))
        rows = rows.withColumn(f"at{n}", F.filter(places, lambda i: passes(  # noqa: B023
            F.xxhash64(F.get("codes", i - 1), F.get("codes", i + (n - 2)))) & passes(F.xxhash64(F.slice("codes", i, n)))))  # noqa: B023
    empty = F.array().cast("array<struct<at:int,hash:bigint,raw:array<string>>>")
    found = F.concat(empty, *[F.coalesce(F.transform(f"at{n}", lambda i: F.struct(
        (i - 1).alias("at"), F.xxhash64(F.slice("codes", i, n)).alias("hash"), F.slice("raw", i, n).alias("raw"))), empty)  # noqa: B023
        for n in sizes])
    return _rows_of(rows, found, "x", "doc_id").select("doc_id", "x.*")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, same_values) per item found in a document."""
    prepare(docs.sparkSession)
    windows = benchmark_windows(benchmark)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW values
    hits = window_hits(docs, bitmap(windows), sizes)
    own = windows.select("item", "text_key", "place", "hash", "n_windows", F.col("raw").alias("item_raw"), "kinds")
    m = hits.join(own, "hash").filter(F.size("raw") == F.size("item_raw"))
    slots = F.filter(F.zip_with(F.arrays_zip("kinds", "item_raw"), "raw", lambda a, b: F.struct(
        F.startswith(a["kinds"], F.lit("<")).alias("slot"), F.rtrim(a["item_raw"], F.lit(MARKS)).alias("item"),
        F.rtrim(b, F.lit(MARKS)).alias("doc"))), lambda s: s["slot"])
    m = m.select("doc_id", "item", "text_key", "n_windows", "place", (F.col("at") - F.col("place")).alias("diagonal"), slots.alias("slots"))
    lines = m.groupBy("doc_id", "item", "text_key", "n_windows", "diagonal").agg(
        F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"))
    values = F.transform("pairs", lambda s: s["item"])
    lines = lines.filter(F.size(F.array_distinct(values)) == F.size("pairs"))
    changed = F.exists("pairs", lambda s: s["item"] != s["doc"])
    whole = lines.select("doc_id", "item", "text_key", "n_windows", F.explode("places").alias("place"), changed.alias("changed")) \
        .groupBy("doc_id", "item", "text_key", "n_windows").agg(
            F.countDistinct("place").alias("n_matched"), (~F.max("changed")).alias("same_values"))
    share = F.col("n_matched") / F.col("n_windows")
    return whole.filter(share >= coverage).groupBy("doc_id", F.col("item").alias("item_id")).agg(
        F.max_by("n_windows", F.struct(share, "text_key")).cast("long").alias("n_windows"),
        F.max_by("n_matched", F.struct(share, "text_key")).cast("long").alias("n_matched"),
        F.round(F.max(share), 6).alias("coverage"), F.max("same_values").alias("same_values"))


def _wide_template(t: Column, i: Column) -> Column:
    """Like ``template``, but the same wherever the token stands: marks and signs before it are cut off, capitals are those
    of any script, and every capitalised word that is no function word is a name.  Reads ``core`` and ``raw``."""
    own, before = F.get(F.col("core"), i), F.get(F.col("core"), i - 1)
    low = F.lower(own)
    word = F.rtrim(low, F.lit(WIDE_MARKS))
    first = F.left(own, F.lit(1))
    listed = lambda words: F.array_contains(F.array(*[F.lit(w) for w in words]), word)
    name = (own != low) & (first != F.lower(first)) & (own != F.upper(own)) & ~listed(FUNCTION_WORDS)
    unit = (before < ":") & (before >= "0") & listed(UNITS)
    return F.when((own < ":") & (own >= "0"), F.lit("<num>")).when(name, F.lit("<name>")).when(unit, F.lit("<unit>")) \
        .otherwise(F.when(word == "", t).otherwise(word))


def _word(t: Column, i: Column) -> Column:
    """The lower-case token without quotes and brackets before it and punctuation after it."""
    word = F.rtrim(F.ltrim(t, F.lit(QUOTES)), F.lit(WIDE_MARKS))
    return F.when(word == "", t).otherwise(word)


#: Ways to read a token.  ``words`` is for items without a usable window in any other; they must be there whole.
READINGS = {"plain": template, "wide": _wide_template, "words": _word}


def _read_tokens(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``raw``, ``low`` and ``core`` (``raw`` without the marks and signs before a token)."""
    bare = lambda t: F.when(((t >= "0") & (t < ":")) | ((t >= "A") & (t < "[")) | ((t >= "a") & (t < "{")), t) \
        .otherwise(F.ltrim(t, F.lit(LEADS)))
    return with_tokens(df, text).withColumn("core", F.transform("raw", bare))


def _stage_windows(benchmark: DataFrame) -> DataFrame:
    """(item, reading, place, size, hash, ends, raw, kinds, n_windows) of every distinct item text with words."""
    items = _read_tokens(benchmark.select(whole_text().alias("t")).dropDuplicates(), F.col("t")).filter(F.size("low") > 0)
    readings = F.array(*[F.struct(F.lit(c).alias("reading"), F.transform("low", f).alias("kinds")) for c, f in READINGS.items()])
    items = items.select(F.md5("t").alias("item"), "raw", F.explode(readings).alias("x")).select("item", "raw", "x.*")
    size = F.least(F.lit(WINDOW), F.size("kinds"))
    w = items.select("*", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("kinds") - size)).alias("place"))
    w = w.select("item", "reading", "place", "size", F.slice("raw", F.col("place") + 1, F.col("size")).alias("raw"),
                 F.slice("kinds", F.col("place") + 1, F.col("size")).alias("kinds"))
    words = F.col("reading") == "words"
    w = w.filter(words | (F.size(F.filter("kinds", lambda t: ~_slots(t))) >= LITERALS))
    usable = w.filter(~words).select("item").distinct()
    w = w.filter(~words).unionByName(w.filter(words).join(usable, "item", "left_anti"))
    totals = w.groupBy("item", "reading").agg(F.countDistinct("place").alias("n_windows"))
    # in a document a number may come before the item's first word, which makes a unit of it
    first = F.get("kinds", F.lit(0))
    unit = (F.col("place") == 0) & ~words & F.array_contains(F.array(*[F.lit(u) for u in UNITS]), first)
    other = F.concat(F.array(F.lit("<unit>")), F.slice("kinds", F.lit(2), F.greatest(F.col("size") - 1, F.lit(0))))
    w = w.withColumn("kinds", F.explode(F.when(unit, F.array("kinds", other)).otherwise(F.array("kinds"))))
    return w.withColumn("hash", F.xxhash64("reading", F.transform("kinds", lambda t: F.xxhash64(t)))) \
        .withColumn("ends", F.xxhash64("reading", F.xxhash64(F.get("kinds", F.lit(0))), F.xxhash64(F.get("kinds", F.col("size") - 1)))) \
        .join(totals, ["item", "reading"])


def _stage_hits(docs: DataFrame, bits: DataFrame, windows: list[tuple[str, int]]) -> DataFrame:
    """(key, at, hash, raw): the documents' windows that pass the bitmap, for each reading and window size in use."""
    rows = _read_tokens(docs.select(content_key().alias("key"), whole_text().alias("t")), F.col("t")).drop("t")
    for c in sorted({c for c, _ in windows}):
        rows = rows.withColumn(c, F.transform("low", lambda t, i: F.xxhash64(READINGS[c](t, i))))  # noqa: B023
    rows = rows.drop("low", "core").withColumn("bits", bits.scalar())

    def passes(h: Column) -> Column:
        low = h.bitwiseAND((1 << BITMAP_LOG2) - 1)
        word = F.get(F.col("bits"), F.shiftright(low, 6).cast("int"))
        return F.getbit(word, low.bitwiseAND(63).cast("int")) == 1

    for c, n in windows:
        places = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - (n - 1)))
        rows = rows.withColumn(f"at_{c}_{n}", F.filter(places, lambda i: passes(  # noqa: B023
            F.xxhash64(F.lit(c), F.get(c, i - 1), F.get(c, i + (n - 2)))) & passes(F.xxhash64(F.lit(c), F.slice(c, i, n)))))  # noqa: B023
    empty = F.array().cast("array<struct<at:int,hash:bigint,raw:array<string>>>")
    found = F.concat(empty, *[F.coalesce(F.transform(f"at_{c}_{n}", lambda i: F.struct(
        (i - 1).alias("at"), F.xxhash64(F.lit(c), F.slice(c, i, n)).alias("hash"), F.slice("raw", i, n).alias("raw"))), empty)  # noqa: B023
        for c, n in windows])
    return _rows_of(rows, found, "x", "key").select("key", "x.*")


def content_key() -> Column:
    return F.unhex(F.md5(whole_text()))


def leaked_texts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(key): the content keys of the documents in which an item was found.

    Unlike ``leaks``, whose result the query's SQL fixes, this checks slot consistency window by window: a value of the
    item that stands for two values of the document voids only the windows that hold both.  A window that is there word
    for word is consistent.
    """
    prepare(docs.sparkSession)
    windows = _stage_windows(benchmark)
    used = sorted((r["reading"], r["size"]) for r in windows.select("reading", "size").distinct().collect())  # WINDOW a reading at most
    hits = _stage_hits(docs, bitmap(windows), used)
    own = windows.select("item", "reading", "place", "hash", "n_windows", F.col("raw").alias("item_raw"), "kinds")
    m = hits.join(own, "hash").filter(F.size("raw") == F.size("item_raw"))
    value = lambda t: F.rtrim(F.ltrim(t, F.lit(LEADS)), F.lit(WIDE_MARKS))
    slots = F.filter(F.zip_with(F.arrays_zip("kinds", "item_raw"), "raw", lambda a, b: F.struct(
        _slots(a["kinds"]).alias("slot"), value(a["item_raw"]).alias("item"), value(b).alias("doc"))), lambda s: s["slot"])
    m = m.withColumn("pairs", F.array_distinct(slots))
    m = m.filter(F.size(F.array_distinct(F.transform("pairs", lambda s: s["item"]))) == F.size("pairs"))
    whole = F.col("reading") == "words"
    line = F.when(whole, F.col("at") - F.col("place"))  # a whole item is on one diagonal
    found = m.groupBy("key", "item", "reading", "n_windows", line.alias("line")).agg(F.countDistinct("place").alias("n_matched"))
    share = F.col("n_matched") / F.col("n_windows")
    return found.filter(share >= F.when(whole, 1.0).otherwise(coverage)).select("key").distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents in which no item was found; findings hold for a text, so rows need no id."""
    bad = leaked_texts(docs, benchmark, coverage).select(F.col("key").alias("leak_key_"))
    return docs.withColumn("leak_key_", content_key()).join(bad, "leak_key_", "left_anti").select(*docs.columns)
