"""Benchmark decontamination by templates, which also finds re-parameterised questions.

Texts turn into tokens; numbers, names and units of measure become typed placeholders with the raw
token kept as the value of the slot. Windows of template tokens are hashed and joined with those of the
benchmark, and so are windows of the raw tokens in lower case, in which numbers and names are words like
any other, so that a verbatim passage is found whatever its share of slots, its case and its line breaks.
Matches on one diagonal (document place minus item place) are put together, and the slots of
a diagonal of templates must be consistent: a value of the item stands for one value of the document wherever it
appears. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import broadcast_if_small, stage

WINDOW = 8
# A window of a template must keep this many tokens that are no placeholders, or shorter ones half of theirs.
MIN_LITERALS = 4
# Share of an item's windows that must match on one diagonal.
MIN_COVERAGE = 0.3
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"

# Units of measure, written after a number.
UNITS = (
    "cm", "mm", "km", "kg", "mg", "lb", "lbs", "oz", "ft", "mph", "kmh", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "inch", "inches", "feet", "yard", "yards",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
)

# A number, with a sign of thousands or a decimal point inside; a word; anything else separates. A word
# that begins with a capital and follows a lower-case word, a number or a comma and white space is a name.
_TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+"
_NAME = r"(?<=[\p{Ll}\p{M}0-9,] )(\p{Lu}[\p{Ll}\p{M}]++)"
# Marks a name in the text; it is neither letter nor digit, and tokens that carry it are names.
_MARK = "\x01"
# What a number counts where slots are counted; other slots count 1.
_NUMBERS = 1 << 16


def raw_tokens(text: Column) -> Column:
    """The tokens of a text in order; names begin with a mark."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARK, " "), r"\s+", " ")
    marked = F.regexp_replace(plain, _NAME, _MARK + "$1")
    return F.regexp_extract_all(marked, F.lit(f"{_MARK}?(?:{_TOKEN})"), F.lit(0))


def template(tokens: Column) -> Column:
    """Tokens with numbers, names and units (after a number) as placeholders, the rest in lower case."""

    def typed(token: Column, i: Column) -> Column:
        first = F.ascii(token)
        after_number = F.ascii(F.get(tokens, i - 1)).between(48, 57)
        return (
            F.when(first.between(48, 57), NUMBER)
            .when(first == 1, NAME)
            .when(F.lower(token).isin(*UNITS) & after_number, UNIT)
            .otherwise(F.lower(token))
        )

    return F.transform(tokens, typed)


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def windows(rows: DataFrame, key: str, sizes: list[int] | None = None, window: int = WINDOW) -> DataFrame:
    """key, place, size, typed (hash of the window of ``template``, null if it keeps too few literal tokens) and
    plain (hash of the window of ``raw`` in lower case, null for short windows of nothing but numbers).

    Both hashes are the same where a window has no slot. Sizes are ``window``, and the given shorter ones.
    """
    # Tokens as numbers: a window's hash is that of its numbers, so no string is put together for it.
    raw_id = lambda t, r: F.when(_is_slot(t), F.xxhash64(F.lower(F.translate(r, _MARK, "")))).otherwise(F.xxhash64(t))
    numbered = rows.select(
        key,
        F.transform("template", lambda t: F.xxhash64(t)).alias("typed"),
        F.zip_with("template", "raw", raw_id).alias("plain"),
        F.transform("template", lambda t: F.when(t == NUMBER, F.lit(_NUMBERS)).when(_is_slot(t), 1).otherwise(0)).alias("slots"),
    )
    parts = []
    for size in sorted({window, *(sizes or ())}):
        inside = numbered.filter(F.size("typed") >= size).select(
            key, "typed", "plain", "slots", F.explode(F.sequence(F.lit(0), F.size("typed") - size)).alias("place")
        )
        at = lambda c, i: F.get(c, F.col("place") + i)
        # One sum tells how many numbers and how many other slots there are.
        marks = sum((at("slots", i) for i in range(1, size)), at("slots", 0))
        parts.append(
            inside.select(
                key,
                "place",
                F.lit(size).alias("size"),
                marks.alias("marks"),
                F.xxhash64(*[at("typed", i) for i in range(size)]).alias("typed"),
                F.xxhash64(*[at("plain", i) for i in range(size)]).alias("plain"),
            ).select(
                key,
                "place",
                "size",
                F.when(size - F.shiftright("marks", 16) - F.col("marks") % _NUMBERS >= min(MIN_LITERALS, (size + 1) // 2), F.col("typed")).alias("typed"),
                (F.col("plain") if size >= window else F.when(F.col("marks") < _NUMBERS * size, F.col("plain"))).alias("plain"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _typed(df: DataFrame, id_column: str, text_column: str, name: str, inside: bool = False) -> DataFrame:
    """Raw tokens and template of each text; ``inside``: as they would be in the middle of a sentence."""
    text = df[text_column]
    raw = F.slice(raw_tokens(F.concat(F.lit("x "), text)), 2, 1 << 30) if inside else raw_tokens(text)
    rows = df.select(df[id_column].cast("bigint").alias(name), raw.alias("raw"))
    return rows.filter(F.col(name).isNotNull()).withColumn("template", template(F.col("raw")))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, matched, item_windows, coverage, slots, changed, verbatim.

    ``matched`` is the number of the item's windows found on the best diagonal, ``slots`` the distinct
    slot values there, ``changed`` those that differ in the document; ``verbatim`` if all of the item's windows of raw tokens
    are there on one diagonal. A pair
    is reported if the coverage of the item's template windows reaches ``min_coverage`` and its slots are
    consistent, or if that of its raw windows does; the higher coverage is given. Items with fewer
    tokens than ``window`` are one window of their own length. Null and empty texts, rows without an
    id, and such short items of nothing but numbers match nothing; repeated ids are taken for one document, and
    repeated items are all reported. Other columns are not looked at. Empty tables give an empty result.
    """
    items = stage(_typed(benchmark, item_column, item_text_column, "item_id").filter(F.size("template") > 0))
    # Bounded: sizes under the window.
    short = [r["n"] for r in items.filter(F.size("template") < window).select(F.size("template").alias("n")).distinct().collect()]
    # A capital that begins the item may stand within a sentence of a document, so both readings count.
    within = _typed(benchmark, item_column, item_text_column, "item_id", inside=True).filter(F.size("template") > 0)
    found = windows(items, "item_id", short, window).unionByName(windows(within, "item_id", short, window))
    kinds = F.explode(F.array(*[F.struct(F.lit(k == "plain").alias("as_is"), F.col(k).alias("h")) for k in ("typed", "plain")])).alias("kind")
    # A short item's only window is itself.
    own = F.least(F.size("template"), F.lit(window))
    lengths = items.select("item_id", own.alias("own")).distinct()
    wanted = found.join(lengths, "item_id").filter(F.col("size") == F.col("own"))
    wanted = wanted.select("item_id", F.col("place").alias("item_place"), "size", kinds).select("item_id", "item_place", "size", "kind.as_is", "kind.h")
    wanted = stage(wanted.filter("h is not null").distinct())
    counts = wanted.groupBy("item_id", "as_is").agg(F.countDistinct("item_place").alias("item_windows"))
    typed = _typed(docs, id_column, text_column, "doc_id")
    hashes = F.when(F.col("typed") == F.col("plain"), F.array("typed")).otherwise(F.array("typed", "plain"))
    hits = (
        windows(typed, "doc_id", short, window)
        .select("doc_id", "place", "size", F.explode(hashes).alias("h"))
        .join(broadcast_if_small(wanted), ["size", "h"])
        .select("doc_id", "item_id", "as_is", "item_place", "size", (F.col("place") - F.col("item_place")).alias("shift"))
    )
    diagonals = stage(hits)
    good = (
        diagonals.groupBy("doc_id", "item_id", "as_is", "shift")
        .agg(F.countDistinct("item_place").alias("matched"), F.min("item_place").alias("low"), F.max(F.col("item_place") + F.col("size")).alias("high"))
        .join(broadcast_if_small(stage(counts)), ["item_id", "as_is"])
        .withColumn("coverage", F.col("matched") / F.col("item_windows"))
        .filter(F.col("coverage") >= min_coverage)
    )
    good = stage(good)
    # Slots: the tokens of the few documents that match, seen from the diagonal.
    suspects = stage(good.select("doc_id").distinct())
    texts = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].alias("text")).join(broadcast_if_small(suspects), "doc_id")
    tokens = _typed(texts, "doc_id", "text", "doc_id").select("doc_id", F.col("raw").alias("doc_raw"), F.col("template").alias("doc_template"))
    both = good.join(tokens, "doc_id").join(items.select("item_id", "raw", "template"), "item_id")
    places = F.sequence(F.col("low"), F.col("high") - 1)
    at = F.filter(
        places,
        lambda i: _is_slot(F.get("template", i)) & (F.get("template", i) == F.get("doc_template", i + F.col("shift"))),
    )
    pairs = F.array_distinct(
        F.transform(at, lambda i: F.struct(F.lower(F.get("raw", i)).alias("item"), F.lower(F.get("doc_raw", i + F.col("shift"))).alias("doc")))
    )
    compared = both.withColumn("pairs", pairs)
    slots = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))
    consistent = compared.filter(F.col("as_is") | (slots == F.size("pairs"))).select(
        "doc_id", "item_id", "matched", "item_windows", "coverage", slots.cast("bigint").alias("slots"), changed.cast("bigint").alias("changed"),
        (F.col("as_is") & (F.col("coverage") >= 1)).alias("whole"),
    )
    # One row per pair: the highest coverage, then most windows, then fewest changes, then fewest slots.
    rank = F.struct("coverage", "matched", (-F.col("changed")).alias("kept"), (-F.col("slots")).alias("few"), "item_windows")
    best = consistent.groupBy("doc_id", "item_id").agg(F.max(rank).alias("best"), F.bool_or("whole").alias("verbatim"))
    changes = -F.col("best.kept")
    return best.select(
        "doc_id", "item_id", "best.matched", "best.item_windows", "best.coverage",
        (-F.col("best.few")).alias("slots"), changes.alias("changed"), "verbatim",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that match no item of the benchmark. Columns stay."""
    found = matches(docs, benchmark, id_column, text_column, **options)
    leaked = stage(found.select(F.col("doc_id").alias(id_column)).distinct())
    return docs.join(broadcast_if_small(leaked), id_column, "left_anti")
