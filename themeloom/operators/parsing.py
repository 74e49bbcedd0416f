"""Reading model replies. Everything works inside a row, so nothing here shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import after, before, col, lines, strip
from themeloom.options import FAILED_SUMMARY, FINAL_THEME_COUNT, MAX_QUOTES, UNCATEGORIZED

# Patterns of the reply formats. A numbered entry starts with decimal digits of any
# script; a list item may also start with a digit sign such as a superscript or circled digit.
NUMBERED = r"^\p{Nd}+:"
CONFIDENCE = r"\(([0-9]+)%\)"
LIST_ITEM = (
    r"^(- |[\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}])"
)

_ENTRIES = "array<struct<summary:string,themes:string>>"


def reply_entries(reply: Column | str) -> Column:
    """The entries of a batch reply, as an array of (summary, themes) texts.

    A numbered line starts an entry, whatever its number; ``Summary:`` and ``Themes:`` lines
    overwrite parts of the current one. A summary before any number starts an entry too.
    """

    def mark(line: Column) -> Column:
        body = strip(F.regexp_replace(line, NUMBERED, ""))
        numbered = F.struct(
            F.lit("entry").alias("kind"),
            strip(before(body, "|")).alias("summary"),
            F.coalesce(strip(after(body, "|")), F.lit("")).alias("themes"),
        )
        summary = F.struct(
            F.lit("summary").alias("kind"),
            strip(F.replace(line, F.lit("Summary:"), F.lit(""))).alias("summary"),
            F.lit(None).cast("string").alias("themes"),
        )
        themes = F.struct(
            F.lit("themes").alias("kind"),
            F.lit(None).cast("string").alias("summary"),
            strip(F.replace(line, F.lit("Themes:"), F.lit(""))).alias("themes"),
        )
        return F.when(line.rlike(NUMBERED), numbered).when(line.startswith("Summary:"), summary).otherwise(themes)

    def closed(state: Column) -> Column:
        entry = F.array(F.struct(state["summary"].alias("summary"), state["themes"].alias("themes")))
        return F.when(state["summary"].isNotNull(), F.concat(state["done"], entry)).otherwise(state["done"])

    def state_of(summary: Column, themes: Column, done: Column) -> Column:
        return F.struct(
            summary.cast("string").alias("summary"),
            themes.cast("string").alias("themes"),
            done.cast(_ENTRIES).alias("done"),
        )

    def step(state: Column, line: Column) -> Column:
        return (
            F.when(line["kind"] == "entry", state_of(line["summary"], line["themes"], closed(state)))
            .when(line["kind"] == "summary", state_of(line["summary"], state["themes"], state["done"]))
            .otherwise(state_of(state["summary"], line["themes"], state["done"]))
        )

    telling = F.filter(lines(reply), lambda line: line.rlike(NUMBERED + "|^Summary:|^Themes:"))
    start = state_of(F.lit(None), F.lit(None), F.array())
    return F.aggregate(F.transform(telling, mark), start, step, closed)


def theme_list(entries: DataFrame, source: str = "themes", name: str = "original") -> DataFrame:
    """Replace a comma-separated theme text by an array of (theme, confidence).

    ``(85%)`` gives the confidence, 1.0 without it. A repeated name keeps its first place and
    its last confidence.
    """

    def item(part: Column) -> Column:
        percent = F.regexp_extract(part, CONFIDENCE, 1)
        return F.struct(
            F.when(percent != "", strip(F.regexp_replace(part, CONFIDENCE, ""))).otherwise(part).alias("theme"),
            F.when(percent != "", percent.cast("double") / 100).otherwise(F.lit(1.0)).alias("confidence"),
        )

    parts = F.filter(F.transform(F.split(col(source), ","), strip), lambda p: p != "")
    items = F.filter(F.transform(parts, item), lambda e: e["theme"] != "")
    first_places = F.array_distinct(F.transform("_items", lambda e: e["theme"]))
    last_confidence = F.transform(
        first_places,
        lambda theme: F.struct(
            theme.alias("theme"),
            F.element_at(F.filter("_items", lambda e: e["theme"] == theme), -1)["confidence"].alias("confidence"),
        ),
    )
    kept = [c for c in entries.columns if c != source]
    return (
        entries.select(*kept, F.coalesce(items, F.array().cast("array<struct<theme:string,confidence:double>>")).alias("_items"))
        .select(*kept, last_confidence.alias(name))
    )


def batch_entries(answered: DataFrame) -> DataFrame:
    """One row per text of each answered batch: ``row_id, batch_id, pos, status, summary, original``.

    ``answered`` has ``batch_id``, ``members`` (row ids in order), ``response`` and ``error``. The
    nth entry goes to the nth text. Missing entries are padded (``status = 'padded'``), extra ones
    dropped, and texts of a failed batch stay with ``status = 'error'``.
    """
    parsed = answered.select(
        "batch_id", "members", "error", F.coalesce(reply_entries("response"), F.array().cast(_ENTRIES)).alias("_entries")
    )
    placed = parsed.select("batch_id", "error", "_entries", F.posexplode("members").alias("pos", "row_id"))
    entry = F.get("_entries", F.col("pos"))
    failed = F.col("error").isNotNull()
    rows = placed.select("row_id", "batch_id", "pos", failed.alias("_failed"), entry.alias("_entry"))
    found = F.col("_entry").isNotNull() & ~F.col("_failed")
    return theme_list(
        rows.select(
            "row_id",
            "batch_id",
            "pos",
            F.when(F.col("_failed"), "error").when(found, "ok").otherwise("padded").alias("status"),
            F.when(found, F.col("_entry.summary")).otherwise(F.lit(FAILED_SUMMARY)).alias("summary"),
            F.when(found, F.col("_entry.themes")).alias("themes"),
        )
    )


def consolidation_names(reply: Column | str, final_count: int = FINAL_THEME_COUNT) -> Column:
    """The theme names of a consolidation reply: list items without their mark, distinct, in order."""

    def bare(line: Column) -> Column:
        return strip(
            F.when(line.contains(". "), after(line, ". "))
            .when(line.contains("- "), F.replace(line, F.lit("- "), F.lit("")))
            .otherwise(line)
        )

    listed = F.filter(lines(reply), lambda line: line.rlike(LIST_ITEM))
    names = F.filter(F.transform(listed, bare), lambda name: name != "")
    return F.slice(F.array_distinct(names), 1, final_count)


def theme_mapping(answered: DataFrame, representatives: Sequence[str]) -> DataFrame:
    """``theme, target`` from mapping replies (``chunk_id, themes, response, error``).

    A target must be a representative; otherwise it is the first representative that contains it
    or is contained in it, ignoring case, otherwise the first one. The last line for a theme wins.
    A chunk that failed maps to the first representative. ``representatives`` is a short list.
    """
    reps = F.array(*[F.lit(r) for r in representatives]).cast("array<string>")
    fallback = F.lit(representatives[0] if representatives else UNCATEGORIZED)
    arrows = F.filter(lines("response"), lambda line: line.contains(" -> "))
    given = F.transform(
        arrows,
        lambda line: F.struct(
            strip(before(line, " -> ")).alias("theme"), strip(after(line, " -> ")).alias("named")
        ),
    )
    unread = F.transform("themes", lambda t: F.struct(t.alias("theme"), F.lit(None).cast("string").alias("named")))
    failed = F.col("error").isNotNull()
    if not representatives:
        failed = failed | F.exists(F.coalesce(lines("response"), F.array().cast("array<string>")), lambda x: x.contains(" -> "))
    pairs = answered.select(
        "chunk_id", F.posexplode(F.when(failed, unread).otherwise(given)).alias("_line", "_pair")
    ).select("chunk_id", "_line", "_pair.theme", "_pair.named")
    named = F.lower("named")
    close = F.filter(reps, lambda r: F.lower(r).contains(named) | named.contains(F.lower(r)))
    target = (
        F.when(F.array_contains(reps, F.col("named")), F.col("named"))
        .otherwise(F.coalesce(F.get(close, F.lit(0)), fallback))
    )
    return (
        pairs.withColumn("target", target)
        .groupBy("theme")
        .agg(F.max_by("target", F.struct("chunk_id", "_line")).alias("target"))
    )


def quotes(reply: Column | str, max_quotes: int = MAX_QUOTES) -> Column:
    """The quoted texts of a quote reply, between the first and the last quotation mark of a line."""
    marked = F.filter(lines(reply), lambda line: line.rlike(r'(?s)^QUOTE.*".*"'))
    return F.slice(
        F.transform(marked, lambda line: F.regexp_extract(line, r'(?s)^[^"]*"(.*)"[^"]*$', 1)), 1, max_quotes
    )


def verdict(reply: Column | str, error: Column | str | None = None) -> Column:
    """(similar, confidence, reason) of a verdict reply; ``Answer:`` and ``Similar:`` both count.

    Of several lines of a kind the last readable one counts.
    """
    said = lines(reply)

    def last(values: Column) -> Column:
        return F.try_element_at(values, F.lit(-1))

    answers = F.filter(said, lambda x: x.startswith("Similar:") | x.startswith("Answer:"))
    numbers = F.transform(
        F.filter(said, lambda x: x.startswith("Confidence:")),
        lambda x: strip(F.replace(strip(F.get(F.split(x, ":"), F.lit(1))), F.lit("%"), F.lit(""))),
    )
    readable = F.filter(numbers, lambda x: x.rlike(r"^[+-]?[0-9]+$"))
    reasons = F.filter(said, lambda x: x.startswith("Reason:"))
    failed = F.lit(False) if error is None else col(error).isNotNull()
    return F.struct(
        F.when(failed, F.lit(False))
        .otherwise(F.coalesce(F.lower(last(answers)).contains("yes"), F.lit(False)))
        .alias("similar"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce(last(readable).cast("bigint"), F.lit(0))).alias("confidence"),
        F.when(failed, F.lit("Validation failed"))
        .otherwise(F.coalesce(strip(after(last(reasons), ":")), F.lit("")))
        .alias("reason"),
    )
