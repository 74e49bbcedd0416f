"""Request tables: one prompt per row, keyed by its md5.

The wording is ours and can be replaced through the ``question`` and ``separator`` arguments or by
building the prompt column yourself; what the parsers in :mod:`themeloom.operators.parsing` rely on
is the reply format each prompt asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.options import (
    ANALYSIS_WORDS,
    FINAL_THEME_COUNT,
    MAPPING_CHUNK_SIZE,
    MAX_QUOTES,
    MAX_THEMES_PER_TEXT,
    THEMES_PER_CONSOLIDATION,
)

# The reply formats the parsers read.
BATCH_REPLY = "1: Brief summary here|Theme1,Theme2\n2: Brief summary here|Theme1\n..."
QUOTE_REPLY = 'QUOTE 1: "exact quote text"\nQUOTE 2: "exact quote text"\n...'
VERDICT_REPLY = "Answer: Yes/No\nConfidence: 0-100%\nReason: Brief explanation"
MAPPING_REPLY = "Original Theme 1 -> Representative Theme\nOriginal Theme 2 -> Representative Theme\n..."
LIST_REPLY = "1. [Consolidated Theme Name]\n2. [Consolidated Theme Name]\n..."


def with_key(requests: DataFrame, prompt: str = "prompt", kind: str | None = None) -> DataFrame:
    """Add the cache key of the prompt and, if given, the kind of request (see :data:`themeloom.options.CALLS`)."""
    keyed = requests.withColumn("prompt_md5", F.md5(F.col(prompt).cast("binary")))
    return keyed.withColumn("kind", F.lit(kind)) if kind else keyed


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _context(question: str) -> str:
    return f'The texts answer this question: "{question}"\n' if question else ""


def batch_requests(
    batches: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    question: str = "",
    known_themes: Sequence[str] = (),
    max_themes: int = MAX_THEMES_PER_TEXT,
    separator: str = "\n",
) -> DataFrame:
    """One analysis request per batch: ``batch_id``, ``members`` (row ids in order), ``prompt``.

    ``batches`` has ``batch_id`` and ``pos``; a group holds no more than the batch size.
    """
    known = ""
    if known_themes:
        known = f"Themes in use so far: {', '.join(known_themes)}\nReuse one where it fits.\n"
    grouped = batches.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col(row_id).alias("row_id"), F.col(text).alias("text")))).alias(
            "_items"
        )
    )
    numbered = F.array_join(
        F.transform("_items", lambda item, i: _text(i + 1, ": ", item["text"])), separator
    )
    return with_key(
        grouped.select(
            "batch_id",
            F.size("_items").cast("bigint").alias("n_texts"),
            F.transform("_items", lambda item: item["row_id"]).alias("members"),
            _text(
                "Summarise each text and name its themes, as Summary|Theme1,Theme2,Theme3 on one line.\n"
                f"Give at most {max_themes} themes per text, each specific and no longer than 15 words.\n"
                f"{known}{_context(question)}TEXTS:\n",
                numbered,
                f"\n\nREPLY FORMAT:\n{BATCH_REPLY}",
            ).alias("prompt"),
        ),
        kind="batch",
    )


def _example_list(examples: DataFrame, separator: str) -> DataFrame:
    """One row per theme with its quoted examples; no more of them than the examples table holds."""
    grouped = examples.groupBy("theme").agg(
        F.first("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_items"),
    )
    return grouped.select(
        "theme",
        "total",
        F.size("_items").cast("bigint").alias("shown"),
        F.array_join(F.transform("_items", lambda e: _text('- "', e["text"], '"')), separator).alias("_list"),
    )


def theme_writeup_requests(
    examples: DataFrame, max_words: int = ANALYSIS_WORDS, separator: str = "\n"
) -> DataFrame:
    """Ask for an account of each theme. ``examples``: ``theme, rank, text, total``."""
    more = F.col("total") - F.col("shown")
    remaining = F.when(more > 0, _text(separator, "(and ", more, " others)")).otherwise(F.lit(""))
    return with_key(
        _example_list(examples, separator).select(
            "theme",
            "total",
            "shown",
            _text(
                'Describe the theme "',
                F.col("theme"),
                '" from the entries below.\n\nEntries with it: ',
                F.col("total"),
                "\nEXAMPLES (",
                F.col("shown"),
                " of ",
                F.col("total"),
                "):\n",
                F.col("_list"),
                remaining,
                f"\n\nIn {max_words} words, cover what the theme consists of, how entries differ, and why it "
                "matters. Claim nothing the entries do not support.",
            ).alias("prompt"),
        ),
        kind="writeup",
    )


def quote_requests(examples: DataFrame, max_quotes: int = MAX_QUOTES, separator: str = "\n") -> DataFrame:
    """Ask for verbatim quotes per theme. ``examples``: ``theme, rank, text, total``."""
    return with_key(
        _example_list(examples, separator).select(
            "theme",
            "shown",
            _text(
                f'Pick the {max_quotes} entries that best show the theme "',
                F.col("theme"),
                '".\n\nENTRIES:\n',
                F.col("_list"),
                "\n\nQuote word for word and prefer quotes that show different sides of the theme.\n\n"
                f"REPLY FORMAT:\n{QUOTE_REPLY}",
            ).alias("prompt"),
        ),
        kind="quotes",
    )


def pair_requests(pairs: DataFrame, context: str = "General analysis") -> DataFrame:
    """Ask whether ``theme1`` and ``theme2`` are the same."""
    return with_key(
        pairs.select(
            "theme1",
            "theme2",
            _text(
                'Do these two themes mean the same here?\n\nNew theme: "',
                F.col("theme1"),
                '"\nExisting theme: "',
                F.col("theme2"),
                f'"\nContext: {context}\n\nREPLY FORMAT:\n{VERDICT_REPLY}',
            ).alias("prompt"),
        ),
        kind="verdict",
    )


def _chunks(themes: DataFrame, size: int) -> DataFrame:
    """Themes with a dense ``seq`` gathered into arrays of at most ``size``, in order, and their counts
    ``n`` (null if not known) in ``counts``."""
    n = F.col("n").cast("bigint") if "n" in themes.columns else F.lit(None).cast("bigint")
    return (
        themes.withColumn("chunk_id", F.floor(F.col("seq") / size).cast("bigint"))
        .groupBy("chunk_id")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "theme", n.alias("n")))).alias("_items"))
        .select("chunk_id", F.transform("_items", lambda e: e["theme"]).alias("themes"), F.transform("_items", lambda e: e["n"]).alias("counts"))
    )


def mapping_requests(
    themes: DataFrame, representatives: Sequence[str], chunk_size: int = MAPPING_CHUNK_SIZE
) -> DataFrame:
    """Ask to map chunks of themes (``theme, seq``) to the representative list."""
    return with_key(
        _chunks(themes, chunk_size).select(
            "chunk_id",
            "themes",
            _text(
                "Place each theme below under the broad theme closest to it.\n\n"
                f"BROAD THEMES: {', '.join(representatives)}\n\nTHEMES TO PLACE:\n",
                F.array_join("themes", ", "),
                f"\n\nREPLY FORMAT:\n{MAPPING_REPLY}\n\nSpell the broad themes as they are above.",
            ).alias("prompt"),
        ),
        kind="mapping",
    )


def consolidation_requests(
    themes: DataFrame,
    final_count: int = FINAL_THEME_COUNT,
    question: str = "",
    themes_per_request: int = THEMES_PER_CONSOLIDATION,
) -> DataFrame:
    """Ask to consolidate themes (``theme, seq`` and their counts ``n``, if known) into ``final_count``.

    Every ``themes_per_request`` themes, in order, are one request, so no task gathers a long list; the
    names from all replies are then consolidated again. ``themes`` and ``counts`` of a request go with
    it, so that a failed one loses nothing.
    """
    n = F.size("themes")
    listed = F.zip_with("themes", "counts", lambda t, k: F.concat(F.lit("- "), t, F.coalesce(F.concat(F.lit(" ("), k.cast("string"), F.lit(")")), F.lit(""))))
    return with_key(
        _chunks(themes, themes_per_request).select(
            "chunk_id",
            n.cast("bigint").alias("n_themes"),
            "themes",
            "counts",
            _text(
                "Answers to an open question were tagged with the ",
                n,
                f" themes below, each with its number of answers if known. Replace them by {final_count} broader themes "
                "that leave none out; themes with many answers should decide.\n",
                _context(question),
                "\nTHEMES:\n",
                F.array_join(listed, "\n"),
                "\n\nWrite the names in sentence case, none longer than 15 words.\n\n"
                f"REPLY FORMAT, {final_count} lines and nothing else:\n{LIST_REPLY}",
            ).alias("prompt"),
        ),
        kind="consolidation",
    )
