"""Repeated passages: hashing of lines, paragraphs or sentences over the whole corpus.

A unit (a line, a paragraph between blank lines, or a sentence, in which line breaks are folded) is normalised and replaced
by its digest; digests are grouped over all documents, the earliest unit by (document id, place in the
document) stays and later ones are repeated. Repeated units that follow each other are a run, and runs of enough words
go: single short lines repeat by chance or by form, passages do not. Only digests and places are shuffled, and
partial aggregation folds a passage that very many documents share to one row per task. Removed units keep
their offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.storage import stage

# Runs of repeated units with fewer words stay.
MIN_WORDS = 20
LINE, PARAGRAPH, SENTENCE = "line", "paragraph", "sentence"
KINDS = (LINE, SENTENCE)
_DIGEST_BYTES = 16
# Units handed on at a time, which bounds memory when one text has very many.
_ROWS = 50_000

_SPACE = r"\x20\x09-\x0d"
_PATTERNS = {
    LINE: re.compile(r"[^\n]+"),
    # Up to a blank line.
    PARAGRAPH: re.compile(rf"(?![{_SPACE}]).+?(?=\n[{_SPACE}]*\n|\Z)", re.S),
    # Up to a word that ends in one of these marks.
    SENTENCE: re.compile(rf"(?![{_SPACE}]).+?(?:(?<=[.!?])(?=[{_SPACE}]|\Z)|\Z)", re.S),
}
_ASCII_SPACE = " \t\n\x0b\x0c\r"

# A text has fewer than 2^31 characters.
_SCHEMA = "doc_id bigint, kind tinyint, unit int, start int, end int, n_words int, first boolean, digest binary"


def normalised(unit: str) -> bytes:
    """A-Z in lower case; words between white space (space and U+0009 to U+000D) joined by one space."""
    return b" ".join(unit.encode("utf-8", "surrogatepass").lower().split())


def units_of(text: str | None, kind: str) -> Iterator[tuple]:
    """(unit, start, end, n_words, first with its digest in the text, digest) of the units of a text that have a word,
    numbered in order; white space around a unit is not part of it."""
    seen: set[bytes] = set()
    number = 0
    for match in _PATTERNS[kind].finditer(text or ""):
        part = match.group().rstrip(_ASCII_SPACE)
        shown = part.lstrip(_ASCII_SPACE)
        if not shown:
            continue
        plain = normalised(shown)
        key = hashlib.blake2b(plain, digest_size=_DIGEST_BYTES).digest()
        yield number, match.start() + len(part) - len(shown), match.start() + len(part), plain.count(b" ") + 1, key not in seen, key
        seen.add(key)
        number += 1


def units(docs: DataFrame, id_column: str, text_column: str, kinds: Sequence[str]) -> DataFrame:
    """One row per unit of every text, with its place and digest, and its kind by number."""
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for number, kind in enumerate(kinds):
                    for unit in units_of(text, kind):
                        rows.append((doc_id, number, *unit))
                        if len(rows) >= _ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].alias("text"))
    return chosen.filter("doc_id is not null and text is not null").mapInPandas(scan, _SCHEMA)


def repeated_units(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    kinds: Sequence[str] = KINDS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """The units to remove: doc_id, kind, unit (number among the units of its kind in the text), start, end (code points, end
    exclusive), n_words, keep_id (the document whose unit stays).

    Units are equal if they are of one kind and equal after :func:`normalised`. Of equal units the first one of the document
    with the smallest id stays, and the others are repeated; those in runs of consecutive repeated units of at least
    ``min_words`` words together are to go. A passage may be found as lines and as sentences; their spans overlap.
    Null and empty texts and rows without an id give none. Rows that repeat an id are taken for one document: their first
    units all stay. Other columns are not looked at. An empty table gives an empty result.
    """
    found = stage(units(docs, id_column, text_column, kinds))
    groups = found.groupBy("kind", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    shared = stage(groups.filter("n > 1").drop("n"))
    later = (F.col("doc_id") > F.col("keep_id")) | ~F.col("first")
    # Digests grow with the corpus: both sides are shuffled at every size, and adaptive execution splits a hot one.
    repeated = found.join(shared.hint("merge"), ["kind", "digest"]).filter(later)
    # Consecutive numbers differ from their rank by the same amount.
    text = Window.partitionBy("doc_id", "kind")
    run = F.col("unit") - F.dense_rank().over(text.orderBy("unit"))
    words = F.sum("n_words").over(Window.partitionBy("doc_id", "kind", "_run"))
    return (
        repeated.withColumn("_run", run)
        .withColumn("_words", words)
        .filter(F.col("_words") >= min_words)
        .select("doc_id", F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("kind") + 1).alias("kind"), *[F.col(c).cast("bigint").alias(c) for c in ("unit", "start", "end", "n_words")], "keep_id")
    )


def remove_units(docs: DataFrame, removed: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the units in ``removed`` (of :func:`repeated_units`) cut from the text, each with the white space after it, or
    before it at the end of the text."""
    spans = removed.groupBy(F.col("doc_id").alias(id_column)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_s"))
    spans = spans.select(id_column, F.transform("_s", lambda s: s["start"]).alias("_starts"), F.transform("_s", lambda s: s["end"]).alias("_ends"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        def one(text, starts, ends):
            if text is None or starts is None:
                return text
            kept, at, whole = [], 0, len(text)
            for start, end in zip(starts, ends):
                if start > at:
                    kept.append(text[at:start])
                at = max(at, end)
                while at < whole and text[at] in _ASCII_SPACE:
                    at += 1
            kept.append(text[at:])
            made = "".join(kept)
            return made.rstrip(_ASCII_SPACE) if at >= whole else made

        return pd.Series([one(*row) for row in zip(texts, starts, ends)], dtype=object)

    joined = docs.join(spans, id_column, "left")
    return joined.withColumn(text_column, cut(F.col(text_column), F.col("_starts"), F.col("_ends"))).select(*docs.columns)
