import hashlib
import re

import pytest
from pyspark.sql import functions as F

SPACE = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SPACE}]+")
CLASHING = ("h", "sha", "norm", "fp", "root", "anchor", "doc", "start", "end", "n", "key", "line", "line_no", "bucket", "idx", "digest", "keep_id",
            "raw", "template", "item_id", "place", "size", "ids", "file", "row", "spans", "found", "score", "held_out", "rank", "_levels", "_found", "n_tokens")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(ascii_lower(text))


def squeezed(text):
    return re.sub(f"[{SPACE}]+", " ", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


LONG = " ".join(f"word{i % 977} of the long text{i % 13}." for i in range(30_000))

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank at dawn, and then it runs back home again.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n ", "de"),
    (5, "The quick brown fox  jumps over the lazy dog near the old river bank at dawn,\tand then it runs back home again.", "en"),
    (6, "the quick brown fox jumps over the lazy dog near the old river bank at dawn, and then it runs back home again.", None),
    (7, "12345 67890 !!!", "fr"),
    (8, LONG, "en"),
    (9, LONG, "en"),
    (10, "Der schnelle braune Fuchs springt über den faulen Hund am alten Flussufer.\nDer schnelle braune Fuchs springt über den faulen Hund am alten Flussufer.", "de"),
    (11, "x", "xx"),
    (12, "\U0001f600 café mail a.b+c@ex-ample.co.uk, a@b.c_d@e.f or 10.0.255.7 and 300.1.1.1, +1 (555) 010-9999, 4111 1111 1111 1111!", "en"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="session")
def clashing(edge):
    return edge.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
