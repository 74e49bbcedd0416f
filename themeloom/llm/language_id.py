"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all labelled training documents, in tasks. Of those documents
``fit_rows`` (chosen by the hash of their ids) turn into sparse vectors that train the model in one
task, by follow-the-regularised-leader with elastic-net penalties; further ``calibrate_rows`` set the
temperature of the softmax. The model is one small row of weights, of a size fixed by the number of
n-gram buckets and languages, and every document is predicted from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.sampling import smallest

# N-grams of 1 to this many characters, hashed into this many buckets.
ORDERS = 3
BUCKETS = 1 << 16
# Bounds of the labelled rows that train and calibrate.
FIT_ROWS = 6_000
CALIBRATE_ROWS = 2_000
# Rows of each language that are in the sample however rare it is, if there are that many.
LANGUAGE_ROWS = 200
UNDECIDED = "und"
# Characters of a text that are looked at at a time; all pieces of a text are.
_PIECE = 1 << 20


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case, with all but letters as a space; and whether it is a letter."""
    letter = np.zeros(0x110000, bool)
    lower = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            letter[point] = True
            lower[point] = ord(c.lower()[0])
    return lower, letter


def ngram_counts(text: str | None, orders: int = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the n-grams of a whole text; None if it has no letter."""
    lower, letter = _letters()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[points].any():
        return None
    counts = np.zeros(buckets, np.int64)
    for at in range(0, len(points), _PIECE):
        # A piece sees the end of the one before it, so that no n-gram is lost or counted twice.
        seen = lower[points[max(0, at - orders + 1) : at + _PIECE]].astype(np.uint64)
        before = min(at, orders - 1)
        gram = np.zeros(len(seen), np.uint64)
        for n in range(1, orders + 1):
            # gram[i] covers the n characters that end at i.
            gram = (np.concatenate([np.zeros(1, np.uint64), gram[:-1]]) if n > 1 else gram) * np.uint64(0x110001) + seen + np.uint64(1)
            first = max(before, n - 1)
            if first < len(seen):
                mixed = (gram[first:] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                counts += np.bincount((mixed >> np.uint64(32)).astype(np.int64) % buckets, minlength=buckets)
    used = np.flatnonzero(counts)
    return used, counts[used]


def _document_counts(buckets: int, orders: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found = ngram_counts(text, orders, buckets)
                if found is not None:
                    seen[found[0]] += 1
                    rows += 1
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(used, -1), "n": np.append(seen[used], rows)})

    return count


def vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF vector of unit length."""
    used, counts = found
    values = (1 + np.log(counts)) * idf[used]
    return used, values / max(np.sqrt(values @ values), 1e-12)


def ftrl(vectors: list, labels: np.ndarray, classes: int, buckets: int, alpha=1.0, beta=1.0, l1=1e-4, l2=1e-4, epochs=3) -> np.ndarray:
    """Weights (buckets x classes) after ``epochs`` passes of FTRL-proximal with elastic net, row by row."""
    z = np.zeros((buckets, classes))
    n = np.zeros((buckets, classes))

    def weights(at):
        active = np.abs(z[at]) > l1
        return np.where(active, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for (used, values), label in zip(vectors, labels):
            w = weights(used)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w
            n[used] += g * g
    return weights(np.arange(buckets))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature on a fixed grid with the smallest log loss."""
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 120)):
        scaled = logits / t
        top = scaled.max(1)
        loss = float(np.mean(np.log(np.exp(scaled - top[:, None]).sum(1)) + top - scaled[np.arange(len(labels)), labels]))
        best = min(best, (loss, float(t)))
    return best[1]


def _train(languages: list[str], orders: int, buckets: int, idf: np.ndarray):
    def train(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["rank", "doc_id"], kind="stable")
        known = {name: k for k, name in enumerate(languages)}
        pairs = [(ngram_counts(t, orders, buckets), known[name], fit) for t, name, fit in zip(table["text"], table["lang"], table["fit"])]
        kept = [(vector(f, idf), k, fit) for f, k, fit in pairs if f is not None]
        fit = [(v, k) for v, k, use in kept if use]
        w = ftrl([v for v, _ in fit], np.array([k for _, k in fit], int), len(languages), buckets)
        held = [(v, k) for v, k, use in kept if not use] or fit
        t = temperature(np.array([v[1] @ w[v[0]] for v, _ in held]), np.array([k for _, k in held], int)) if held else 1.0
        yield pd.DataFrame({"weights": [(w / t).astype(np.float32).tobytes()], "idf": [idf.astype(np.float32).tobytes()]})

    return train


def in_training(id_column: Column, folds: int = 5) -> Column:
    """Whether a row may be learned from: crc32 of the id as text, modulo ``folds``, is not 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds != 0, F.lit(False))


class Model:
    """Weights by bucket and language, already divided by the temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, orders: int) -> None:
        self.languages, self.weights, self.idf, self.orders = languages, weights, idf, orders

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its probability; ``und`` and 0 without a letter or without a known language."""
        found = ngram_counts(text, self.orders, len(self.idf)) if self.languages else None
        if found is None:
            return UNDECIDED, 0.0
        used, values = vector(found, self.idf)
        logits = values @ self.weights[used]
        p = np.exp(logits - logits.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def fit(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    fit_rows: int = FIT_ROWS,
    calibrate_rows: int = CALIBRATE_ROWS,
    orders: int = ORDERS,
    buckets: int = BUCKETS,
    language_rows: int = LANGUAGE_ROWS,
) -> Model:
    """Learn from all rows of ``labelled`` with a text and a language.

    Statistics cover every row. The ``fit_rows`` and ``calibrate_rows`` rows with the smallest hashes of
    id are the bounded sample that trains and calibrates, and with them the ``language_rows`` smallest of each language, so that no
    language of the table is missing from the model. Ties in the hash fall to the smaller id.
    """
    rows = labelled.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    counts = rows.select("text").mapInPandas(_document_counts(buckets, orders), "bucket int, n bigint")
    # Bounded: one row per bucket.
    seen = {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = seen.pop(-1, 0)
    frequency = np.zeros(buckets)
    for bucket, n in seen.items():
        frequency[bucket] = n
    idf = np.log((1 + total) / (1 + frequency)) + 1
    ranked = rows.withColumn("rank", F.xxhash64(F.col("doc_id").cast("string")))
    # Ids first: their bound keeps texts that are not in the sample where they are.
    narrow = ranked.select("rank", "doc_id", "lang")
    last = smallest(narrow, "rank", fit_rows + calibrate_rows, total, "doc_id").collect()
    if not last:
        return Model([], np.zeros((buckets, 0), np.float32), idf, orders)
    bound, split = last[-1]["rank"], last[min(fit_rows, len(last)) - 1]["rank"]
    # Every language there is, and enough of the rare ones. Each task passes on this many rows a language.
    order = Window.partitionBy("lang").orderBy("rank", "doc_id")
    least = narrow.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= language_rows).collect()
    languages = sorted({r["lang"] for r in least})
    # Those train, but for every fourth, which calibrates; the commonest languages' are among the first of the sample anyway.
    chosen, fitted = [r["rank"] for r in least if r["rank"] > bound], [r["rank"] for r in least if r["place"] % 4 and r["rank"] > split]
    known = (F.col("rank") <= bound) | F.col("rank").isin(chosen)
    sample = ranked.filter(known).withColumn("fit", (F.col("rank") <= split) | F.col("rank").isin(fitted))
    trained = sample.coalesce(1).mapInPandas(_train(languages, orders, buckets, idf), "weights binary, idf binary").head()
    weights = np.frombuffer(trained["weights"], np.float32).reshape(buckets, len(languages))
    return Model(languages, weights, np.frombuffer(trained["idf"], np.float32), orders)


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> Column:
    """A struct column (lang_pred, score) for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    return of(docs[text_column])


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **options) -> DataFrame:
    """For every row: doc_id, held_out (not learned from), lang_pred, score (0 to 1).

    Learns from the rows of :func:`in_training` that have a text and a language, and predicts every row
    from its text alone. Null texts, texts without a letter and all texts if nothing could be learned
    are ``und`` with score 0. Rows without an id are held out. Equal texts get equal predictions.
    """
    learn = in_training(docs[id_column])
    model = fit(docs.filter(learn), id_column, text_column, lang_column, **options)
    made = predict(docs, model, text_column)
    found = docs.select(docs[id_column].cast("bigint").alias("doc_id"), (~learn).alias("held_out"), made.alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_known(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", min_score: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` whose text has a language of at least ``min_score``.

    Rejected are texts without a letter, which have none, and those under the score. Without any row to learn from no
    language is known, and only texts without a letter are rejected. Columns stay. Rows with equal or no ids are judged each by
    itself; an empty table gives an empty one.
    """
    model = fit(docs.filter(in_training(docs[id_column])), id_column, text_column, lang_column, **options)
    if not model.languages:
        return docs.filter(docs[text_column].rlike(r"\p{L}"))
    made = predict(docs, model, text_column)
    name = "_found"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, made)
    return found.filter((found[name]["lang_pred"] != UNDECIDED) & (found[name]["score"] >= min_score)).drop(name)
