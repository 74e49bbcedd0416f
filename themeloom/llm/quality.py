"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every whole text are worked out once and staged as fixed-point numbers, so that their
means and spreads over all documents are exact sums. A Gaussian kernel over the standardised statistics
is approximated by random Fourier features, whose values are rounded to 15 binary places: the normal
equations that tasks sum over the labelled documents are then sums of whole numbers, and the model does
not depend on how the rows were dealt. Scores of every fold by a model without it are calibrated by
isotonic regression on a histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import stage

# Random Fourier features; the width of the kernel over standardised statistics; the ridge penalty a row.
FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-4
SEED = 42
# Rows are learned from if crc32 of their id, modulo FOLDS, is not 0; the remainders 1 to 4 are the folds.
FOLDS = 5
# At and above this score a text is predicted to have label 1.
THRESHOLD = 0.3
# Binary places of the statistics and of the features.
_STATISTIC_BITS, _FEATURE_BITS = 16, 15
# Standardised statistics are held within this many spreads of the mean.
_FAR = 5.0
# Labelled rows that are summed into one set of normal equations, at least.
_ROWS_PER_SUM = 1 << 15
# Bins of raw scores, from -1 to 2.
_BINS = 3_000

_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_HIGH = np.array([b > 127 for b in range(256)])
_MARK = ~(_LETTER | _DIGIT | _SPACE)

STATISTICS = (
    "bytes", "words", "word_bytes", "distinct_words", "commonest_word", "repeated_word", "wordless", "letters", "capitals", "digits",
    "marks", "entropy", "non_ascii", "line_breaks", "distinct_lines", "words_a_line", "lines_ended", "exclamations", "bars", "stops",
)


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, each within a fixed range; an empty or null text has those of no bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    size, letters = max(1, len(data)), max(1, int(seen[_LETTER].sum()))
    words = data.split()
    counts = Counter(words)
    n = max(1, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    some = seen[seen > 0] / size
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        np.log1p(sum(map(len, words)) / n),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(c for w, c in counts.items() if not any(b > 127 or 65 <= b & 223 <= 90 for b in w)) / n,
        seen[_LETTER].sum() / size,
        seen[_UPPER].sum() / letters,
        seen[_DIGIT].sum() / size,
        seen[_MARK].sum() / size,
        -float((some * np.log2(some)).sum()),
        seen[_HIGH].sum() / size,
        seen[10] / size,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / max(1, len(lines)),
        seen[33] / n,
        seen[124] / n,
        seen[46] / n,
    ]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [np.round(np.array(statistics(t)) * (1 << _STATISTIC_BITS)).astype(np.int64) for t in batch["text"]]
        yield pd.DataFrame({"doc": batch["doc"], "fold": batch["fold"], "x": made})


@dataclass(frozen=True)
class Kernel:
    """The random Fourier features of standardised statistics."""

    mean: np.ndarray
    spread: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Features of rows of fixed-point statistics, and a constant, as whole numbers in float64."""
        z = np.clip((x / (1 << _STATISTIC_BITS) - self.mean) / self.spread, -_FAR, _FAR)
        made = np.cos(z @ self.frequency + self.phase) * (1 << _FEATURE_BITS)
        return np.round(np.hstack([made, np.full((len(x), 1), 1 << _FEATURE_BITS)]))


def kernel(measured: DataFrame, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> Kernel:
    """The kernel for a table of statistics: mean and spread over all its rows."""
    size = len(STATISTICS)
    x = [F.col("x")[i] for i in range(size)]
    square = [(v.cast("decimal(20,0)") * v.cast("decimal(20,0)")).cast("decimal(28,0)") for v in x]
    sums = measured.agg(F.count(F.lit(1)), *[F.sum(v) for v in x], *[F.sum(s) for s in square]).head()
    n = max(1, sums[0])
    mean = np.array([float(v or 0) / n for v in sums[1 : size + 1]]) / (1 << _STATISTIC_BITS)
    second = np.array([float(v or 0) / n for v in sums[size + 1 :]]) / (1 << 2 * _STATISTIC_BITS)
    spread = np.sqrt(np.maximum(second - mean * mean, 0))
    random = np.random.default_rng(seed)
    frequency = random.standard_normal((size, features)) / width
    return Kernel(mean, np.maximum(spread, 1e-3), frequency, random.uniform(0, 2 * np.pi, features))


def _sums(of: Kernel):
    """Normal equations of each fold, as rows: fold, row of the matrix, its numbers and the right side's."""
    size = len(of.phase) + 1

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y, folds = of.features(np.stack(batch["x"])), batch["y"].to_numpy(np.float64), batch["fold"].to_numpy()
            for fold in np.unique(folds):
                here = z[folds == fold]
                # Whole numbers below 2^53 in a batch, so that BLAS is exact; int64 beyond.
                both = np.hstack([here, (y[folds == fold] * (1 << _FEATURE_BITS))[:, None]])
                total[int(fold)] = total.get(int(fold), 0) + (here.T @ both).astype(np.int64)
        for fold, matrix in total.items():
            yield pd.DataFrame({"fold": fold, "row": np.arange(size), "sums": list(matrix)})

    return add


def _add_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for fold, row, sums in zip(batch["fold"], batch["row"], batch["sums"]):
            total[fold, row] = total.get((fold, row), 0) + np.asarray(sums, np.int64)
    if total:
        yield pd.DataFrame({"fold": [f for f, _ in total], "row": [r for _, r in total], "sums": list(total.values())})


def solve(matrix: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights from normal equations (the last column is the right side); zeros for no rows."""
    size = len(matrix)
    unit = float(1 << 2 * _FEATURE_BITS)
    n = matrix[-1, -2] / unit
    a = matrix[:, :-1].astype(np.float64) / unit + ridge * max(n, 1.0) * np.eye(size)
    return np.linalg.solve(a, matrix[:, -1].astype(np.float64) / unit)


def isotonic(bins: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising curve from bins of raw scores to shares of label 1: pools of adjacent violators.

    ``bins`` gives rows and rows of label 1. A pool's share counts one row more, half of it label 1.
    """
    pools: list[list[float]] = []
    for b in sorted(bins):
        n, ones = bins[b]
        pools.append([n, ones, n * b])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array([at / n for n, _, at in pools])
    return at, np.maximum.accumulate(np.array([(ones + 0.5) / (n + 1) for n, ones, _ in pools]))


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 1) * (_BINS / 3), 0, _BINS)


@dataclass(frozen=True)
class Model:
    """A kernel, ridge weights and a calibration curve; none of them if there was no label."""

    kernel: Kernel
    weights: np.ndarray | None
    curve: tuple[np.ndarray, np.ndarray] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        raw = self.kernel.features(x) @ self.weights / (1 << _FEATURE_BITS)
        return np.clip(np.interp(_bin(raw), *self.curve), 0.0, 1.0)


def fit(measured: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """Learn from every row of ``measured`` (doc, fold 1 to 4, x) that ``labels`` (doc, y of 0 or 1) names."""
    spark = measured.sparkSession
    of = kernel(measured, features)
    examples = stage(measured.filter("fold > 0").join(labels, "doc").select("fold", "x", F.col("y").cast("double").alias("y")))
    sets = max(1, examples.count() // _ROWS_PER_SUM)
    part = examples.coalesce(sets).mapInPandas(_sums(of), "fold int, row int, sums array<bigint>")
    # Bounded: a row of each fold's matrix.
    rows = part.repartition(min(64, max(1, sets)), "fold", "row").mapInPandas(_add_rows, part.schema).collect()
    if not rows:
        return Model(of, None, None)
    size = features + 1
    by_fold = {f: np.zeros((size, size + 1), np.int64) for f in range(1, FOLDS)}
    for r in rows:
        by_fold[r["fold"]][r["row"]] = r["sums"]
    every = sum(by_fold.values())
    without = {f: solve(every - m, ridge) for f, m in by_fold.items()}

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = of.features(np.stack(batch["x"])) / (1 << _FEATURE_BITS)
            raw = np.array([v @ without[f] for v, f in zip(z, batch["fold"])])
            yield pd.DataFrame({"bin": np.floor(_bin(raw)).astype(np.int32), "y": batch["y"]})

    # Bounded: a row per bin.
    counted = examples.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)), F.sum("y")).collect()
    return Model(of, solve(every, ridge), isotonic({b: (n, int(ones)) for b, n, ones in counted}))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_id_column: str = "doc_id",
    label_column: str = "quality",
    threshold: float = THRESHOLD,
    features: int = FEATURES,
    ridge: float = RIDGE,
) -> DataFrame:
    """For every document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (0 or 1).

    Learns from labelled documents whose crc32 of the id, as text, is not 0 modulo 5; a row without an id
    is held out. Every pair of a document and a label row counts, so repeated ids count again. A label
    is 1 or, for any other number, 0; null labels and labels of unknown documents are not used. Without
    any label to learn from, every score is 0.5. Null and empty texts are scored as texts of no bytes, and equal
    texts get equal scores. An empty table gives no row. Other columns are not looked at.
    """
    doc = docs[id_column].cast("bigint")
    remainder = F.crc32(docs[id_column].cast("string").cast("binary")) % FOLDS
    # -1 marks rows without an id.
    texts = docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), F.coalesce(remainder, F.lit(-1)).cast("int").alias("fold"), docs[text_column].alias("text"))
    measured = stage(texts.mapInPandas(_measure, "doc bigint, fold int, x array<bigint>"))
    known = labels.filter(labels[label_column].isNotNull()).select(labels[label_id_column].cast("bigint").alias("doc"), (labels[label_column] == 1).cast("int").alias("y"))
    model = fit(measured, known, features, ridge)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = model.scores(np.stack(batch["x"])) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"doc": batch["doc"], "fold": batch["fold"], "score": scores})

    found = measured.mapInPandas(scored, "doc bigint, fold int, score double")
    return found.select(
        F.when(F.col("fold") >= 0, F.col("doc")).alias("doc_id"),
        (F.col("fold") <= 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
