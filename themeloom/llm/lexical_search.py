"""Ranked lexical search: dense products of item-vocabulary tiles and document-impact tiles.

The items are taken in blocks of bounded size. For a block, the documents become sparse vectors of the
terms the block uses (one pass over the whole texts, staged), the document frequencies of those terms
are counted, and every task multiplies a tile of item weights with a tile of document impacts. Weights
and impacts are whole numbers, and a vocabulary tile ends before the sum of its products could reach
2^53, so that float64 gives each tile's partial sum exactly, in whatever order BLAS adds; tiles are
added up as 64-bit integers. Each task keeps its k best documents an item, ties by document, and the
best of those are the result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.storage import stage

# Bounds of a block of items: how many, and how many of their terms (distinct within each item).
ITEMS_PER_BLOCK = 512
TERMS_PER_BLOCK = 16_384
# Documents and terms of a tile.
DOCS_PER_TILE = 512
TERMS_PER_TILE = 4_096
# Every product of a weight and an impact is below weight * IMPACT; sums below EXACT are exact in float64.
IMPACT = 1_000_000
EXACT = 1 << 53
# A longer term is known by its digest, so that a block's vocabulary has a size in bytes too.
_TERM_BYTES = 64

# Bytes below 128 that are no letter or digit separate; A-Z becomes a-z; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order: runs of ASCII letters, digits and all other characters beyond ASCII."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return [t if len(t) <= _TERM_BYTES else b"\0" + hashlib.sha256(t).digest() for t in found]


def weight(documents: int, frequency: int) -> int:
    """The weight of a term in ``frequency`` of ``documents`` documents."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term of weight 1 adds for ``tf`` occurrences in a text of ``n`` terms; all whole numbers."""
    if 25 * int(n.max(initial=0)) * documents >= 1 << 63:
        m = np.array([75 + 25 * int(k) * documents // length for k in n], np.int64)
    else:
        m = 75 + (25 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counted = [sorted(Counter(terms_of(t)).items()) for t in batch["text"]]
        yield pd.DataFrame({"item": batch["item"], "terms": [[t for t, _ in c] for c in counted], "counts": [[n for _, n in c] for c in counted]})


def _vectors(vocabulary: dict[bytes, int]):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in batch["text"]:
                found = terms_of(text)
                known = Counter(map(vocabulary.get, found))
                known.pop(None, None)
                n.append(len(found))
                ids.append(list(known))
                tfs.append(list(known.values()))
            made = pd.DataFrame({"doc": batch["doc"], "missing": batch["missing"], "n": n, "ids": ids, "tfs": tfs})
            yield made[made["n"] > 0]

    return of


def tiles(items: list[dict[int, int]], weights: list[int], terms_per_tile: int = TERMS_PER_TILE, exact: int = EXACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vocabulary tiles: the terms of each, and what they weigh for every item, as float64.

    Within a tile no item's weights, times the bound of an impact, add up to ``exact``. A term whose
    repeats alone would is dealt over several tiles.
    """
    most = (exact - 1) // IMPACT
    columns: dict[int, list[tuple[int, int]]] = {}
    for i, counts in enumerate(items):
        for term, n in counts.items():
            columns.setdefault(term, []).append((i, n * weights[term]))
    made, terms, entries, sums = [], [], [], np.zeros(len(items), np.int64)

    def close():
        nonlocal terms, entries
        if terms:
            q = np.zeros((len(items), len(terms)))
            for c, column in enumerate(entries):
                for i, value in column:
                    q[i, c] = value
            made.append((np.array(terms, np.int64), q))
        terms, entries = [], []
        sums[:] = 0

    for term, column in sorted(columns.items()):
        while column:
            part = [(i, min(value, most)) for i, value in column]
            if len(terms) == terms_per_tile or any(sums[i] + value > most for i, value in part):
                close()
            terms.append(term)
            entries.append(part)
            for i, value in part:
                sums[i] += value
            column = [(i, value - most) for i, value in column if value > most]
    close()
    return made


class Best:
    """The k best documents of each item so far: by score, then by document, those without an id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(items)]
        self.floor = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        """Take in a tile of scores (items x documents). A score equal to the k-th may still win by its document."""
        enough = scores >= self.floor[:, None]
        for i in np.flatnonzero(enough.any(1)):
            at = enough[i]
            s, d, m = (np.concatenate(pair) for pair in zip(self.rows[i], (scores[i, at], docs[at], missing[at])))
            order = np.lexsort((d, m, -s))[: self.k]
            self.rows[i] = s[order], d[order], m[order]
            if len(order) == self.k:
                self.floor[i] = s[order[-1]]

    def table(self) -> pd.DataFrame:
        s, d, m = (np.concatenate([r[c] for r in self.rows]) for c in range(3))
        item = np.repeat(np.arange(len(self.rows)), [len(r[0]) for r in self.rows])
        return pd.DataFrame({"item_no": item, "doc": d, "missing": m, "score": s})


def _search(made: list[tuple[np.ndarray, np.ndarray]], items: int, vocabulary: int, documents: int, length: int, k: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(items, k)
        for batch in batches:
            for at in range(0, len(batch), DOCS_PER_TILE):
                part = batch.iloc[at : at + DOCS_PER_TILE]
                sizes = part["ids"].map(len).to_numpy()
                ids = np.concatenate([*part["ids"], np.zeros(0, np.int64)]).astype(np.int64)
                column = np.repeat(np.arange(len(part)), sizes)
                tf = np.concatenate([*part["tfs"], np.zeros(0, np.int64)]).astype(np.int64)
                value = impacts(tf, np.repeat(part["n"].to_numpy(np.int64), sizes), documents, length)
                scores = np.zeros((items, len(part)), np.int64)
                for terms, q in made:
                    place = np.full(vocabulary, -1, np.int64)
                    place[terms] = np.arange(len(terms))
                    row = place[ids]
                    here = row >= 0
                    x = np.zeros((len(terms), len(part)))
                    x[row[here], column[here]] = value[here]
                    scores += (q @ x).astype(np.int64)
                best.add(scores, part["doc"].to_numpy(np.int64), part["missing"].to_numpy(bool))
        yield best.table()

    return of


def _blocks(rows: Iterator, items_per_block: int, terms_per_block: int):
    """Items in blocks within the bounds; an item beyond the bound of terms is a block of its own."""
    block, size = [], 0
    for row in rows:
        if block and (len(block) == items_per_block or size + len(row["terms"]) > terms_per_block):
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row["terms"])
    if block:
        yield block


def _best_of_block(texts: DataFrame, block: list, item_type: T.DataType, k: int) -> DataFrame:
    spark = texts.sparkSession
    vocabulary = {t: v for v, t in enumerate(sorted({bytes(t) for row in block for t in row["terms"]}))}
    vectors = stage(texts.mapInPandas(_vectors(vocabulary), "doc bigint, missing boolean, n bigint, ids array<int>, tfs array<bigint>"))
    totals = vectors.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).head()
    # Bounded: a row per term of the block.
    held = dict(vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect())
    weights = [weight(totals["documents"], held.get(v, 0)) for v in range(len(vocabulary))]
    items = [{vocabulary[bytes(t)]: n for t, n in zip(row["terms"], row["counts"])} for row in block]
    search = _search(tiles(items, weights), len(items), len(vocabulary), totals["documents"], totals["length"], k)
    found = vectors.mapInPandas(search, "item_no int, doc bigint, missing boolean, score bigint")
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), "missing", "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, row["item"]) for i, row in enumerate(block)], T.StructType([T.StructField("item_no", T.IntegerType()), T.StructField("item_id", item_type)]))
    # Bounded: a row per item of the block.
    return stage(ranked.join(F.broadcast(names), "item_no").select("item_id", "rank", F.when(~F.col("missing"), F.col("doc")).alias("doc_id"), "score"))


def top_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    items_per_block: int = ITEMS_PER_BLOCK,
    terms_per_block: int = TERMS_PER_BLOCK,
) -> DataFrame:
    """For every item its ``k`` best documents with a score above 0: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters and digits (A-Z lower-cased) and all characters beyond ASCII, from
    whole texts. A term weighs floor(1000 ln((2N+2)/(2df+1))), and a document adds, for each time the
    item has the term, weight * (10^9 tf div (1000 tf + 12 m)) with m = 75 + (25 n N div L). Equal scores
    go by ascending doc_id. Null and empty texts have no term: such documents do not count in N and such
    items have no row. Every row counts by itself: repeated documents rank side by side, documents
    without an id after others of their score, and repeated items have ranks of their own each.
    An empty table on either side gives no row. Other columns are not looked at.
    """
    spark = docs.sparkSession
    doc = docs[id_column].cast("bigint")
    texts = docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNull().alias("missing"), docs[text_column].alias("text"))
    item_type = items.schema[item_id_column].dataType
    asked = items.select(items[item_id_column].alias("item"), items[item_text_column].alias("text"))
    schema = T.StructType([T.StructField("item", item_type), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    stored = stage(asked.mapInPandas(_item_terms, schema).filter(F.size("terms") > 0))
    found = [_best_of_block(texts, block, item_type, k) for block in _blocks(stored.toLocalIterator(), items_per_block, terms_per_block)]
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type)])).selectExpr("item_id", "cast(null as int) as rank", "cast(null as bigint) as doc_id", "cast(null as bigint) as score")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
