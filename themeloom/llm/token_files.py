"""Token ids in Parquet files: list columns, row groups and page indexes under control.

Documents are range-partitioned by id, encoded in tasks and written by Spark's committed Parquet writer,
so that file and row order is the order of ids and a lost task leaves nothing behind. The id column is
dictionary-encoded (or delta-encoded), row groups and pages have set sizes, and the writer keeps column
and offset indexes: a reader that wants few documents or only the metadata columns reads few pages.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 2_000
# A worker remembers the ids of this many words at most, and so many ids for each; longer words are encoded each time.
CACHED_WORDS = 750_000
CACHED_BYTES = 64
_CACHED_IDS = 8
# Bytes of text encoded at a time, and words encoded as one text.
_BATCH_BYTES = 4_000_000
_TOGETHER = 200
# Words whose normal form is their small letters and that are never split: letters of ASCII, already
# small, and of Latin-1; with a stop or without.
_PLAIN = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"
_STOPS = (".", ",")

SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>"


class WordEncoder:
    """Ids of whole texts from a tokenizer in lower case that drops white space and joins nothing across it.

    For such a tokenizer the ids of a text are those of its white-space separated parts in turn, and
    most parts are words seen before. The parts of many texts are numbered by Arrow, so that each different one is
    looked up once and ids are gathered by number. New words of plain Latin letters, with or without a full stop or
    comma behind them, skip the tokenizer's normalisation and splitting, which change nothing in them:
    many are encoded as one text and told apart by the tokens that end words.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.stops = {p: self._ids([p]) for p in _STOPS}
        self._forget()

    def _forget(self) -> None:
        # Places of words; the ids of the word in a place are those from its bound to the next one's.
        self.known: dict[str, int] = {}
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of any parts, by the tokenizer as it is."""
        return _flat(self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of plain words in lower case."""
        _, ids = _flat(self.words.encode_batch_fast([" ".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self._ids(words)
        return np.diff(stops, prepend=0), ids

    def _plain_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of plain words in any case, with a stop or without."""
        if not len(parts):
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        cores = pc.dictionary_encode(pc.utf8_lower(pc.utf8_rtrim(parts, "".join(_STOPS))))
        lengths, ids = self._word_ids(cores.dictionary.to_pylist())
        which = cores.indices.to_numpy()
        starts = np.cumsum(lengths) - lengths
        stopped = [pc.ends_with(parts, stop).to_numpy(zero_copy_only=False) for stop in _STOPS]
        # Ids of a stop stand behind those of all words.
        starts, lengths = [starts[which]], [lengths[which]]
        for stop, behind in zip(_STOPS, stopped):
            n, more = self.stops[stop]
            starts.append(np.full(len(parts), len(ids)))
            lengths.append(np.where(behind, n[0], 0))
            ids = np.concatenate([ids, more])
        found = _gathered(ids, np.column_stack(starts).ravel(), np.column_stack(lengths).ravel())
        return np.sum(lengths, axis=0), found

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """The places of new parts."""
        plain = pc.match_substring_regex(parts, _PLAIN)
        some, others = parts.filter(plain), parts.filter(pc.invert(plain)).to_pylist()
        found = [self._plain_ids(some), self._ids(others)]
        first = len(self.bounds) - 1
        lengths = np.concatenate([f[0] for f in found])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, *(f[1] for f in found)])
        places = np.arange(first, first + len(lengths))
        self.known.update((part, place) for part, place in zip([*some.to_pylist(), *others], places.tolist()) if len(part) <= CACHED_BYTES)
        order = np.empty(len(parts), np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        order[mask], order[~mask] = places[: len(some)], places[len(some) :]
        return order

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, null being empty, and the ids of all texts in turn."""
        if len(self.known) > CACHED_WORDS or len(self.ids) > _CACHED_IDS * CACHED_WORDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        # A-Z only become small, which the tokenizer does too, but its special tokens keep their case; texts are
        # split at the white space of ASCII only, all of which the tokenizer drops.
        small = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(small)
        parts = pc.dictionary_encode(split.flatten())
        words = parts.dictionary
        known = self.known
        places = np.fromiter(map(known.get, words.to_pylist(), repeat(-1)), np.int64, len(words))
        new = places < 0
        if new.any():
            places[new] = self._learn(words.filter(pa.array(new)))
        starts, lengths = self.bounds[places], np.diff(self.bounds)[places]
        which = parts.indices.to_numpy()
        each = lengths[which]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        return np.diff(ends), _gathered(self.ids, starts[which], each)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        lengths, ids = self.encode(pa.array(texts, pa.string()))
        return [part.astype("<u4").tobytes() for part in np.split(ids, np.cumsum(lengths)[:-1])]


def _flat(found: list) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.array(e.ids, np.uint32) for e in found]
    return np.array([len(i) for i in ids], np.int64), np.concatenate([np.empty(0, np.uint32), *ids])


def _gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``starts`` and have these lengths, one after another."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return ids[at]


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes of text, a row at least."""
    for batch in rows:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(ends):
            held = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, held + _BATCH_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _encode(path: str, end_id: int):
    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks are what runs side by side.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(path)
        for piece in _pieces(rows):
            lengths, ids = encoder.encode(piece.column(1))
            ends = np.cumsum(lengths)
            values = np.insert(ids.astype(np.int32), ends, end_id)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
            arrays = [piece.column(0), pa.array(lengths + 1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids"])

    return encode


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text and write doc_id, n_tokens (with the end id) and ids, in ascending order of ids.

    Null and empty texts are the end id alone. Rows that repeat an id stay next to each other; rows without
    an id come first. Other columns are not written. An empty table writes files without rows.
    ``tokenizer_path`` must be readable at the same place on all machines.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].alias("text"))
    # The texts are moved, which are smaller than their ids; ties fall to the text, so that a retry agrees.
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    coded = ordered.mapInArrow(_encode(tokenizer_path, end_id), SCHEMA)
    dictionary = encoding == "dictionary"
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": str(dictionary).lower(),
        "parquet.writer.version": "v1" if dictionary else "v2",
    }
    coded.write.options(**options).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The chosen columns of the files; filters on doc_id skip row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(folder).select(*columns)


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return pd.Series([zlib.crc32(np.asarray(a).astype("<u4").tobytes()) for a in ids], dtype="int64")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """From the files, for every document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Totals by file give each file's start; a running sum inside a file gives the document's. Only a row
    per file is ordered in one task.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"),
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_block_start").alias("block"),
    )
    # File names carry the number of the range they hold; row numbers run through a file.
    metadata = spark.read.schema(SCHEMA).parquet(folder).select("n_tokens", F.col("_metadata.file_name").alias("file"))
    totals = metadata.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(starts, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
