"""Scores of texts by an n-gram model kept as Elias-Fano tries in memory-mapped files.

Words are known by 64-bit hashes and numbered in the order of their hashes. Tasks count the n-grams of
their documents and deal them to shards; a shard is a range of (first, second word), cut so that each
holds about ``SHARD_TOKENS`` tokens, and a frequent first word is spread over several. One task per
shard merges its counts and writes the trie of the range: rising pointers from each context to its
continuations, and continuations as word ids on top of the last one of the context before, so that each
level is one rising sequence in which a word is searched relative to its context.

Probabilities are smoothed by interpolated discounting, with discounts of counts 1, 2 and more that each
shard estimates from its own counts of counts: p(w|h) = a(hw) + g(h) p(w|h'), down to additive smoothing
of single words. a and g are stored as logarithms in 16 bits, rounded down, so that no context sums to
more than one.

The files lie below ``spark.checkpoint.dir``, which must be a folder that all machines can open, since
memory mapping needs that. Files are renamed into place, so a lost task is simply run again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.elias_fano import Sequence, load, save

ORDER = 3
SHARD_TOKENS = 4_000_000
# The vocabulary is cut by the leading bits of the words' hashes; choose so many that a part fits a task.
VOCABULARY_BITS = 6
# Additive smoothing of single words.
ADDED = 0.1
END = xxhash.xxh64_intdigest(b"\n")
# Tokens counted or scored at a time in a task.
_FLUSH = 2_000_000
_SCORED = 500_000
# Stored logarithms have steps of this size.
_STEP = 2.0**-11
_NONE = 65_535


def tokens(text: str | None) -> list[int]:
    """Hashes of the words of a text in A-Z lower case, then of its end."""
    digest = xxhash.xxh64_intdigest
    return [digest(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()] + [END]


def in_training(id_column, folds: int = 10):
    """Whether a row may be learned from: crc32 of the id as text, modulo ``folds``, is not 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds != 0, F.lit(False))


def local_path(folder: str) -> str:
    """The path under which every machine opens a shared folder."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a folder that all machines can open, not {folder}")
    return parts.path


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, bytes of a place together, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(1).compress(planes)


def _unsqueeze(payload: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in flat]


def _counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, with their summed weights."""
    if weights is None:
        found, n = np.unique(values, return_counts=True)
        return found, n.astype(np.int64)
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return values[first], np.add.reduceat(weights, first) if len(first) else weights


def _hashes(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[list[list[int]]]:
    """Texts as lists of hashes, about ``limit`` tokens together."""
    held, n = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(tokens(text))
            n += len(held[-1])
            if n >= limit:
                yield held
                held, n = [], 0
    if held:
        yield held


def _flat(texts: list[list[int]]) -> np.ndarray:
    return np.fromiter((h for t in texts for h in t), np.uint64, sum(map(len, texts)))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of word hashes by part of the vocabulary."""
    for texts in _hashes(batches, 2 * _FLUSH):
        found, n = _counted(_flat(texts))
        part = (found >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)
        edges = np.searchsorted(part, np.arange((1 << VOCABULARY_BITS) + 1))
        used = [k for k in range(1 << VOCABULARY_BITS) if edges[k] < edges[k + 1]]
        rows = [_squeeze(np.diff(found[a:b], prepend=np.uint64(0)), n[a:b]) for a, b in ((edges[k], edges[k + 1]) for k in used)]
        yield pd.DataFrame({"part": used, "payload": rows})


def _write_part(folder: str):
    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        columns = [_unsqueeze(p, 2) for p in rows["payload"]]
        found, n = _counted(np.concatenate([np.cumsum(c[0]) for c in columns]), np.concatenate([c[1].astype(np.int64) for c in columns]))
        before = np.concatenate([[0], np.cumsum(n)])
        save(f"{folder}/words-{key[0]}", {"hashes": Sequence.build(found)}, {"before": before}, {})
        return pd.DataFrame({"part": [key[0]], "words": [len(found)], "tokens": [int(before[-1])]})

    return write


class Vocabulary:
    """Ids of word hashes, their counts, and the tokens before each in the order of ids."""

    def __init__(self, folder: str, parts: list[tuple[int, int, int]]) -> None:
        """``parts``: (part, words, tokens), rising."""
        self.parts = {k: load(f"{folder}/words-{k}") for k, _, _ in parts}
        self.first = np.concatenate([[0], np.cumsum([w for _, w, _ in parts])]).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum([t for _, _, t in parts])]).astype(np.int64)
        self.order = [k for k, _, _ in parts]
        self.size, self.tokens = int(self.first[-1]), int(self.base[-1])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; -1 for unknown ones."""
        found = np.full(len(hashes), -1, np.int64)
        for i, k in enumerate(self.order):
            a, b = np.searchsorted(hashes >> np.uint64(64 - VOCABULARY_BITS), [k, k + 1])
            if a < b:
                part = self.parts[k][0]["hashes"]
                place = part.successor(hashes[a:b])
                inside = np.flatnonzero(place < part.n)
                same = inside[part[place[inside]] == hashes[a:b][inside]]
                found[a + same] = self.first[i] + place[same]
        return found

    def before(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of all words with smaller ids; ids may be one past the last."""
        if not self.order:
            return np.zeros(len(ids), np.int64)
        part = np.minimum(np.searchsorted(self.first, ids, side="right") - 1, len(self.order) - 1).astype(np.int16)
        rows = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[rows], np.arange(len(self.order) + 1))
        found = np.zeros(len(ids), np.int64)
        for i, k in enumerate(self.order):
            at = rows[edges[i] : edges[i + 1]]
            found[at] = self.base[i] + self.parts[k][1]["before"][ids[at] - self.first[i]]
        return found

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self.before(ids + 1) - self.before(ids)


@lru_cache(2)
def _vocabulary(folder: str, parts: tuple) -> Vocabulary:
    return Vocabulary(folder, list(parts))


def _shard_of(words: Vocabulary, first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    """The shard of pairs of words: it rises with (first, second) and each is met about equally often."""
    if not words.tokens:
        return np.zeros(len(first), np.int64)
    start = words.before(first)
    n = words.before(first + 1) - start
    place = start + n * (words.before(second) / words.tokens)
    return np.minimum((place * (shards / words.tokens)).astype(np.int64), shards - 1)


def _count_ngrams(folder: str, parts: tuple, shards: int, order: int):
    """Counts of (first * V + second, third) by shard; the third is V where a text ends, and for bigrams."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _vocabulary(folder, parts)
        size = np.uint64(words.size)
        for texts in _hashes(batches, _FLUSH):
            flat = _flat(texts)
            known, place = np.unique(flat, return_inverse=True)
            ids = words.ids(known)[place].astype(np.uint64)
            last = np.zeros(len(ids), bool)
            last[np.cumsum([len(t) for t in texts]) - 1] = True
            begin = np.flatnonzero(~last)
            if not len(begin):
                continue
            pair = ids[begin] * size + ids[begin + 1]
            third = np.full(len(begin), size, np.uint64)
            if order > 2:
                more = ~last[begin + 1]
                third[more] = ids[begin[more] + 2]
            sort = np.lexsort((third, pair))
            pair, third = pair[sort], third[sort]
            starts = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
            n = np.diff(np.append(starts, len(pair)))
            pair, third = pair[starts], third[starts]
            shard = _shard_of(words, (pair // size).astype(np.int64), (pair % size).astype(np.int64), shards)
            used = np.unique(shard)
            edges = np.append(np.searchsorted(shard, used), len(shard))
            rows = [_squeeze(np.diff(pair[a:b], prepend=np.uint64(0)), third[a:b], n[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pd.DataFrame({"shard": used, "payload": rows})

    return count


def discounts(n: np.ndarray) -> np.ndarray:
    """What counts of 1, 2 and 3 or more lose, from the counts of counts of ``n``."""
    t = [int((n == k).sum()) for k in (1, 2, 3, 4)]
    if not t[0] or not t[1]:
        return np.array([0.5, 0.75, 0.9])
    y = t[0] / (t[0] + 2 * t[1])
    found = [k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.array([min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3))])


def _coded(p: np.ndarray) -> np.ndarray:
    """Logarithms in steps, rounded down."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log10(p) / _STEP), _NONE).astype(np.uint16)


def _decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code == _NONE, 0.0, 10.0 ** (-_STEP * code.astype(float)))


def _chained(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Words (rising in each context) on top of the last one of the context before: one rising sequence."""
    if not len(context):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    ends = np.append(starts[1:], len(context)) - 1
    top = np.concatenate([[0], np.cumsum(word[ends].astype(np.int64) + 1)[:-1]])
    return np.repeat(top, np.diff(np.append(starts, len(context)))) + word.astype(np.int64) + 1


def _level(context: np.ndarray, contexts: int, word: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[dict, dict, np.ndarray]:
    """Sequences and arrays of one level, and by context the discounted counts that g is made of."""
    lost = discounts(n)
    loses = lost[np.minimum(n, 3) - 1]
    pointers = np.searchsorted(context, np.arange(contexts + 1))
    mass = np.bincount(context, weights=loses, minlength=contexts)
    return {"pointers": Sequence.build(pointers), "words": Sequence.build(_chained(context, word))}, {"a": _coded((n - loses) / total[context])}, mass


def _write_shard(folder: str, parts: tuple, order: int):
    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words = _vocabulary(folder, parts)
        size = np.uint64(words.size)
        columns = [_unsqueeze(p, 3) for p in rows["payload"]]
        pair = np.concatenate([np.cumsum(c[0]) for c in columns])
        third = np.concatenate([c[1] for c in columns])
        n = np.concatenate([c[2] for c in columns]).astype(np.int64)
        del columns
        sort = np.lexsort((third, pair))
        pair, third, n = pair[sort], third[sort], n[sort]
        starts = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
        n, pair, third = np.add.reduceat(n, starts), pair[starts], third[starts]
        two = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pairs, n_pairs = pair[two], np.add.reduceat(n, two)
        first = (pairs // size).astype(np.int64)
        low, high = int(first[0]), int(first[-1])
        total = words.counts(np.arange(low, high + 1))
        seq2, arr2, mass = _level(first - low, high - low + 1, pairs % size, n_pairs, np.maximum(total, 1))
        sequences = {f"2/{k}": s for k, s in seq2.items()}
        arrays = {f"2/{k}": a for k, a in arr2.items()} | {"1/g": _coded(mass / np.maximum(total, 1))}
        if order > 2:
            context = np.repeat(np.arange(len(two)), np.diff(np.append(two, len(pair))))
            real = third < size
            held = np.bincount(context[real], weights=n[real], minlength=len(two))
            seq3, arr3, mass3 = _level(context[real], len(two), third[real], n[real], np.maximum(held, 1))
            sequences |= {f"3/{k}": s for k, s in seq3.items()}
            arrays |= {f"3/{k}": a for k, a in arr3.items()} | {"2/g": _coded(np.where(held > 0, mass3 / np.maximum(held, 1), 0))}
        save(f"{folder}/shard-{key[0]}", sequences, arrays, {"low": low, "high": high})
        # The words at a shard's edges may go on in the next shard, so their parts of g are put together later.
        return pd.DataFrame({
            "shard": [key[0]], "low": [low], "high": [high],
            "mass_low": [float(mass[0])], "mass_high": [float(mass[-1])],
            "total_low": [int(total[0])], "total_high": [int(total[-1])],
            "ngrams": [len(pairs) + (int((third < size).sum()) if order > 2 else 0)],
        })

    return write


class Model:
    """The mapped files of a model; small facts of its parts come from the driver."""

    def __init__(self, folder: str, parts: tuple, shards: tuple, shared: tuple, count: int, order: int) -> None:
        """``shared``: g of first words that several shards hold; ``count``: shards there could be."""
        self.words = _vocabulary(folder, parts)
        self.shards = {k: load(f"{folder}/shard-{k}") for k in shards}
        self.shared, self.count, self.order = dict(shared), count, order

    def _children(self, shard: int, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words among the continuations of contexts, or -1; and whether the context has any."""
        sequences, _, _ = self.shards[shard]
        pointers, chain = sequences[f"{level}/pointers"], sequences[f"{level}/words"]
        start, end = pointers[context].astype(np.int64), pointers[context + 1].astype(np.int64)
        place = np.full(len(context), -1, np.int64)
        some = np.flatnonzero(start < end)
        top = np.zeros(len(some), np.uint64)
        later = np.flatnonzero(start[some] > 0)
        top[later] = chain[start[some][later] - 1]
        wanted = top + word[some].astype(np.uint64) + np.uint64(1)
        at = chain.successor(wanted)
        inside = np.flatnonzero(at < end[some])
        hit = inside[chain[at[inside]] == wanted[inside]]
        place[some[hit]] = at[hit]
        return place, start < end

    def pairs(self, first: np.ndarray, second: np.ndarray, third: np.ndarray | None = None):
        """For rows of known (first, second): a2 and g1 of the first; place and shard of the pair.

        Sorted by (first, second), so that each shard sees one slice.
        """
        shard = _shard_of(self.words, first, second, self.count)
        a = np.zeros(len(first))
        g = np.zeros(len(first))
        place = np.full(len(first), -1, np.int64)
        for k in np.unique(shard):
            rows = np.flatnonzero(shard == k)
            if k not in self.shards:
                g[rows] = [self.shared.get(int(u), 1.0) for u in first[rows]]
                continue
            _, arrays, facts = self.shards[k]
            inside = rows[(first[rows] >= facts["low"]) & (first[rows] <= facts["high"])]
            outside = rows[(first[rows] < facts["low"]) | (first[rows] > facts["high"])]
            g[outside] = [self.shared.get(int(u), 1.0) for u in first[outside]]
            local = first[inside] - facts["low"]
            found, _ = self._children(k, 2, local, second[inside])
            hit = found >= 0
            a[inside[hit]] = _decoded(arrays["2/a"][found[hit]])
            g[inside] = _decoded(arrays["1/g"][local])
            for edge in {facts["low"], facts["high"]} & set(self.shared):
                g[inside[first[inside] == edge]] = self.shared[edge]
            place[inside] = found
        return a, g, place, shard

    def score(self, texts: list[list[int]]) -> pd.DataFrame:
        """n_tokens, n_known, base_score, score of texts given as hashes."""
        flat = _flat(texts)
        lengths = np.array([len(t) for t in texts])
        known, inverse = np.unique(flat, return_inverse=True)
        ids = self.words.ids(known)
        counts = np.zeros(len(known), np.int64)
        counts[ids >= 0] = self.words.counts(ids[ids >= 0])
        denominator = self.words.tokens + ADDED * (self.words.size + 1)
        single = ((counts + ADDED) / denominator)[inverse]
        ids, counts = ids[inverse], counts[inverse]
        first_of_text = np.zeros(len(flat), bool)
        first_of_text[np.cumsum(lengths) - lengths] = True
        p = single.copy()
        # Bigrams whose first word is known; a word unknown to the model has no continuation anywhere.
        at = np.flatnonzero(~first_of_text)
        at = at[ids[at - 1] >= 0]
        size = max(self.words.size, 1)
        code = ids[at - 1] * (size + 1) + ids[at] + 1
        distinct, back = np.unique(code, return_inverse=True)
        u, v = distinct // (size + 1), distinct % (size + 1) - 1
        real = np.flatnonzero(v >= 0)
        a2, g1, place, shard = np.zeros(len(u)), np.zeros(len(u)), np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        a2[real], g1[real], place[real], shard[real] = self.pairs(u[real], v[real])
        unknown = np.flatnonzero(v < 0)
        if len(unknown):
            g1[unknown] = self.pairs(u[unknown], np.zeros(len(unknown), np.int64))[1]
        p[at] = a2[back] + g1[back] * single[at]
        if self.order > 2:
            # Trigrams whose first pair was seen: ids of pairs by token, -1 elsewhere.
            of_token = np.full(len(flat), -1, np.int64)
            of_token[at] = np.where(place[back] >= 0, back, -1)
            third = np.flatnonzero(~first_of_text)
            third = third[of_token[third - 1] >= 0]
            pair = of_token[third - 1]
            code = pair * (size + 1) + ids[third] + 1
            distinct, back3 = np.unique(code, return_inverse=True)
            pair, w = distinct // (size + 1), distinct % (size + 1) - 1
            a3, g2 = np.zeros(len(pair)), np.ones(len(pair))
            for k in np.unique(shard[pair]):
                rows = np.flatnonzero(shard[pair] == k)
                arrays = self.shards[k][1]
                found, has = self._children(k, 3, place[pair[rows]], np.maximum(w[rows], 0))
                hit = (found >= 0) & (w[rows] >= 0)
                a3[rows[hit]] = _decoded(arrays["3/a"][found[hit]])
                g2[rows[has]] = _decoded(arrays["2/g"][place[pair[rows[has]]]])
            p[third] = a3[back3] + g2[back3] * p[third]
        starts = np.cumsum(lengths) - lengths
        return pd.DataFrame({
            "n_tokens": lengths,
            "n_known": np.add.reduceat((counts > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(np.log10(single), starts),
            "score": np.add.reduceat(np.log10(np.maximum(p, 1e-300)), starts),
        })


@lru_cache(1)
def _model(folder: str, parts: tuple, shards: tuple, shared: tuple, count: int, order: int) -> Model:
    return Model(folder, parts, shards, shared, count, order)


def train(texts: DataFrame, folder: str, order: int = ORDER, shard_tokens: int = SHARD_TOKENS) -> tuple:
    """Write the model of the column ``text`` below ``folder``; what is returned opens it in a task.

    Null texts count as empty. Without rows there is no word, and every text scores by additive smoothing.
    """
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    counted = texts.select("text").mapInPandas(_count_words, "part int, payload binary")
    # A row per part of the vocabulary and per shard reaches the driver.
    written = counted.groupBy("part").applyInPandas(_write_part(path), "part int, words bigint, tokens bigint").collect()
    parts = tuple(sorted((r["part"], r["words"], r["tokens"]) for r in written))
    total = sum(t for _, _, t in parts)
    count = max(1, -(-total // shard_tokens))
    ngrams = texts.select("text").mapInPandas(_count_ngrams(path, parts, count, order), "shard int, payload binary") if parts else None
    schema = "shard int, low bigint, high bigint, mass_low double, mass_high double, total_low bigint, total_high bigint, ngrams bigint"
    edges = sorted(ngrams.groupBy("shard").applyInPandas(_write_shard(path, parts, order), schema).collect()) if parts else []
    mass: dict[int, list[float]] = {}
    for r in edges:
        mass.setdefault(r["low"], []).append(r["mass_low"] / max(r["total_low"], 1))
        if r["high"] != r["low"]:
            mass.setdefault(r["high"], []).append(r["mass_high"] / max(r["total_high"], 1))
    shared = tuple(sorted((u, sum(m)) for u, m in mass.items()))
    return path, parts, tuple(r["shard"] for r in edges), shared, count, order


def score(docs: DataFrame, model: tuple, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row: doc_id, n_tokens, n_known, base_score, score."""

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = _model(*model)

        def done(ids, texts):
            rows = opened.score(texts)
            rows.insert(0, "doc_id", pd.array(ids, "Int64"))
            return rows

        ids, texts, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids.append(doc_id)
                texts.append(tokens(text))
                n += len(texts[-1])
                if n >= _SCORED:
                    yield done(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield done(ids, texts)

    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInPandas(rate, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def score_documents(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """For every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows of :func:`in_training` and scores every row's whole text. Null and empty texts
    are an end alone. Rows without an id are held out. Repeated rows score alike. Other columns are not
    looked at. An empty table gives an empty result.
    """
    learn = in_training(docs[id_column])
    model = train(docs.filter(learn).select(docs[text_column].alias("text")), folder, **options)
    found = score(docs, model, id_column, text_column)
    held = ~in_training(F.col("doc_id"))
    total = sum(t for _, _, t in model[1])
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
