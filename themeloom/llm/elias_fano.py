"""Rising sequences of integers in Elias-Fano form, in flat arrays that can be mapped from a file."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_WORD = np.uint64(64)
_SIX = np.uint64(6)
_LOW6 = np.uint64(63)
# For each byte, the place of its k-th set bit.
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint64)
_BYTE = np.uint64(255)
_EACH = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other in 64-bit words (and one spare word)."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> _SIX).astype(np.int64), at & _LOW6
        np.bitwise_or.at(words, word, values << shift)
        over = shift + np.uint64(width) > _WORD
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (_WORD - shift[over]))
    return words


def _bits(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> _SIX).astype(np.int64), at & _LOW6
    high = np.where(shift > 0, words[word + 1] << ((_WORD - shift) & _LOW6), np.uint64(0))
    return ((words[word] >> shift) | high) & np.uint64((1 << width) - 1)


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, zeros: bool) -> np.ndarray:
    """The place of the set (or clear) bit number ``rank``; ``before`` counts them up to each word.

    Inside a word all eight bytes are counted at once in one 64-bit number.
    """
    word = np.searchsorted(before, rank, side="right") - 1
    bits = words[word]
    if zeros:
        bits = ~bits
    pairs = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
    fours = (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))
    # Byte i of ``upto``: the bits set in bytes 0 to i.
    upto = ((fours + (fours >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    left = (rank - before[word]).astype(np.uint64)
    byte = np.bitwise_count((((left * _EACH) | _TOPS) - upto) & _TOPS).astype(np.uint64) * np.uint64(8)
    inside = left - (((upto << np.uint64(8)) >> byte) & _BYTE)
    return word * 64 + (byte + _SELECT[(bits >> byte) & _BYTE, inside]).astype(np.int64)


class Sequence:
    """A non-decreasing sequence: its low bits packed, its high bits in unary with rank directories."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, low_bits: int) -> None:
        self.arrays, self.n, self.low_bits = arrays, n, low_bits

    @classmethod
    def build(cls, values: np.ndarray) -> Sequence:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64)
        size = n + (top >> width) + 1
        # A last clear bit ends the last bucket.
        marks = np.zeros((size // 64 + 1) * 64, np.uint8)
        marks[high + np.arange(n)] = 1
        words = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
        low = _pack(values & np.uint64((1 << width) - 1), width)
        return cls({"low": low, "high": words, "ones": ones}, n, width)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        place = _select(self.arrays["high"], self.arrays["ones"], index, zeros=False)
        return ((place - index).astype(np.uint64) << np.uint64(self.low_bits)) | _bits(self.arrays["low"], index, self.low_bits)

    def _bucket_end(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most ``bucket``."""
        words = np.arange(len(self.arrays["ones"])) * 64
        return _select(self.arrays["high"], words - self.arrays["ones"], bucket, zeros=True) - bucket

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The place of the first value that is not smaller; ``n`` if there is none."""
        values = values.astype(np.uint64)
        if not self.n or not len(values):
            return np.zeros(len(values), np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(self.arrays["ones"][-1]) + int(np.bitwise_count(self.arrays["high"][-1]))
        most = len(self.arrays["high"]) * 64 - last - 1
        inside = high <= most
        bucket = np.minimum(high, most)
        end = self._bucket_end(bucket)
        start = np.where(bucket > 0, self._bucket_end(np.maximum(bucket - 1, 0)), 0)
        low = values & np.uint64((1 << self.low_bits) - 1)
        # Halve the bucket until the first low part that is not smaller.
        open_ = np.flatnonzero(inside & (start < end))
        while len(open_):
            middle = (start[open_] + end[open_]) // 2
            less = _bits(self.arrays["low"], middle, self.low_bits) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[start[open_] < end[open_]]
        return np.where(inside, np.minimum(start, self.n), self.n)


def save(path: str, sequences: dict[str, Sequence], arrays: dict[str, np.ndarray], facts: dict) -> None:
    """Write to a name of its own and rename, so that a repeated or lost task leaves a whole file."""
    flat = arrays | {f"{name}/{k}": a for name, s in sequences.items() for k, a in s.arrays.items()}
    entries, at = {}, 0
    for name, a in flat.items():
        entries[name] = (at, str(a.dtype), len(a))
        at += (a.nbytes + 7) // 8 * 8
    head = json.dumps({"facts": facts, "arrays": entries, "sequences": {k: (s.n, s.low_bits) for k, s in sequences.items()}}).encode()
    head += b" " * (-len(head) % 8)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in flat.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(own, path)


def load(path: str) -> tuple[dict[str, Sequence], dict[str, np.ndarray], dict]:
    """Sequences, arrays and facts of a file, mapped into memory."""
    whole = np.memmap(path, np.uint8, "r")
    length = int.from_bytes(bytes(whole[:8]), "little")
    head = json.loads(bytes(whole[8 : 8 + length]))
    data = whole[8 + length :]
    flat = {}
    for name, (at, kind, n) in head["arrays"].items():
        dtype = np.dtype(kind)
        flat[name] = np.asarray(data[at : at + n * dtype.itemsize]).view(dtype)
    sequences = {
        name: Sequence({k: flat.pop(f"{name}/{k}") for k in ("low", "high", "ones")}, n, width) for name, (n, width) in head["sequences"].items()
    }
    return sequences, flat, head["facts"]
