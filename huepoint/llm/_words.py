"""Words of whole texts as 64-bit values in NumPy arrays, and rolling hashes over them."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd, so that every word of a window keeps all its bits in the polynomial modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MEMO_WORDS = 150_000

U64 = np.uint64


class WordValues(dict):
    """word -> 64-bit value; forgets all once it holds MEMO_WORDS words, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


VALUES = WordValues()

#: What a worker keeps from task to task of a step, for speed alone.
MEMOS: list[dict] = [VALUES]


def blank_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at just these six bytes, bytes.lower() maps A-Z only."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(VALUES.__getitem__, words), U64, len(words))


def distinct_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As blank_words() of all texts: values of the distinct words, each word's place among them, and each text's number of words.

    Arrow splits at the same six bytes; it leaves an empty word at a blank end of a text.
    """
    whole = pa.array([x or b"" for x in texts], pa.large_binary()).cast(pa.large_string(), safe=False)  # bytes as they are
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    words, text = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)
    words, text = words.filter(real).dictionary_encode(), text[real.to_numpy(zero_copy_only=False)]
    distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct)), words.indices.to_numpy(), np.bincount(text, minlength=len(texts))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (64 bits each, mixed) and the place of each key among them.

    Sorts numbers of the leading bits of a key and its place, several times as fast as sorting places by key; where
    that leaves keys with equal leading bits out of order, which is rare, it does the latter.
    """
    if not len(keys):
        return keys, np.empty(0, np.int32)
    low = keys.min()
    spare, bits = U64(64 - int(keys.max() - low).bit_length()), U64(len(keys).bit_length())
    if spare == 64:
        return keys[:1], np.zeros(len(keys), np.int32)
    packed = keys - low  # in place from here on: buckets have millions of keys
    packed <<= spare
    packed >>= bits
    packed <<= bits
    packed |= np.arange(len(keys), dtype=U64)
    packed.sort()
    packed &= (U64(1) << bits) - U64(1)
    order = packed.view(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered[new], place


def corpus(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All word values one text after another, and the len(texts) + 1 offsets."""
    parts = [values(blank_words(t, lower)) for t in texts]
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return (np.concatenate(parts) if parts else np.empty(0, U64)), off


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: a bijection that spreads every bit, so that top bits can deal out keys."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def rolling(words: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Hash of every k consecutive values (len - k + 1 of them), by doubling: log k passes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    power, block, size = U64(base), words, 1  # block[i]: hash of size words from i
    out, done = None, 0
    while True:
        if k & size:
            part = block[done : done + n]
            out = part if out is None else out * power + part
            done += size
        if 2 * size > k:
            return mix(out)
        block = block[:-size] * power + block[size:]
        with np.errstate(over="ignore"):
            power = power * power
        size *= 2


def give_back() -> None:
    """Returns freed memory to the system; a worker lives through many tasks, and its heap would keep the peak of each."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forget(but: dict | None = None) -> None:
    """Empties the memories of words, but one. A worker goes on from step to step: what one has kept would add to the peak of all later ones."""
    for x in MEMOS:
        if x is not but and x:
            x.clear()
    give_back()
