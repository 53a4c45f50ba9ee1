"""Substring dedup by recompression.

Every word of a window of ``window`` words that also starts in a document with a smaller id is removed.

A text is rewritten in rounds: first runs of one word, then, in each round, pairs of neighbours whose
left symbol falls on the left side of a hashed partition and whose right symbol on the right side, get
a new name. A name is a 64-bit hash of what it stands for, so it is the same in every document on every
executor with no exchange in between, and equal substrings get equal symbols inside; only a few symbols
at their ends depend on what stands around them. How far that reaches is carried along for each symbol
as its context. A high-level symbol with its followers up to ``span`` words is a key; a window is
anchored at the first key whose context lies inside it, and every other occurrence of the window is
anchored at the same key. So

1. reveal: each chunk sends its anchor keys, 0.16 a word; a key in one document clears its windows;
2. verify: the windows of shared keys, and those without an anchor, are compared by 128 bits of hash of
   all their words, and the smallest document id of each is found.

Nulls and texts without words give no words and an empty text. Documents with equal ids (repeated rows)
don't remove each other's words. A null id counts as larger than every other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huepoint.llm import _exchange as X
from huepoint.llm._store import stash
from huepoint.llm._words import BASE, U64, blank_words, give_back, mix, rolling, values

ROUNDS, SPAN = 6, 16
SECOND_BASE = 0xD6E8FEB86659FD93  # odd, too
NULL_ID = np.iinfo(np.int64).max


def symbols(w: np.ndarray, off: np.ndarray, rounds: int = ROUNDS):
    """name, first word, end, left and right end of the context, document of each symbol after the last round."""
    n, doc = len(w), np.repeat(np.arange(len(off) - 1), np.diff(off))
    new = np.ones(n, bool)
    new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], n)
    k = (e - s).astype(U64)
    name = np.where(k > 1, mix(w[s] ^ (k * U64(BASE))), w[s])
    d, left, right = doc[s], s - 1, e + 1
    for r in range(rounds if n else 0):
        goes_right = (mix(name + U64(r * 0x1234567 + 1)) >> U64(63)).astype(bool)
        joined = np.append(d[1:] == d[:-1], False)  # to the next one
        pair = joined.copy()
        pair[:-1] &= ~goes_right[:-1] & goes_right[1:]
        second = np.append(False, pair[:-1])
        # one that stays alone was decided by a neighbour, whose context it therefore needs
        before = np.where(np.append(False, joined[:-1]), np.append(0, left[:-1]), left)
        after = np.where(joined, np.append(right[1:], 0), right)
        alone_left = np.where(goes_right, before, left)
        alone_right = np.where(goes_right, right, after)
        i = np.flatnonzero(~second)
        p, j = pair[i], np.minimum(i + 1, len(name) - 1)
        named = mix(name[i] * U64(BASE) + mix(name[j] + U64(r)))
        name, s, e, left, right, d = (np.where(p, named, name[i]), s[i], np.where(p, e[j], e[i]), np.where(p, left[i], alone_left[i]), np.where(p, right[j], alone_right[i]), d[i])
    return name, s, e, left, right, d


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def below(values: np.ndarray, n: int) -> np.ndarray:
    """For each of 0 to n - 1, how many of the sorted values (from -1) are smaller."""
    return np.cumsum(np.bincount(values[values < n] + 1, minlength=n + 1))[:n]


def anchors(w: np.ndarray, off: np.ndarray, window: int, rounds: int = ROUNDS, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and document of each window; first window and anchor key (0: none) of each stretch of windows with one anchor."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(np.arange(len(w)) + window <= off[1:][doc])
    doc = doc[at]
    if not len(at):
        return at, doc, at, np.empty(0, U64)
    name, s, e, left, right, d = symbols(w, off, rounds)
    last = np.searchsorted(e, s + span)  # the first that makes it span words long
    whole = last < len(s)
    last = np.minimum(last, len(s) - 1)
    whole &= d[last] == d
    sums = np.append(U64(0), np.cumsum(name * powers(BASE, len(s)), dtype=U64))
    inverse = pow(BASE, -1, 1 << 64)
    key = mix((sums[last + 1] - sums[:-1]) * powers(inverse, len(s)) + (e[last] - s).astype(U64))
    key[key == 0] = 1
    first = below(left, len(w))[at]  # contexts begin and end in the order of the symbols
    held = first < len(s)
    first = np.minimum(first, len(s) - 1)
    held &= whole[first] & (d[first] == doc) & (right[last[first]] <= at + window)
    code = np.where(held, first, -1 - doc)  # one for each anchor, one for each document's windows without
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return at, doc, start, np.where(held[start], key[first[start]], U64(0))


def _texts(t: pa.Table) -> tuple[np.ndarray, list[list[bytes]], np.ndarray, np.ndarray]:
    """ids (null: largest), words of each text, all word values and offsets."""
    give_back()  # what the chunk before has left
    ids = np.array([NULL_ID if i is None else i for i in t["doc_id"].to_pylist()], np.int64)
    words = [blank_words(x) for x in t["text"].to_pylist()]
    off = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in words], out=off[1:])
    return ids, words, (np.concatenate([values(x) for x in words]) if words else np.empty(0, U64)), off


def _shared_keys(t: pa.Table, window: int) -> tuple:
    """ids, words, word values, offsets, then as anchors(), then the chunk's sorted distinct keys and whether two of its own documents hold each."""
    ids, words, w, off = _texts(t)
    at, doc, start, key = anchors(w, off, window)
    some = key > 0
    k, i = key[some], ids[doc[start[some]]]
    order = np.lexsort((i, k))
    k, i = k[order], i[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    end = np.append(first[1:], len(k))
    return ids, words, w, off, at, doc, start, key, k[first], 1 + (i[first] != i[end - 1] if len(k) else np.empty(0, bool))


def _candidates(t: pa.Table, replies: dict[int, bytes], window: int, spread: X.Spread) -> tuple:
    """Windows that may be repeated: sorted distinct hashes, of each the smallest id here and the hash's second half, and each one's start, document and place in these."""
    ids, words, w, off, at, doc, start, key, keys, own = _shared_keys(t, window)
    shared = X.answers(replies, keys, spread) >= 2
    place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
    stretch = (key == 0) | (shared[place] if len(keys) else False)
    keep = np.repeat(stretch, np.diff(np.append(start, len(at))))
    at, doc = at[keep], doc[keep]
    hashes, halves = (rolling(w, window, base)[at] if len(at) else np.empty(0, U64) for base in (BASE, SECOND_BASE))
    order = np.lexsort((ids[doc], halves, hashes))
    h, half = hashes[order], halves[order]
    first = np.append(True, (h[1:] != h[:-1]) | (half[1:] != half[:-1])) if len(h) else np.empty(0, bool)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return ids, words, off, at, doc, inverse, h[first], np.stack([ids[doc][order][first], half[first].view(np.int64)])


def _bodies(t: pa.Table, stage: int) -> dict[int, bytes]:
    return {b: x for s, b, x in zip(t["stage"].to_pylist(), t["bucket"].to_pylist(), t["body"].to_pylist()) if s == stage}


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed (longs), kept_text: the words that stay, joined by one space."""
    layout = X.Layout(docs)
    parts = layout.parts(docs)
    first, second = layout.spread(0.04, 5), layout.spread(0.06)

    def reveal(key: tuple, t: pa.Table) -> pa.Table:
        *_, keys, own = _shared_keys(t, window)
        return X.messages(key[0].as_py(), keys, own, first)

    replies = stash(X.exchange(parts.groupBy("chunk").applyInArrow(reveal, X.MESSAGE), first, X.Sum(), layout, deal=False)).withColumn("stage", F.lit(1))

    def verify(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        *_, hashes, smallest = _candidates(t, _bodies(r, 1), window, first)
        return X.messages(key[0].as_py(), hashes, smallest, second, packed=X.raw)

    def remove(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        ids, words, off, at, doc, inverse, hashes, smallest = _candidates(t, _bodies(r, 1), window, first)
        repeated = X.answers(_bodies(r, 2), hashes, second) > 0
        hit = at[repeated[inverse] | (smallest[0][inverse] < ids[doc])] if len(at) else at
        change = np.bincount(hit, minlength=off[-1] + 1) - np.bincount(hit + window, minlength=off[-1] + 1)
        keep = np.cumsum(change[:-1]) == 0
        gone, text = [], []
        for i, x in enumerate(words):
            own = keep[off[i] : off[i + 1]]
            gone.append(len(x) - int(own.sum()))
            text.append(b" ".join(x if not gone[-1] else [x[j] for j in np.flatnonzero(own)]))
        return pa.table({"doc_id": t["doc_id"], "n_words": pa.array([len(x) for x in words], pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(text, pa.binary()).cast(pa.string())})

    chunks = parts.groupBy("chunk")
    known = X.dealt(replies, layout.partitions, "chunk")
    sent = chunks.cogroup(known.groupBy("chunk")).applyInArrow(verify, X.MESSAGE)
    both = X.dealt(replies.unionByName(X.exchange(sent, second, X.Least(), layout, deal=False).withColumn("stage", F.lit(2))), layout.partitions, "chunk")
    return chunks.cogroup(both.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")


def brute_force(texts: list[tuple[int, bytes | None]], window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The definition itself, for small fixtures."""
    words = [(i, blank_words(t)) for i, t in texts]
    least: dict[tuple, int] = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            x = tuple(w[j : j + window])
            least[x] = min(least.get(x, i), i)
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        yield i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)
