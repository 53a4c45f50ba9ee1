"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (all words of a shorter, not empty item). A
document word inside any occurrence of a window is hit. Texts are rolled into k-word hashes; of every
``window - k + 1`` consecutive ones the smallest is a fingerprint. A span of ``window`` words has that
many k-word hashes, so equal spans choose an equal one: joining the fingerprints of the documents with
those of the benchmark misses no shared span. Each joined fingerprint is extended: the windows around it
are looked up by their hash and compared word by word with the benchmark's.

The benchmark's size is summed first. Up to ``part_bytes`` of distinct texts its index is sent to the
executors (some 18 bytes a byte of text). A larger one stays a table: only a bitmap of its fingerprints of
fixed size is sent, which lets nearly no other fingerprint pass; the windows around those that pass are
joined with the benchmark's windows by 128 bits of hash. Texts aren't moved for that, and a window that
many documents hold isn't joined in one task.

Null, empty and wordless texts have no words and no hits. Items without words have no window. Equal
items all count. Rows that repeat an id give a row each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huepoint.llm._store import keyed_join, stash
from huepoint.llm._words import U64, VALUES, forget, rolling, values

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII characters, makes the rest spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

PART_BYTES = 2 << 20
BLOCKS, BLOCK_BITS = 256, 1 << 19  # of the bitmap: 16 MB
SECOND_BASE = 0xD6E8FEB86659FD93  # odd
OUT = "doc_id long, n_words long, n_hit long, items array<string>"


def plain_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest (of equal ones the last) hash in each ``width`` consecutive ones."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, size, at = hashes, 1, np.arange(len(hashes))
    while size < width:  # a sliding minimum by doubling
        step = min(size, width - size)
        later = least[step:] <= least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.where(later, least[step:], least[:-step])
        size += step
    return np.unique(at)


class Index:
    """The windows of one part of the benchmark."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int, k: int):
        self.window, self.k = window, k
        prints, rows = [], defaultdict(list)
        self.windows: dict[int, dict[int, list[tuple[bytes, set[str]]]]] = defaultdict(dict)  # length -> hash -> [words, items]
        for name, text in items:
            if not (w := values(plain_words(text))).size:
                continue
            size = min(window, len(w))
            if size == window:
                h = rolling(w, k)
                prints.append(h[winnow(h, window - k + 1)])
            for j, h in enumerate(rolling(w, size).tolist()):
                rows[size].append((h, w[j : j + size].tobytes(), name))
        for size, found in rows.items():
            for h, words, name in found:
                same = self.windows[size].setdefault(h, [])
                for other, names in same:
                    if other == words:
                        names.add(name)
                        break
                else:
                    same.append((words, {name}))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, U64)
        self.sorted = {size: np.array(sorted(x), U64) for size, x in self.windows.items()}

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Whether each word is hit, and the items with windows that occur."""
        change, names, n = np.zeros(len(w) + 1, np.int64), set(), len(w)
        for size, known in self.sorted.items():
            if n < size:
                continue
            if size == self.window:
                h = rolling(w, self.k)
                at = winnow(h, size - self.k + 1)
                at = at[member(h[at], self.prints)]
                if not len(at):
                    continue
                at = np.unique((at[:, None] - np.arange(size - self.k + 1)[None, :]).ravel())
                at = at[(at >= 0) & (at <= n - size)]
            else:
                at = np.arange(n - size + 1)
            h = rolling(w, size)[at]
            found = member(h, known)
            for i, x in zip(at[found].tolist(), h[found].tolist()):
                for words, items in self.windows[size][x]:
                    if words == w[i : i + size].tobytes():
                        change[i] += 1
                        change[i + size] -= 1
                        names |= items
        return np.cumsum(change[:-1]) > 0, names


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _scan(docs: DataFrame, items: list[tuple[str, bytes | None]], window: int, k: int) -> DataFrame:
    """With a small benchmark, by its index."""
    sent = docs.sparkSession.sparkContext.broadcast(Index(items, window, k))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            n, hit, names = [], [], []
            for text in b["text"].to_pylist():
                mask, found = index.hits(w := values(plain_words(text)))
                n.append(len(w))
                hit.append(int(mask.sum()))
                names.append(sorted(found))
            yield pa.record_batch({"doc_id": b["doc_id"], "n_words": pa.array(n, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "items": pa.array(names, pa.list_(pa.string()))})

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(fn, OUT)


class _Benchmark:
    """Distinct items, and whether their index is small enough to send."""

    def __init__(self, benchmark: DataFrame, part_bytes: int):
        self.items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).distinct()
        self.small = (self.items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) <= part_bytes

    def read(self) -> list[tuple[str, bytes | None]]:
        """At most part_bytes of texts."""
        return [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in self.items.collect()]


def _pair(w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash of each window, as signed numbers."""
    return rolling(w, size).view(np.int64), rolling(w, size, SECOND_BASE).view(np.int64)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in the bitmap, in one block."""
    h = h.view(U64)
    block = (h >> U64(56)).astype(np.int64) * BLOCK_BITS
    return block + ((h >> U64(37)) & U64(BLOCK_BITS - 1)).astype(np.int64), block + ((h >> U64(18)) & U64(BLOCK_BITS - 1)).astype(np.int64)


def _windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """size, h, h2, item of every window; and rows of size 0 with the hash of every fingerprint (of a short item, its window)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b["item"].to_pylist(), b["text"].to_pylist()):
                if not (w := values(plain_words(text))).size:
                    continue
                size = min(window, len(w))
                h, h2 = _pair(w, size)
                prints = h if size < window else (x := rolling(w, k))[winnow(x, window - k + 1)].view(np.int64)
                n, m = len(h), len(prints)
                yield pa.record_batch({"size": pa.array([size] * n + [0] * m, pa.int32()), "h": pa.array(np.concatenate([h, prints])), "h2": pa.array(np.concatenate([h2, np.zeros(m, np.int64)])), "item": pa.array([item] * n + [None] * m, pa.string())})

    return items.mapInArrow(fn, "size int, h long, h2 long, item string").distinct()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The bits of all fingerprints; BLOCKS rows of BLOCK_BITS / 8 bytes come to the driver, whatever the benchmark."""

    def fn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOCK_BITS, bool)
        for b in batches:
            for at in _bits(b["h"].to_numpy()):
                bits[at % BLOCK_BITS] = True
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    prints = windows.filter("size = 0").select(F.shiftrightunsigned("h", 56).cast("int").alias("block"), "h")
    out = np.zeros((BLOCKS, BLOCK_BITS // 8), np.uint8)
    for r in prints.groupBy("block").applyInArrow(fn, "block int, bits binary").collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _row_key(docs: DataFrame) -> Column:
    """Tells rows of other ids or texts apart; equal rows share it."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _candidates(docs: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    """row, doc_id, n_words, found: the windows at a fingerprint that passes the bitmap."""
    sizes = [r["size"] for r in windows.filter("size > 0").select("size").distinct().collect()]  # at most ``window``
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(windows))

    def member_bits(h: np.ndarray) -> np.ndarray:
        a, b = _bits(h)
        on = lambda at: sent.value[at >> 3] >> (7 - (at & 7)) & 1
        return (on(a) & on(b)).astype(bool)

    def places(w: np.ndarray, size: int) -> np.ndarray:
        if size < window:
            return np.flatnonzero(member_bits(rolling(w, size)))
        h = rolling(w, k)
        at = winnow(h, size - k + 1)
        at = at[member_bits(h[at])]
        at = np.unique((at[:, None] - np.arange(size - k + 1)[None, :]).ravel())
        return at[(at >= 0) & (at <= len(w) - size)]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found = [], []
            for text in b["text"].to_pylist():
                w, own = values(plain_words(text)), []
                for size in sizes:
                    if len(w) >= size and len(at := places(w, size)):
                        h, h2 = _pair(w, size)
                        own += [{"size": size, "start": int(i), "h": int(h[i]), "h2": int(h2[i])} for i in at]
                n.append(len(w))
                found.append(own)
            kind = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int64()), ("h", pa.int64()), ("h2", pa.int64())]))
            yield pa.record_batch({"row": b["row"], "doc_id": b["doc_id"], "n_words": pa.array(n, pa.int64()), "found": pa.array(found, kind)})

    rows = docs.select(_row_key(docs).alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    return stash(rows.mapInArrow(fn, "row string, doc_id long, n_words long, found array<struct<size: int, start: long, h: long, h2: long>>"))


def _joined(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """row, start, size, h, h2 of the candidates that are windows of the benchmark."""
    key = ["size", "h", "h2"]
    rows = stash(scanned.filter(F.size("found") > 0).select("row", "found").dropDuplicates(["row"]).select("row", F.explode("found").alias("x")).select("row", "x.*"))
    known = windows.filter("size > 0").select(*key).distinct()
    return stash(keyed_join(rows, stash(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).join(known, key)), key, "rows", rows.count()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items: the ids (as strings, sorted) of the items with windows in the text."""
    bench = _Benchmark(benchmark, part_bytes)
    if bench.small:
        return _scan(docs, bench.read(), window, k)
    windows = stash(_windows(bench.items, window, k))
    scanned = _candidates(docs, windows, window, k)
    hits = _joined(scanned, windows)
    # words covered by the windows, in order of their starts
    step = lambda s, x: F.struct(F.greatest(s["end"], x["start"] + x["size"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["size"] - F.greatest(s["end"], x["start"]))).alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.col("size").cast("long").alias("size")))).alias("x")).select("row", F.aggregate("x", zero, step)["n"].alias("n_hit"))
    named = hits.select("row", "size", "h", "h2").distinct().join(windows.filter("size > 0"), ["size", "h", "h2"]).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = scanned.select("row", "doc_id", "n_words").join(covered.join(named, "row"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark."""
    bench = _Benchmark(benchmark, part_bytes)
    if bench.small:
        return docs.filter(_without_hits(docs, Index(bench.read(), window, k)))
    windows = stash(_windows(bench.items, window, k))
    gone = stash(_joined(_candidates(docs, windows, window, k), windows).select(F.col("row").alias("__gone")).distinct())
    return docs.join(gone, _row_key(docs) == F.col("__gone"), "left_anti")


def _without_hits(docs: DataFrame, index: Index) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget(but=VALUES)
        for texts in batches:
            yield pa.array([not sent.value.hits(values(plain_words(t.as_py())))[0].any() for t in texts], pa.bool_())

    return keep(F.col("text").cast("binary"))


def brute_force(texts: list[tuple[int, bytes | None]], items: list[tuple[str, bytes | None]], window: int) -> Iterator[tuple[int, int, int, list[str]]]:
    """The definition itself, for small fixtures."""
    windows = set()
    for name, t in items:
        w = plain_words(t)
        size = min(window, len(w))
        windows |= {(tuple(w[j : j + size]), name) for j in range(len(w) - size + 1) if size}
    for i, t in texts:
        w, hit, names = plain_words(t), set(), set()
        for x, name in windows:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    names.add(name)
        yield i, len(w), len(hit), sorted(names)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
