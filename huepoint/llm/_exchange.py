"""Packed two-way exchange: ask every document of a corpus about keys, without a row for each key.

Documents are dealt to chunks by a hash of their id. A chunk sends its distinct 64-bit keys, sorted, in
one packed row for each bucket (a bucket is a range of keys, so the slices of a sorted array are its
messages); a bucket merges what all chunks sent and answers each message with an array of the same
length and order; the chunk meets its answers again in a cogroup with its texts. A key that a third of
all documents hold costs one entry for each chunk, so nothing is skewed, and Spark moves a few large
binary rows instead of one row for each word.

Chunks and buckets have fixed sizes, whatever the corpus. Each chunk would write to each bucket, so
beyond ``FAN`` buckets there are two hops: chunks write to FAN near buckets, each of a group of chunks
merged by a task of its own, which writes to the far buckets of its range of keys. A message then carries
as many keys at 100 TB as at 1 GB, and a task holds as many.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huepoint.llm._words import U64, forget, give_back, numbered

MESSAGE = "bucket int, chunk int, keys binary, vals binary"
REPLY = "chunk int not null, bucket int, body binary"

CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 3_000_000
FAN = 512
PIECE = 1 << 18  # keys whose numbers NumPy converts at once


@dataclass(frozen=True)
class Spread:
    """Where keys go: ``near`` buckets, each of ``far`` buckets beyond (1: there is one hop), by ``groups`` of chunks."""

    near: int
    far: int = 1
    groups: int = 1
    width: int = 8  # bytes that tell the keys of a bucket apart

    @property
    def buckets(self) -> int:
        return self.near * self.far


class Layout:
    """Sizes for one corpus, from one pass over the lengths of all its texts."""

    def __init__(self, docs: DataFrame, chunk_bytes: int | None = None):
        spark = docs.sparkSession
        got = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
        self.bytes, self.rows = int(got["b"] or 0), int(got["n"] or 0)
        self.chunks = max(1, math.ceil(self.bytes / (chunk_bytes or CHUNK_BYTES)), math.ceil(self.rows / 100_000))
        self.least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.partitions = max(self.least, math.ceil(self.bytes / (64 << 20)))

    def chunk(self, doc_id: str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(self.chunks)).cast("int").alias("chunk")

    def spread(self, keys_per_byte: float, width: int = 8) -> Spread:
        """At least a bucket for each of up to 32 tasks, so that a small corpus with one large group has its work dealt out."""
        total = self.bytes * keys_per_byte
        buckets = max(min(self.least, 32), math.ceil(total / BUCKET_KEYS))
        if buckets <= FAN:
            return Spread(buckets, width=width)
        far = math.ceil(buckets / FAN)
        near = math.ceil(buckets / far)
        each = max(1, round(BUCKET_KEYS / max(1.0, total / self.chunks / near)))  # chunks that one task merges
        return Spread(near, far, math.ceil(self.chunks / each), width)

    def parts(self, docs: DataFrame) -> DataFrame:
        """chunk, doc_id, text as UTF-8 bytes; dealt by chunk."""
        return dealt(docs.select(self.chunk(), "doc_id", F.col("text").cast("binary").alias("text")), self.partitions, "chunk")


def dealt(df: DataFrame, partitions: int, column: str) -> DataFrame:
    """By the number in ``column`` in turn, so that all partitions get as many; grouping by it needs no more exchange."""
    return df.repartitionById(partitions, F.col(column))


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0: a byte each, 255 for those that follow, in order, in 8 bytes. Most counts are small."""
    large = x >= 255
    low = np.where(large, 255, x).astype(np.uint8).tobytes()
    return low + x[large].astype(np.int64).tobytes() if large.any() else low


def unpack(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, n).astype(np.int64)
    if len(b) > n:
        out[out == 255] = np.frombuffer(b[n:], np.int64)
    return out


def tight(x: np.ndarray) -> bytes:
    """As pack(), compressed: for answers that most of an operator's traffic consists of."""
    return zstandard.ZstdCompressor(level=3).compress(pack(x))


def untight(b: bytes, n: int) -> np.ndarray:
    return unpack(zstandard.ZstdDecompressor().decompress(b), n)


@lru_cache(64)
def edges(buckets: int) -> np.ndarray:
    """The smallest top half of a key in each bucket."""
    return np.array([-(-(b << 32) // buckets) for b in range(buckets)], U64)


def _shift(buckets: int, width: int) -> U64:
    """Bits dropped of a key's distance from its bucket's edge, to leave ``width`` bytes."""
    return U64(max(0, 65 - buckets.bit_length() - 8 * width))


def pack_keys(keys: np.ndarray, bucket: int, buckets: int, width: int) -> bytes:
    """Sorted keys as steps, byte plane by byte plane: planes, then the planes. Steps have few high bytes."""
    x = (keys - (edges(buckets)[bucket] << U64(32))) >> _shift(buckets, width)
    steps = np.diff(x, prepend=U64(0)).astype("<u8")
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack_keys(b: bytes, bucket: int, buckets: int, width: int) -> np.ndarray:
    """The keys, without the bits that ``width`` drops."""
    planes = b[0]
    n = (len(b) - 1) // planes
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :planes] = np.frombuffer(b, np.uint8, n * planes, 1).reshape(planes, n).T
    return (np.cumsum(steps.reshape(-1).view("<u8"), dtype=U64) << _shift(buckets, width)) + (edges(buckets)[bucket] << U64(32))


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's slice of sorted keys begins; buckets + 1 numbers."""
    return np.append(np.searchsorted(keys, edges(buckets) << U64(32)), len(keys))


def messages(chunk: int, keys: np.ndarray, vals: np.ndarray, spread: Spread, packed: Callable[[np.ndarray], bytes] = pack) -> pa.Table:
    """One row for each bucket that some of these sorted keys belong to.

    packed: how the values (numbers from 0, or an array with a last axis of the keys' length) are written.
    """
    at = bounds(keys, spread.near)
    rows = [b for b in range(spread.near) if at[b + 1] > at[b]]
    return table(chunk, rows, [pack_keys(keys[at[b] : at[b + 1]], b, spread.near, spread.width) for b in rows], [packed(vals[..., at[b] : at[b + 1]].ravel()) for b in rows])


def table(chunk: int, buckets: list[int], keys: list[bytes | None], vals: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array([chunk] * len(buckets), pa.int32()), "keys": pa.array(keys, pa.binary()), "vals": pa.array(vals, pa.binary())})


def raw(x: np.ndarray) -> bytes:
    """64-bit numbers as they are, for ids."""
    return np.ascontiguousarray(x, np.int64).tobytes()


def replies_of(chunks: list[int], buckets: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "body": pa.array(bodies, pa.binary())})


def answers(replies: dict[int, bytes], keys: np.ndarray, spread: Spread, each: int = 1, read: Callable[[bytes, int], np.ndarray] = unpack) -> np.ndarray:
    """The chunk's answers in the order of its sorted keys (each > 1: so many rows of them); fails if a bucket's is missing."""
    return answers_at(replies, bounds(keys, spread.near), each, read)


def answers_at(replies: dict[int, bytes], at: np.ndarray, each: int = 1, read: Callable[[bytes, int], np.ndarray] = unpack) -> np.ndarray:
    parts = [read(replies[b], each * (at[b + 1] - at[b])).reshape(each, -1) for b in range(len(at) - 1) if at[b + 1] > at[b]]
    out = np.concatenate(parts, 1) if parts else np.empty((each, 0), np.int64)
    return out[0] if each == 1 else out


class Sum:
    """Each key's total over all messages. An exchange's merge: ``up`` makes one value of each key's, ``down`` each message's answer."""

    each = 1  # numbers in an answer

    def read(self, b: bytes, n: int) -> np.ndarray:
        return unpack(b, n)

    def write(self, x: np.ndarray) -> bytes:
        return pack(x)

    packed, unpacked = staticmethod(pack), staticmethod(unpack)  # of answers

    def codes(self, keys: np.ndarray, vals: np.ndarray) -> np.ndarray:
        """The number of each entry's key among all. By sorting: a table of hashes takes several times the memory of the keys."""
        return numbered(keys)[1]

    def up(self, codes: np.ndarray, n: int, vals: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for at in range(0, len(codes), PIECE):
            np.add.at(out, codes[at : at + PIECE], vals[at : at + PIECE])
        return out

    def down(self, codes: np.ndarray, vals: np.ndarray, merged: np.ndarray, reply: np.ndarray | None) -> np.ndarray:
        """merged: of these messages; reply: what the far buckets say of it, if there are any."""
        return (merged if reply is None else reply)[codes]


class Own(Sum):
    """Twice each key's total, plus 1 for one message that has it: one chunk owns each key."""

    def down(self, codes: np.ndarray, vals: np.ndarray, merged: np.ndarray, reply: np.ndarray | None) -> np.ndarray:
        total, give = (merged, np.ones(len(merged), bool)) if reply is None else (reply >> 1, (reply & 1) > 0)
        first = np.full(len(merged), len(codes))
        np.minimum.at(first, codes, np.arange(len(codes)))
        out = 2 * total[codes]
        out[first[give]] += 1
        return out


class Least(Sum):
    """1 where another message has a smaller value for the key, else 0. A key is 128 bits: the one sent and a second half, sent with the values."""

    def read(self, b: bytes, n: int) -> np.ndarray:
        return np.frombuffer(b, np.int64).reshape(2, n)

    def write(self, x: np.ndarray) -> bytes:
        return raw(x)

    def codes(self, keys: np.ndarray, vals: np.ndarray) -> np.ndarray:
        codes, distinct = pd.factorize(keys)
        half = np.empty(len(distinct), np.int64)
        half[codes[::-1]] = vals[1][::-1]  # of each key's first entry
        other = np.flatnonzero(vals[1] != half[codes])
        if len(other):  # equal in 64 bits only
            codes = codes.copy()
            codes[other] = len(distinct) + pd.factorize(pd.MultiIndex.from_arrays([codes[other], vals[1][other]]))[0]
        return codes

    def up(self, codes: np.ndarray, n: int, vals: np.ndarray) -> np.ndarray:
        out = np.full((2, n), np.iinfo(np.int64).max)
        np.minimum.at(out[0], codes, vals[0])
        out[1][codes] = vals[1]
        return out

    def down(self, codes: np.ndarray, vals: np.ndarray, merged: np.ndarray, reply: np.ndarray | None) -> np.ndarray:
        out = merged[0][codes] < vals[0]
        return (out if reply is None else out | (reply[codes] > 0)).astype(np.int64)


def exchange(sent: DataFrame, spread: Spread, op: Sum, layout: Layout, keys: DataFrame | None = None, deal: bool = True) -> DataFrame:
    """chunk, bucket, body: ``op``'s answer to each message; dealt by chunk, unless the caller does that.

    keys: messages sent before, whose keys those of ``sent`` (without keys) have again; then rows of ``sent``
    for buckets from ``near`` on are notes of chunks to themselves, which come back as they are.
    """
    near, far, buckets, width, notes = spread.near, spread.far, spread.buckets, spread.width, keys is not None

    def opened(left: pa.Table, right: pa.Table | None, bucket: int, buckets: int, name: bool = True) -> tuple:
        """Senders, sizes, codes and values of a bucket's messages; then of each distinct key itself (if name) and the merged value."""
        forget()
        senders, said = left["chunk"].to_pylist(), left if right is None else right
        order = sorted(range(len(senders)), key=senders.__getitem__)  # a rerun sees the same order
        of_sender = {c: i for i, c in enumerate(said["chunk"].to_pylist())}
        # a message at a time leaves Arrow's table, and what has been read is freed
        got = [unpack_keys(left["keys"][i].as_py(), bucket, buckets, width) for i in order]
        senders, sizes, flat = [senders[i] for i in order], [len(k) for k in got], np.concatenate(got)
        del got
        vals = np.concatenate([op.read(said["vals"][of_sender[c]].as_py(), n) for c, n in zip(senders, sizes)], -1)
        codes = op.codes(flat, vals)
        n, of = int(codes.max()) + 1, None
        if name:
            of = np.empty(n, U64)
            of[codes] = flat
        del flat
        return senders, sizes, codes, vals, of, op.up(codes, n, vals)

    def cut(x: np.ndarray, sizes: list[int]) -> list[bytes]:
        return [op.packed(p.ravel()) for p in np.split(x, np.cumsum(sizes)[:-1], axis=-1)]

    def returned(t: pa.Table) -> pa.Table:
        return replies_of(t["chunk"].to_pylist(), t["bucket"].to_pylist(), t["vals"].to_pylist())

    def answered(left: pa.Table, right: pa.Table | None, bucket: int, buckets: int) -> pa.Table:
        senders, sizes, codes, vals, _, merged = opened(left, right, bucket, buckets, name=False)
        out = replies_of(senders, [bucket] * len(senders), cut(op.down(codes, vals, merged, None), sizes))
        give_back()
        return out

    def applied(column: str, partitions: int, one: DataFrame, two: DataFrame | None, fn: Callable, schema: str) -> DataFrame:
        first = dealt(one, partitions, column).groupBy(column)
        if two is None:
            return first.applyInArrow(lambda key, t: fn(key[0].as_py(), t, None), schema)
        return first.cogroup(dealt(two, partitions, column).groupBy(column)).applyInArrow(lambda key, t, r: fn(key[0].as_py(), t, r), schema)

    def answer(bucket: int, left: pa.Table, right: pa.Table | None) -> pa.Table:
        return answered(left, right, bucket, near) if len(left) else returned(right)

    one, two = (keys, sent.select("bucket", "chunk", "vals")) if notes else (sent, None)  # keys as they are: their exchange is used again
    if far == 1:
        out = applied("bucket", min(near, layout.partitions), one, two, answer, REPLY)
        return dealt(out, layout.partitions, "chunk") if deal else out

    # a merging task's number: its group of chunks and its near bucket; notes have one for each chunk
    groups, tasks = spread.groups, min(spread.groups * near, layout.partitions)
    mid = F.when(F.col("bucket") < near, F.col("chunk") % groups * near + F.col("bucket")).otherwise(groups * near + F.col("chunk")).cast("int").alias("mid")
    one, two = one.select("*", mid), two.select("*", mid) if notes else None

    def ranged(mid: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the keys, and where those of each far bucket begin."""
        order = np.argsort(of, kind="stable")
        first = mid % near * far
        at = np.searchsorted(of[order], edges(buckets)[first : first + far] << U64(32))
        at[0] = 0
        return order, np.append(at, len(of))

    def further(mid: int, left: pa.Table, right: pa.Table | None) -> pa.Table:
        if not len(left):
            return table(mid, [], [], [])
        *_, of, merged = opened(left, right, mid % near, near)
        order, at = ranged(mid, of)
        of, merged, first = of[order], merged[..., order], mid % near * far
        rows = [b for b in range(far) if at[b + 1] > at[b]]
        out = table(mid, [first + b for b in rows], [pack_keys(of[at[b] : at[b + 1]], first + b, buckets, width) for b in rows], [op.write(merged[..., at[b] : at[b + 1]]) for b in rows])
        give_back()
        return out

    def back(mid: int, left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.filter(pc.is_valid(right["body"]))
        right = right.filter(pc.is_null(right["body"])) if notes else None
        if not len(left):
            return returned(right)
        senders, sizes, codes, vals, of, merged = opened(left, right, mid % near, near)
        order, at = ranged(mid, of)
        reply = np.empty((op.each, len(of)), np.int64)
        reply[:, order] = answers_at({b - mid % near * far: x for b, x in zip(told["bucket"].to_pylist(), told["body"].to_pylist())}, at, op.each, op.unpacked)
        out = replies_of(senders, [mid % near] * len(senders), cut(op.down(codes, vals, merged, reply if op.each > 1 else reply[0]), sizes))
        give_back()
        return out

    up = applied("mid", tasks, one, two, further, MESSAGE)
    told = applied("bucket", min(buckets, layout.partitions), up, None, lambda b, t, _: answered(t, None, b, buckets), REPLY).withColumnRenamed("chunk", "mid")
    right = told if two is None else told.unionByName(two, allowMissingColumns=True)
    out = applied("mid", tasks, one, right, back, REPLY)
    return dealt(out, layout.partitions, "chunk") if deal else out
