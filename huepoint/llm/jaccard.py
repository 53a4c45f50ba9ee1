"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

Documents link when 100 * |intersection| >= percent * |union| of their sets of distinct k-word shingles.

1. Documents with the same word sequence are one node, named by their smallest id.
2. How many nodes hold each shingle is counted over the whole corpus by the packed exchange. Links need
   shared shingles, so a node with too few of them that occur twice has no links. In the order (count,
   hash), which all nodes share, linked nodes have a common shingle among the first
   n - ceil(n * percent / 100) + 1 of each, its prefix; so a prefix shingle is what a tile is made by,
   and shingles of passages that a third of all documents hold come last and make no tiles.
3. Each node is first compared with the smallest node of its tiles. Components of those links leave
   tiles whose nodes are all of one component with nothing to find.
4. The others are split by size band (sizes of linked nodes differ by 100 / percent at most) and, where
   a tile is large, into blocks whose pairs cover every pair. In a tile, sizes, prefix places and bit
   counts bound the overlap from above: a bitmap holds the parity of the shingles hashed to each bit, so
   the bits in which two differ are at most the shingles in which they differ. Pairs of nodes of
   different components that pass are compared exactly, at first the likeliest of each two components,
   in the end all of them. No link between different components is lost, so components are exact.

Texts of fewer than k words are one shingle; those without words have none and link with nothing, nor
does a null. A null id counts as larger than every other, and component_id is null where no other id is
reachable. Rows that repeat an id are one document. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huepoint.llm import _exchange as X
from huepoint.llm._store import keyed_join, local_rows, stash
from huepoint.llm._words import U64, VALUES, blank_words, forget, give_back, mix, rolling, values
from huepoint.llm.components import components

NULL_ID = np.iinfo(np.int64).max
BLOCK = 2048
MOST_PAIRS = 100_000  # held before they are sent on
TILE_ROWS = 100_000
LIKELIEST_ROUNDS = 2


def needed(n: int, percent: int) -> int:
    """The fewest shared shingles of a set of n with any set it links with."""
    return -(-n * percent // 100)


def linked(common, sizes, percent: int):
    """100 * common >= percent * (sizes - common), in integers."""
    return (100 + percent) * common >= percent * sizes


def sequence_hash(words: list[bytes]) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def shingle_set(w: np.ndarray, k: int) -> np.ndarray:
    if len(w) >= k:
        return np.unique(rolling(w, k))
    return mix(rolling(w, len(w)) + U64(len(w))) if len(w) else w


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        rows = []
        for t in b["text"]:  # one text's words at a time
            words = blank_words(t.as_py(), lower=True)
            rows.append((len(words), *sequence_hash(words)))
        give_back()
        yield pa.record_batch({"doc_id": b["doc_id"], **{c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("words", "h1", "h2"))}})


def _sets(t: pa.Table, nodes: pa.Table, k: int) -> list[tuple[int, int, int, np.ndarray]]:
    """id, both hashes and set of the texts that are nodes, each once."""
    forget(but=VALUES)  # and give back what the chunk before has left
    wanted = {x for x in zip(nodes["rep"].to_pylist(), nodes["h1"].to_pylist(), nodes["h2"].to_pylist()) if x[1] is not None}
    out = []
    for i, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
        if (words := blank_words(text, lower=True)) and (x := (i, *sequence_hash(words))) in wanted:
            wanted.discard(x)
            out.append((*x, shingle_set(values(words), k)))
    return sorted(out, key=lambda x: x[:3])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix shingle; rest: the shingles from this one on."""
    forget()  # no step from here on reads words
    for b in batches:
        ids, n, shared, tokens = (b[c].to_pylist() for c in ("id", "n", "shared", "prefix"))
        for at in range(0, len(ids), 500):
            part = [np.frombuffer(x, np.int64) for x in tokens[at : at + 500]]
            long = [len(x) for x in part]
            if not part:
                continue
            rest = np.concatenate([s - np.arange(m) for s, m in zip(shared[at : at + 500], long)])
            yield pa.record_batch({"token": np.concatenate(part), "id": np.repeat(np.array(ids[at : at + 500], np.int64), long), "n": np.repeat(np.array(n[at : at + 500], np.int64), long), "rest": rest.astype(np.int64)})


def bitmap(tokens: np.ndarray, n: int) -> np.ndarray:
    """Parity of the tokens at each of a power of two of bits, n to 2 n of them and 64 at least."""
    bits = max(64, 1 << max(0, n - 1).bit_length())
    odd = np.bincount((mix(tokens) & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(U64)


def fold(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        bits = [bitmap(np.frombuffer(t, U64), n).tobytes() for t, n in zip(b["tokens"].to_pylist(), b["n"].to_pylist())]
        yield pa.record_batch({"id": b["id"], "single": b["single"], "bits": pa.array(bits, pa.binary())})


PAIRS = ("a", "b", "ca", "cb", "differ")


def _tile_pairs(t: pa.Table, percent: int, all_pairs: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in these tiles that no bound excludes; unless all_pairs, the nearest of each two components.

    They leave in batches of about MOST_PAIRS, so a pair of components may come more than once.
    """
    names = ("token", "band", "bi", "bj", "home", "block", "n", "rest", "id", "component", "single")
    c = {x: t[x].to_numpy() for x in names}
    bits = t["bits"].to_pylist()
    order = np.lexsort((c["id"], c["n"], c["bj"], c["bi"], c["band"], c["token"]))
    c = {x: v[order] for x, v in c.items()}
    tile = np.stack([c[x] for x in ("token", "band", "bi", "bj")])
    starts = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(0))) if len(order) else np.empty(0, np.int64)
    held: list[np.ndarray] = []  # rows of PAIRS
    size = 0

    def batch() -> pa.RecordBatch:
        x = np.concatenate(held, 1) if held else np.empty((5, 0), np.int64)
        if all_pairs:
            x = np.unique(x[:2], axis=1)
            x = np.concatenate([x, np.zeros((3, x.shape[1]), np.int64)])
        else:
            x = x[:, np.lexsort((x[1], x[0], x[4], x[3], x[2]))]
            if x.shape[1]:
                x = x[:, np.append(True, (x[2:4, 1:] != x[2:4, :-1]).any(0))]
        return pa.record_batch({name: pa.array(row, pa.int64()) for name, row in zip(PAIRS, x)})

    for s, e in zip(starts, np.append(starts[1:], len(order))):
        if e - s < 2 or (c["component"][s:e] == c["component"][s]).all():
            continue
        n, rest, comp, block, home, single, ids = (c[x][s:e] for x in ("n", "rest", "component", "block", "home", "single", "id"))
        maps = [np.frombuffer(bits[i], U64) for i in order[s:e]]
        words = min(len(m) for m in maps)
        small = np.stack([fold(m, words) for m in maps])
        cross = c["bi"][s] != c["bj"][s]
        for i in range(e - s - 1):
            j = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // percent, "right")))
            ok = (comp[j] != comp[i]) & linked(np.minimum(rest[j], rest[i]), n[j] + n[i], percent) & ((home[j] == 1) | (home[i] == 1))
            if cross:
                ok &= block[j] != block[i]
            if not len(j := j[ok]):
                continue
            differ = np.bitwise_count(small[j] ^ small[i]).sum(1, dtype=np.int64) + single[j] + single[i]
            near = linked((n[j] + n[i] - differ) // 2, n[j] + n[i], percent)
            if not near.any():
                continue
            j, differ = j[near], differ[near]
            held.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j]), differ]))
            size += len(j)
            if size >= MOST_PAIRS:
                yield batch()
                held, size = [], 0
    yield batch()


class _Join:
    def __init__(self, nodes: DataFrame, percent: int):
        self.nodes, self.percent = nodes, percent
        self.prefix = nodes.mapInArrow(_prefixes, "token long, id long, n long, rest long")

    def band(self) -> Column:
        """Linked nodes are in the same or in neighbouring bands (a little wider than the size ratio, for rounding)."""
        return F.floor(F.log("n") / F.lit(math.log(100 / self.percent) + 1e-9))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sorted arrays have enough in common."""
        percent = self.percent

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for b in batches:
                keep = [
                    bool(linked(len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True)), m + n, percent))
                    for x, y, m, n in zip(*(b[c].to_pylist() for c in ("ta", "tb", "na", "nb")))
                ]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        side = lambda x: self.nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
        return stash(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(fn, "a long, b long"))

    def leaders(self) -> DataFrame:
        """Each node with the smallest node of its tiles."""
        rows = self.prefix.select("token", self.band().alias("band"), "id")
        least = rows.groupBy("token", "band").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        return rows.join(least, ["token", "band"]).groupBy("id").agg(F.min("least").alias("b")).filter("b < id").select(F.col("id").alias("a"), "b")

    def tile_pairs(self, component: DataFrame, all_pairs: bool) -> DataFrame:
        percent, spark = self.percent, self.nodes.sparkSession
        rows = self.prefix.join(component.withColumnRenamed("component", "c"), "id", "left").withColumn("component", F.coalesce("c", "id")).drop("c")
        tiles = stash(rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo < hi").select("token", F.ceil(F.col("rows") / BLOCK).alias("blocks"), "rows"))
        size = tiles.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0]
        if not size:
            return local_rows(spark, {x: pa.array([], pa.int64()) for x in PAIRS})
        band = self.band()
        rows = rows.join(tiles.drop("rows"), "token").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        rows = rows.withColumn("x", F.explode(F.array(F.struct(band.alias("band"), F.lit(1).alias("home")), F.struct((band - 1).alias("band"), F.lit(0).alias("home"))))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select("token", "x.band", "x.home", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "n", "rest", "id", "component")
        bits = self.nodes.select("id", "n", "single", "tokens").mapInArrow(_bitmaps, "id long, single long, bits binary")
        groups = max(1, math.ceil(2 * size / TILE_ROWS))
        rows = rows.join(bits, "id").withColumn("deal", F.pmod(F.xxhash64("token", "band", "bi", "bj"), F.lit(groups)))
        
        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            yield from _tile_pairs(pa.Table.from_batches(batches), percent, all_pairs)

        return rows.groupBy("deal").applyInArrow(pairs, "a long, b long, ca long, cb long, differ long")

    def run(self) -> DataFrame:
        links = self.verified(self.leaders())
        found = components(links)
        for turn in range(LIKELIEST_ROUNDS + 1):
            last = turn == LIKELIEST_ROUNDS
            pairs = self.tile_pairs(found, last)
            pairs = pairs.select("a", "b").distinct() if last else pairs.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.struct("differ", "a", "b")).alias("x")).select("x.*").distinct()
            new = self.verified(pairs)
            if not new.isEmpty():
                links = links.unionByName(new)
                found = components(links)
        return found


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    layout = X.Layout(docs)
    seq = stash(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_sequences, "doc_id long, words long, h1 long, h2 long"))
    reps = stash(seq.filter("words > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    parts = layout.parts(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text"))
    nodes = reps.select(layout.chunk("rep"), "rep", "h1", "h2")
    spread = layout.spread(0.16, 4)

    def count(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        sets = [x[3] for x in _sets(t, r, k)]
        keys, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, U64), np.empty(0, np.int64))
        return X.messages(key[0].as_py(), keys, n, spread)

    def select(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        sets = _sets(t, r, k)
        replies = {b: x for b, x in zip(r["bucket"].to_pylist(), r["body"].to_pylist()) if b is not None}
        flat = np.concatenate([x[3] for x in sets]) if sets else np.empty(0, U64)
        keys, inverse = np.unique(flat, return_inverse=True)
        df, at, rows = X.answers(replies, keys, spread)[inverse], 0, []
        for i, h1, h2, own in sets:
            n, times = len(own), df[at : at + len(own)]
            at += n
            shared = times > 1
            m = int(shared.sum())
            if m < needed(n, percent):
                rows.append((i, h1, h2, n, None, n - m, m, None))
                continue
            tokens = own[shared]
            prefix = tokens[np.lexsort((tokens, times[shared]))][: m - needed(n, percent) + 1]
            rows.append((i, h1, h2, n, tokens.tobytes(), n - m, m, prefix.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({x: pa.array([row[i] for row in rows], kinds[i]) for i, x in enumerate(("id", "h1", "h2", "n", "tokens", "single", "shared", "prefix"))})

    chunks = parts.groupBy("chunk")
    sent = chunks.cogroup(X.dealt(nodes, layout.partitions, "chunk").groupBy("chunk")).applyInArrow(count, X.MESSAGE)
    both = X.dealt(X.exchange(sent, spread, X.Sum(), layout, deal=False).unionByName(nodes, allowMissingColumns=True), layout.partitions, "chunk")
    found = stash(chunks.cogroup(both.groupBy("chunk")).applyInArrow(select, "id long, h1 long, h2 long, n long, tokens binary, single long, shared long, prefix binary"))
    component = _Join(found.filter("tokens is not null").select("id", "n", "tokens", "single", "shared", "prefix"), percent).run()
    known = found.select("id", "h1", "h2", "n").join(component, "id", "left").select("h1", "h2", "n", F.coalesce("component", "id").alias("component"))
    known = known.join(reps.select("h1", "h2", "copies"), ["h1", "h2"])
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    rows = seq.select("doc_id", "words", "h1", "h2")
    some = keyed_join(rows.filter("words > 0"), stash(known), ["h1", "h2"], "copies", layout.rows).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    out = some.unionByName(rows.filter("words = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.select(back("doc_id"), "n_shingles", back("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; of rows that repeat an id all stay or go."""
    drop = similar_documents(docs, k, percent).filter("component_id < doc_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drop, docs["doc_id"].eqNullSafe(drop["_gone"]), "left_anti")


def brute_force(texts: list[tuple[int, bytes | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (size, component) from all pairs, for small fixtures."""
    sets = {}
    for i, t in texts:
        w = blank_words(t, lower=True)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    to = {i: i for i in sets}

    def root(i: int) -> int:
        while to[i] != i:
            i = to[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                to[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}
