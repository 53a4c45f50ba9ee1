"""Language-model scoring by a hierarchical Pitman-Yor model.

Each word that precedes another is a context restaurant; a follower's customers sit at tables, and each
table sends one customer to the restaurant of all words, the parent that all contexts share, whose tables
draw from a base that is uniform over the vocabulary and one unknown word. Seatings are sampled by Gibbs:
a sweep draws the tables of every (context, follower), its own left out of all sums, and then those of
every word at the parent, from their conditionals (``_seating``). The pairs of a sweep are drawn at once,
given the sums of the sweep before. After ``burn_in`` sweeps the next ``samples`` states are kept; the
probability of a word is the mean of their predictive probabilities, and the score of a text is the log10
of its tokens' probabilities.

Everything runs over the packed exchange. Chunks learn how often each of their words and pairs occurs in
all training texts, and which pairs they own: of the chunks that hold a pair, one draws its tables. For
each sweep a chunk sends, under the words sent once, what its own pairs add to the tables of each context
and the customers of each word at the parent; the bucket of a word adds up, draws the word's tables at
the parent, and answers. A pair that occurs once has one table and is drawn no more. At last the owners
tell all chunks that hold a pair the sum of its tables over the kept states. All draws come from hashes of
the pair and the sweep, so that a rerun, on other partitions too, gives the same.

Words and pairs are 64-bit hashes. Pairs are told apart in their bucket by 6 bytes: by 52 bits at half a gigabyte,
one more for each doubling, all 64 from about 2 TB on. Up to there less than one pair in a corpus is
expected to share another's count.

Tokens are the blank-separated words with A-Z lower-cased, then one end. Null and empty texts have the
end alone. Texts whose ids hash to a multiple of ``folds`` are held out: scored, never counted. With no
training text every token has probability 1. A null id is no held-out one. Rows that repeat an id are
counted each. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huepoint.llm import _exchange as X
from huepoint.llm._seating import pair_tables, parent_tables
from huepoint.llm._words import BASE, U64, distinct_words, give_back, mix, numbered

FOLDS, BURN_IN, SAMPLES = 10, 2, 3
CHUNK_BYTES = 9 << 20
WORDS_A_BYTE = 0.04  # distinct words of chunks, by which buckets are numbered
STRENGTH, PARENT_STRENGTH, PARENT_DISCOUNT = 1.0, 1.0, 0.75
END, START = U64(0x1D8E4E27C47D124F), U64(0xEB44ACCAB455D165)
#: Keys under which chunks add up: training tokens, known words, customers and tables of the parent, pairs that occur once and twice.
STATS = np.array([0x0123456789ABCDEF, 0x2B7E151628AED2A6, 0x452821E638D01377, 0x3C6EF372FE94F82B, 0x6A09E667F3BCC908, 0x9B05688C2B3E6C1F], U64)

BASE_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
OUT = BASE_OUT + ", score double"


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def squeeze(**arrays: np.ndarray) -> bytes:
    """Arrays by name; each byte plane of a column apart, as high bytes are few."""
    plain = {k: (x.dtype.str, x.tobytes() if x.dtype.itemsize == 1 else np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes(), len(x)) for k, x in arrays.items()}
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(plain))


def unsqueeze(b: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (kind, data, n) in pickle.loads(zstandard.ZstdDecompressor().decompress(b)).items():
        kind = np.dtype(kind)
        out[k] = np.frombuffer(data, kind) if kind.itemsize == 1 else np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()
    return out


SIZED = "chunk int not null, ids array<long>, body binary"


def chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Texts of about ``size`` bytes as one row: the distinct words, frequent ones first, and each token's place among them."""
    texts: list[bytes | None] = []
    ids: list[int | None] = []
    held = count = 0
    task = TaskContext.get()

    def row() -> pa.RecordBatch:
        distinct, at, sizes = distinct_words(texts, lower=True)
        words = np.concatenate([distinct, np.array([END, START], U64), STATS])
        inside = np.ones(len(at) + len(texts), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        codes = np.full(len(inside), len(distinct))
        codes[inside] = at
        often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often), dtype=np.uint32)
        body = squeeze(sizes=(sizes + 1).astype(np.int64), words=mix(words[often]), codes=place[codes])
        if task.partitionId() >= 1 << 20 or count >= 1 << 11:
            raise ValueError("chunks are numbered for up to 2**20 partitions of up to 18 GB; repartition the documents")
        number = task.partitionId() + (count << 20)
        return pa.record_batch({"chunk": pa.array([number], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64())), "body": pa.array([body], pa.binary())})

    for b in batches:
        for i, x in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            ids.append(i)
            texts.append(x)
            held += len(x or b"") + 64
            if held >= size:
                yield row()
                give_back()
                texts, ids, held, count = [], [], 0, count + 1
    if ids:
        yield row()


class Chunk:
    """Words of one chunk's texts and, if asked for, their pairs."""

    def __init__(self, t: pa.Table, folds: int, pairs: bool = True):
        give_back()  # what the chunk before has left
        (row,) = t.select(["chunk", "ids", "body"]).to_pylist()
        body = unsqueeze(row["body"])
        self.number, self.ids = row["chunk"], row["ids"]
        self.out = np.array([held_out(i, folds) for i in self.ids], bool)
        self.sizes = body["sizes"]
        self.words, rank = numbered(body["words"])  # places, here and below, of 4 bytes a token: these are most of a task's memory
        self.word = rank[body["codes"]]
        del body, row, rank
        self.start, *stats = np.searchsorted(self.words, mix(np.append(START, STATS)))
        self.stats = np.array(stats)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        self.trained = ~self.out[self.doc]
        if pairs:
            starts = np.cumsum(self.sizes) - self.sizes
            self.context = np.append(np.int32(self.start), self.word[:-1]).astype(np.int32)
            self.context[starts] = self.start
            self.pairs, self.pair = numbered(mix(self.words[self.context] * U64(BASE) + self.words[self.word]))
            self.pair_word, self.pair_context = np.empty(len(self.pairs), np.int32), np.empty(len(self.pairs), np.int32)
            self.pair_word[self.pair], self.pair_context[self.pair] = self.word, self.context

    def word_counts(self) -> np.ndarray:
        """Own training counts; of the start: training texts."""
        word = np.bincount(self.word[self.trained], minlength=len(self.words))
        word[self.start] = int((~self.out).sum())
        word[self.stats[0]] = int(self.trained.sum())
        return word

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.trained], minlength=len(self.pairs))

    def learn_words(self, replies: dict[int, bytes], words: X.Spread) -> None:
        """Counts of words over all training texts, and which of them this chunk owns."""
        word = X.answers(replies, self.words, words)
        self.count, self.own_word = word >> 1, (word & 1) > 0
        self.total = int(self.count[self.stats[0]])
        self.count[self.stats] = 0
        self.known = self.own_word & (self.count > 0)
        self.known[self.start] = False

    def learn(self, replies: dict[int, dict[int, bytes]], words: X.Spread, pairs: X.Spread) -> None:
        """Counts over all training texts, and what of them this chunk owns."""
        self.learn_words(replies[WORDS], words)
        pair = X.answers(replies[PAIRS], self.pairs, pairs)
        self.pair_count, self.own = pair >> 1, (pair & 1) > 0

    def owned(self, words: X.Spread, pairs: X.Spread) -> bytes:
        """What the sweeps need: own pairs that occur twice and more one by one, the others' sums by word."""
        once, more = self.own & (self.pair_count == 1), np.flatnonzero(self.own & (self.pair_count > 1))
        single = lambda x: np.bincount(x[once], minlength=len(self.words)).astype(np.uint32)
        return squeeze(
            word_at=X.bounds(self.words, words.near),
            pair_at=X.bounds(self.pairs, pairs.near),
            stats=self.stats,
            place=np.diff(more, prepend=0).astype(np.uint32),
            context=self.pair_context[more].astype(np.uint32),
            word=self.pair_word[more].astype(np.uint32),
            count=self.pair_count[more],
            key=(self.pairs[more] >> U64(32)).astype(np.uint32),
            single_tables=single(self.pair_context),
            single_customers=single(self.pair_word),
            known=self.known,
            sums=np.array([int(self.known.sum()), int(once.sum()), int((self.pair_count[more] == 2).sum())], np.int64),
        )

    def add(self, x: np.ndarray) -> np.ndarray:
        """Of the tokens' numbers, each text's sum."""
        return np.bincount(self.doc, x, len(self.ids)) if len(self.ids) else np.empty(0)

    def base(self, known: int) -> pa.Table:
        """All columns but the score; known: distinct words of all training texts."""
        n, count = len(self.ids), self.count[self.word]
        base = self.add(np.log10((self.count + 0.1) / (self.total + 0.1 * (known + 1)))[self.word]) if self.total else np.zeros(n)
        return pa.table(
            {
                "doc_id": pa.array(self.ids, pa.int64()),
                "held_out": pa.array(self.out),
                "n_tokens": pa.array(self.sizes),
                "n_known": pa.array(self.add(count > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, self.total, np.int64)),
                "base_score": pa.array(base, pa.float64()),
            }
        )

    def scores(self, replies: dict[int, dict[int, bytes]], words: X.Spread, pairs: X.Spread, kept: list[int]) -> pa.Table:
        known, score = 0, np.zeros(len(self.ids))
        if self.total:
            told = lambda k: Sums(X.answers(replies[SWEEP + k], self.words, words, Seats.each, X.untight), self.stats)
            first = told(kept[0])
            known = first.known
            tables = X.answers(replies[KEPT], self.pairs, pairs, 1, X.untight) + len(kept) * (self.pair_count > 0)
            p = np.zeros(len(self.pairs))
            for k in kept:
                sums, parents = told(k), told(k + 1).parents
                parent = sums.customers - PARENT_DISCOUNT * sums.tables_there + (PARENT_STRENGTH + PARENT_DISCOUNT * parents) / (first.known + 1)
                parent /= sums.total + PARENT_STRENGTH
                p += (STRENGTH + first.discount * sums.tables)[self.pair_context] * parent[self.pair_word]
            p += np.maximum(len(kept) * self.pair_count - first.discount * tables, 0)
            score = self.add(np.log10(p / (len(kept) * (STRENGTH + self.count[self.pair_context])))[self.pair])
        return self.base(known).append_column("score", pa.array(score, pa.float64()))


class Sums:
    """A sweep's answer for the words of a chunk: tables of each context, customers and tables of each word at the parent, and totals."""

    def __init__(self, rows: np.ndarray, stats: np.ndarray):
        self.tables, self.customers, self.tables_there = rows
        _, self.known, self.total, self.parents, once, twice = (int(self.customers[x]) for x in stats)
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
        self.model = (STRENGTH, self.discount, PARENT_STRENGTH, PARENT_DISCOUNT)
        for x in rows:
            x[stats] = 0


class Extra(X.Sum):
    """The sums of tables beyond one a state; most are 0."""

    packed, unpacked = staticmethod(X.tight), staticmethod(X.untight)

    def codes(self, keys: np.ndarray, vals: np.ndarray) -> np.ndarray:
        return numbered(keys)[1]

    def read(self, b: bytes, n: int) -> np.ndarray:
        return X.untight(b, n)

    def write(self, x: np.ndarray) -> bytes:
        return X.tight(x)


class Seats(X.Sum):
    """Adds up tables and customers of each word, then draws the word's tables at the parent."""

    each = 3
    packed, unpacked = staticmethod(X.tight), staticmethod(X.untight)

    def __init__(self, sweep: int):
        self.sweep, self.head = sweep, (0, 0)  # the parent's tables as last known, known words

    def read(self, b: bytes, n: int) -> np.ndarray:
        self.head = struct.unpack("<qq", b[:16])
        return X.untight(b[16:], 2 * n).reshape(2, n)

    def write(self, x: np.ndarray) -> bytes:
        return struct.pack("<qq", *self.head) + X.tight(x.ravel())

    def codes(self, keys: np.ndarray, vals: np.ndarray) -> np.ndarray:
        self.keys, codes = numbered(keys)
        return codes

    def up(self, codes: np.ndarray, n: int, vals: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(codes, x, n) for x in vals]).astype(np.int64)

    def down(self, codes: np.ndarray, vals: np.ndarray, merged: np.ndarray, reply: np.ndarray | None) -> np.ndarray:
        if reply is None:
            customers, (parents, known) = merged[1], self.head
            tables = np.minimum(customers, 1)
            at = np.flatnonzero(customers > 1)  # of STATS, too; nobody looks at those
            if len(at) and known:
                tables[at] = np.round(customers[at] ** PARENT_DISCOUNT)
                for turn in range(3):
                    tables[at] = parent_tables(customers[at], tables[at], parents, 1 / (known + 1), (STRENGTH, 0.5, PARENT_STRENGTH, PARENT_DISCOUNT), self.keys[at], 1_000_000 + 10 * self.sweep + turn)
            reply = np.concatenate([merged, tables[None]])
        return reply[:, codes]


#: Stages of replies: counts of words and pairs, sums of kept tables, own pairs, then those of each sweep.
WORDS, PAIRS, KEPT, SWEEP = 0, 1, 2, 10


def bodies(t: pa.Table) -> dict[int, dict[int, bytes]]:
    """Replies by stage and bucket, of a table of them or of a chunk's row with lists of them."""
    out: dict[int, dict[int, bytes]] = {}
    rows = zip(t["stage"].to_pylist(), t["bucket"].to_pylist(), t["body"].to_pylist()) if "stage" in t.column_names else (tuple(x.values()) for c in t.column_names if pa.types.is_list(t[c].type) and c != "ids" for x in t[c].to_pylist()[0])
    for s, b, x in rows:
        out.setdefault(s, {})[b] = x
    return out


def in_chunks(docs: DataFrame, layout: X.Layout) -> DataFrame:
    return X.dealt(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lambda batches: chunked(batches, CHUNK_BYTES), SIZED), layout.partitions, "chunk")


def word_messages(parts: DataFrame, words: X.Spread, folds: int) -> DataFrame:
    """Each chunk's training counts of its words."""

    def count_words(key: tuple, t: pa.Table) -> pa.Table:
        chunk = Chunk(t, folds, False)
        return X.messages(chunk.number, chunk.words, chunk.word_counts(), words)

    return parts.groupBy("chunk").applyInArrow(count_words, X.MESSAGE)


def base_scored(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The columns of ``scored`` but the score. They follow from counts of words alone: no pair is counted, nothing is drawn."""
    layout = X.Layout(docs)
    parts, words = in_chunks(docs, layout), layout.spread(WORDS_A_BYTE)
    counts = X.exchange(word_messages(parts, words, folds), words, X.Own(), layout).groupBy("chunk")

    def learned(t: pa.Table, r: pa.Table) -> Chunk:
        chunk = Chunk(t, folds, False)
        chunk.learn_words(dict(zip(r["bucket"].to_pylist(), r["body"].to_pylist())), words)
        return chunk

    def own_known(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        return pa.table({"known": pa.array([int(learned(t, r).known.sum())], pa.int64())})

    def base(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        return learned(t, r).base(t["known"][0].as_py())

    known = parts.groupBy("chunk").cogroup(counts).applyInArrow(own_known, "known long").agg(F.sum("known").alias("known"))
    return parts.crossJoin(F.broadcast(known)).groupBy("chunk").cogroup(counts).applyInArrow(base, BASE_OUT)


def scored(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The first state has one table for each pair; it and the states of the next ``burn_in`` - 1 sweeps aren't kept (burn_in = 0: it is).
    """
    layout = X.Layout(docs)
    parts = in_chunks(docs, layout)
    words, pairs = layout.spread(WORDS_A_BYTE), layout.spread(0.12, 6)
    kept = list(range(burn_in, burn_in + samples))
    last = burn_in + samples + 1  # one more sweep: its exchange tells how many tables the parent had in the last kept state

    def staged(replies: DataFrame, stage: int) -> DataFrame:
        return replies.selectExpr("chunk", "bucket", "body", f"{stage} AS stage")

    def count_pairs(key: tuple, t: pa.Table) -> pa.Table:
        chunk = Chunk(t, folds)
        return X.messages(chunk.number, chunk.pairs, chunk.pair_counts(), pairs)

    def own(key: tuple, t: pa.Table) -> pa.Table:
        chunk = Chunk(t, folds)
        chunk.learn(bodies(t), words, pairs)
        return X.replies_of([chunk.number], [0], [chunk.owned(words, pairs)])

    def told(number: int, o: dict[str, np.ndarray], t: np.ndarray, total: np.ndarray, parents: int) -> pa.Table:
        """What a state's own tables add to the sums, and the state itself as a note."""
        n = len(o["known"])
        sums = np.stack([np.bincount(o["context"], t, n), np.bincount(o["word"], t, n)]).astype(np.int64)
        sums[0] += o["single_tables"]
        sums[1] += o["single_customers"]
        known, once, twice = o["sums"].tolist()
        sums[0, o["stats"]] = 0
        sums[1, o["stats"]] = [0, known, int(t.sum()) + once, int(parents), once, twice]
        at = o["word_at"]
        rows = [b for b in range(words.near) if at[b + 1] > at[b]]
        seats = Seats(0)
        seats.head = o["head"]
        return X.table(number, [*rows, words.near + number], [None] * (len(rows) + 1), [*(seats.write(sums[:, at[b] : at[b + 1]]) for b in rows), squeeze(tables=t, total=total)])

    def begin(key: tuple, t: pa.Table) -> pa.Table:
        o = unsqueeze(t["body"][0].as_py()) | {"head": (0, 0)}
        one = np.ones(len(o["count"]), np.int64)
        return told(key[0].as_py(), o, one, one * (0 in kept), 0)

    def sweep(k: int):
        """From the answer to state k - 1 to state k; after the kept ones to their sums, for all chunks that hold the pairs."""

        def fn(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
            number, o = key[0].as_py(), unsqueeze(t["body"][0].as_py())
            got = bodies(r)[SWEEP + k - 1]
            sums = Sums(X.answers_at(got, o["word_at"], Seats.each, X.untight), o["stats"])
            note = unsqueeze(got[words.near + number])
            now, context, word = note["tables"], o["context"], o["word"]
            if k == last:
                vals = np.zeros(o["pair_at"][-1], np.int64)
                vals[np.cumsum(o["place"].astype(np.int64))] = note["total"] - len(kept)
                at = o["pair_at"]
                rows = [b for b in range(pairs.near) if at[b + 1] > at[b]]
                return X.table(number, rows, [None] * len(rows), [X.tight(vals[at[b] : at[b + 1]]) for b in rows])
            parents = int(sums.tables_there[o["known"]].sum())
            key_ = mix(o["key"].astype(U64))
            t = pair_tables(o["count"], now, sums.tables[context], sums.customers[word], sums.tables_there[word], sums.total, sums.model, key_, k)
            o["head"] = (sums.parents or sums.known, sums.known)
            return told(number, o, t, note["total"] + t * (k in kept), parents)

        return fn

    def listed(replies: DataFrame, name: str) -> DataFrame:
        """A row for each chunk; so frames that are dealt by chunk meet in joins, where a union of them would be dealt once more."""
        return replies.groupBy("chunk").agg(F.collect_list(F.struct("stage", "bucket", "body")).alias(name))

    sent_words = word_messages(parts, words, folds)
    sent_pairs = parts.groupBy("chunk").applyInArrow(count_pairs, X.MESSAGE)
    counts = X.dealt(staged(X.exchange(sent_words, words, X.Own(), layout, deal=False), WORDS).unionByName(staged(X.exchange(sent_pairs, pairs, X.Own(), layout, deal=False), PAIRS)), layout.partitions, "chunk")
    counted = parts.join(listed(counts, "counts"), "chunk")
    owned = X.dealt(counted.groupBy("chunk").applyInArrow(own, X.REPLY), layout.partitions, "chunk").groupBy("chunk")
    answers = [staged(X.exchange(owned.applyInArrow(begin, X.MESSAGE), words, Seats(0), layout, sent_words), SWEEP)]
    for k in range(1, last + 1):
        sent = owned.cogroup(answers[-1].groupBy("chunk")).applyInArrow(sweep(k), X.MESSAGE)
        if k < last:
            answers.append(staged(X.exchange(sent, words, Seats(k), layout, sent_words), SWEEP + k))
    told_all = counted.join(listed(staged(X.exchange(sent, pairs, Extra(), layout, sent_pairs), KEPT), "extra"), "chunk")
    for k, a in enumerate(answers[burn_in:]):
        told_all = told_all.join(listed(a, f"state{k}"), "chunk")

    def score(key: tuple, t: pa.Table) -> pa.Table:
        chunk, replies = Chunk(t, folds), bodies(t)
        chunk.learn(replies, words, pairs)
        return chunk.scores(replies, words, pairs, kept)

    return told_all.groupBy("chunk").applyInArrow(score, OUT)
