"""Importance resampling towards a target distribution, by hashed word n-grams.

A text's features are its runs of 1 to ``n`` consecutive words, repeats counted; each falls into the bucket
of its CRC-32. A bucket's gain is the logarithm of its share in the target's texts over that in the corpus,
both smoothed by one. A document's weight is the mean of its features' gains, and the documents with the
highest weight plus Gumbel noise (from a hash of seed and id) are drawn: sampling without replacement with
probabilities in proportion to the importance weights.

A text of more than ``CHUNK_BYTES`` is cut into chunks at word boundaries. A chunk owns the features that
begin at its own words and carries the next n - 1 words to end them, so chunks are counted and weighed by
different tasks, and their counts and weights are summed by document. Corpus and target send a row for each
bucket and task; the table of gains has ``buckets`` numbers, whatever the corpus. Ranks come from ranges of
scores and prefix sums of their sizes, not from one task.

Null, empty and wordless texts have no features: weight 0, and they are drawn only if ``least_words`` is 0.
Rows that repeat an id are a row each and have the same noise (a null id that of "null", last among equal
scores); rows equal in all of this are ranked in any order. Empty tables: no corpus gives no rows, no target
texts gains against a uniform target. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huepoint.llm._store import stash
from huepoint.llm._words import give_back
from huepoint.llm.mixing import _running

N, BUCKETS, SEED, PERCENT, LEAST_WORDS = 2, 10_000, 7, 25, 20
CHUNK_BYTES = 256 << 10

#: Lower case for A-Z, a blank for every ASCII character that belongs to no word.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def chunks_of(text: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of a lower-cased text of blank-separated words, each with the number of words that it owns."""
    at, end = 0, len(text)
    while at < end:
        cut = text.find(b" ", min(at + size, end))
        cut = stop = end if cut < 0 else cut
        for _ in range(n - 1):  # the carry
            while stop < end and text[stop] == 0x20:
                stop += 1
            stop = text.find(b" ", stop)
            stop = end if stop < 0 else stop
        owned = len(text[at:cut].split())
        if owned:
            yield text[at:stop], owned
        at = cut


def buckets_of(text: bytes, owned: int | None, n: int, buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of each feature that begins at one of the ``owned`` first words (None: at any), and the number of those words."""
    words = text.split()
    owned = len(words) if owned is None else owned
    hashes = list(map(zlib.crc32, words))
    spaced, out = [b" " + w for w in words], [hashes[:owned]]
    for m in range(1, n):  # a CRC goes on where that of the shorter run ended
        hashes = list(map(zlib.crc32, spaced[m:], hashes))
        out.append(hashes[:owned])
    return np.fromiter((x for part in out for x in part), np.int64, sum(map(len, out))) % buckets, owned


def _pieces(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows of texts of up to CHUNK_BYTES as they are, and the chunks of longer ones, dealt out anew."""
    size = CHUNK_BYTES
    docs = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b["text"]):
                pieces = list(chunks_of(text.as_py().translate(TABLE), n, size)) or [(b"", 0)]
                for k, (piece, owned) in enumerate(pieces):
                    yield pa.record_batch({"doc_id": b["doc_id"].slice(i, 1), "row": b["row"].slice(i, 1), "chunk": pa.array([k], pa.int32()), "text": pa.array([piece], pa.binary()), "owned": pa.array([owned], pa.int32())})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    long = docs.filter(F.octet_length("text") > size).mapInArrow(cut, f"doc_id {id_type}, row long, chunk int, text binary, owned int")
    short = docs.filter(F.octet_length("text") <= size).select("doc_id", "row", "text", F.lit(None).cast("int").alias("owned"))
    return short, long.repartition("row", "chunk").select("doc_id", "row", "text", "owned")


def bucket_counts(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``buckets`` numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text, owned in zip(b["text"], b["owned"].to_pylist()):
                total += np.bincount(buckets_of(text.as_py().translate(TABLE), owned, n, buckets)[0], minlength=buckets)
            give_back()
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    short, long = _pieces(docs.select(F.lit(0).alias("doc_id"), "text"), n)
    rows = [x.select("text", "owned").mapInArrow(count, "bucket int, n long") for x in (short, long)]
    out = np.zeros(buckets, np.int64)
    for r in rows[0].unionByName(rows[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths."""
    size = len(corpus)
    above, below = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * above / ((float(s) + 1) * below))) for s, t in zip(corpus, target)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text, owned in zip(b["text"], b["owned"].to_pylist()):
                found, words = buckets_of(text.as_py().translate(TABLE), owned, n, len(sent.value))
                got.append((words, len(found), int(sent.value[found].sum())))
            give_back()
            yield pa.record_batch({"doc_id": b["doc_id"], "row": b["row"]} | {c: pa.array([g[i] for g in got], pa.int64()) for i, c in enumerate(("n_words", "n_features", "gain"))})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    short, long = (x.mapInArrow(weigh, f"doc_id {id_type}, row long, n_words long, n_features long, gain long") for x in _pieces(docs, n))
    summed = long.groupBy("doc_id", "row").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return short.drop("row").unionByName(summed.drop("row")).select("doc_id", "n_words", "n_features", mean.alias("weight"))


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of ``docs``; rank is null where it isn't drawn.

    ``percent`` of the rows of at least ``least_words`` words are drawn; equal scores go to the smaller id.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    rows = stash(weights(docs.select("doc_id", "text"), gain, n).withColumn("score", F.col("weight") + noise("doc_id", seed)))
    can = rows.filter(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = _running(can, order, {"place": F.lit(1).cast("long")})
    drawn = can.count() * percent // 100
    ranked = placed.select(*rows.columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn (of rows that repeat an id, all or none)."""
    ids = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_FEATURES = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"

#: CRC-32 over bytes by its table, made of the reversed polynomial.
SQL = f"""
WITH z AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
df AS (SELECT doc_id, unnest({_FEATURES}) AS f FROM d),
bf AS (SELECT unnest({_FEATURES}) AS f FROM (SELECT {_WORDS} AS ws FROM benchmark)),
dc AS (SELECT f, count(*) AS n FROM df GROUP BY 1),
bc AS (SELECT f, count(*) AS n FROM bf GROUP BY 1),
h AS (SELECT f, hex(f) AS x FROM (SELECT f FROM dc UNION SELECT f FROM bc)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM h, z),
s AS (SELECT b, sum(n)::DOUBLE AS s FROM dc JOIN k USING (f) GROUP BY 1),
t AS (SELECT b, sum(n)::DOUBLE AS t FROM bc JOIN k USING (f) GROUP BY 1),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM dc)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM bc)::DOUBLE AS t_all),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (b), a),
w AS (SELECT doc_id, count(*) AS n_features, (sum(gain) - ((sum(gain) % count(*)) + count(*)) % count(*)) // count(*) AS weight FROM df JOIN k USING (f) JOIN g USING (b) GROUP BY 1),
r AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(ws) >= 20 AS can, ('0x' || sha256('7:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id) AS place, 25 * count(*) FILTER (can) OVER () // 100 AS drawn FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND place <= drawn THEN place END AS rank FROM o
"""
