"""Vector codes: equal integer parts as weighted distinct rows, weighted Lloyd over them, codes joined back.

Each component becomes floor(scale * x); a vector is cut into ``parts`` equal consecutive parts. Equal parts
of a position are one row with a weight, so copies of vectors and of parts cost nothing in the rounds: those
run over the distinct rows, each task adding up components and weights by nearest entry before a shuffle of
parts x entries rows. What comes to the driver are the codebooks, parts x entries small integer vectors,
whatever the number of vectors. At last each distinct part's code and error are joined back to the vectors;
parts that very many vectors share are joined by broadcast (``keyed_join``).

Rows whose vector is null, holds null or non-finite components, or isn't of the table's width are dropped;
the width is that of the smallest vec_id's vector that parts divide. Codebooks start from the ``entries``
smallest vec_ids, nulls last; of rows that repeat an id only the smallest vector counts there, but all rows
get codes. Fewer vectors than entries make smaller codebooks; none, an empty result. Integers beyond 2**27
stop there (components of 524,288 and more at scale 256), so that errors fit into 64 bits. Sums of errors
that don't fit become null. Equal labels share their sum, null being one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huepoint.llm._store import keyed_join, stash

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LIMIT = 1 << 27
BATCH_ROWS = 16_384  # distances of a batch: so many rows x entries x components


def integers(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where one is null or not finite."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    floor = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return F.when(fine, F.transform(F.col(vector), floor))


def kept(table: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """row (a number of its own), vec_id, label, v: the vectors that get codes, written once."""
    rows = table.select("vec_id", "label", integers("embedding", scale).alias("v")).filter(f"v is not null and size(v) > 0 and size(v) % {parts} = 0")
    rows = stash(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()  # a top-1, not a sort
    return rows.filter(F.size("v") == first[0]["n"]) if first else rows


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """entries x parts x components of the smallest ids; ``entries`` rows come to the driver."""
    ids = rows.select(F.col("vec_id").alias("id")).distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries)
    least = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("id"))).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    least.sort(key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    return np.array([r["v"] for r in least], np.int64).reshape(len(least), parts, -1) if least else np.empty((0, parts, 0), np.int64)


def split(rows: DataFrame, parts: int) -> DataFrame:
    """A row for each part: row, vec_id, label, pos, part."""
    size = F.expr(f"size(v) div {parts}").cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(F.col("v"), i * size + 1, size))
    return rows.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and the squared distance."""
    d = np.zeros((len(x), len(book)), np.int64)
    for c in range(x.shape[1]):
        step = x[:, c, None] - book[None, :, c]
        d += step * step
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Of each batch and position in it: the batch, the position, which rows, and their parts."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            b = whole.slice(at, BATCH_ROWS)
            pos = b["pos"].to_numpy()
            x = b["part"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(pos), -1)
            for p in np.unique(pos):
                rows = np.flatnonzero(pos == p)
                yield b, int(p), rows, x[rows]


def lloyd(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``rounds`` times: each distinct part to its nearest entry, each entry to the floored weighted mean. ``distinct(pos, part, n)``."""
    entries, _, width = books.shape
    for _ in range(rounds):
        sent = distinct.sparkSession.sparkContext.broadcast(books)  # parts x entries small vectors

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b, p, rows, x in _positions(batches):
                n = b["n"].to_numpy()[rows]
                at, _ = nearest(x, sent.value[:, p])
                into = sums.setdefault(p, np.zeros((entries, width + 1), np.int64))
                np.add.at(into, at, np.column_stack([x * n[:, None], n]))
            for p, s in sums.items():
                used = np.flatnonzero(s[:, -1])
                yield pa.record_batch({"pos": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()), "s": pa.array(s[used].tolist(), pa.list_(pa.int64()))})

        told = distinct.mapInArrow(add, "pos int, entry int, s array<bigint>")
        # beyond 64 bits a sum is still right
        total = told.groupBy("pos", "entry").agg(*[F.sum(F.col("s")[i].cast("decimal(19,0)")).alias(f"s{i}") for i in range(width + 1)]).collect()
        books = books.copy()
        for r in total:
            n = int(r[f"s{width}"])
            books[r["entry"], r["pos"]] = [int(r[f"s{i}"]) // n for i in range(width)]
    return books


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """pos, part, n, code, error of each distinct part."""
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, p, rows, x in _positions(batches):
            at, error = nearest(x, sent.value[:, p])
            yield pa.record_batch({"pos": b["pos"].take(pa.array(rows)), "part": b["part"].take(pa.array(rows)), "n": b["n"].take(pa.array(rows)), "code": pa.array(at, pa.int64()), "error": pa.array(error, pa.int64())})

    return distinct.mapInArrow(fn, "pos int, part array<int>, n long, code long, error long")


def digest(books: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.transpose(1, 0, 2).ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (one number for each part), error of each kept row; and the codebooks, entries x parts x components."""
    rows = kept(table, scale, parts)
    books = first_entries(rows, parts, entries)
    if not len(books):
        return rows.select("vec_id", "label", F.array().cast("array<bigint>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    own = split(rows, parts)
    distinct = stash(own.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")))
    books = lloyd(distinct, books, rounds)
    values = stash(assigned(distinct, books))
    total = rows.count() * parts
    joined = keyed_join(own, values, ["pos", "part"], "n", total)
    # codes of a byte, eight to a number: sums of fixed size instead of lists
    byte = lambda k: F.sum(F.when(F.expr(f"pos div 7 = {k}"), F.expr("shiftleft(code, 8 * (pos % 7))")).otherwise(F.lit(0))).alias(f"c{k}")
    words = range(-(-parts // 7))
    summed = joined.groupBy("row", "vec_id", "label").agg(F.sum("error").alias("error"), *[byte(k) for k in words])
    codes = F.array(*[F.expr(f"shiftright(c{p // 7}, {8 * (p % 7)}) & 255") for p in range(parts)])
    return summed.select("vec_id", "label", codes.alias("codes"), "error"), books


def decoded(codes: str, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that codes stand for, by the middles of the integers' steps."""
    flat = F.array(*[F.array(*[F.array(*[F.lit((int(c) + 0.5) / scale) for c in e]) for e in book]) for book in books.transpose(1, 0, 2)])
    return F.flatten(F.transform(F.col(codes), lambda c, i: F.element_at(F.element_at(flat, i + 1), c.cast("int") + 1)))


def coded(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = encode(table)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = stash(rows.select("vec_id", code.alias("code"), "error", F.coalesce("label", F.lit(0)).alias("some"), F.col("label").isNull().alias("none")))
    labels = stash(rows.groupBy("some", "none").agg(F.expr("try_cast(sum(cast(error as decimal(20,0))) as bigint)").alias("label_error"), F.count(F.lit(1)).alias("n")))
    joined = keyed_join(rows, labels, ["some", "none"], "n", rows.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign(book: str) -> str:
    """pos, part, n, and the nearest entry e with its squared distance."""
    square = " + ".join(f"(p.part[{i}] - b.v[{i}]) * (p.part[{i}] - b.v[{i}])" for i in range(1, 5))
    return f"SELECT p.pos, p.part, any_value(p.n) AS n, min({{'d': {square}, 'e': b.e}}) AS best FROM p JOIN {book} b ON b.pos = p.pos GROUP BY p.pos, p.part"


def _updated(book: str, found: str) -> str:
    sums = ", ".join(f"sum(n * part[{i}])::BIGINT AS s{i}" for i in range(1, 5))
    mean = ", ".join(f"(s{i} - ((s{i} % m) + m) % m) // m" for i in range(1, 5))
    return f"SELECT b.pos, b.e, coalesce(u.v, b.v) AS v FROM {book} b LEFT JOIN (SELECT pos, e, [{mean}] AS v FROM (SELECT pos, best.e AS e, sum(n)::BIGINT AS m, {sums} FROM {found} GROUP BY 1, 2)) u USING (pos, e)"


SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
o AS (SELECT vec_id, label, i AS pos, v[4 * i + 1 : 4 * i + 4] AS part FROM k, range(16) r(i)),
p AS (SELECT pos, part, count(*)::BIGINT AS n FROM o GROUP BY 1, 2),
b0 AS (SELECT pos, e, part AS v FROM o JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64) USING (vec_id)),
a1 AS MATERIALIZED ({_assign("b0")}), b1 AS MATERIALIZED ({_updated("b0", "a1")}),
a2 AS MATERIALIZED ({_assign("b1")}), b2 AS MATERIALIZED ({_updated("b1", "a2")}),
a3 AS MATERIALIZED ({_assign("b2")}),
c AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM o JOIN a3 USING (pos, part) GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, s
"""
