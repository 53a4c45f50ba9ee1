"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text's symbols are its blank-separated words (of a longer word, each 16 characters). Every k symbols
are a k-mer, every s of them inside an s-mer. A k-mer is an anchor if the smallest hash of its s-mers is
that of its first or its last one: a choice that depends on the k-mer alone, so a stretch of text has
the same anchors wherever it stands. The fingerprint is all distinct anchor hashes in order, each with the place
of its first anchor, as ``hash:place,hash:place...``; a text of fewer than k symbols is one anchor. Hashes have 40
bits, as only two texts meet at a time: of two with 10,000 anchors each one in 10,000 pairs shares one by chance.
A digest of the ``keep`` smallest serves where room is scarce.

Two texts are matched by all their distinct anchors and the places of these: an anchor that both have
matches if it stands at the same place in both or if another one is moved by as many symbols, as those
of a shared passage are. Common phrases scattered over both texts don't match. The share of anchors that
match is 2 |matching| / (|A| + |B|), and follows from the two fingerprints alone. ``likeness`` estimates the share
of common anchors, wherever they stand, from two digests (exact for texts of up to ``keep`` anchors).

Null texts are empty ones; texts without symbols have the empty fingerprint, likeness 1 to each other
and 0 to the rest. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huepoint.llm._store import stash

K, S, KEEP = 4, 2, 64
PLACE_BITS = 23
ANCHORS = "array<struct<hash: bigint, place: int>>"
SYMBOL = "[^\\x20\\x09-\\x0D]{1,16}"


def hashed(x: Column) -> Column:
    return F.shiftrightunsigned(x, 24)


def firsts(ordered: str, name: Callable[[Column], Column]) -> Column:
    """Without those whose hash has come before."""
    return F.filter(ordered, lambda x, i: (i == 0) | (name(x) != name(F.col(ordered)[F.greatest(i - 1, F.lit(0))])))


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S, keep: int = KEEP, place_bits: int = PLACE_BITS) -> DataFrame:
    """Adds ``out``: struct(hash, place) of two arrays, by hash, and ``all_out``, all distinct anchors.

    Staged so that no step is worked out twice. A k-mer's hash is that of its s-mers at 0, s, 2 s ... and
    the last. Hash and place are packed into one number (``all_out.packed``), so that numbers are sorted,
    not rows; only in texts of 2**place_bits symbols and more they stay rows (``all_out.wide``).
    """
    h, g, p, w, p0, w0 = (f"__{x}_{out}" for x in ("h", "g", "p", "w", "p0", "w0"))
    inner = k - s + 1  # s-mers in a k-mer
    at = lambda i, j: F.col(g)[i + (j - 1)]  # noqa: E731  i counts from 1
    df = df.withColumn(h, F.transform(F.regexp_extract_all(F.col(text), F.lit(SYMBOL), F.lit(0)), lambda x: F.xxhash64(x)))
    pair = F.col(h)
    for j in range(1, s):
        pair = F.zip_with(pair, F.slice(F.col(h), j + 1, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn(g, pair)
    edge = lambda i: F.least(at(i, 0), at(i, inner - 1)) <= (F.least(*[at(i, j) for j in range(1, inner - 1)]) if inner > 3 else at(i, 1))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(1))), edge)
    packed = lambda x, i: F.shiftleft(hashed(x), place_bits) + i
    wide = lambda x, i: F.struct(hashed(x).alias("hash"), i.cast("int").alias("place"))
    kmer = lambda i: F.xxhash64(*[at(i, j) for j in sorted({*range(0, inner, s), inner - 1})])
    few = F.xxhash64(h)
    some = lambda pair, empty: F.when(F.size(h) >= k, F.transform(places, lambda i: pair(kmer(i), i))).when(F.size(h) > 0, F.array(pair(few, F.lit(1)))).otherwise(F.array().cast(empty))
    name = lambda x: F.shiftright(x, place_bits)
    short = F.size(h) < (1 << place_bits)
    df = df.withColumn(p0, F.sort_array(F.when(short, some(packed, "array<bigint>")))).withColumn(w0, F.sort_array(F.when(~short, some(wide, ANCHORS))))
    df = df.withColumn(p, firsts(p0, name)).withColumn(w, firsts(w0, lambda x: x["hash"]))
    low, low_wide = F.slice(p, 1, keep), F.slice(w, 1, keep)
    digest = F.struct(
        F.coalesce(F.transform(low, name), F.transform(low_wide, lambda x: x["hash"])).alias("hash"),
        F.coalesce(F.transform(low, lambda x: x.bitwiseAND((1 << place_bits) - 1).cast("int")), F.transform(low_wide, lambda x: x["place"])).alias("place"),
    )
    return df.withColumn(out, digest).withColumn(f"all_{out}", F.struct(F.col(p).alias("packed"), F.col(w).alias("wide"))).drop(h, g, p, w, p0, w0)


def with_matching(df: DataFrame, a: str, b: str, out: str, place_bits: int = PLACE_BITS) -> DataFrame:
    """Adds ``out``: the share of two texts' anchors (``all_out`` of with_anchors) that match by hash and place.

    A merge of both in order of hashes pairs the shared anchors; each one's shift is its place in b less that in a.
    """
    merged, merged_wide, moved = (f"__{x}_{out}" for x in ("merged", "wide", "moved"))
    mask = (1 << place_bits) - 1
    x, y = F.col(f"{a}.packed"), F.col(f"{b}.packed")
    row = lambda e: F.struct(F.shiftright(e, place_bits).alias("hash"), e.bitwiseAND(mask).cast("int").alias("place"))
    sided = lambda c, n: F.transform(F.coalesce(F.col(f"{c}.wide"), F.transform(F.col(f"{c}.packed"), row)), lambda e: F.struct(e["hash"].alias("hash"), e["place"].alias("place"), F.lit(n).alias("side")))
    df = df.withColumn(merged, F.sort_array(F.concat(F.transform(x, lambda e: F.shiftleft(e, 1)), F.transform(y, lambda e: F.shiftleft(e, 1) + 1))))
    df = df.withColumn(merged_wide, F.when(x.isNull() | y.isNull(), F.sort_array(F.concat(sided(a, 0), sided(b, 1)))))

    def shifts(v: str, name: Callable[[Column], Column], place: Callable[[Column], Column], side: Callable[[Column], Column]) -> Column:
        after = F.slice(F.col(v), 2, F.greatest(F.size(v), F.lit(1)))
        return F.zip_with(v, after, lambda e, n: F.when(name(e) == name(n), (place(n) - place(e)) * (1 - 2 * side(e))))

    packed = shifts(merged, lambda e: F.shiftright(e, place_bits + 1), lambda e: F.shiftright(e, 1).bitwiseAND(mask), lambda e: e.bitwiseAND(1))
    wide = shifts(merged_wide, lambda e: e["hash"], lambda e: e["place"].cast("long"), lambda e: e["side"])
    df = df.withColumn(moved, F.sort_array(F.array_compact(F.coalesce(packed, wide))))
    v, last = F.col(moved), F.size(moved) - 1
    found = F.size(F.filter(moved, lambda d, i: (d == 0) | (i > 0) & (d == v[F.greatest(i - 1, F.lit(0))]) | (i < last) & (d == v[F.least(i + 1, last)])))
    size = sum(F.coalesce(F.array_size(c), F.lit(0)) for c in (x, F.col(f"{a}.wide"), y, F.col(f"{b}.wide")))
    return df.withColumn(out, F.when(size == 0, F.lit(1.0)).otherwise(2.0 * found / size)).drop(merged, merged_wide, moved)


def written(anchors: str, place_bits: int = PLACE_BITS) -> Column:
    """The fingerprint of a text from its ``all_...`` column."""
    pair = lambda x, p: F.concat(F.lpad(F.lower(F.hex(x)), 10, "0"), F.lit(":"), p.cast("string"))
    packed = F.transform(f"{anchors}.packed", lambda e: pair(F.shiftright(e, place_bits), e.bitwiseAND((1 << place_bits) - 1)))
    return F.array_join(F.coalesce(packed, F.transform(f"{anchors}.wide", lambda e: pair(e["hash"], e["place"]))), ",")


def likeness(a: str, b: str, keep: int = KEEP) -> Column:
    """Of two texts by their fingerprints' anchors."""
    x, y = F.col(f"{a}.hash"), F.col(f"{b}.hash")
    union = F.slice(F.sort_array(F.array_union(x, y)), 1, keep)
    both, all_ = F.size(F.array_intersect(union, F.array_intersect(x, y))), F.size(union)
    return F.when(all_ == 0, F.lit(1.0)).otherwise(2.0 * both / (all_ + both))


def following(ids: DataFrame) -> DataFrame:
    """``ids(doc_id, n)`` of distinct ids -> doc_id, next_id, n: the next smaller id (null smallest), after the last the first."""
    spark = ids.sparkSession
    dealt = stash(ids.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id()))
    down = F.col("doc_id").desc_nulls_last()
    heads = dealt.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("head"))  # a row for each partition
    order = Window.orderBy("part")
    ends = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = dealt.withColumn("head", F.lead(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).over(Window.partitionBy("part").orderBy(down)))
    return inside.join(ends, "part").select("doc_id", F.coalesce("head", "after")["doc_id"].alias("next_id"), "n")


def key(c: str) -> Column:
    """Equal for equal ids, nulls included, and not null."""
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, text, edited, next_id, next_text: each text, and it with its last third replaced by the beginning of the next document's, by descending id.

    Where rows repeat an id, all have the next smaller id as next, and the smallest of its texts is taken.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = base.select("doc_id", F.length("text").alias("n"))
    counted = lengths.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key("doc_id")).alias("ids")).first()
    once = counted["rows"] == counted["ids"]
    order = following(lengths.groupBy("doc_id").agg(F.max("n").alias("n")))
    rows = base.select(key("doc_id").alias("k"), "doc_id", "text").repartition(F.col("k"))
    # both uses read all columns of rows, so that one exchange serves them
    giver = rows if once else rows.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    asked = order.select(key("next_id").alias("k"), key("doc_id").alias("to"))
    given = giver.join(asked, "k").select(F.col("to").alias("k"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third), F.col("next_text").substr(F.lit(1), third))
    return rows.join(given, "k").select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_id", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document and its edited text (``edits``).

    doc_id, n_chars, edited (text), all_anchors, all_edited_anchors (``written`` prints them), next_id, match_edited,
    match_next (by all anchors and their places); anchors, edited_anchors (digests), near_edited, near_next (likeness
    of the digests). Texts travel, not their anchors, which would take more room.
    """
    out = edits(docs)
    for text, anchors in (("text", "anchors"), ("edited", "edited_anchors"), ("next_text", "next_anchors")):
        out = with_anchors(out, text, anchors)
    out = out.withColumn("near_edited", likeness("anchors", "edited_anchors")).withColumn("near_next", likeness("anchors", "next_anchors"))
    out = with_matching(out, "all_anchors", "all_edited_anchors", "match_edited")
    out = with_matching(out, "all_anchors", "all_next_anchors", "match_next")
    return out.drop("text", "next_text", "next_anchors", "all_next_anchors")


#: Of the documents, what SQL can say about ``edits``.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), o AS (SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t)::BIGINT AS n_chars, next_id, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(u, 1, length(t) // 3)) AS edited_sha256 FROM o
"""
