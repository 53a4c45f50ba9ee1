"""Mixing sources to target weights, in DataFrame operations only.

A source's size is the number of words of its documents. Sources in code point order, null last, take
the weights in turn and share the total size by weight; a target stops at ``most`` times its source's
size and the excess goes to the others by weight, until none is above. A document is taken
floor(target / size) times, and once more if a number drawn from a hash of the seed and its id falls
below the fraction; so a rerun takes the same, and no document is taken more than ``most`` times.

A null text has size 0. A source of size 0 has target 0 and its documents are not taken. Rows that
repeat an id draw alike. Other columns are kept by ``mixed``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huepoint.llm._store import stash

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: str, seed: str) -> Column:
    """In [0, 1): the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums over all rows before it in ``order``, without bringing all rows to one task."""
    spark = df.sparkSession
    dealt = stash(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(*[F.sum(x).alias(f"total_{c}") for c, x in sums.items()])  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(f"total_{c}").over(before), F.lit(0)).alias(f"total_{c}") for c in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(totals), "part").select(*df.columns, *[(F.coalesce(F.sum(x).over(own), F.lit(0)) + F.col(f"total_{c}")).alias(c) for c, x in sums.items()])


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sized(source, size)`` -> source, source_size, target.

    In the order of limit / weight the sources that are full come first: the level is that of the first
    source whose limit is not below what the rest, shared by weight, would give it.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = _running(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    s = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit"))
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    s = stash(_running(s, [F.col("ratio"), F.col("source").asc_nulls_last()], {"spent": F.col("limit"), "shared": F.col("weight")}))
    all_ = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(all_["size"] or 0) - F.col("spent")) / (F.lit(all_["weight"] or 0) - F.col("shared"))
    got = s.select("ratio", "spent", level.alias("level")).filter("ratio >= level").agg(F.min_by("level", F.struct("ratio", "spent")).alias("level")).first()["level"]
    top = F.lit(float("inf") if got is None else got)
    return s.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * top).alias("target"))


def copies(doc_id: str = "doc_id", source_size: str = "source_size", target: str = "target", most: int = MOST, seed: str = SEED) -> Column:
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return F.least(whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0), F.lit(most)).cast("long")


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies of every document."""
    sized = docs.select("doc_id", "source", size_of().alias("size"))
    by_source = targets(sized, weights, most)
    s = by_source.select(F.col("source").alias("_source"), "source_size", "target")
    return sized.join(s, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", copies(most=most, seed=seed).alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken; they travel as one struct, so no column's name can clash."""
    t = targets(docs.select("source", size_of().alias("size")), weights, most)
    rows = docs.select(F.col("source").alias("s"), F.col("doc_id").alias("i"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = rows.join(t, F.col("s").eqNullSafe(F.col("source"))).select("row", copies("i", most=most, seed=seed).alias("n"))
    return taken.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM s
), sums AS (
  SELECT k, 3.0::DOUBLE * source_size / weight AS ratio,
         ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ordered
), level AS (
  SELECT coalesce((SELECT level FROM sums WHERE ratio >= level ORDER BY k LIMIT 1), 1e300) AS level
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * level) AS target FROM s, level
), d AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM d
"""
