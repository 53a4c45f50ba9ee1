"""Cross-site boilerplate lines by HyperLogLog sketches, in DataFrame operations only.

A line (between newlines, without spaces around it; empty ones don't count) that stands in documents of
at least ``min_sites`` sites is boilerplate and goes from every document. Each line hash gets a sketch
of its sites; partial sketches are merged by aggregation, so a line in a third of all documents costs a
sketch for each task. Where the estimate is within ``margin`` standard errors of the threshold, the
sites of the line are counted exactly; beyond, the sketch decides.

A null site is a site of its own. Null and empty texts have no lines. Rows that repeat an id are judged
each by its text. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huepoint.llm._store import keyed_join, stash

MIN_SITES, LG_K, MARGIN = 10, 12, 4.0


def error_of(lg_k: int) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / (1 << lg_k) ** 0.5


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """``lines(hash, site)`` -> hash, n (rows) of the lines of at least ``min_sites`` sites. Lines of very many rows are joined where they are."""
    wide = margin * error_of(lg_k)
    merged = stash(lines.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.count(F.lit(1)).alias("n")).filter(F.col("sites") >= min_sites * (1 - wide) - 1))
    near = merged.filter(F.col("sites") <= min_sites * (1 + wide) + 1)
    spread = keyed_join(lines, near.select("hash", "n"), ["hash"], "n", lines.count()).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    exact = near.select("hash", "n").join(spread.select("hash"), "hash")
    return stash(merged.filter(F.col("sites") > min_sites * (1 + wide) + 1).select("hash", "n").unionByName(exact))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text."""
    key = F.xxhash64("doc_id", "text").alias("key")
    base = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("site"))
    exploded = base.select(key, "site", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")
    lines = stash(exploded.select("key", "site", line_hash(F.col("line")).alias("hash")))
    bad = boilerplate(lines.select("hash", "site"), min_sites, lg_k, margin)
    found = keyed_join(lines.select("key", "hash"), bad, ["hash"], "n", lines.count())
    gone = found.groupBy("key").agg(F.collect_set("hash").alias("gone"))  # as long as one text at most
    out = base.select("doc_id", key, F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")).join(gone, "key", "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("gone", line_hash(x))))
    out = out.select("doc_id", "lines", kept.alias("kept"))
    count = lambda c: F.size(F.filter(c, lambda x: F.trim(x) != "")).cast("long")
    return out.select("doc_id", count("lines").alias("n_lines"), (count("lines") - count("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))


SQL = """
WITH l AS (
  SELECT doc_id, coalesce('s' || source, 'null') AS site, unnest(string_split(text, chr(10))) AS line FROM documents
), bad AS (
  SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10
), badlist AS (SELECT coalesce(list(line), []) AS bad FROM bad
), d AS (
  SELECT doc_id, coalesce(string_split(text, chr(10)), ['']) AS lines, map_from_entries(list_transform(bad, lambda x: (x, 1))) AS bad FROM documents, badlist
), k AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: trim(x) = '' OR NOT map_contains(bad, trim(x))) AS kept FROM d
)
SELECT doc_id, len(list_filter(lines, lambda x: trim(x) <> ''))::BIGINT AS n_lines,
       (len(lines) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
"""
