"""Folders of clouds, runs and metadata, as tables: what is there, what belongs together, and what can't be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huepoint.sources import arrays, ply
from huepoint.sources.registry import large_enough

XYZ = ("x", "y", "z")


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path and length of the files below; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", "length")


def with_missing(whole: DataFrame, partial: DataFrame, key: Sequence[str] = ("object_id",)) -> DataFrame:
    """``whole`` with ``is_missing``: whether its place is none of the partial cloud's, by equal 32-bit coordinates.

    A partial cloud is a subset of the whole one, so no search in space is needed. Objects without a partial cloud
    are left out.
    """
    place = [F.col(c).cast("float").alias(f"__{c}") for c in XYZ]
    seen = partial.select(*key, *place).distinct().withColumn("__seen", F.lit(True))
    both = partial.select(*key).distinct()
    own = whole.join(both, list(key), "left_semi").withColumns({f"__{c}": F.col(c).cast("float") for c in XYZ})
    return own.join(seen, [*key, *[f"__{c}" for c in XYZ]], "left").select(*[F.col(c) for c in whole.columns], F.col("__seen").isNull().alias("is_missing"))


def whole_and_partial(spark: SparkSession, whole: str, partial: str, least: int = 32, limit: int | None = None) -> DataFrame:
    """Clouds of ``whole`` (npz files) with ``is_missing`` from the files of the same name below ``partial`` (PLY).

    Objects with fewer than ``least`` missing or visible points are left out; ``limit``: the first so many whole files by name.
    """
    files = ply.files(spark, whole, "*.npz")
    if limit is not None:
        first = listed(spark, whole, "*.npz").select("path").orderBy("path").limit(limit)
        files = files.join(F.broadcast(first), "path", "left_semi")  # ``limit`` names
    good = lambda decoded: decoded.filter("error is null").drop("error")
    marked = with_missing(good(ply.decoded(files, arrays.npz_points)), good(ply.read(spark, partial)))
    counts = marked.groupBy("object_id").agg(F.sum(F.col("is_missing").cast("long")).alias("m"), F.count(F.lit(1)).alias("n")).filter((F.col("m") >= least) & (F.col("n") - F.col("m") >= least))
    return marked.join(counts.select("object_id"), "object_id")


def of_category(spark: SparkSession, root: str, category: str, least: int = 512, limit: int | None = None) -> DataFrame:
    """Coloured clouds (PLY) in folders whose name holds the category, in any case; the first ``limit`` files by path.

    Files without colours, of fewer than ``least`` points or that can't be read are left out.
    """
    inside = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda d: F.contains(F.lower(d), F.lit(category.lower())))
    below = F.replace("path", F.lit(root.rstrip("/").split("://")[-1].removeprefix("file:")), F.lit(""))
    names = listed(spark, root, "*.ply").withColumn("full", F.col("path")).withColumn("path", below).filter(inside).select(F.col("full").alias("path"))
    if limit is not None:
        names = names.orderBy("path").limit(limit)
    files = ply.files(spark, root, "*.ply").join(names, "path", "left_semi")
    read = ply.decoded(files, lambda data: ply.points(data, missing=None)).filter("error is null").drop("error")
    return large_enough(read, least)


SHARD = "model_id string, hierarchyList array<struct<name: string>>"


def metadata_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, model_id, kind, path) of the JSON files below, kind being their folder; and (path, error) of those that can't be read.

    A file that is cut short, isn't an object or names no root is kept apart with what is wrong; the others are read.
    """
    raw = spark.read.schema(f"{SHARD}, broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = raw.select("model_id", F.try_element_at("hierarchyList", F.lit(1))["name"].alias("name"), "broken", F.col("_metadata.file_path").alias("path"))
    error = F.when(F.col("broken").isNotNull(), "not JSON").when(F.col("model_id").isNull(), "no model_id").when(F.coalesce("name", F.lit("")) == "", "no root")
    told = rows.withColumn("error", error)
    good = told.filter("error is null").select("name", "model_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("kind"), "path")
    return good, told.filter("error is not null").select("path", "error")


def runs(spark: SparkSession, folders: Sequence[str], manifest: str = "run_manifest.json", table: str = "tables/eval_raw.csv") -> DataFrame:
    """system, folder, manifest, table: of the folders that hold both files, the first of each system.

    Folders come in the order given, then by name. A manifest that isn't JSON or names no system is no run.
    """
    found = None
    for i, folder in enumerate(folders):
        m = spark.read.format("binaryFile").option("pathGlobFilter", manifest).option("recursiveFileLookup", True).load(folder)
        m = m.select(F.lit(i).alias("at"), F.col("path").alias("manifest"), F.expr(f"substring(path, 1, length(path) - {len(manifest) + 1})").alias("folder"), F.get_json_object(F.decode("content", "utf-8"), "$.system").alias("system"))
        name = table.rsplit("/", 1)[-1]
        t = listed(spark, folder, name).filter(F.col("path").endswith(f"/{table}")).select(F.col("path").alias("table"), F.expr(f"substring(path, 1, length(path) - {len(table) + 1})").alias("folder"))
        both = m.join(t, "folder").filter("system is not null")
        found = both if found is None else found.unionByName(both)
    first = F.row_number().over(Window.partitionBy("system").orderBy("at", "folder"))
    return found.withColumn("__n", first).filter("__n = 1").select("system", "folder", "manifest", "table")
