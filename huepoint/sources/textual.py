"""Text formats: point lists with labels, paired label files, OBJ faces and textures, result logs, manifests, hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huepoint.functions.maths import stem_of

RESULT = "dataset string, category string, difficulty string, model string, has_parts boolean, chamfer_in double, chamfer_out double"


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """object_id, line_no, value; a file is one row of the reader, so that line numbers are those of the file."""
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    lines = text.select(stem_of(F.input_file_name()).alias("object_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return lines.filter(F.trim("value") != "")


def _number(words: str, i: int, kind: str = "double") -> Column:
    return F.try_element_at(F.col(words), F.lit(i)).cast(kind)


def part_points(lines: DataFrame) -> DataFrame:
    """``lines(object_id, line_no, value)`` of x y z [nx ny nz [label]] -> object_id, point_id, x, y, z, part (0 without label)."""
    w = lines.select("object_id", F.col("line_no").cast("long").alias("point_id"), F.split(F.trim("value"), "\\s+").alias("w")).filter(F.size("w") >= 3)
    return w.select("object_id", "point_id", *[_number("w", i + 1).alias(c) for i, c in enumerate("xyz")], F.coalesce(F.when(F.size("w") >= 7, _number("w", 7).cast("long")), F.lit(0).cast("long")).alias("part"))


def read_part_points(spark: SparkSession, path: str) -> DataFrame:
    return part_points(_lines(spark, path, "*.txt"))


def read_point_label_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``name.pts`` with ``name.seg``: points with the label of the same line; files without a partner are left out."""
    p = part_points(_lines(spark, path, "*.pts")).drop("part")
    s = _lines(spark, path, "*.seg").select("object_id", F.col("line_no").cast("long").alias("point_id"), F.trim("value").cast("long").alias("part"))
    return p.join(s, ["object_id", "point_id"])


def merged_labels(points: DataFrame, masks: Sequence[tuple[str, DataFrame]], none: str = "none") -> DataFrame:
    """Binary label files ``(object_id, point_id, on)`` by name: the last name that is on wins."""
    out = points
    for i, (name, m) in enumerate(masks):
        out = out.join(m.select("object_id", "point_id", F.when(F.col("on") == 1, i).alias(f"__l{i}")), ["object_id", "point_id"], "left")
    last = F.greatest(F.lit(-1), *[F.coalesce(f"__l{i}", F.lit(-1)) for i in range(len(masks))])
    names = F.array(F.lit(none), *[F.lit(n) for n, _ in masks])
    return out.withColumn("label", F.element_at(names, last + 2)).drop(*[f"__l{i}" for i in range(len(masks))])


def obj_faces(lines: DataFrame) -> DataFrame:
    """``lines(object_id, line_no, value)`` of an OBJ file -> object_id, face_id (by order), v0, v1, v2 from zero."""
    f = lines.filter(F.col("value").startswith("f ")).withColumn("w", F.split(F.trim("value"), "\\s+"))
    v = lambda i: (F.split_part(F.element_at("w", i + 2), F.lit("/"), F.lit(1)).cast("long") - 1).alias(f"v{i}")
    return f.select("object_id", (F.row_number().over(Window.partitionBy("object_id").orderBy("line_no")) - 1).cast("long").alias("face_id"), v(0), v(1), v(2))


def read_obj_faces(spark: SparkSession, path: str) -> DataFrame:
    return obj_faces(_lines(spark, path, "*.obj"))


def textures(obj: DataFrame, mtl: DataFrame) -> DataFrame:
    """object_id, library, texture: of OBJ files' material libraries (``lines`` of both; a library's object_id is its name)."""
    lib = obj.select("object_id", F.regexp_extract("value", r"^mtllib\s+(?:.*/)?([^/\s]+)\.mtl\s*$", 1).alias("library")).filter("library <> ''")
    tex = mtl.select(F.col("object_id").alias("library"), F.regexp_extract("value", r"^\s*map_Kd\s+(\S.*?)\s*$", 1).alias("texture")).filter("texture <> ''")
    return lib.join(tex, "library", "left").select("object_id", "library", "texture")


def with_and_without_labels(points: DataFrame, masks: Sequence[tuple[str, DataFrame]], least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Objects that have every label's file, and the others, which can only be tested on; objects of fewer than ``least`` points are neither.

    An object has a label's file if ``masks`` of that name has rows of it.
    """
    n = points.groupBy("object_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    has = None
    for name, m in masks:
        one = m.select("object_id").distinct().withColumn("__label", F.lit(name))
        has = one if has is None else has.unionByName(one)
    full = has.groupBy("object_id").agg(F.count_distinct("__label").alias("__labels")).filter(F.col("__labels") == len(masks)).select("object_id")
    large = points.join(n.select("object_id"), "object_id", "left_semi")
    return large.join(full, "object_id", "left_semi"), large.join(full, "object_id", "left_anti")


def _last(column: Column) -> Column:
    """The last value so far in the file."""
    return F.last(column, True).over(Window.partitionBy("object_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))


def obj_corners(lines: DataFrame) -> DataFrame:
    """``lines(object_id, line_no, value)`` of OBJ files -> object_id, face_id, material, ax .. cz, au .. cv: triangles with their corners.

    Polygons are cut into fans; indices from the end (negative) count as OBJ says; corners without texture
    coordinates have null ones, faces before any ``usemtl`` a null material.
    """
    w = lines.select("object_id", "line_no", F.split(F.trim("value"), "\\s+").alias("w")).withColumn("kind", F.element_at("w", 1))
    order = Window.partitionBy("object_id", "kind").orderBy("line_no")
    numbered = lambda kind: w.filter(F.col("kind") == kind).select("object_id", "line_no", "w", F.row_number().over(order).cast("long").alias("i"))
    v = numbered("v").select("object_id", "i", *[_number("w", k + 2).alias(c) for k, c in enumerate("xyz")])
    vt = numbered("vt").select("object_id", "i", *[_number("w", k + 2).alias(c) for k, c in enumerate("uv")])
    so_far = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).over(Window.partitionBy("object_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    f = w.withColumns({"material": _last(F.when(F.col("kind") == "usemtl", F.element_at("w", 2))), "n_v": so_far("v"), "n_vt": so_far("vt")}).filter("kind = 'f' and size(w) >= 4")
    fan = f.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 3)))
    fan = fan.withColumn("face_id", (F.row_number().over(Window.partitionBy("object_id").orderBy("line_no", "k")) - 1).cast("long"))
    index = lambda corner, part, n: F.when((i := F.nullif(F.split_part(corner, F.lit("/"), F.lit(part)), F.lit("")).cast("long")) < 0, F.col(n) + i + 1).otherwise(i)
    corners = {"a": F.lit(2), "b": F.col("k") + 2, "c": F.col("k") + 3}
    out = fan.select("object_id", "face_id", "material", *[x for c, at in corners.items() for x in (index(F.element_at("w", at), 1, "n_v").alias(f"{c}_v"), index(F.element_at("w", at), 2, "n_vt").alias(f"{c}_vt"))])
    for c in corners:
        out = out.join(v.select("object_id", F.col("i").alias(f"{c}_v"), *[F.col(x).alias(f"{c}{x}") for x in "xyz"]), ["object_id", f"{c}_v"])
        out = out.join(vt.select("object_id", F.col("i").alias(f"{c}_vt"), *[F.col(x).alias(f"{c}{x}") for x in "uv"]), ["object_id", f"{c}_vt"], "left")
    return out.select("object_id", "face_id", "material", *[f"{c}{x}" for c in corners for x in "xyz"], *[f"{c}{x}" for c in corners for x in "uv"])


def material_textures(obj: DataFrame, mtl: DataFrame) -> DataFrame:
    """object_id, material, texture (its file's name): from the libraries that OBJ files name (``lines`` of both)."""
    lib = obj.select("object_id", F.regexp_extract("value", r"^mtllib\s+(?:.*/)?([^/\s]+)\.mtl\s*$", 1).alias("library")).filter("library <> ''").distinct()
    rows = mtl.withColumn("material", _last(F.nullif(F.regexp_extract("value", r"^\s*newmtl\s+(\S+)", 1), F.lit(""))))
    tex = rows.select(F.col("object_id").alias("library"), "material", F.regexp_extract("value", r"^\s*map_Kd\s+(?:\S.*[/\\])?([^/\\]+?)\s*$", 1).alias("texture")).filter("texture <> ''")
    return lib.join(tex, "library").select("object_id", "material", "texture")


def read_textured_meshes(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of all OBJ files below the path, as ``obj_corners``, with the texture of their material (null without one)."""
    obj = _lines(spark, path, "*.obj")
    return obj_corners(obj).join(material_textures(obj, _lines(spark, path, "*.mtl")), ["object_id", "material"], "left")


def read_results(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """JSON lines; malformed ones are dropped. tag: what the file's name says after ``results``, else ``base``."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    tag = F.regexp_extract(F.input_file_name(), r"results_?([^/]*)\.jsonl", 1)
    return rows.withColumn("tag", F.when(tag == "", "base").otherwise(tag))


def json_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The text's fields as columns; nulls where it isn't JSON."""
    return df.withColumn("__j", F.from_json(column, schema)).select("*", "__j.*").drop("__j")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """{category: {directory, labels, colours}} -> a row for each category."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<directory: string, lables: array<string>, colors: array<string>>>").alias("m"))
    return raw.select(F.explode("m").alias("category", "v")).select("category", "v.directory", F.col("v.lables").alias("labels"), F.col("v.colors").alias("colours"))


def hierarchy(df: DataFrame, column: str = "tree") -> DataFrame:
    """``df(model_id, tree)``: JSON nodes {name, maskId, children} -> model_id, path, name, mask_id, depth.

    Levels are opened one after another until none is left, as many rounds as the deepest tree is deep.
    """
    node = "struct<name: string, maskId: int, children: array<string>>"
    level = df.select("model_id", F.lit("").alias("path"), F.explode(F.from_json(column, "array<string>")).alias("raw"), F.lit(0).alias("depth"))
    out = None
    while True:
        parsed = level.withColumn("n", F.from_json("raw", node)).withColumn("path", F.concat_ws("/", F.nullif("path", F.lit("")), "n.name"))
        rows = parsed.select("model_id", "path", F.col("n.name").alias("name"), F.col("n.maskId").alias("mask_id"), "depth")
        out = rows if out is None else out.unionByName(rows)
        level = parsed.select("model_id", "path", F.explode("n.children").alias("raw"), (F.col("depth") + 1).alias("depth"))
        if level.isEmpty():
            return out


def face_parts(masks: DataFrame, parts: DataFrame, other: str = "other", order: Sequence[str] = ("depth", "mask_id")) -> DataFrame:
    """``masks(model_id, mask_id, faces array)`` and ``parts(model_id, mask_id, name, depth)`` -> model_id, face, part: the deepest mask's part.

    ``order`` names other columns of either whose highest values win: a mask's position gives the last one written.
    A mask without a part counts as ``other`` where its order has no null.
    """
    f = masks.select("model_id", "mask_id", *[c for c in order if c in masks.columns and c != "mask_id"], F.explode("faces").alias("face"))
    j = f.join(parts, ["model_id", "mask_id"], "left").groupBy("model_id", "face").agg(F.max_by("name", F.struct(*order)).alias("part"))
    return j.select("model_id", "face", F.coalesce("part", F.lit(other)).alias("part"))


def class_names(prompts: DataFrame, pattern: str, fallback: dict[str, int] | None = None) -> DataFrame:
    """``prompts(key, prompt)``: name captured by the pattern, id from the key's hexadecimal beginning -> name, class_id (most frequent)."""
    rows = prompts.select(F.regexp_extract("prompt", pattern, 1).alias("name"), F.conv(F.substring_index("key", "_", 1), 16, 10).cast("long").alias("class_id")).filter("name <> ''")
    out = rows.groupBy("name").agg(F.mode("class_id", True).alias("class_id"))
    if fallback:
        extra = prompts.sparkSession.createDataFrame(list(fallback.items()), "name string, class_id long")
        out = out.unionByName(extra.join(out, "name", "left_anti"))
    return out


def model_index(metadata: DataFrame) -> DataFrame:
    """``(name, model_id, kind, path)`` of metadata shards -> name, models (sorted)."""
    return metadata.filter("name is not null").groupBy("name").agg(F.array_sort(F.collect_set(F.struct("model_id", "kind", "path"))).alias("models"))


def partial_pairs(files: DataFrame) -> DataFrame:
    """``files(object_id, ...)``: partial clouds with their ``_missing`` ones -> object_id, partials, missings, whole."""
    is_missing = F.col("object_id").endswith("_missing")
    base = F.regexp_replace("object_id", "_missing$", "")
    g = files.groupBy(base.alias("object_id")).agg(F.sum((~is_missing).cast("long")).alias("partials"), F.sum(is_missing.cast("long")).alias("missings"))
    return g.withColumn("whole", (F.col("partials") == 1) & (F.col("missings") == 1))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, read with the schema that it must have; no pass to guess types, bad cells are null."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="PERMISSIVE")
