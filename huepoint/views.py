"""Point clouds and evaluation rows as views of the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = 128  # points of an object: objects grow in number with the data, not in size
XYZ, RGB = ("x", "y", "z"), ("r", "g", "b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, point_id, x, y, z, r, g, b, part."""
    e = lambda i: F.col("embedding")[i].cast("double")
    colour = lambda i: F.greatest(F.least(0.5 + 2 * e(i), F.lit(1.0)), F.lit(0.0))
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / POINTS).alias("object_id"), F.col("vec_id").alias("point_id"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), colour(3).alias("r"), colour(4).alias("g"), colour(5).alias("b"), (F.col("label") % 4).cast("long").alias("part")
    )


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference points and query points of each object."""
    c = cloud(spark, sf_dir)
    return c.filter("point_id % 2 = 0"), c.filter("point_id % 2 = 1")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj, method, difficulty, metric, other."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        (F.col("l_partkey") % 50).cast("long").alias("obj"), F.col("l_returnflag").alias("method"), F.col("o_orderpriority").alias("difficulty"), (F.col("l_extendedprice").cast("double") / 1000).alias("metric"), F.col("l_quantity").cast("double").alias("other")
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, face_id, v0, v1, v2, quality."""
    l = table(spark, sf_dir, "lineitem")
    v = lambda c, n: (F.col(c) % n).cast("long")
    return l.select((F.col("l_orderkey") % 20).cast("long").alias("object_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("face_id"), v("l_partkey", 7).alias("v0"), v("l_suppkey", 5).alias("v1"), v("l_quantity", 3).alias("v2"), F.col("l_extendedprice").cast("double").alias("quality"))


CLOUD = f"""cloud AS (
  SELECT (vec_id // {POINTS})::BIGINT AS object_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
         greatest(least(0.5 + 2 * embedding[4]::DOUBLE, 1.0), 0.0) AS r, greatest(least(0.5 + 2 * embedding[5]::DOUBLE, 1.0), 0.0) AS g,
         greatest(least(0.5 + 2 * embedding[6]::DOUBLE, 1.0), 0.0) AS b, (label % 4)::BIGINT AS part FROM embeddings
), ref AS (SELECT * FROM cloud WHERE point_id % 2 = 0), qry AS (SELECT * FROM cloud WHERE point_id % 2 = 1)"""

EVAL = """ev AS (
  SELECT (l_partkey % 50)::BIGINT AS obj, l_returnflag AS method, o_orderpriority AS difficulty, l_extendedprice::DOUBLE / 1000 AS metric, l_quantity::DOUBLE AS other
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

FACES = """faces AS (
  SELECT (l_orderkey % 20)::BIGINT AS object_id, (l_orderkey * 10 + l_linenumber)::BIGINT AS face_id, (l_partkey % 7)::BIGINT AS v0, (l_suppkey % 5)::BIGINT AS v1,
         (l_quantity % 3)::BIGINT AS v2, l_extendedprice::DOUBLE AS quality FROM lineitem
)"""


def sql_lab(r: str, g: str, b: str, out: str = "lab", profile: str = "spec7") -> str:
    """Select items that give {out}_l, {out}_a, {out}_b."""
    from huepoint.functions.colour import MATRIX, WHITE

    lin = [f"(CASE WHEN greatest(least({c}, 1.0), 0.0) > 0.04045 THEN power((greatest(least({c}, 1.0), 0.0) + 0.055) / 1.055, 2.4) ELSE greatest(least({c}, 1.0), 0.0) / 12.92 END)" for c in (r, g, b)]
    items = [f"{lin[i]} AS {out}_n{i}" for i in range(3)]
    for i, row in enumerate(MATRIX[profile]):
        t = "(" + " + ".join(f"{out}_n{j} * {v!r}::DOUBLE" for j, v in enumerate(row)) + f") / {WHITE[i]!r}::DOUBLE"
        if profile == "cie4":
            d = 6 / 29
            items.append(f"(CASE WHEN {t} > {d**3!r}::DOUBLE THEN cbrt({t}) ELSE {t} / {3 * d**2!r}::DOUBLE + {4 / 29!r}::DOUBLE END) AS {out}_f{i}")
        else:
            items.append(f"(CASE WHEN {t} > {216 / 24389!r}::DOUBLE THEN cbrt({t}) ELSE ({24389 / 27!r}::DOUBLE * {t} + 16) / 116 END) AS {out}_f{i}")
    return ", ".join([*items, f"116 * {out}_f1 - 16 AS {out}_l", f"500 * ({out}_f0 - {out}_f1) AS {out}_a", f"200 * ({out}_f1 - {out}_f2) AS {out}_b"])


def sql_de00(p: str, q: str, out: str = "de00") -> str:
    """Select items that give {out} of the Lab columns {p}_l ... and {q}_l ..."""
    far = lambda x: f"sqrt(power({x}, 7) / (power({x}, 7) + 6103515625.0::DOUBLE + 1e-30))"
    turn = lambda y, x: f"((degrees(atan2({y}, {x})) % 360) + 360) % 360"
    o = out
    return f"""0.5 * (1 - {far(f"((sqrt({p}_a*{p}_a+{p}_b*{p}_b) + sqrt({q}_a*{q}_a+{q}_b*{q}_b)) / 2)")}) AS {o}_g,
      (1 + {o}_g) * {p}_a AS {o}_p1, (1 + {o}_g) * {q}_a AS {o}_p2, sqrt({o}_p1*{o}_p1 + {p}_b*{p}_b) AS {o}_c1, sqrt({o}_p2*{o}_p2 + {q}_b*{q}_b) AS {o}_c2,
      {turn(f"{p}_b", f"{o}_p1")} AS {o}_h1, {turn(f"{q}_b", f"{o}_p2")} AS {o}_h2,
      CASE WHEN {o}_c1 * {o}_c2 = 0 THEN 0 WHEN {o}_h2 - {o}_h1 > 180 THEN {o}_h2 - {o}_h1 - 360 WHEN {o}_h2 - {o}_h1 < -180 THEN {o}_h2 - {o}_h1 + 360 ELSE {o}_h2 - {o}_h1 END AS {o}_dh,
      CASE WHEN {o}_c1 * {o}_c2 = 0 THEN {o}_h1 + {o}_h2 WHEN abs({o}_h2 - {o}_h1) <= 180 THEN ({o}_h1 + {o}_h2) / 2 WHEN {o}_h1 + {o}_h2 < 360 THEN ({o}_h1 + {o}_h2 + 360) / 2 ELSE ({o}_h1 + {o}_h2 - 360) / 2 END AS {o}_hm,
      ({o}_c1 + {o}_c2) / 2 AS {o}_cm, ({p}_l + {q}_l) / 2 AS {o}_lm,
      1 - 0.17 * cos(radians({o}_hm - 30)) + 0.24 * cos(radians(2 * {o}_hm)) + 0.32 * cos(radians(3 * {o}_hm + 6)) - 0.20 * cos(radians(4 * {o}_hm - 63)) AS {o}_t,
      ({q}_l - {p}_l) / (1 + 0.015 * power({o}_lm - 50, 2) / sqrt(20 + power({o}_lm - 50, 2))) AS {o}_dl,
      ({o}_c2 - {o}_c1) / (1 + 0.045 * {o}_cm) AS {o}_dc,
      2 * sqrt({o}_c1 * {o}_c2) * sin(radians({o}_dh / 2)) / (1 + 0.015 * {o}_cm * {o}_t) AS {o}_dhh,
      -sin(radians(60 * exp(-power(({o}_hm - 275) / 25, 2)))) * 2 * {far(f"{o}_cm")} AS {o}_r,
      sqrt(greatest(0.0, {o}_dl*{o}_dl + {o}_dc*{o}_dc + {o}_dhh*{o}_dhh + {o}_r*{o}_dc*{o}_dhh)) AS {o}"""
