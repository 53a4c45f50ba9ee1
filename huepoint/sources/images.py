"""Images as tables of texels, by Spark's image reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXELS = "texture string, width int, height int, column int, row int, r double, g double, b double"


def texels(images: DataFrame) -> DataFrame:
    """``images(image)`` as the reader gives them -> TEXELS: a row for each pixel, row 0 on top; grey images have three equal channels.

    texture is the file's name. Images that can't be decoded have no rows.
    """
    i = images.select(F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("texture"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data").filter("height > 0 and channels > 0")
    p = i.withColumn("at", F.explode(F.expr("sequence(0, width * height - 1)")))
    channel = lambda k: (F.conv(F.hex(F.expr(f"substring(data, at * channels + least({k}, channels - 1) + 1, 1)")), 16, 10).cast("double") / 255)
    # bytes are blue, green, red
    return p.select("texture", "width", "height", F.expr("cast(at % width as int)").alias("column"), F.expr("cast(at div width as int)").alias("row"), channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def read_texels(spark: SparkSession, path: str) -> DataFrame:
    """All images below the path; files that aren't images are left out."""
    return texels(spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path))
