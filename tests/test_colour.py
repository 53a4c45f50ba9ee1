import numpy as np
import pytest
from pyspark.sql import functions as F

from huepoint.functions import colour as C
from huepoint.functions import maths as M

# Published CIEDE2000 pairs (Lab, Lab, difference).
PAIRS = [
    ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, 2.8361, -74.02), (50, 0, -82.7485), 3.4412),
    ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.5, 0), (50, 0, -2.5), 4.3065),
]


def test_ciede2000_pairs(spark):
    rows = [(*map(float, a), *map(float, b), d) for a, b, d in PAIRS]
    df = spark.createDataFrame(rows, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for a, b in ((("l1", "a1", "b1"), ("l2", "a2", "b2")), (("l2", "a2", "b2"), ("l1", "a1", "b1"))):
        for r in C.with_ciede2000(df, a, b).collect():
            assert r.de00 == pytest.approx(r.want, abs=1e-4)


@pytest.mark.parametrize("profile", ["cie4", "spec7"])
def test_lab_of_known_colours(spark, profile):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, -1.0, 0.0)], "r double, g double, b double")
    got = np.array([tuple(r)[3:] for r in C.with_lab(df, profile=profile).collect()])
    assert got == pytest.approx(np.array([(100, 0, 0), (0, 0, 0), (53.24, 80.09, 67.20), (53.24, 80.09, 67.20)]), abs=0.05)


def test_null_channels_and_strings(spark):
    df = spark.createDataFrame([(None, 0.5, 0.25, 7), (1.0, 0.5, 0.25, -1)], "r double, g double, b double, part long")
    a, b = C.with_lab(df).withColumns({"css": C.rgb_string(), "p": C.palette("part", ["x", "y", "z"])}).collect()
    assert a.lab_l is None and b.css == "rgb(255,127,63)" and (a.p, b.p) == ("y", "z")


def test_maths(spark):
    df = spark.createDataFrame([(2.5, 3, float("nan"))], "v double, t int, n double")
    r = df.select(M.half_even(F.col("v")).alias("e"), M.timestep_embedding("t", 4).alias("emb"), M.one_hot("t", 5).alias("hot"), M.nan_to_null("n").alias("nn"), M.seed_of("t", "v").alias("seed"), M.psnr(F.lit(0.01)).alias("psnr")).first()
    assert r.e == 2.0 and r.hot == [0, 0, 0, 1, 0] and r.nn is None and r.psnr == pytest.approx(20)
    f = np.exp(-np.log(10000) * np.arange(2) / 2) * 3
    assert r.emb == pytest.approx([*np.sin(f), *np.cos(f)])
    import zlib

    assert r.seed == zlib.crc32(b"3_2.5") & 0x7FFFFFFF
