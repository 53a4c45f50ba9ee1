"""Colour science as Column expressions: Lab, colour differences, palettes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB to XYZ (D65) in two roundings, white point, companding constants.
MATRIX = {
    "cie4": ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505)),
    "spec7": ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)),
}
WHITE = (0.95047, 1.0, 1.08883)


def clip01(c: Column) -> Column:
    """0 to 1; null stays null (least and greatest would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def linear(c: Column) -> Column:
    c = clip01(c)
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def _companded(t: Column, profile: str) -> Column:
    if profile == "cie4":
        d = 6 / 29
        return F.when(t > d**3, F.cbrt(t)).otherwise(t / (3 * d**2) + 4 / 29)
    return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)


def with_lab(df: DataFrame, rgb: Sequence[str] = ("r", "g", "b"), out: Sequence[str] = ("lab_l", "lab_a", "lab_b"), profile: str = "spec7") -> DataFrame:
    """Adds Lab columns; staged, so that each power is worked out once. A null channel gives nulls."""
    m = MATRIX[profile]
    lin = [f"__lin{i}_{out[0]}" for i in range(3)]
    f = [f"__f{i}_{out[0]}" for i in range(3)]
    df = df.withColumns({lin[i]: linear(F.col(rgb[i])) for i in range(3)})
    df = df.withColumns({f[i]: _companded((F.col(lin[0]) * m[i][0] + F.col(lin[1]) * m[i][1] + F.col(lin[2]) * m[i][2]) / WHITE[i], profile) for i in range(3)})
    df = df.withColumns({out[0]: 116 * F.col(f[1]) - 16, out[1]: 500 * (F.col(f[0]) - F.col(f[1])), out[2]: 200 * (F.col(f[1]) - F.col(f[2]))})
    return df.drop(*lin, *f)


def delta_e76(a: Sequence[str], b: Sequence[str]) -> Column:
    return F.sqrt(sum((F.pow(F.col(x) - F.col(y), F.lit(2.0)) for x, y in zip(a, b)), F.lit(0.0)))


def with_ciede2000(df: DataFrame, a: Sequence[str], b: Sequence[str], out: str = "de00") -> DataFrame:
    """Adds the CIEDE2000 difference (all weights 1) of two Lab triples, in stages below the JVM's method limit."""
    n = lambda x: f"__{out}_{x}"
    c = lambda x: F.col(n(x))
    (l1, a1, b1), (l2, a2, b2) = ([F.col(x) for x in t] for t in (a, b))
    hyp = lambda x, y: F.sqrt(x * x + y * y)
    far = lambda x: F.sqrt(F.pow(x, F.lit(7.0)) / (F.pow(x, F.lit(7.0)) + 25.0**7 + 1e-30))
    turn = lambda y, x: F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    df = df.withColumn(n("g"), 0.5 * (1 - far((hyp(a1, b1) + hyp(a2, b2)) / 2)))
    df = df.withColumns({n("p1"): (1 + c("g")) * a1, n("p2"): (1 + c("g")) * a2})
    df = df.withColumns({n("c1"): hyp(c("p1"), b1), n("c2"): hyp(c("p2"), b2), n("h1"): turn(b1, c("p1")), n("h2"): turn(b2, c("p2"))})
    grey, diff, both = c("c1") * c("c2") == 0, c("h2") - c("h1"), c("h1") + c("h2")
    df = df.withColumns(
        {
            n("dh"): F.when(grey, 0.0).when(diff > 180, diff - 360).when(diff < -180, diff + 360).otherwise(diff),
            n("hm"): F.when(grey, both).when(F.abs(diff) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2),
            n("cm"): (c("c1") + c("c2")) / 2,
            n("lm"): (l1 + l2) / 2,
        }
    )
    cos = lambda k, d: F.cos(F.radians(k * c("hm") + d))
    df = df.withColumns(
        {
            n("t"): 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63),
            n("l"): (l2 - l1) / (1 + 0.015 * F.pow(c("lm") - 50, F.lit(2.0)) / F.sqrt(20 + F.pow(c("lm") - 50, F.lit(2.0)))),
            n("c"): (c("c2") - c("c1")) / (1 + 0.045 * c("cm")),
            n("r"): -F.sin(F.radians(60 * F.exp(-F.pow((c("hm") - 275) / 25, F.lit(2.0))))) * 2 * far(c("cm")),
        }
    )
    df = df.withColumn(n("h"), 2 * F.sqrt(c("c1") * c("c2")) * F.sin(F.radians(c("dh") / 2)) / (1 + 0.015 * c("cm") * c("t")))
    df = df.withColumn(out, F.sqrt(F.greatest(F.lit(0.0), c("l") * c("l") + c("c") * c("c") + c("h") * c("h") + c("r") * c("c") * c("h"))))
    return df.drop(*[n(x) for x in ("g", "p1", "p2", "c1", "c2", "h1", "h2", "dh", "hm", "cm", "lm", "t", "l", "c", "r", "h")])


def chroma_spread(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def palette(part: str, colours: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in colours]), (F.pmod(F.col(part), F.lit(len(colours))) + 1).cast("int"))


def rgb_string(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.format_string("rgb(%d,%d,%d)", *[(clip01(F.col(c)) * 255).cast("int") for c in (r, g, b)])


def quantised(c: str) -> Column:
    return (clip01(F.col(c)) * 255).cast("int")


def to_signed(c: str) -> Column:
    return 2 * F.col(c) - 1


def from_signed(c: str) -> Column:
    return clip01((F.col(c) + 1) / 2)


def texel(u: str, v: str, width: int | Column, height: int | Column) -> tuple[Column, Column]:
    """Pixel column and row of texture coordinates: wrapped, v upwards."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    x = F.least((F.pmod(F.col(u), F.lit(1.0)) * w).cast("int"), w - 1)
    y = F.least(((1 - F.pmod(F.col(v), F.lit(1.0))) * h).cast("int"), h - 1)
    return F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))


def barycentric(values: Sequence[Column], weights: Sequence[Column]) -> Column:
    return sum((v * w for v, w in zip(values, weights)), F.lit(0.0))
