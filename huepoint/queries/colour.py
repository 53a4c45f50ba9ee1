"""Colour functions over the clouds."""

from pyspark.sql import functions as F

from huepoint.functions import colour as C
from huepoint.functions import maths as M
from huepoint.queries._registry import query, r6, six
from huepoint.views import CLOUD, EVAL, cloud, eval_rows, sql_de00, sql_lab, table

LAB = ("lab_l", "lab_a", "lab_b")
GREY = ("g_r", "g_g", "g_b")
COLOURS = ("#e6194b", "#3cb44b", "#ffe119")


def _lab_query(name: str, profile: str):
    @query(name, f"WITH {CLOUD} SELECT point_id, {r6(*LAB)} FROM (SELECT point_id, {sql_lab('r', 'g', 'b', 'lab', profile)} FROM cloud)")
    def run(spark, sf_dir):
        return six(C.with_lab(cloud(spark, sf_dir), profile=profile).select("point_id", *LAB))


_lab_query("lab_cie4", "cie4")
_lab_query("lab_spec7", "spec7")

_TURNED = f"""WITH {CLOUD}, p AS (SELECT point_id, {sql_lab('r', 'g', 'b', 'p')}, {sql_lab('b', 'r', 'g', 'q')} FROM cloud)"""


def _turned(spark, sf_dir):
    """Each colour and the one with its channels turned."""
    return C.with_lab(C.with_lab(cloud(spark, sf_dir), out=[f"p_{c}" for c in "lab"]), ("b", "r", "g"), [f"q_{c}" for c in "lab"])


@query("delta_e76", _TURNED + f" SELECT point_id, {r6('sqrt(power(p_l - q_l, 2) + power(p_a - q_a, 2) + power(p_b - q_b, 2)) AS de76')} FROM p")
def delta_e76(spark, sf_dir):
    return six(_turned(spark, sf_dir).select("point_id", C.delta_e76([f"p_{c}" for c in "lab"], [f"q_{c}" for c in "lab"]).alias("de76")))


@query("ciede2000", _TURNED + f", d AS (SELECT point_id, {sql_de00('p', 'q')} FROM p) SELECT point_id, {r6('de00')} FROM d")
def ciede2000(spark, sf_dir):
    return six(C.with_ciede2000(_turned(spark, sf_dir), [f"p_{c}" for c in "lab"], [f"q_{c}" for c in "lab"]).select("point_id", "de00"))


@query(
    "chroma_grey_fraction",
    f"""WITH {CLOUD}, s AS (SELECT object_id, greatest(r, g, b) - least(r, g, b) AS c FROM cloud)
    SELECT object_id, {r6('avg(c) AS mean_chroma')}, avg(c) < 0.3 AS grey, {r6('avg(CASE WHEN c < 0.3 THEN 1.0 ELSE 0.0 END) AS grey_points')} FROM s GROUP BY object_id""",
)
def chroma_grey_fraction(spark, sf_dir):
    c = cloud(spark, sf_dir).withColumn("c", C.chroma_spread())
    return six(c.groupBy("object_id").agg(F.avg("c").alias("mean_chroma"), (F.avg("c") < 0.3).alias("grey"), F.avg((F.col("c") < 0.3).cast("double")).alias("grey_points")))


@query("palette_lookup", f"WITH {CLOUD} SELECT point_id, (['{COLOURS[0]}', '{COLOURS[1]}', '{COLOURS[2]}'])[(part % 3) + 1] AS colour FROM cloud")
def palette_lookup(spark, sf_dir):
    return cloud(spark, sf_dir).select("point_id", C.palette("part", COLOURS).alias("colour"))


@query("rgb_string", f"WITH {CLOUD} SELECT point_id, format('rgb({{}},{{}},{{}})', floor(r * 255)::INT, floor(g * 255)::INT, floor(b * 255)::INT) AS css FROM cloud")
def rgb_string(spark, sf_dir):
    return cloud(spark, sf_dir).select("point_id", C.rgb_string().alias("css"))


@query("channel_pack", f"WITH {CLOUD} SELECT point_id, {r6('2 * r - 1 AS signed', 'greatest(least(((2 * r - 1) * 1.5 + 1) / 2, 1.0), 0.0) AS back')} FROM cloud")
def channel_pack(spark, sf_dir):
    c = cloud(spark, sf_dir).withColumn("signed", C.to_signed("r")).withColumn("wide", F.col("signed") * 1.5)
    return six(c.select("point_id", "signed", C.from_signed("wide").alias("back")))


@query("texel_lookup", f"WITH {CLOUD} SELECT point_id, greatest(least(floor((x - floor(x)) * 64), 63), 0)::BIGINT AS tx, greatest(least(floor((1 - (y - floor(y))) * 64), 63), 0)::BIGINT AS ty FROM cloud")
def texel_lookup(spark, sf_dir):
    tx, ty = C.texel("x", "y", 64, 64)
    return six(cloud(spark, sf_dir).select("point_id", tx.alias("tx"), ty.alias("ty")))


@query(
    "timestep_embedding",
    f"""WITH t AS (SELECT DISTINCT l_linenumber::BIGINT AS t FROM lineitem), i AS (SELECT t, unnest(range(0, 4)) AS i FROM t)
    SELECT t, i::BIGINT AS i, {r6('sin(t * exp(-ln(10000) * i / 4)) AS s', 'cos(t * exp(-ln(10000) * i / 4)) AS c')} FROM i""",
)
def timestep_embedding(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("t")).distinct()
    e = t.withColumn("e", M.timestep_embedding("t", 8)).select("t", "e", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return six(e.select("t", "i", F.col("e")[F.col("i")].alias("s"), F.col("e")[F.col("i") + 4].alias("c")))


@query("round_half_even", f"WITH {EVAL} SELECT (other / 4)::DOUBLE AS v, round_even(other / 4, 0) + 0.0 AS even, count(*) AS n FROM ev GROUP BY 1, 2")
def round_half_even(spark, sf_dir):
    return eval_rows(spark, sf_dir).select((F.col("other") / 4).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("v", M.half_even(F.col("v")).alias("even"), "n")


@query(
    "key_hashes",
    "SELECT o_orderkey, (o_orderkey::VARCHAR || '_' || o_orderpriority) AS name, substr(sha256(o_orderkey::VARCHAR || '_' || o_orderpriority), 1, 16) AS hash, lpad(o_orderkey::VARCHAR, 12, '0') AS padded FROM orders",
)
def key_hashes(spark, sf_dir):
    name = F.concat_ws("_", F.col("o_orderkey").cast("string"), "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), M.short_hash(name.cast("binary")).alias("hash"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("padded"))


#: CRC-32 over the bytes of s, by its table, made of the reversed polynomial.
_CRC = """z AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
k AS (SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(hex(s)) // 2), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM t, z)"""


@query("crc32_seed", f"WITH t AS (SELECT o_orderkey, o_orderkey || '_' || o_orderpriority AS s FROM orders), {_CRC} SELECT o_orderkey, crc & 2147483647 AS seed FROM t JOIN k USING (s)")
def crc32_seed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", M.seed_of("o_orderkey", "o_orderpriority").alias("seed"))
