"""Completion and colour metrics. The prediction is each object's even points, the reference its odd ones; or the same points with turned channels."""

from pyspark.sql import functions as F

from huepoint.operators import geometry as G
from huepoint.operators import metrics as M
from huepoint.operators import sampling
from huepoint.plans import completion
from huepoint.queries._registry import query, r6, six
from huepoint.queries.geometry import _SURFACE, UNIT, VIEW, crop_sql, triangles
from huepoint.queries.joins import knn_sql
from huepoint.queries.windows import fps_sql
from huepoint.views import CLOUD, cloud, split, sql_de00, sql_lab

RGB, LAB = ("r", "g", "b"), ("l", "a", "b")
DIRECTIONS = ((1.0, 0.0, 0.0), (0.6, 0.8, 0.0), (0.0, 0.6, -0.8), (0.48, -0.6, 0.64))

BOTH = f"""{CLOUD}, {knn_sql('pe', 'ref', 'qry', 1)}, {knn_sql('te', 'qry', 'ref', 1)},
lab AS (SELECT object_id, point_id, part, r, g, b, {sql_lab('r', 'g', 'b')} FROM cloud)"""


def matched_sql(edges: str) -> str:
    return f"""SELECT object_id, q_id, d, de00 FROM (SELECT *, {sql_de00('p', 't')} FROM (SELECT e.object_id, q_id, sqrt(d2) AS d, {', '.join(f'q.lab_{c} AS p_{c}, n.lab_{c} AS t_{c}' for c in LAB)}
  FROM {edges} e JOIN lab q ON e.object_id = q.object_id AND q_id = q.point_id JOIN lab n ON e.object_id = n.object_id AND n_id = n.point_id))"""


def _completion(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return M.completion(ref, qry, tau=0.1, match=0.12)


@query("chamfer_l1", f"WITH {CLOUD}, {knn_sql('pe', 'ref', 'qry', 1)}, {knn_sql('te', 'qry', 'ref', 1)} SELECT object_id, {r6('a + b AS cd_l1')} FROM (SELECT object_id, avg(sqrt(d2)) AS a FROM pe GROUP BY 1) JOIN (SELECT object_id, avg(sqrt(d2)) AS b FROM te GROUP BY 1) USING (object_id)")
def chamfer_l1(spark, sf_dir):
    return six(G.chamfer(*split(spark, sf_dir)).withColumnRenamed("chamfer", "cd_l1"))


@query("chamfer_l2", f"WITH {CLOUD}, {knn_sql('pe', 'ref', 'qry', 1)}, {knn_sql('te', 'qry', 'ref', 1)} SELECT object_id, {r6('a + b AS cd_l2')} FROM (SELECT object_id, avg(d2) AS a FROM pe GROUP BY 1) JOIN (SELECT object_id, avg(d2) AS b FROM te GROUP BY 1) USING (object_id)")
def chamfer_l2(spark, sf_dir):
    return six(G.chamfer(*split(spark, sf_dir), square=True).withColumnRenamed("chamfer", "cd_l2"))


@query("fscore", f"WITH {CLOUD}, {knn_sql('pe', 'ref', 'qry', 1)}, {knn_sql('te', 'qry', 'ref', 1)}, p AS (SELECT object_id, avg(CASE WHEN sqrt(d2) < 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM pe GROUP BY 1), t AS (SELECT object_id, avg(CASE WHEN sqrt(d2) < 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS t FROM te GROUP BY 1) SELECT object_id, {r6('CASE WHEN p + t > 0 THEN 2 * p * t / (p + t) ELSE 0 END AS fscore')} FROM p JOIN t USING (object_id)")
def fscore(spark, sf_dir):
    return six(_completion(spark, sf_dir).select("object_id", "fscore"))


@query("de00_sym", f"WITH {BOTH}, mp AS ({matched_sql('pe')}), mt AS ({matched_sql('te')}), p AS (SELECT object_id, avg(de00) AS p FROM mp GROUP BY 1), t AS (SELECT object_id, avg(de00) AS t FROM mt GROUP BY 1) SELECT object_id, {r6('p AS de00_pred2ref', 't AS de00_ref2pred', '(p + t) / 2 AS de00_sym')} FROM p JOIN t USING (object_id)")
def de00_sym(spark, sf_dir):
    return six(_completion(spark, sf_dir).select("object_id", "de00_pred2ref", "de00_ref2pred", "de00_sym"))


@query("de00_matched", f"WITH {BOTH}, mt AS ({matched_sql('te')}) SELECT object_id, {r6('avg(CASE WHEN d < 0.12 THEN 1.0::DOUBLE ELSE 0 END) AS match_rate', 'CASE WHEN count(*) FILTER (d < 0.12) >= 8 THEN avg(de00) FILTER (d < 0.12) END AS de00_matched')} FROM mt GROUP BY 1")
def de00_matched(spark, sf_dir):
    return six(_completion(spark, sf_dir).select("object_id", "match_rate", "de00_matched"))


_DIRS = ", ".join(f"({i}, {', '.join(f'{v!r}::DOUBLE' for v in d)})" for i, d in enumerate(DIRECTIONS))


def swd_sql(a: str, b: str, keys: str = "object_id") -> str:
    side = lambda t, s: f"{s} AS (SELECT {keys}, dir, r * d0 + g * d1 + b * d2 AS v, row_number() OVER (PARTITION BY {keys}, dir ORDER BY r * d0 + g * d1 + b * d2, point_id) - 1 AS k, count(*) OVER (PARTITION BY {keys}, dir) AS n FROM {t}, dirs)"
    rank = lambda n: f"round_even(CASE WHEN n > 1 THEN i * ({n} - 1) / (n - 1) ELSE 0 END, 0)::BIGINT"
    return f"""dirs(dir, d0, d1, d2) AS (VALUES {_DIRS}), {side(a, 'sa')}, {side(b, 'sb')},
n AS (SELECT {keys}, dir, a.n AS na, b.n AS nb, least(a.n, b.n) AS n FROM (SELECT DISTINCT {keys}, dir, n FROM sa) a JOIN (SELECT DISTINCT {keys}, dir, n FROM sb) b USING ({keys}, dir)),
i AS (SELECT *, unnest(range(0, n)) AS i FROM n), s AS (SELECT {keys}, dir, {rank('na')} AS ra, {rank('nb')} AS rb FROM i),
x AS (SELECT {keys}, dir, k AS ra, v AS va FROM sa), y AS (SELECT {keys}, dir, k AS rb, v AS vb FROM sb)
SELECT {keys}, {r6('avg(abs(va - vb)) AS swd')} FROM s JOIN x USING ({keys}, dir, ra) JOIN y USING ({keys}, dir, rb) GROUP BY {keys}"""


@query("colour_swd", f"WITH {CLOUD}, few AS (SELECT * FROM qry WHERE part <> 1), {swd_sql('ref', 'few')}")
def colour_swd(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(M.sliced_wasserstein(ref, qry.filter("part <> 1"), DIRECTIONS))


@query("part_swd", f"WITH {CLOUD}, {swd_sql('ref', 'qry', 'object_id, part')}")
def part_swd(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(M.sliced_wasserstein(ref, qry, DIRECTIONS, key=("object_id", "part")))


SEEDS = "sd AS (SELECT * FROM cloud WHERE point_id % 16 = 0)"


def seeds(spark, sf_dir):
    return cloud(spark, sf_dir).filter("point_id % 16 = 0")


@query(
    "region_de",
    f"""WITH {CLOUD}, {SEEDS}, {knn_sql('ce', 'cloud', 'sd', 1)}, lab AS (SELECT object_id, point_id, {sql_lab('r', 'g', 'b')} FROM cloud),
    m AS (SELECT object_id, n_id AS cell, q_id % 2 AS odd, avg(lab_l) AS l, avg(lab_a) AS a, avg(lab_b) AS b FROM ce JOIN lab USING (object_id) WHERE lab.point_id = q_id GROUP BY 1, 2, 3),
    j AS (SELECT p.object_id, {', '.join(f'p.{c} AS p_{c}, t.{c} AS t_{c}' for c in LAB)} FROM m p JOIN m t ON p.object_id = t.object_id AND p.cell = t.cell AND p.odd = 0 AND t.odd = 1), d AS (SELECT *, {sql_de00('p', 't')} FROM j)
    SELECT object_id, count(*) AS cells, {r6('CASE WHEN count(*) >= 4 THEN avg(de00) END AS region_de')} FROM d GROUP BY 1""",
)
def region_de(spark, sf_dir):
    return six(M.region_difference(*split(spark, sf_dir), seeds(spark, sf_dir)))


def turned(spark, sf_dir):
    """The cloud with its channels turned: same places, other colours."""
    c = cloud(spark, sf_dir)
    return c.withColumns({"r": F.col("b"), "g": F.col("r"), "b": F.col("g")})


@query(
    "region_de_weighted",
    f"""WITH {CLOUD}, {SEEDS}, {knn_sql('ce', 'cloud', 'sd', 1)}, m AS (SELECT c.object_id, n_id AS cell, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM ce JOIN cloud c ON ce.object_id = c.object_id AND q_id = point_id GROUP BY 1, 2),
    l AS (SELECT object_id, n, {sql_lab('r', 'g', 'b', 't')}, {sql_lab('b', 'r', 'g', 'p')} FROM m)
    SELECT object_id, {r6('sum(n * sqrt(power(p_l - t_l, 2) + power(p_a - t_a, 2) + power(p_b - t_b, 2))) / sum(n) AS region_de76')} FROM l GROUP BY 1""",
)
def region_de_weighted(spark, sf_dir):
    return six(M.region_difference_weighted(turned(spark, sf_dir), cloud(spark, sf_dir), seeds(spark, sf_dir)))


def graph_sql(name: str, k: int, rgb: str = "r, g, b") -> str:
    r, g, b = rgb.split(", ")
    return f"""{name}_l AS (SELECT object_id, point_id, part, {r} AS r, {g} AS g, {b} AS b, {sql_lab(r, g, b)} FROM cloud), {knn_sql(name + '_e', 'cloud', 'cloud', k, False)},
{name}_j AS (SELECT e.object_id, q_id, q.part = n.part AS same, sqrt(power(q.r - n.r, 2) + power(q.g - n.g, 2) + power(q.b - n.b, 2)) AS d_rgb, {', '.join(f'q.lab_{c} AS p_{c}, n.lab_{c} AS t_{c}' for c in LAB)}
  FROM {name}_e e JOIN {name}_l q ON e.object_id = q.object_id AND q_id = q.point_id JOIN {name}_l n ON e.object_id = n.object_id AND n_id = n.point_id),
{name} AS (SELECT object_id, q_id, same, d_rgb, de00 FROM (SELECT *, {sql_de00('p', 't')} FROM {name}_j)),
{name}_v AS (SELECT object_id, q_id, bool_or(NOT same) AS boundary, max(d_rgb) AS strength, max(de00) AS contrast, avg(d_rgb) AS rough FROM {name} GROUP BY 1, 2)"""


@query(
    "edge_iou",
    f"""WITH {CLOUD}, {graph_sql('x', 8)}, {graph_sql('y', 8, 'b, r, g')}, t AS (SELECT object_id, q_id, x.contrast >= quantile_cont(x.contrast, 0.9) OVER w AS t, y.contrast >= quantile_cont(y.contrast, 0.9) OVER w AS p FROM x_v x JOIN y_v y USING (object_id, q_id) WINDOW w AS (PARTITION BY object_id))
    SELECT object_id, {r6('count(*) FILTER (p AND t) / nullif(count(*) FILTER (p OR t), 0) AS edge_iou')} FROM t GROUP BY 1""",
)
def edge_iou(spark, sf_dir):
    return six(M.edge_iou(turned(spark, sf_dir), cloud(spark, sf_dir)))


@query(
    "edge_iou_shared",
    f"""WITH {CLOUD}, {graph_sql('x', 8)}, {graph_sql('y', 8, 'r, g, 0.5 * b')}, t AS (SELECT object_id, q_id, x.strength > greatest(quantile_cont(x.strength, 0.9) OVER w, 1e-6) AS t, y.strength > greatest(quantile_cont(x.strength, 0.9) OVER w, 1e-6) AS p FROM x_v x JOIN y_v y USING (object_id, q_id) WINDOW w AS (PARTITION BY object_id))
    SELECT object_id, {r6('count(*) FILTER (p AND t) / nullif(count(*) FILTER (p OR t), 0) AS edge_iou')} FROM t GROUP BY 1""",
)
def edge_iou_shared(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return six(M.edge_iou(c.withColumn("b", 0.5 * F.col("b")), c, shared=True))


@query("local_roughness", f"WITH {CLOUD}, {graph_sql('x', 6)} SELECT object_id, {r6('avg(rough) AS roughness')} FROM x_v GROUP BY 1")
def local_roughness(spark, sf_dir):
    return six(M.vertices(M.graph(cloud(spark, sf_dir), 6)).groupBy("object_id").agg(F.avg("rough").alias("roughness")))


@query("local_consistency", f"WITH {CLOUD}, {graph_sql('x', 6)}, {graph_sql('y', 6, 'r, g, 0.5 * b')}, a AS (SELECT object_id, avg(rough) AS t FROM x_v GROUP BY 1), b AS (SELECT object_id, avg(rough) AS p FROM y_v GROUP BY 1) SELECT object_id, {r6('abs(p - t) AS absdiff', 'CASE WHEN t > 1e-6 THEN p / t END AS ratio')} FROM a JOIN b USING (object_id)")
def local_consistency(spark, sf_dir):
    c = cloud(spark, sf_dir)
    rough = lambda df, n: M.vertices(M.graph(df, 6)).groupBy("object_id").agg(F.avg("rough").alias(n))
    j = rough(c.withColumn("b", 0.5 * F.col("b")), "p").join(rough(c, "t"), "object_id")
    return six(j.select("object_id", F.abs(F.col("p") - F.col("t")).alias("absdiff"), F.when(F.col("t") > 1e-6, F.col("p") / F.col("t")).alias("ratio")))


_BINS = lambda rgb: ", ".join(f"least(floor({c} * 8), 7)::BIGINT AS h{i}" for i, c in enumerate(rgb))


@query("hist_chi2", f"WITH {CLOUD}, p AS (SELECT object_id, {_BINS('brg')}, count(*) AS n FROM cloud GROUP BY ALL), t AS (SELECT object_id, {_BINS('rgb')}, count(*) AS n FROM cloud GROUP BY ALL), ps AS (SELECT *, n / sum(n) OVER (PARTITION BY object_id) AS s FROM p), ts AS (SELECT *, n / sum(n) OVER (PARTITION BY object_id) AS s FROM t), j AS (SELECT object_id, coalesce(ps.s, 0) AS p, coalesce(ts.s, 0) AS t FROM ps FULL JOIN ts USING (object_id, h0, h1, h2)) SELECT object_id, {r6('0.5 * sum(power(p - t, 2) / (p + t + 1e-12)) AS chi2')} FROM j GROUP BY 1")
def hist_chi2(spark, sf_dir):
    return six(M.histogram_chi2(turned(spark, sf_dir), cloud(spark, sf_dir)))


_POINT = f"""{CLOUD}, pl AS (SELECT object_id, point_id, part, r, g, b, {sql_lab('r', 'g', 'b', 't')}, {sql_lab('b', 'r', 'g', 'p')} FROM cloud), pd AS (SELECT *, {sql_de00('t', 'p')}, sqrt(power(p_l - t_l, 2) + power(p_a - t_a, 2) + power(p_b - t_b, 2)) AS de76,
  (abs(b - r) + abs(r - g) + abs(g - b)) / 3 AS mae, (power(b - r, 2) + power(r - g, 2) + power(g - b, 2)) / 3 AS mse FROM pl)"""


@query("psnr_mae_mse", f"WITH {_POINT} SELECT object_id, {r6('avg(mae) AS rgb_mae', 'avg(mse) AS rgb_mse', 'avg(de76) AS de76', 'quantile_cont(de76, 0.95) AS de76_p95', 'avg(de00) AS de00', '10 * log10(1 / greatest(avg(mse), 1e-12)) AS psnr')} FROM pd GROUP BY 1")
def psnr_mae_mse(spark, sf_dir):
    return six(M.pointwise(turned(spark, sf_dir), cloud(spark, sf_dir)))


@query("part_macro_de00", f"WITH {_POINT}, p AS (SELECT object_id, part, avg(de00) AS v FROM pd GROUP BY 1, 2) SELECT object_id, {r6('avg(v) AS part_macro')}, count(*) AS parts FROM p GROUP BY 1")
def part_macro_de00(spark, sf_dir):
    per = M.pointwise(turned(spark, sf_dir), cloud(spark, sf_dir), ("object_id", "part"))
    return six(per.groupBy("object_id").agg(F.avg("de00").alias("part_macro"), F.count(F.lit(1)).alias("parts")))


@query("part_consistency", f"WITH {CLOUD}, {graph_sql('x', 6)} SELECT object_id, {r6('avg(d_rgb) FILTER (same) AS within')} FROM x GROUP BY 1")
def part_consistency(spark, sf_dir):
    return six(M.graph(cloud(spark, sf_dir), 6).groupBy("object_id").agg(F.avg(F.when(F.col("same"), F.col("d_rgb"))).alias("within")))


@query("boundary_interior", f"WITH {_POINT}, {knn_sql('e', 'cloud', 'cloud', 6, False)}, v AS (SELECT e.object_id, q_id, bool_or(q.part <> n.part) AS boundary FROM e JOIN cloud q ON e.object_id = q.object_id AND q_id = q.point_id JOIN cloud n ON e.object_id = n.object_id AND n_id = n.point_id GROUP BY 1, 2) SELECT v.object_id, {r6('avg(de00) FILTER (boundary) AS edge_de', 'avg(de00) FILTER (NOT boundary) AS inner_de', 'avg(CASE WHEN boundary THEN 1.0::DOUBLE ELSE 0 END) AS boundary_frac')} FROM v JOIN pd ON v.object_id = pd.object_id AND q_id = point_id GROUP BY 1")
def boundary_interior(spark, sf_dir):
    from huepoint.functions.colour import with_ciede2000, with_lab

    c = with_lab(with_lab(cloud(spark, sf_dir), out=[f"t_{x}" for x in LAB]), ("b", "r", "g"), [f"p_{x}" for x in LAB])
    de = with_ciede2000(c, [f"t_{x}" for x in LAB], [f"p_{x}" for x in LAB]).select("object_id", F.col("point_id").alias("q_id"), "de00")
    v = M.vertices(M.graph(cloud(spark, sf_dir), 6)).join(de, ["object_id", "q_id"])
    return six(v.groupBy("object_id").agg(F.avg(F.when(F.col("boundary"), F.col("de00"))).alias("edge_de"), F.avg(F.when(~F.col("boundary"), F.col("de00"))).alias("inner_de"), F.avg(F.col("boundary").cast("double")).alias("boundary_frac")))


@query(
    "coherence_ratio",
    f"""WITH {CLOUD}, lab AS (SELECT object_id, part, {sql_lab('r', 'g', 'b')} FROM cloud), s AS (SELECT object_id, part, {', '.join(f'lab_{c} - avg(lab_{c}) OVER (PARTITION BY object_id) AS g{c}, lab_{c} - avg(lab_{c}) OVER (PARTITION BY object_id, part) AS p{c}' for c in LAB)} FROM lab),
    d AS (SELECT object_id, part, sqrt(gl*gl + ga*ga + gb*gb) AS g, sqrt(pl*pl + pa*pa + pb*pb) AS p FROM s), v AS (SELECT object_id, part, avg(p) AS v, count(*) AS w, sum(g) AS g FROM d GROUP BY 1, 2)
    SELECT object_id, {r6('sum(g) / sum(w) AS v_global', 'sum(v * w) / sum(w) / (sum(g) / sum(w)) AS r_micro', 'avg(v) / (sum(g) / sum(w)) AS r_macro')}, count(*) AS n_parts FROM v GROUP BY 1""",
)
def coherence_ratio(spark, sf_dir):
    return six(M.dispersion(cloud(spark, sf_dir)))


_H = lambda seed: f"('0x' || substr(md5(concat_ws(':', '{seed}', point_id)), 1, 13))::BIGINT"


@query(
    "coherence_null",
    f"""WITH {CLOUD}, own AS (SELECT object_id, part, row_number() OVER (PARTITION BY object_id ORDER BY point_id) AS k FROM cloud), dl AS (SELECT object_id, r, g, b, row_number() OVER (PARTITION BY object_id ORDER BY {_H(5)}, point_id) AS k FROM cloud),
    lab AS (SELECT object_id, part, {sql_lab('r', 'g', 'b')} FROM dl JOIN own USING (object_id, k)), s AS (SELECT object_id, part, {', '.join(f'lab_{c} - avg(lab_{c}) OVER (PARTITION BY object_id) AS g{c}, lab_{c} - avg(lab_{c}) OVER (PARTITION BY object_id, part) AS p{c}' for c in LAB)} FROM lab),
    d AS (SELECT object_id, part, sqrt(gl*gl + ga*ga + gb*gb) AS g, sqrt(pl*pl + pa*pa + pb*pb) AS p FROM s), v AS (SELECT object_id, part, avg(p) AS v, count(*) AS w, sum(g) AS g FROM d GROUP BY 1, 2)
    SELECT object_id, {r6('sum(v * w) / sum(w) / (sum(g) / sum(w)) AS r_micro_null')} FROM v GROUP BY 1""",
)
def coherence_null(spark, sf_dir):
    """Dispersion of random parts of the same sizes: parts dealt anew by hash order."""
    from pyspark.sql import Window

    from huepoint.functions.maths import uniform

    c = cloud(spark, sf_dir)
    w = Window.partitionBy("object_id")
    own = c.select("object_id", "part", F.row_number().over(w.orderBy("point_id")).alias("k"))
    dealt = c.drop("part").withColumn("k", F.row_number().over(w.orderBy(uniform("point_id", seed=5), "point_id")))
    return six(M.dispersion(dealt.join(own, ["object_id", "k"])).select("object_id", F.col("r_micro").alias("r_micro_null")))


@query("intra_inter", f"WITH {CLOUD}, {graph_sql('x', 6)} SELECT object_id, {r6('avg(de00) FILTER (same) AS intra', 'avg(de00) FILTER (NOT same) AS inter', 'avg(de00) FILTER (NOT same) / greatest(avg(de00) FILTER (same), 1e-9) AS ratio', 'avg(CASE WHEN same THEN 0.0::DOUBLE ELSE 1 END) AS inter_edges')} FROM x GROUP BY 1")
def intra_inter(spark, sf_dir):
    same, other = F.avg(F.when(F.col("same"), F.col("de00"))), F.avg(F.when(~F.col("same"), F.col("de00")))
    g = M.graph(cloud(spark, sf_dir), 6).groupBy("object_id").agg(same.alias("intra"), other.alias("inter"), (other / F.greatest(same, F.lit(1e-9))).alias("ratio"), F.avg((~F.col("same")).cast("double")).alias("inter_edges"))
    return six(g)


@query("edge_alignment", f"WITH {CLOUD}, {graph_sql('x', 6)}, t AS (SELECT object_id, boundary, strength > greatest(quantile_cont(strength, 0.9) OVER (PARTITION BY object_id), 1e-6) AS strong FROM x_v) SELECT object_id, {r6('avg(CASE WHEN strong THEN 1.0::DOUBLE ELSE 0 END) FILTER (boundary) AS recall', 'avg(CASE WHEN boundary THEN 1.0::DOUBLE ELSE 0 END) FILTER (strong) AS precision', 'avg(CASE WHEN strong THEN 1.0::DOUBLE ELSE 0 END) AS chance')} FROM t GROUP BY 1")
def edge_alignment(spark, sf_dir):
    v = M.vertices(M.graph(cloud(spark, sf_dir), 6)).withColumn("strong", F.col("strength") > F.greatest(M.above(None, "strength", 0.9), F.lit(1e-6)))
    one = lambda c: F.col(c).cast("double")
    return six(v.groupBy("object_id").agg(F.avg(F.when(F.col("boundary"), one("strong"))).alias("recall"), F.avg(F.when(F.col("strong"), one("boundary"))).alias("precision"), F.avg(one("strong")).alias("chance")))


@query(
    "fidelity",
    f"""WITH {_SURFACE}, {knn_sql('e', 'cloud', 'cloud', 12)}, sp AS (SELECT e.object_id, e.q_id, (stddev_pop(c.r) + stddev_pop(c.g) + stddev_pop(c.b)) / 3 AS s FROM e JOIN cloud c ON c.point_id = e.n_id GROUP BY 1, 2),
    a AS (SELECT object_id, avg(s) AS speckle FROM sp GROUP BY 1), b AS (SELECT object_id, stddev_pop(sqrt(d2)) / (avg(sqrt(d2)) + 1e-12) AS uniformity FROM e WHERE rank = 2 GROUP BY 1), p AS (SELECT object_id, avg(d) AS p2f FROM su GROUP BY 1)
    SELECT object_id, {r6('speckle', 'uniformity', 'p2f')} FROM a JOIN b USING (object_id) JOIN p USING (object_id)""",
)
def fidelity(spark, sf_dir):
    return six(M.fidelity(cloud(spark, sf_dir), triangles(spark, sf_dir)))


@query(
    "headroom",
    f"""WITH {CLOUD}, m AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY object_id, part) AS m{c}, avg({c}) OVER (PARTITION BY object_id) AS w{c}' for c in RGB)} FROM cloud),
    l AS (SELECT object_id, {sql_lab('r', 'g', 'b', 't', 'cie4')}, {sql_lab('mr', 'mg', 'mb', 'm', 'cie4')}, {sql_lab('wr', 'wg', 'wb', 'w', 'cie4')} FROM m),
    d AS (SELECT object_id, avg(sqrt(power(m_l - t_l, 2) + power(m_a - t_a, 2) + power(m_b - t_b, 2))) AS oracle, avg(sqrt(power(w_l - t_l, 2) + power(w_a - t_a, 2) + power(w_b - t_b, 2))) AS global_mean FROM l GROUP BY 1)
    SELECT object_id, {r6('oracle', 'global_mean', 'global_mean - oracle AS headroom', 'oracle / global_mean AS ratio')} FROM d""",
)
def headroom(spark, sf_dir):
    return six(M.headroom(cloud(spark, sf_dir), 4))


def _base(ratio: str) -> str:
    return f"""{UNIT}, {crop_sql(ratio)}, vis AS (SELECT * FROM crop WHERE NOT is_missing), mis AS (SELECT * FROM crop WHERE is_missing), {knn_sql('e', 'mis', 'vis', 1)},
g AS (SELECT object_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM vis GROUP BY 1), p AS (SELECT object_id, part, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM vis GROUP BY 1, 2), c AS (SELECT object_id, part, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM crop GROUP BY 1, 2),
j AS (SELECT e.object_id, m.part <> v.part AS wrong, {', '.join(f'm.{x} AS t{x}, v.{x} AS n{x}, coalesce(p.{x}, g.{x}) AS p{x}, c.{x} AS c{x}, g.{x} AS g{x}' for x in RGB)}
  FROM e JOIN mis m ON e.object_id = m.object_id AND q_id = m.point_id JOIN vis v ON e.object_id = v.object_id AND n_id = v.point_id JOIN g ON e.object_id = g.object_id LEFT JOIN p ON e.object_id = p.object_id AND m.part = p.part JOIN c ON e.object_id = c.object_id AND m.part = c.part),
l AS (SELECT object_id, wrong, {', '.join(sql_lab(f'{s}r', f'{s}g', f'{s}b', s) for s in 'tnpcg')} FROM j)"""


_BASE = _base("0.5")


def _diff(s: str) -> str:
    return f"avg(sqrt(power({s}_l - t_l, 2) + power({s}_a - t_a, 2) + power({s}_b - t_b, 2)))"


@query("colour_baselines", f"WITH {_BASE} SELECT object_id, count(*) AS n_missing, {r6(_diff('n') + ' AS nn_copy', _diff('p') + ' AS part_mean', _diff('c') + ' AS ceiling', _diff('g') + ' AS global_mean', 'avg(CASE WHEN wrong THEN 1.0::DOUBLE ELSE 0 END) AS wrong_part_frac')} FROM l GROUP BY 1")
def colour_baselines(spark, sf_dir):
    return six(M.baselines(G.crop(cloud(spark, sf_dir), VIEW, 0.5), 4))


@query("ablation_deltas", f"WITH {_BASE}, s AS (SELECT object_id, {_diff('n')} AS n, {_diff('p')} AS p, {_diff('c')} AS c, {_diff('g')} AS g FROM l GROUP BY 1) SELECT object_id, {r6('p - n AS gap', 'p - c AS anchor_penalty', 'g - p AS prior_margin', 'n / p AS gain')} FROM s")
def ablation_deltas(spark, sf_dir):
    b = M.baselines(G.crop(cloud(spark, sf_dir), VIEW, 0.5), 4)
    return six(b.select("object_id", (F.col("part_mean") - F.col("nn_copy")).alias("gap"), (F.col("part_mean") - F.col("ceiling")).alias("anchor_penalty"), (F.col("global_mean") - F.col("part_mean")).alias("prior_margin"), (F.col("nn_copy") / F.col("part_mean")).alias("gain")))


@query("part_visibility", f"WITH {UNIT}, {crop_sql('0.75')}, p AS (SELECT object_id, part, avg(CASE WHEN is_missing THEN 0.0::DOUBLE ELSE 1 END) AS vis FROM crop GROUP BY 1, 2), o AS (SELECT object_id, min(vis) AS worst, count(*) FILTER (vis = 0) AS anchorless FROM p GROUP BY 1) SELECT object_id, {r6('worst')}, anchorless, greatest(1, least(10, round_even(5 * (1.5 - worst), 0)))::BIGINT AS resamples FROM o")
def part_visibility(spark, sf_dir):
    return six(M.part_visibility(G.crop(cloud(spark, sf_dir), VIEW, 0.75), 5))


@query("posterior_mean", f"WITH {CLOUD}, m AS (SELECT object_id, point_id, (r + b) / 2 AS pr, (g + r) / 2 AS pg, (b + g) / 2 AS pb, r, g, b FROM cloud), l AS (SELECT object_id, {sql_lab('pr', 'pg', 'pb', 'p')}, {sql_lab('r', 'g', 'b', 't')} FROM m) SELECT object_id, {r6('avg(sqrt(power(p_l - t_l, 2) + power(p_a - t_a, 2) + power(p_b - t_b, 2))) AS de76')} FROM l GROUP BY 1")
def posterior_mean(spark, sf_dir):
    c = cloud(spark, sf_dir)
    mean = c.unionByName(turned(spark, sf_dir)).groupBy("object_id", "point_id").agg(*[F.avg(x).alias(x) for x in RGB])
    return six(M.pointwise(mean, c).select("object_id", "de76"))


_SWEEP = " UNION ALL ".join(f"SELECT '{d}' AS difficulty, * FROM (WITH {_base(str(ratio))} SELECT object_id, {_diff('n')} AS nn_copy, {_diff('p')} AS part_mean, {_diff('c')} AS ceiling FROM l GROUP BY 1)" for d, ratio in G.DIFFICULTIES)


@query("benchmark_by_difficulty", f"SELECT difficulty, count(*) AS n, {r6('avg(nn_copy) AS nn_copy', 'avg(part_mean) AS part_mean', 'avg(ceiling) AS ceiling')} FROM ({_SWEEP}) GROUP BY 1")
def benchmark_by_difficulty(spark, sf_dir):
    return six(completion.by_difficulty(completion.benchmark(cloud(spark, sf_dir), 4)))


@query("inpainted_colours")
def inpainted_colours(spark, sf_dir):
    out = completion.inpainted(G.crop(cloud(spark, sf_dir), VIEW, 0.5), steps=20)
    return six(out.select("object_id", "point_id", "pred_r", "pred_g", "pred_b"))


@query(
    "fps_regions",
    f"""WITH {fps_sql(8)}, s AS (SELECT object_id, ids[at_] AS seed FROM fp JOIN ob USING (object_id)), p AS (SELECT c.*, s.seed, power(c.x - q.x, 2) + power(c.y - q.y, 2) + power(c.z - q.z, 2) AS d FROM cloud c JOIN s USING (object_id) JOIN cloud q ON q.point_id = s.seed)
    SELECT object_id, point_id, seed AS cell FROM p QUALIFY row_number() OVER (PARTITION BY object_id, point_id ORDER BY d, seed) = 1""",
)
def fps_regions(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return M.regions(c, sampling.fps(c, 8)).select("object_id", "point_id", "cell")


@query("noise_squared_error", f"WITH {CLOUD} SELECT object_id, {r6('avg((power(r - x, 2) + power(g - y, 2) + power(b - z, 2)) / 3) AS mse')} FROM cloud GROUP BY 1")
def noise_squared_error(spark, sf_dir):
    return six(M.squared_error(cloud(spark, sf_dir), ("r", "g", "b"), ("x", "y", "z")))


@query(
    "geometry_errors",
    f"""WITH {CLOUD}, p AS (SELECT object_id, point_id, y AS x, z AS y, x AS z FROM cloud), {knn_sql('pe', 'p', 'cloud', 1)}, {knn_sql('te', 'cloud', 'p', 1)}, lab AS (SELECT object_id, point_id, {sql_lab('r', 'g', 'b')} FROM cloud),
    g AS (SELECT object_id, power(p.x - c.x, 2) + power(p.y - c.y, 2) + power(p.z - c.z, 2) AS d2 FROM p JOIN cloud c USING (object_id, point_id)),
    o AS (SELECT object_id, avg(d2) / 3 AS mse, avg(sqrt(d2)) AS p2p, quantile_cont(sqrt(d2), 0.95) AS p2p_p95 FROM g GROUP BY 1),
    a AS (SELECT e.object_id, avg(sqrt(d2)) AS a1, avg(d2) AS a2, avg(sqrt(power(q.lab_l - n.lab_l, 2) + power(q.lab_a - n.lab_a, 2) + power(q.lab_b - n.lab_b, 2))) AS cc FROM pe e JOIN lab q ON e.object_id = q.object_id AND q_id = q.point_id JOIN lab n ON e.object_id = n.object_id AND n_id = n.point_id GROUP BY 1),
    b AS (SELECT object_id, avg(sqrt(d2)) AS b1, avg(d2) AS b2 FROM te GROUP BY 1)
    SELECT object_id, {r6('mse', 'p2p', 'p2p_p95', 'a1 + b1 AS cd_l1', 'a2 + b2 AS cd_l2', 'cc AS coloured_chamfer')} FROM o JOIN a USING (object_id) JOIN b USING (object_id)""",
)
def geometry_errors(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return six(M.geometry_errors(c.select("object_id", "point_id", F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z")), c))


@query("coverage", f"WITH {CLOUD}, {knn_sql('e', 'qry', 'ref', 1)}, b AS (SELECT object_id, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) AS diagonal FROM qry GROUP BY 1), d AS (SELECT object_id, avg(sqrt(d2)) AS d FROM e GROUP BY 1) SELECT object_id, {r6('d / diagonal AS coverage')} FROM d JOIN b USING (object_id)")
def coverage(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(M.coverage(ref, qry))


@query(
    "part_ceiling",
    f"""WITH {CLOUD}, m AS (SELECT *, count(*) OVER w AS n, {', '.join(f'avg({c}) OVER w AS m{c}' for c in RGB)} FROM cloud WINDOW w AS (PARTITION BY object_id, part)), l AS (SELECT object_id, part, {sql_lab('r', 'g', 'b', 't')}, {sql_lab('mr', 'mg', 'mb', 'm')} FROM m WHERE n > 30),
    d AS (SELECT object_id, part, avg(sqrt(power(m_l - t_l, 2) + power(m_a - t_a, 2) + power(m_b - t_b, 2))) AS d FROM l GROUP BY 1, 2) SELECT object_id, count(*) AS parts, {r6('avg(d) AS ceiling')} FROM d GROUP BY 1""",
)
def part_ceiling(spark, sf_dir):
    return six(M.part_ceiling(cloud(spark, sf_dir), 31))


@query("fully_occluded", f"WITH {UNIT}, {crop_sql('0.75')}, p AS (SELECT object_id, part, bool_and(is_missing) AS gone FROM crop GROUP BY 1, 2) SELECT object_id, bool_or(gone) AS fully_occluded FROM p GROUP BY 1")
def fully_occluded(spark, sf_dir):
    return M.fully_occluded(G.crop(cloud(spark, sf_dir), VIEW, 0.75))


SEEDED = M.directions()
_SEEDED = ", ".join(f"({i}, {', '.join(f'{v!r}::DOUBLE' for v in d)})" for i, d in enumerate(SEEDED))


@query("colour_swd_seeded", f"WITH {CLOUD}, few AS (SELECT * FROM qry WHERE part <> 1), {swd_sql('ref', 'few').replace(_DIRS, _SEEDED)}")
def colour_swd_seeded(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(M.sliced_wasserstein(ref, qry.filter("part <> 1"), SEEDED))


@query("inpainted_adaptive")
def inpainted_adaptive(spark, sf_dir):
    out = completion.inpainted(G.crop(cloud(spark, sf_dir), VIEW, 0.5), steps=20, adaptive=True)
    return six(out.select("object_id", "point_id", "pred_r", "pred_g", "pred_b"))


@query(
    "colour_quality",
    f"WITH {CLOUD}, v AS (SELECT object_id, unnest([r, g, b]) AS v FROM cloud), q AS (SELECT object_id, (count(*) // 3)::BIGINT AS n, stddev_pop(v) AS color_std FROM v GROUP BY 1), e AS (SELECT object_id, sqrt(power(avg(x), 2) + power(avg(y), 2) + power(avg(z), 2)) * 10 AS residual FROM cloud GROUP BY 1) SELECT object_id, n, {r6('color_std')}, color_std > 0.01 AS color_ok, residual > 0.15 AS weak FROM q JOIN e USING (object_id)",
)
def colour_quality(spark, sf_dir):
    """Which objects have colours, and whose centre is far off."""
    c = cloud(spark, sf_dir)
    off = c.groupBy("object_id").agg((F.sqrt(sum((F.pow(F.avg(x), F.lit(2.0)) for x in ("x", "y", "z")), F.lit(0.0))) * 10).alias("residual"))
    return six(M.colour_quality(c).join(off, "object_id").withColumn("weak", M.weak()).drop("residual"))


@query(
    "colour_gradient",
    f"""WITH {CLOUD}, e AS (SELECT q.object_id, q.point_id, n.r, n.g, n.b FROM cloud q JOIN cloud n ON q.object_id = n.object_id AND q.point_id <> n.point_id QUALIFY row_number() OVER (PARTITION BY q.object_id, q.point_id ORDER BY power(q.x - n.x, 2) + power(q.y - n.y, 2) + power(q.z - n.z, 2), n.point_id) <= 8),
    m AS (SELECT object_id, point_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM e GROUP BY 1, 2)
    SELECT c.object_id, c.point_id, {r6('coalesce(sqrt(power(c.r - m.r, 2) + power(c.g - m.g, 2) + power(c.b - m.b, 2)), 0) AS gradient')} FROM cloud c LEFT JOIN m USING (object_id, point_id)""",
)
def colour_gradient(spark, sf_dir):
    return six(M.colour_gradient(cloud(spark, sf_dir), 8))
