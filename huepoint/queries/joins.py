"""Nearest-neighbour and relational joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from huepoint.operators import geometry as G
from huepoint.operators import metrics, nn, stats
from huepoint.queries._registry import query, r6, six
from huepoint.sources import registry, sinks
from huepoint.views import CLOUD, EVAL, cloud, eval_rows, split

XYZ, RGB = ("x", "y", "z"), ("r", "g", "b")


def d2(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in XYZ)


def knn_sql(name: str, q: str, r: str, k: int, self_: bool = True, extra: str = "") -> str:
    """CTE {name}: object_id, q_id, n_id, d2, rank."""
    return f"""{name} AS (SELECT q.object_id, q.point_id AS q_id, n.point_id AS n_id, {d2('q', 'n')} AS d2, row_number() OVER (PARTITION BY q.object_id, q.point_id ORDER BY {d2('q', 'n')}, n.point_id) AS rank
  FROM {q} q JOIN {r} n ON q.object_id = n.object_id {'' if self_ else 'AND q.point_id <> n.point_id'} {extra} QUALIFY rank <= {k})"""


@query("nn_join", f"WITH {CLOUD}, {knn_sql('e', 'qry', 'ref', 1)} SELECT object_id, q_id, n_id, {r6('sqrt(d2) AS d')} FROM e")
def nn_join(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(nn.nearest(qry, ref))


@query("nn_join_grid", f"WITH {CLOUD}, {knn_sql('e', 'qry', 'ref', 1)} SELECT object_id, q_id, n_id, {r6('sqrt(d2) AS d')} FROM e")
def nn_join_grid(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(nn.nearest(qry, ref, strategy="grid", width=0.08))


@query("knn_self", f"WITH {CLOUD}, {knn_sql('e', 'cloud', 'cloud', 5, False)} SELECT object_id, q_id, n_id, rank, {r6('d2')} FROM e")
def knn_self(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return six(nn.knn(c, c, 5, include_self=False))


@query("knn_cross", f"WITH {CLOUD}, {knn_sql('e', 'qry', 'ref', 4)} SELECT object_id, q_id, n_id, rank, {r6('d2')} FROM e")
def knn_cross(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(nn.knn(qry, ref, 4, strategy="grid", width=0.15))


@query("knn_visible", f"WITH {CLOUD}, {knn_sql('e', 'cloud', 'cloud', 3, True, 'AND n.part <> 2')} SELECT object_id, q_id, n_id, rank FROM e")
def knn_visible(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return six(nn.knn(c, c.filter("part <> 2"), 3).drop("d2"))


@query(
    "knn_padded",
    f"""WITH {CLOUD}, few AS (SELECT * FROM cloud WHERE part = 1), {knn_sql('e', 'qry', 'few', 20)}, n AS (SELECT object_id, q_id, count(*) AS n FROM e GROUP BY 1, 2),
    s AS (SELECT object_id, q_id, n, unnest(range(1, 21)) AS rank FROM n) SELECT s.object_id, s.q_id, s.rank, e.n_id FROM s JOIN e ON s.object_id = e.object_id AND s.q_id = e.q_id AND e.rank = ((s.rank - 1) % s.n) + 1""",
)
def knn_padded(spark, sf_dir):
    _, qry = split(spark, sf_dir)
    return six(nn.padded(nn.knn(qry, cloud(spark, sf_dir).filter("part = 1"), 20), 20))


@query(
    "three_nn_interpolate",
    f"""WITH {CLOUD}, {knn_sql('e', 'qry', 'ref', 3)}, w AS (SELECT e.*, 1 / (sqrt(d2) + 1e-8) AS w, r.r, r.g, r.b FROM e JOIN ref r ON e.object_id = r.object_id AND e.n_id = r.point_id)
    SELECT object_id, q_id AS point_id, {r6('sum(w * r) / sum(w) AS r', 'sum(w * g) / sum(w) AS g', 'sum(w * b) / sum(w) AS b')} FROM w GROUP BY 1, 2""",
)
def three_nn_interpolate(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(G.interpolated(qry, ref, RGB))


@query(
    "ball_query",
    f"""WITH {CLOUD}, i AS (SELECT q.object_id, q.point_id AS q_id, n.point_id AS n_id, row_number() OVER (PARTITION BY q.object_id, q.point_id ORDER BY n.point_id) AS rank FROM qry q JOIN ref n ON q.object_id = n.object_id AND {d2('q', 'n')} <= 0.1::DOUBLE * 0.1::DOUBLE QUALIFY rank <= 4),
    s AS (SELECT object_id, q_id, n_id AS first_id, unnest(range(1, 5)) AS rank FROM i WHERE rank = 1)
    SELECT s.object_id, s.q_id, s.rank, coalesce(i.n_id, first_id) AS n_id FROM s LEFT JOIN i ON s.object_id = i.object_id AND s.q_id = i.q_id AND s.rank = i.rank""",
)
def ball_query(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(nn.ball(qry, ref, 0.1, 4))


@query("subset_mask", f"WITH {CLOUD} SELECT object_id, point_id, (point_id % 2 = 0 AND part <> 1) OR EXISTS (SELECT 1 FROM ref n WHERE n.part <> 1 AND n.object_id = c.object_id AND {d2('c', 'n')} < 1e-10) AS visible FROM cloud c")
def subset_mask(spark, sf_dir):
    ref, _ = split(spark, sf_dir)
    return nn.subset_mask(cloud(spark, sf_dir), ref.filter("part <> 1")).select("object_id", "point_id", "visible")


@query("label_remap", f"WITH {CLOUD}, l AS (SELECT point_id, part * 7 + 3 AS raw FROM cloud WHERE part <> 1) SELECT point_id, dense_rank() OVER (ORDER BY raw) - 1 AS part FROM l")
def label_remap(spark, sf_dir):
    c = cloud(spark, sf_dir).filter("part <> 1").withColumn("part", F.col("part") * 7 + 3)
    return registry.label_remap(c).select("point_id", "part")


@query("gather_neighbours", f"WITH {CLOUD}, {knn_sql('e', 'cloud', 'cloud', 3, False)} SELECT e.object_id, q_id, rank, n.part AS n_part, {r6('n.r AS n_r')} FROM e JOIN cloud n ON e.object_id = n.object_id AND e.n_id = n.point_id")
def gather_neighbours(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return six(nn.attach(nn.knn(c, c, 3, include_self=False), c, "n_id", ("part", "r"), "n_").select("object_id", "q_id", "rank", "n_part", "n_r"))


_NORM = """nu AS (SELECT object_id, point_id, part, odd, cx / s AS x, cy / s AS y, cz / s AS z FROM (SELECT *, max(sqrt(cx*cx + cy*cy + cz*cz)) OVER (PARTITION BY object_id, odd) + 1e-12 AS s FROM
  (SELECT *, point_id % 2 AS odd, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM cloud WINDOW w AS (PARTITION BY object_id, point_id % 2)))),
nq AS (SELECT * FROM nu WHERE odd = 1), nr AS (SELECT * FROM nu WHERE odd = 0)"""


@query("segment_oracle", f"WITH {CLOUD}, {_NORM}, {knn_sql('e', 'nq', 'nr', 1)} SELECT e.object_id, q_id AS point_id, n.part AS label FROM e JOIN nr n ON e.object_id = n.object_id AND e.n_id = n.point_id")
def segment_oracle(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    e = nn.nearest(G.unit_sphere(qry), G.unit_sphere(ref))
    return nn.attach(e, ref, "n_id", ("part",), "n_").select("object_id", F.col("q_id").alias("point_id"), F.col("n_part").alias("label"))


@query("nn_colour", f"WITH {CLOUD}, {knn_sql('e', 'qry', 'ref', 1)} SELECT e.object_id, q_id AS point_id, {r6('n.r AS r', 'n.g AS g', 'n.b AS b')} FROM e JOIN ref n ON e.object_id = n.object_id AND e.n_id = n.point_id")
def nn_colour(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(nn.attach(nn.nearest(qry, ref), ref, "n_id", RGB, "").select("object_id", F.col("q_id").alias("point_id"), *RGB))


@query(
    "two_hop_nn",
    f"""WITH {CLOUD}, a AS (SELECT * FROM cloud WHERE point_id % 3 = 0), b AS (SELECT * FROM cloud WHERE point_id % 3 = 1), c AS (SELECT * FROM cloud WHERE point_id % 3 = 2), {knn_sql('e1', 'a', 'b', 1)}, {knn_sql('e2', 'b', 'c', 1)}
    SELECT e1.object_id, e1.q_id AS point_id, e2.n_id AS source_id FROM e1 JOIN e2 ON e1.object_id = e2.object_id AND e1.n_id = e2.q_id""",
)
def two_hop_nn(spark, sf_dir):
    a, b, c = (cloud(spark, sf_dir).filter(f"point_id % 3 = {i}") for i in range(3))
    one, two = nn.nearest(a, b), nn.nearest(b, c)
    hop = two.select("object_id", F.col("q_id").alias("n_id"), F.col("n_id").alias("source_id"))
    return one.join(hop, ["object_id", "n_id"]).select("object_id", F.col("q_id").alias("point_id"), "source_id")


@query("edge_label_join", f"WITH {CLOUD}, {knn_sql('e', 'cloud', 'cloud', 4, False)} SELECT e.object_id, q.part = n.part AS same, count(*) AS edges FROM e JOIN cloud q ON e.object_id = q.object_id AND e.q_id = q.point_id JOIN cloud n ON e.object_id = n.object_id AND e.n_id = n.point_id GROUP BY 1, 2")
def edge_label_join(spark, sf_dir):
    c = cloud(spark, sf_dir)
    e = nn.attach(nn.attach(nn.knn(c, c, 4, include_self=False), c, "q_id", ("part",), "q_"), c, "n_id", ("part",), "n_")
    return e.groupBy("object_id", (F.col("q_part") == F.col("n_part")).alias("same")).agg(F.count(F.lit(1)).alias("edges"))


@query("paired_methods", f"WITH {EVAL}, m AS (SELECT obj, avg(metric) FILTER (method = 'N') AS a, avg(metric) FILTER (method = 'R') AS b FROM ev GROUP BY obj) SELECT obj, {r6('a', 'b')} FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_methods(spark, sf_dir):
    return six(stats.paired(eval_rows(spark, sf_dir), "N", "R"))


@query("resume_anti_join", f"WITH {EVAL}, c AS (SELECT DISTINCT obj, method, difficulty FROM ev), d AS (SELECT DISTINCT obj, method, difficulty FROM ev WHERE other > 49.5 AND metric > 60) SELECT obj, method, difficulty FROM c ANTI JOIN d USING (obj, method, difficulty)")
def resume_anti_join(spark, sf_dir):
    ev = eval_rows(spark, sf_dir)
    return sinks.pending(ev.select("obj", "method", "difficulty").distinct(), ev.filter("other > 49.5 and metric > 60"), ["obj", "method", "difficulty"])


@query("semi_common_ids", f"WITH {EVAL} SELECT obj, method, count(*) AS n FROM ev SEMI JOIN (SELECT obj FROM ev WHERE other > 49.5) USING (obj) GROUP BY 1, 2")
def semi_common_ids(spark, sf_dir):
    ev = eval_rows(spark, sf_dir)
    return ev.join(ev.filter("other > 49.5").select("obj").distinct(), "obj", "left_semi").groupBy("obj", "method").agg(F.count(F.lit(1)).alias("n"))


@query("ids_in_all_systems", f"WITH {EVAL} SELECT obj, difficulty FROM ev WHERE other > 35 GROUP BY 1, 2 HAVING count(DISTINCT method) = 3")
def ids_in_all_systems(spark, sf_dir):
    return eval_rows(spark, sf_dir).filter("other > 35").groupBy("obj", "difficulty").agg(F.countDistinct("method").alias("n")).filter("n = 3").drop("n")


@query("label_transfer", f"WITH {CLOUD}, {knn_sql('e', 'cloud', 'ref', 1)} SELECT e.object_id, q_id AS point_id, n.part AS part FROM e JOIN ref n ON e.object_id = n.object_id AND e.n_id = n.point_id")
def label_transfer(spark, sf_dir):
    ref, _ = split(spark, sf_dir)
    return nn.attach(nn.nearest(cloud(spark, sf_dir), ref), ref, "n_id", ("part",), "").select("object_id", F.col("q_id").alias("point_id"), "part")


@query("union_known", f"WITH {CLOUD} SELECT point_id, TRUE AS known FROM ref UNION ALL SELECT point_id, FALSE FROM qry")
def union_known(spark, sf_dir):
    return G.union_known(*split(spark, sf_dir)).select("point_id", "known")


@query("remaining_points", f"WITH {CLOUD}, s AS (SELECT object_id, point_id FROM cloud QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY x DESC, point_id) <= 10) SELECT object_id, point_id FROM cloud ANTI JOIN s USING (object_id, point_id)")
def remaining_points(spark, sf_dir):
    c = cloud(spark, sf_dir)
    top = c.withColumn("k", F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("x"), "point_id"))).filter("k <= 10")
    return c.select("object_id", "point_id").join(top.select("object_id", "point_id"), ["object_id", "point_id"], "left_anti")


@query(
    "config_diff",
    """WITH a AS (SELECT c_custkey::VARCHAR AS name, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey::VARCHAR AS name, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 4 <> 0)
    SELECT name, a.value AS "left", b.value AS "right" FROM a FULL JOIN b USING (name) WHERE a.value IS DISTINCT FROM b.value""",
)
def config_diff(spark, sf_dir):
    from huepoint.views import table

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("value"), "c_custkey")
    b = c.filter("c_custkey % 4 <> 0").withColumn("value", F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("value")))
    return stats.config_difference(c.filter("c_custkey % 3 <> 0"), b)


@query(
    "ball_query_filled",
    f"""WITH {CLOUD}, f AS (SELECT * FROM ref WHERE part <> 1), l AS (SELECT object_id, min(point_id) AS lowest FROM f GROUP BY 1),
    i AS (SELECT q.object_id, q.point_id AS q_id, n.point_id AS n_id, row_number() OVER (PARTITION BY q.object_id, q.point_id ORDER BY n.point_id) AS rank FROM qry q JOIN f n ON q.object_id = n.object_id AND {d2('q', 'n')} <= 0.05::DOUBLE * 0.05::DOUBLE QUALIFY rank <= 4),
    s AS (SELECT q.object_id, q.point_id AS q_id, coalesce(i.n_id, lowest) AS first_id, unnest(range(1, 5)) AS rank FROM qry q JOIN l ON q.object_id = l.object_id LEFT JOIN i ON i.object_id = q.object_id AND i.q_id = q.point_id AND i.rank = 1)
    SELECT s.object_id, s.q_id, s.rank, coalesce(i.n_id, first_id) AS n_id FROM s LEFT JOIN i ON s.object_id = i.object_id AND s.q_id = i.q_id AND s.rank = i.rank""",
)
def ball_query_filled(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(nn.ball(qry, ref.filter("part <> 1"), 0.05, 4, fill_empty=True))


@query("part_edges", f"WITH {CLOUD}, {knn_sql('e', 'cloud', 'cloud', 2, False)}, s AS (SELECT e.object_id, q_id, n_id FROM e JOIN cloud q ON e.object_id = q.object_id AND q_id = q.point_id JOIN cloud n ON e.object_id = n.object_id AND n_id = n.point_id WHERE q.part = n.part) SELECT c.object_id, c.point_id AS q_id, coalesce(n_id, c.point_id) AS n_id FROM cloud c LEFT JOIN s ON s.object_id = c.object_id AND q_id = c.point_id")
def part_edges(spark, sf_dir):
    return metrics.part_edges(cloud(spark, sf_dir), 2)


@query(
    "masks_last_wins",
    """WITH m AS (SELECT l_suppkey % 10 AS model_id, l_partkey % 20 AS mask_id, l_orderkey * 10 + l_linenumber AS position, [l_quantity::BIGINT % 7, l_quantity::BIGINT % 5] AS faces FROM lineitem), f AS (SELECT model_id, mask_id, position, unnest(faces) AS face FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY model_id, face ORDER BY position DESC) AS k FROM f) SELECT model_id, face, CASE WHEN mask_id % 3 = 0 THEN 'part' || mask_id ELSE 'other' END AS part FROM k WHERE k = 1""",
)
def masks_last_wins(spark, sf_dir):
    from huepoint.sources.textual import face_parts
    from huepoint.views import table

    q = F.col("l_quantity").cast("long")
    m = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("model_id"), (F.col("l_partkey") % 20).alias("mask_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.array(q % 7, q % 5).alias("faces"))
    parts = m.select("model_id", "mask_id").distinct().filter("mask_id % 3 = 0").withColumn("name", F.concat(F.lit("part"), F.col("mask_id").cast("string"))).withColumn("depth", F.lit(0))
    return face_parts(m, parts, order=("position",))
