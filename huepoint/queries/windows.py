"""Ranks, running values, samples and splits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from huepoint.operators import sampling as S
from huepoint.operators import ordered, schedules
from huepoint.queries._registry import query, r6, six
from huepoint.store import kept
from huepoint.views import CLOUD, EVAL, cloud, eval_rows, table


@query("runner_up_margin", f"WITH {EVAL}, m AS (SELECT obj, method, avg(metric) AS v FROM ev GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS k, lead(v) OVER w AS next FROM m WINDOW w AS (PARTITION BY obj ORDER BY v, method)) SELECT obj, method, {r6('v', 'next / v - 1 AS margin')} FROM k WHERE k = 1")
def runner_up_margin(spark, sf_dir):
    m = eval_rows(spark, sf_dir).groupBy("obj", "method").agg(F.avg("metric").alias("v"))
    w = Window.partitionBy("obj").orderBy("v", "method")
    return six(m.withColumns({"k": F.row_number().over(w), "next": F.lead("v").over(w)}).filter("k = 1").select("obj", "method", "v", (F.col("next") / F.col("v") - 1).alias("margin")))


@query(
    "cumprod_schedule",
    f"""WITH t AS (SELECT unnest(range(0, 200)) AS t), f AS (SELECT t, power(cos((t / 200.0::DOUBLE + 0.008) / 1.008 * (pi() / 2)), 2) AS f0, power(cos(((t + 1) / 200.0::DOUBLE + 0.008) / 1.008 * (pi() / 2)), 2) AS f1 FROM t),
    b AS (SELECT t, greatest(least(1 - f1 / f0, 0.999), 1e-8) AS beta FROM f), a AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS abar FROM b),
    s AS (SELECT t, beta, abar, lag(abar, 1, 1.0::DOUBLE) OVER (ORDER BY t) AS abar_prev FROM a)
    SELECT event_id, t, {r6('beta', 'abar', 'abar_prev', 'sqrt(abar) * value AS kept')} FROM events JOIN s ON event_id % 200 = t""",
)
def cumprod_schedule(spark, sf_dir):
    """Each event's value as its step of the schedule leaves it."""
    rates = schedules.products(schedules.cosine(spark, 200)).select("t", "beta", "abar", "abar_prev")
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") % 200).alias("t"))
    return six(e.join(F.broadcast(rates), "t").select("event_id", "t", "beta", "abar", "abar_prev", (F.sqrt("abar") * F.col("value")).alias("kept")))  # 200 rows


WALK = """WITH t AS (SELECT unnest(range(-1, 200)) AS m), b AS (SELECT m, [m] || CASE WHEN m % 10 = 0 AND m >= 0 AND m < 190 THEN (range(m + 1, m + 11) || range(m + 9, m - 1, -1)) || (range(m + 1, m + 11) || range(m + 9, m - 1, -1)) ELSE [] END AS ts FROM t),
e AS (SELECT m, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM b), s AS (SELECT row_number() OVER (ORDER BY m DESC, i) - 1 AS step, t FROM e), n AS (SELECT step, t, lead(t) OVER (ORDER BY step) AS next_t FROM s)
SELECT event_id, step, t, next_t, CASE WHEN next_t < t THEN 'denoise' ELSE 'jump' END AS kind FROM events JOIN n ON step = event_id % (SELECT count(*) - 1 FROM n) WHERE next_t IS NOT NULL"""


@query("walk_steps", WALK)
def walk_steps(spark, sf_dir):
    """The step of the walk that each event takes, in turn."""
    steps = schedules.walk_steps(spark, 200, 10, 3)
    e = table(spark, sf_dir, "events").select("event_id").crossJoin(F.broadcast(steps.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return e.withColumn("step", F.col("event_id") % F.col("n")).join(F.broadcast(steps), "step").select("event_id", "step", "t", "next_t", "kind")  # as many rows as the walk has steps


@query("percent_rank_cdf", f"WITH {EVAL}, m AS (SELECT method, obj, avg(metric) AS v FROM ev GROUP BY 1, 2) SELECT method, obj, {r6('percent_rank() OVER (PARTITION BY method ORDER BY v) AS cdf', 'cume_dist() OVER (PARTITION BY method ORDER BY v) AS cume')} FROM m")
def percent_rank_cdf(spark, sf_dir):
    m = eval_rows(spark, sf_dir).groupBy("method", "obj").agg(F.avg("metric").alias("v"))
    w = Window.partitionBy("method").orderBy("v")
    return six(m.select("method", "obj", F.percent_rank().over(w).alias("cdf"), F.cume_dist().over(w).alias("cume")))


@query("second_largest_part", f"WITH {CLOUD}, c AS (SELECT object_id, part, count(*) AS n FROM cloud GROUP BY 1, 2) SELECT object_id, part, n FROM c QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY n DESC, part) = 2")
def second_largest_part(spark, sf_dir):
    c = cloud(spark, sf_dir).groupBy("object_id", "part").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("n"), "part"))).filter("k = 2").drop("k")


@query("last_valid_loss", "WITH h AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice::DOUBLE END AS v FROM orders) SELECT o_orderkey, " + r6("last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS last_v") + " FROM h")
def last_valid_loss(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice").cast("double")).alias("v"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return six(h.select("o_orderkey", F.last("v", ignorenulls=True).over(w).alias("last_v")))


@query("ema", "WITH h AS (SELECT o_custkey, list(o_totalprice::DOUBLE ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) SELECT o_custkey, " + r6("list_reduce(l, lambda s, v: 0.9::DOUBLE * s + (1 - 0.9::DOUBLE) * v) AS ema") + " FROM h")
def ema(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    return six(schedules.ema(o, "o_custkey", "o_orderkey", "v", 0.9))


@query("metric_rank", f"WITH {EVAL}, m AS (SELECT obj, avg(metric) AS v FROM ev GROUP BY 1) SELECT obj, rank() OVER (ORDER BY v) AS low, rank() OVER (ORDER BY v DESC) AS high FROM m")
def metric_rank(spark, sf_dir):
    m = kept(eval_rows(spark, sf_dir).groupBy("obj").agg(F.avg("metric").alias("v")))  # means that are worked out again may differ in their last digits
    by = ordered.value_counts(m.dropna(subset=["v"]), "v")
    out = m.join(by, "v", "left").crossJoin(F.broadcast(m.agg(F.count("v").alias("all"))))  # one row; SQL puts nulls last in both orders
    after = lambda c: F.coalesce(c, F.col("all")) + 1
    return six(out.select("obj", after(F.col("before")).alias("low"), after(F.col("all") - F.col("before") - F.col("n")).alias("high")))


@query("difficulty_order", f"WITH {EVAL}, m AS (SELECT difficulty, avg(metric) AS v FROM ev GROUP BY 1) SELECT difficulty, {r6('v')}, row_number() OVER (ORDER BY CASE difficulty WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, difficulty) AS place FROM m")
def difficulty_order(spark, sf_dir):
    m = eval_rows(spark, sf_dir).groupBy("difficulty").agg(F.avg("metric").alias("v"))
    order = F.when(F.col("difficulty") == "5-LOW", 0).when(F.col("difficulty") == "3-MEDIUM", 1).when(F.col("difficulty") == "1-URGENT", 2).otherwise(3)
    return six(m.select("difficulty", "v", F.row_number().over(Window.orderBy(order, "difficulty")).alias("place")))


@query("limit_per_category", f"WITH {CLOUD} SELECT object_id, point_id FROM cloud QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY part, point_id) <= 5")
def limit_per_category(spark, sf_dir):
    return S.limited(cloud(spark, sf_dir), ("part", "point_id"), 5, ("object_id",)).select("object_id", "point_id")


@query("tail_holdout", f"WITH {CLOUD} SELECT object_id, point_id, row_number() OVER (PARTITION BY object_id ORDER BY point_id DESC) <= greatest(1, floor(count(*) OVER (PARTITION BY object_id) * 0.25)) AS held_out FROM cloud")
def tail_holdout(spark, sf_dir):
    return S.ranked_split(cloud(spark, sf_dir), ("point_id",), 0.25, ("object_id",)).select("object_id", "point_id", "held_out")


@query("head_split", f"WITH {CLOUD} SELECT object_id, point_id, row_number() OVER (PARTITION BY object_id ORDER BY point_id) <= greatest(1, floor(count(*) OVER (PARTITION BY object_id) * 0.8)) AS train FROM cloud")
def head_split(spark, sf_dir):
    return S.ranked_split(cloud(spark, sf_dir), ("point_id",), 0.8, ("object_id",), tail=False).select("object_id", "point_id", F.col("held_out").alias("train"))


def fps_sql(n: int, start: str = "1") -> str:
    """CTEs up to fp(object_id, i, at): the place of each object's i-th farthest point, both from 1."""
    square = lambda q, s: " + ".join(f"({q}[{k}] - {s}[{k}]) * ({q}[{k}] - {s}[{k}])" for k in (1, 2, 3))
    return f"""RECURSIVE {CLOUD}, ob AS (SELECT object_id, list(point_id ORDER BY point_id) AS ids, list([x, y, z] ORDER BY point_id) AS ps FROM cloud GROUP BY 1),
    fp AS (SELECT object_id, 1 AS i, {start} AS at_, [1e308::DOUBLE for q in ps] AS d FROM ob
      UNION ALL SELECT object_id, i + 1, list_position(e, list_max(e)), e FROM (SELECT object_id, i, list_transform(ps, lambda q, j: least(d[j], {square('q', 'ps[at_]')})) AS e FROM fp JOIN ob USING (object_id) WHERE i < least({n}, len(ps))))"""


@query("fps", f"WITH {fps_sql(16)} SELECT object_id, ids[at_] AS point_id, i::BIGINT - 1 AS fps_order FROM fp JOIN ob USING (object_id)")
def fps(spark, sf_dir):
    return S.fps(cloud(spark, sf_dir), 16).select("object_id", "point_id", "fps_order")


_START = "floor(('0x' || substr(md5('3:' || object_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * len(ps))::BIGINT + 1"


@query("fps_padded", f"WITH {fps_sql(160, _START)}, n AS (SELECT object_id, max(i) AS n FROM fp GROUP BY 1) SELECT object_id, ids[at_] AS point_id, k::BIGINT AS fps_order FROM (SELECT object_id, n, unnest(range(160)) AS k FROM n) JOIN fp USING (object_id) JOIN ob USING (object_id) WHERE i = k % n + 1")
def fps_padded(spark, sf_dir):
    return S.fps(cloud(spark, sf_dir), 160, seed=3, pad=True).select("object_id", "point_id", "fps_order")


@query("colour_aware_sample")
def colour_aware_sample(spark, sf_dir):
    return S.colour_aware(cloud(spark, sf_dir), 48, 0.5, 8).select("object_id", "point_id", "by_colour")


U = lambda seed, *keys: f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(
    "random_subsample",
    f"""WITH {CLOUD}, k AS (SELECT object_id, point_id, row_number() OVER (PARTITION BY object_id ORDER BY {U(1, 'point_id')}, point_id) AS k, count(*) OVER (PARTITION BY object_id) AS n FROM cloud)
    SELECT object_id, point_id, k - 1 AS slot FROM k WHERE n >= 120 AND k <= 120
    UNION ALL SELECT k.object_id, k.point_id, slot FROM (SELECT object_id, n, slot, floor({U(2, 'object_id', 'slot')} * n)::BIGINT + 1 AS k FROM (SELECT DISTINCT object_id, n FROM k WHERE n < 120), range(120) s(slot)) d JOIN k USING (object_id, k)""",
)
def random_subsample(spark, sf_dir):
    return S.subsample(cloud(spark, sf_dir), 120, seed=1).select("object_id", "point_id", F.col("slot").cast("long"))


@query(
    "keep_then_pad",
    f"""WITH {CLOUD}, k AS (SELECT object_id, point_id, row_number() OVER (PARTITION BY object_id ORDER BY point_id) - 1 AS k, count(*) OVER (PARTITION BY object_id) AS n FROM cloud)
    SELECT object_id, point_id, k AS slot FROM k WHERE k < 140
    UNION ALL SELECT k.object_id, k.point_id, slot FROM (SELECT object_id, slot, floor({U(1, 'object_id', 'slot')} * n)::BIGINT AS k FROM (SELECT DISTINCT object_id, n FROM k WHERE n < 140), range(140) s(slot) WHERE slot >= n) d JOIN k USING (object_id, k)""",
)
def keep_then_pad(spark, sf_dir):
    return S.keep_then_pad(cloud(spark, sf_dir), 140, seed=1).select("object_id", "point_id", F.col("slot").cast("long"))


@query("hash_split", f"WITH {CLOUD} SELECT point_id, {U(0, 'point_id')} < 0.2 AS validation FROM cloud")
def hash_split(spark, sf_dir):
    return S.hash_split(cloud(spark, sf_dir), "point_id", 0.2).select("point_id", "validation")


@query("epoch_batches", f"WITH {CLOUD} SELECT object_id, point_id, (row_number() OVER (PARTITION BY object_id ORDER BY {U(2, 'point_id')}, point_id) - 1) // 16 AS batch FROM cloud")
def epoch_batches(spark, sf_dir):
    return S.batches(cloud(spark, sf_dir), "point_id", 16, 2, ("object_id",)).select("object_id", "point_id", "batch")


@query("counted_split", f"WITH {CLOUD}, k AS (SELECT point_id, row_number() OVER (ORDER BY point_id) AS k FROM cloud) SELECT point_id, CASE WHEN k <= 150 THEN 'train' ELSE 'validation' END AS split FROM k WHERE k <= 190")
def counted_split(spark, sf_dir):
    return S.counted_split(cloud(spark, sf_dir).select("point_id"), "point_id", 150, 40)


@query("permuted_split", f"WITH {CLOUD}, k AS (SELECT point_id, row_number() OVER (ORDER BY {U(42, 'point_id')}, point_id) AS k FROM cloud) SELECT point_id, CASE WHEN k <= 150 THEN 'train' ELSE 'validation' END AS split FROM k WHERE k <= 190")
def permuted_split(spark, sf_dir):
    return S.counted_split(cloud(spark, sf_dir).select("point_id"), "point_id", 150, 40, seed=42)


@query("chosen_objects", f"WITH {CLOUD}, k AS (SELECT object_id FROM (SELECT DISTINCT object_id FROM cloud) ORDER BY {U(42, 'object_id')}, object_id LIMIT 2) SELECT object_id, point_id FROM cloud SEMI JOIN k USING (object_id)")
def chosen_objects(spark, sf_dir):
    return S.chosen(cloud(spark, sf_dir), 2).select("object_id", "point_id")


@query("table_batches", f"WITH {CLOUD} SELECT point_id, (row_number() OVER (ORDER BY {U(3, 'point_id')}, point_id) - 1) // 16 AS batch FROM cloud")
def table_batches(spark, sf_dir):
    return S.batches(cloud(spark, sf_dir), "point_id", 16, 3).select("point_id", "batch")


@query("table_tail_holdout", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) <= greatest(1, floor(count(*) OVER () * 0.25)) AS held_out FROM orders")
def table_tail_holdout(spark, sf_dir):
    return S.ranked_split(table(spark, sf_dir, "orders").select("o_orderkey"), ("o_orderkey",), 0.25)
