"""Grouped tables, part means, histograms, reports."""

from pyspark.sql import functions as F

from huepoint.operators import aggregate as A
from huepoint.queries._registry import query, r6, six
from huepoint.views import CLOUD, EVAL, cloud, eval_rows, table

RGB = ("r", "g", "b")


@query("grid_means", f"WITH {EVAL} SELECT method, difficulty, count(*) AS n, {r6('avg(metric) AS metric', 'avg(other) AS other')} FROM ev GROUP BY 1, 2")
def grid_means(spark, sf_dir):
    return six(A.grid_means(eval_rows(spark, sf_dir), ("method", "difficulty"), ("metric", "other")))


@query("ratio_of_aggregates", f"WITH {EVAL} SELECT difficulty, {r6('avg(metric) / greatest(avg(other), 1e-9) AS ratio')} FROM ev GROUP BY 1")
def ratio_of_aggregates(spark, sf_dir):
    return six(eval_rows(spark, sf_dir).groupBy("difficulty").agg((F.avg("metric") / F.greatest(F.avg("other"), F.lit(1e-9))).alias("ratio")))


@query("two_stage_mean", f"WITH {EVAL} SELECT method, {r6('avg(m) AS metric')}, count(*) AS n FROM (SELECT method, obj, avg(metric) AS m FROM ev GROUP BY 1, 2) GROUP BY 1")
def two_stage_mean(spark, sf_dir):
    return six(A.two_stage_mean(eval_rows(spark, sf_dir), ("obj",), ("method",), "metric"))


@query(
    "part_means_fallback",
    f"""WITH {CLOUD}, v AS (SELECT * FROM cloud WHERE NOT (part = 2 AND object_id % 2 = 0)), a AS (SELECT object_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM v GROUP BY 1),
    p AS (SELECT object_id, part, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM v GROUP BY 1, 2), d AS (SELECT object_id, unnest(range(0, 5)) AS part FROM a)
    SELECT d.object_id, d.part, coalesce(n, 0) AS n, {r6('coalesce(p.r, a.r) AS r', 'coalesce(p.g, a.g) AS g', 'coalesce(p.b, a.b) AS b')} FROM d JOIN a USING (object_id) LEFT JOIN p ON d.object_id = p.object_id AND d.part = p.part""",
)
def part_means_fallback(spark, sf_dir):
    return six(A.part_means(cloud(spark, sf_dir), 5, ~((F.col("part") == 2) & (F.col("object_id") % 2 == 0))))


@query("part_pool", f"WITH {CLOUD} SELECT point_id, {r6('avg(r) OVER w AS pool_r', 'max(g) OVER w AS top_g')} FROM cloud WINDOW w AS (PARTITION BY object_id, part)")
def part_pool(spark, sf_dir):
    c = A.pooled(A.pooled(cloud(spark, sf_dir), ("r",)), ("g",), how="max")
    return six(c.select("point_id", "pool_r", F.col("pool_g").alias("top_g")))


@query("weighted_mean", f"WITH {EVAL} SELECT method, {r6('sum(metric * other) / sum(other) AS weighted')} FROM ev GROUP BY 1")
def weighted_mean(spark, sf_dir):
    return six(eval_rows(spark, sf_dir).groupBy("method").agg(A.weighted_mean("metric", "other").alias("weighted")))


@query("micro_macro", f"WITH {EVAL}, o AS (SELECT method, obj, avg(metric) AS v, count(*) AS w FROM ev GROUP BY 1, 2) SELECT method, {r6('sum(v * w) / sum(w) AS micro', 'avg(v) AS macro')} FROM o GROUP BY 1")
def micro_macro(spark, sf_dir):
    o = eval_rows(spark, sf_dir).groupBy("method", "obj").agg(F.avg("metric").alias("v"), F.count(F.lit(1)).alias("w"))
    return six(o.groupBy("method").agg(A.weighted_mean("v", "w").alias("micro"), F.avg("v").alias("macro")))


@query("std_pop_samp", f"WITH {EVAL} SELECT method, {r6('stddev_pop(metric) AS pop', 'stddev_samp(metric) AS samp')} FROM ev GROUP BY 1")
def std_pop_samp(spark, sf_dir):
    return six(eval_rows(spark, sf_dir).groupBy("method").agg(F.stddev_pop("metric").alias("pop"), F.stddev_samp("metric").alias("samp")))


@query("percentiles", f"WITH {EVAL} SELECT difficulty, {r6('quantile_cont(metric / 7, 0.025) AS p025', 'quantile_cont(metric / 7, 0.9) AS p90', 'quantile_cont(metric / 7, 0.975) AS p975')} FROM ev GROUP BY 1")
def percentiles(spark, sf_dir):
    ev = eval_rows(spark, sf_dir).withColumn("v", F.col("metric") / 7)
    return six(A.percentiles(ev, "v", {"p025": 0.025, "p90": 0.9, "p975": 0.975}, ("difficulty",)))


@query("median", f"WITH {EVAL} SELECT obj, {r6('median(metric) AS median')} FROM ev GROUP BY 1")
def median(spark, sf_dir):
    return six(A.percentiles(eval_rows(spark, sf_dir), "metric", {"median": 0.5}, ("obj",)))


@query("distinct_colours", f"WITH {CLOUD} SELECT object_id, count(DISTINCT (floor(r * 255)::INT, floor(g * 255)::INT, floor(b * 255)::INT)) AS colours, list_sort(list(DISTINCT part))::VARCHAR AS parts FROM cloud GROUP BY 1")
def distinct_colours(spark, sf_dir):
    from huepoint.functions.colour import quantised

    parts = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("part")), ", "), F.lit("]"))
    return cloud(spark, sf_dir).groupBy("object_id").agg(F.countDistinct(*[quantised(c) for c in RGB]).alias("colours"), parts.alias("parts"))


_HIST = ", ".join(f"least(floor({c} * 8), 7)::BIGINT AS bin_{c}" for c in RGB)


@query("hist3d", f"WITH {CLOUD}, h AS (SELECT object_id, {_HIST}, count(*) AS n FROM cloud GROUP BY ALL) SELECT object_id, bin_r, bin_g, bin_b, n, {r6('n / sum(n) OVER (PARTITION BY object_id) AS share')} FROM h")
def hist3d(spark, sf_dir):
    return six(A.histogram3d(cloud(spark, sf_dir)))


@query("bincount", f"WITH {CLOUD}, d AS (SELECT object_id, unnest(range(0, 6)) AS part FROM (SELECT DISTINCT object_id FROM cloud)) SELECT d.object_id, d.part, count(c.point_id) AS n FROM d LEFT JOIN cloud c ON d.object_id = c.object_id AND d.part = c.part GROUP BY 1, 2")
def bincount(spark, sf_dir):
    return A.bincount(cloud(spark, sf_dir), "part", 6)


@query("top_vocab_other", "WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_type FROM c ORDER BY n DESC, p_type LIMIT 5) SELECT CASE WHEN p_type IN (FROM t) THEN p_type ELSE 'other' END AS p_type, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def top_vocab_other(spark, sf_dir):
    return A.most_common(table(spark, sf_dir, "part"), "p_type", 5)


@query("best_method", f"WITH {EVAL}, m AS (SELECT obj, method, avg(metric) AS v FROM ev GROUP BY 1, 2) SELECT obj, arg_min(method, v) AS best FROM m GROUP BY 1")
def best_method(spark, sf_dir):
    m = eval_rows(spark, sf_dir).groupBy("obj", "method").agg(F.avg("metric").alias("v"))
    return m.groupBy("obj").agg(F.min_by("method", "v").alias("best"))


@query("pivot_models", f"WITH {EVAL} SELECT difficulty, {r6(*[f'''avg(metric) FILTER (method = '{m}') AS m_{m}''' for m in 'ANR'])} FROM ev GROUP BY 1")
def pivot_models(spark, sf_dir):
    p = eval_rows(spark, sf_dir).groupBy("difficulty").pivot("method", ["A", "N", "R"]).agg(F.avg("metric"))
    return six(p.select("difficulty", *[F.col(m).alias(f"m_{m}") for m in "ANR"]))


@query("win_rate", f"WITH {EVAL}, m AS (SELECT obj, avg(metric) FILTER (method = 'N') AS a, avg(metric) FILTER (method = 'R') AS b FROM ev GROUP BY 1) SELECT {r6('avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END) AS rate')} FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def win_rate(spark, sf_dir):
    from huepoint.operators.stats import paired

    return six(paired(eval_rows(spark, sf_dir), "N", "R").agg(F.avg((F.col("b") < F.col("a")).cast("double")).alias("rate")))


_LABELS = "l AS (SELECT l.doc_id, l.quality::BIGINT AS truth, (CASE WHEN d.n_chars > 800 THEN 1 ELSE 0 END)::BIGINT AS guess, d.n_chars FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").cast("long").alias("truth"), (F.col("n_chars") > 800).cast("long").alias("guess"), "n_chars")


@query("confusion", f"WITH {_LABELS} SELECT truth, {r6('avg(CASE WHEN guess = 0 THEN 1.0 ELSE 0.0 END) AS p0', 'avg(CASE WHEN guess = 1 THEN 1.0 ELSE 0.0 END) AS p1')} FROM l GROUP BY 1")
def confusion(spark, sf_dir):
    return six(A.confusion(labelled(spark, sf_dir), "truth", "guess", (0, 1)))


@query(
    "class_report",
    f"""WITH {_LABELS}, c AS (SELECT unnest([0, 1])::BIGINT AS class), s AS (SELECT class, count(*) FILTER (truth = class) AS support, count(*) FILTER (guess = class) AS chosen, count(*) FILTER (truth = class AND guess = class) AS hits FROM l, c GROUP BY 1),
    p AS (SELECT class, support, coalesce(hits / nullif(chosen, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM s WHERE support + chosen > 0)
    SELECT class, support, {r6('precision', 'recall', 'CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1', '1 - recall AS error_rate')} FROM p""",
)
def class_report(spark, sf_dir):
    return six(A.class_report(labelled(spark, sf_dir), "truth", "guess"))


@query(
    "roc_auc",
    f"""WITH {_LABELS}, r AS (SELECT truth, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS k FROM l)
    SELECT {r6('(sum(k) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2) / (count(*) FILTER (truth = 1) * count(*) FILTER (truth = 0)) AS auc')}, count(*) FILTER (truth = 1) AS positives, count(*) FILTER (truth = 0) AS negatives FROM r""",
)
def roc_auc(spark, sf_dir):
    return six(A.roc_auc(labelled(spark, sf_dir), "truth", "n_chars"))


_CELLS = f"""{EVAL}, cells AS (SELECT obj, avg(metric) AS base, avg(metric) FILTER (method = 'A') AS a, avg(metric) FILTER (method = 'N') AS n, avg(metric) FILTER (method = 'R') AS ceiling FROM ev GROUP BY 1)"""


def cells(spark, sf_dir):
    by = lambda m: F.avg(F.when(F.col("method") == m, F.col("metric")))
    return eval_rows(spark, sf_dir).groupBy("obj").agg(F.avg("metric").alias("base"), by("A").alias("a"), by("N").alias("n"), by("R").alias("ceiling"))


@query("win_ledger", f"WITH {_CELLS} SELECT 'a' AS method, count(*) FILTER (a < base) AS wins, count(a) AS cells FROM cells UNION ALL SELECT 'n', count(*) FILTER (n < base), count(n) FROM cells UNION ALL SELECT 'ceiling', count(*) FILTER (ceiling < base), count(ceiling) FROM cells")
def win_ledger(spark, sf_dir):
    return six(A.win_ledger(cells(spark, sf_dir), "base", ("a", "n", "ceiling")))


@query("margin_bins", f"WITH {_CELLS} SELECT CASE WHEN base - ceiling > 1 THEN 'wide' WHEN base - ceiling >= 0 THEN 'narrow' ELSE 'none' END AS bin, count(*) AS cells, count(*) FILTER (a < base) AS wins, {r6('avg(a - base) AS mean_gap')} FROM cells GROUP BY 1")
def margin_bins(spark, sf_dir):
    return six(A.margin_bins(cells(spark, sf_dir), "base", "ceiling", "a", (1.0, 0.0)))


@query("overall_and_by_category", f"WITH {EVAL} SELECT method, difficulty, {r6('avg(metric) AS mean')}, count(metric) AS n FROM ev GROUP BY GROUPING SETS ((method), (method, difficulty))")
def overall_and_by_category(spark, sf_dir):
    return six(A.overall_and_by(eval_rows(spark, sf_dir), "method", "difficulty", "metric"))


@query("channel_summary", f"WITH {CLOUD} " + " UNION ALL ".join(f"SELECT '{c}' AS channel, {r6(f'min({c}) AS lo', f'max({c}) AS hi', f'avg({c}) AS mean', f'stddev_pop({c}) AS std')} FROM cloud" for c in RGB))
def channel_summary(spark, sf_dir):
    return six(A.described(cloud(spark, sf_dir), RGB))


@query("accuracy", f"WITH {CLOUD}, e AS (SELECT object_id, count(*) AS n, sum(CASE WHEN part = CASE WHEN point_id % 3 = 0 THEN part + 1 ELSE part END THEN 1 ELSE 0 END) AS ok FROM cloud GROUP BY 1) SELECT count(*) AS objects, sum(n)::BIGINT AS points, {r6('sum(ok) / sum(n) AS by_point', 'avg(ok / n) AS by_object')} FROM e")
def accuracy(spark, sf_dir):
    guess = cloud(spark, sf_dir).withColumn("guess", F.when(F.col("point_id") % 3 == 0, F.col("part") + 1).otherwise(F.col("part")))
    return six(A.accuracy(guess, "part", "guess"))
