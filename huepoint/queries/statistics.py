"""Paired statistics."""

from pyspark.sql import functions as F

from huepoint.operators import stats as X
from huepoint.queries._registry import query, r6, six
from huepoint.views import EVAL, eval_rows, table

PAIRS = f"""{EVAL}, pr AS (SELECT difficulty, obj, avg(metric) FILTER (method = 'N') AS a, avg(metric) FILTER (method = 'R') AS b FROM ev GROUP BY 1, 2), p AS (SELECT * FROM pr WHERE a IS NOT NULL AND b IS NOT NULL)"""


def pairs(spark, sf_dir):
    return X.paired(eval_rows(spark, sf_dir), "N", "R", key=("difficulty",))


@query(
    "paired_improvement",
    f"""WITH {PAIRS} SELECT difficulty, count(*) AS n, {r6('avg(a) AS baseline', 'avg(b) AS conditioned', 'CASE WHEN abs(avg(a)) > 1e-12 THEN -(avg(b) - avg(a)) * 100 / abs(avg(a)) ELSE -(avg(b) - avg(a)) END AS improvement', 'avg(CASE WHEN b < a THEN 1.0::DOUBLE ELSE 0 END) AS win_rate')},
    CASE WHEN abs(avg(a)) > 1e-12 THEN '%' ELSE 'abs' END AS scale FROM p GROUP BY 1 HAVING count(*) >= 5""",
)
def paired_improvement(spark, sf_dir):
    return six(X.improvement(pairs(spark, sf_dir), key=("difficulty",)))


@query(
    "pearson_spearman",
    f"""WITH {PAIRS}, r AS (SELECT difficulty, a, b, rank() OVER (PARTITION BY difficulty ORDER BY a) + (count(*) OVER (PARTITION BY difficulty, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY difficulty ORDER BY b) + (count(*) OVER (PARTITION BY difficulty, b) - 1) / 2 AS rb FROM p)
    SELECT difficulty, count(*) AS n, {r6('corr(a, b) AS pearson', 'corr(ra, rb) AS spearman')} FROM r GROUP BY 1""",
)
def pearson_spearman(spark, sf_dir):
    return six(X.correlations(pairs(spark, sf_dir), "a", "b", ("difficulty",)))


@query("linear_fit", f"WITH {PAIRS} SELECT difficulty, {r6('regr_slope(b, a) AS slope', 'regr_intercept(b, a) AS intercept', 'regr_r2(b, a) AS r2')} FROM p GROUP BY 1")
def linear_fit(spark, sf_dir):
    return six(X.linear_fit(pairs(spark, sf_dir), "a", "b", ("difficulty",)))


@query("relative_improvement", f"WITH {PAIRS} SELECT difficulty, {r6('avg(-100 * (b - a) / nullif(abs(a), 0)) AS mean_of_ratios', '-100 * (avg(b) - avg(a)) / nullif(abs(avg(a)), 0) AS ratio_of_means')} FROM p GROUP BY 1")
def relative_improvement(spark, sf_dir):
    return six(X.relative_improvement(pairs(spark, sf_dir), ("difficulty",), "a", "b"))


@query("metric_agreement", f"WITH {EVAL} SELECT 'metric' AS metric, CASE WHEN avg(metric) FILTER (method = 'R') < avg(metric) FILTER (method = 'N') THEN 'R' WHEN avg(metric) FILTER (method = 'R') > avg(metric) FILTER (method = 'N') THEN 'N' ELSE 'neither' END AS favours FROM ev UNION ALL SELECT 'other', CASE WHEN avg(other) FILTER (method = 'R') > avg(other) FILTER (method = 'N') THEN 'R' WHEN avg(other) FILTER (method = 'R') < avg(other) FILTER (method = 'N') THEN 'N' ELSE 'neither' END FROM ev")
def metric_agreement(spark, sf_dir):
    return X.agreement(eval_rows(spark, sf_dir), {"metric": "lower", "other": "higher"}, "N", "R")


@query("compatibility_gate", f"WITH {EVAL}, m AS (SELECT method, difficulty, avg(metric) AS v FROM ev GROUP BY 1, 2) SELECT method, difficulty, {r6('v')} FROM m WHERE difficulty = '1-URGENT' AND (SELECT count(DISTINCT difficulty) FROM m WHERE difficulty = '1-URGENT') = 1")
def compatibility_gate(spark, sf_dir):
    m = eval_rows(spark, sf_dir).groupBy("method", "difficulty").agg(F.avg("metric").alias("v"))
    return six(X.gated(m.filter("difficulty = '1-URGENT'"), "difficulty"))


def _compared(spark, sf_dir):
    return X.compared(pairs(spark, sf_dir), ("difficulty",), draws=500)


U = lambda seed, *keys: f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


TIMES = f"len(list_filter([{', '.join(map(repr, X.AT_MOST))}]::DOUBLE[], lambda q: {U(0, 'draw', 'obj')} >= q))"


def _interval_sql(unit: str, pairs: str, sign: int = -1, draws: int = 500) -> str:
    """CTEs up to ``ci`` over p(difficulty, obj, a, b)."""
    return f"""{pairs}, times AS (SELECT *, {TIMES} AS w FROM p, range({draws}) r(draw)),
    drawn AS (SELECT difficulty, draw, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b FROM times GROUP BY 1, 2 HAVING sum(w) > 0),
    base AS (SELECT difficulty, abs(avg(a)) AS base, count(*) AS n FROM p GROUP BY 1),
    x AS (SELECT difficulty, n, {sign} * (b - a) * CASE WHEN base <= 1e-12 THEN 1 ELSE 100 / nullif({unit}, 0) END AS x FROM drawn JOIN base USING (difficulty)),
    ci AS (SELECT difficulty, any_value(n) AS n, CASE WHEN count(x) >= 20 THEN quantile_cont(x, 0.025) END AS ci_lo, CASE WHEN count(x) >= 20 THEN quantile_cont(x, 0.975) END AS ci_hi FROM x GROUP BY 1 HAVING any_value(n) >= 5)"""


@query("bootstrap_ci", f"WITH {_interval_sql('abs(a)', PAIRS)} SELECT difficulty, n, {r6('ci_lo', 'ci_hi')} FROM ci")
def bootstrap_ci(spark, sf_dir):
    return six(_compared(spark, sf_dir).select("difficulty", "n", "ci_lo", "ci_hi"))


@query("bootstrap_ci_fixed", f"WITH {_interval_sql('base', PAIRS)} SELECT difficulty, n, {r6('ci_lo', 'ci_hi')} FROM ci")
def bootstrap_ci_fixed(spark, sf_dir):
    return six(X.compared(pairs(spark, sf_dir), ("difficulty",), draws=500, fixed=True).select("difficulty", "n", "ci_lo", "ci_hi"))


@query(
    "wilcoxon_statistic",
    f"""WITH {PAIRS}, d AS (SELECT difficulty, a - b AS d FROM p WHERE a <> b), r AS (SELECT difficulty, d, rank() OVER (PARTITION BY difficulty ORDER BY abs(d)) + (count(*) OVER (PARTITION BY difficulty, abs(d)) - 1) / 2 AS k FROM d)
    SELECT difficulty, {r6('least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0)) AS statistic')} FROM r GROUP BY 1""",
)
def wilcoxon_statistic(spark, sf_dir):
    return six(_compared(spark, sf_dir).select("difficulty", "statistic"))


@query("verdicts", f"WITH {_interval_sql('abs(a)', PAIRS)} SELECT difficulty, CASE WHEN ci_lo > 0 THEN 'helps' WHEN ci_hi < 0 THEN 'hurts' ELSE 'unresolved' END AS verdict, CASE WHEN ci_lo > 0 THEN 'second wins' WHEN ci_hi < 0 THEN 'first wins' ELSE 'unresolved' END AS winner FROM ci")
def verdicts(spark, sf_dir):
    c = _compared(spark, sf_dir)
    return c.select("difficulty", "verdict", X.verdict(words=("second wins", "first wins", "unresolved")).alias("winner"))


@query("wilcoxon_p")
def wilcoxon_p(spark, sf_dir):
    return six(_compared(spark, sf_dir).select("difficulty", "wilcoxon_p"))


VOTES = " UNION ALL ".join(
    f"SELECT difficulty, CASE WHEN ci_lo > 0 THEN 'helps' WHEN ci_hi < 0 THEN 'hurts' ELSE 'unresolved' END AS verdict FROM (WITH {_interval_sql('abs(a)', PAIRS.replace('avg(metric)', f'avg({m})'), sign)} SELECT * FROM ci)" for m, sign in (("metric", -1), ("other", 1))
)


@query("metric_vote", f"WITH v AS ({VOTES}), n AS (SELECT difficulty, count(*) FILTER (verdict = 'helps') AS helps, count(*) FILTER (verdict = 'hurts') AS hurts FROM v GROUP BY 1) SELECT *, CASE WHEN helps >= 2 AND helps > hurts THEN 'helps' WHEN hurts >= 2 AND hurts > helps THEN 'hurts' ELSE 'unresolved' END AS outcome FROM n")
def metric_vote(spark, sf_dir):
    """Over the two metrics, of which one is better when lower, at each difficulty."""
    rows = eval_rows(spark, sf_dir)
    of = lambda m, direction: X.compared(X.paired(rows, "N", "R", value=m, key=("difficulty",)), ("difficulty",), direction, 500).select("difficulty", "verdict")
    return X.vote(of("metric", "lower").unionByName(of("other", "higher")), ("difficulty",))


@query("correlation_p")
def correlation_p(spark, sf_dir):
    c = X.correlations(pairs(spark, sf_dir), "a", "b", ("difficulty",))
    return six(X.with_p(X.with_p(c, "pearson", "n", "pearson_p"), "spearman", "n", "spearman_p"))


@query(
    "spearman_of_table",
    "WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS x, rank() OVER (ORDER BY doc_id) AS y FROM documents WHERE n_chars IS NOT NULL) SELECT count(*) AS n, " + r6("corr(x, y) AS spearman") + " FROM r",
)
def spearman_of_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return six(X.correlations(d, "n_chars", "doc_id").select("n", "spearman"))


@query(
    "bootstrap_bars",
    f"""WITH {EVAL}, per AS (SELECT method, obj, avg(metric) AS a FROM ev GROUP BY 1, 2), times AS (SELECT *, {TIMES} AS w FROM per, range(500) r(draw)),
    drawn AS (SELECT method, draw, sum(w * a) / sum(w) AS a FROM times GROUP BY 1, 2 HAVING sum(w) > 0),
    m AS (SELECT method, count(*) AS n, avg(a) AS mean FROM per GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT method, quantile_cont(a, 0.025) AS lo, quantile_cont(a, 0.975) AS hi FROM drawn GROUP BY 1)
    SELECT method, n, {r6('mean', 'mean - lo AS below', 'hi - mean AS above')} FROM m JOIN e USING (method)""",
)
def bootstrap_bars(spark, sf_dir):
    return six(X.bars(eval_rows(spark, sf_dir), "metric", ("method",), draws=500))
