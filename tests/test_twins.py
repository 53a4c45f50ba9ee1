"""Queries against their SQL on tables of a test's own."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from huepoint.catalog import ORACLE_SQL as SQL
from huepoint.catalog import QUERIES
from huepoint.operators import stats
from huepoint.queries import windows


def embeddings(n, seed=1, label=None, size=8):
    r = np.random.default_rng(seed)
    labels = r.integers(0, 10, n).astype("int32")
    return pd.DataFrame({"vec_id": np.arange(n), "embedding": list(r.normal(0, 0.2, (n, size)).astype("float32")), "label": labels if label is None else label(np.arange(n), labels)})


def written(folder, **tables):
    for name, df in tables.items():
        df.to_parquet(folder / f"{name}.parquet")
    return str(folder)


def assert_equal(spark, folder, name, **tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    a, b = c.sql(SQL[name]).df(), QUERIES[name](spark, written(folder, **tables)).toPandas()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    for x in columns:
        assert ((a[x] == b[x]) | (a[x].isna() & b[x].isna())).all(), x


@pytest.fixture
def twin(spark, tmp_path):
    def check(name, **tables):
        written(tmp_path, **tables)
        assert_equal(spark, tmp_path, name, **tables)

    return check


@pytest.mark.parametrize("n", [128 * 5 + 3, 128 * 4 + 1])
def test_gain_vs_coherence_counts_objects_of_one_part(twin, n):
    """The last object has few points of one part, or a single point, whose ratio is no number."""
    twin("gain_vs_coherence", embeddings=embeddings(n, label=lambda i, x: np.where(i >= n - 3, 1, x).astype("int32")))


def test_ranks_of_values_that_differ_when_worked_out_again(spark):
    draw = F.udf(lambda: random.random(), "double").asNondeterministic()
    df = spark.range(200).withColumn("x", draw()).withColumn("y", F.col("id").cast("double"))
    assert stats.correlations(df, "x", "y").first().n == 200


def test_metric_rank_of_means_that_differ_when_worked_out_again(spark, monkeypatch):
    draw = F.udf(lambda: random.random(), "double").asNondeterministic()
    monkeypatch.setattr(windows, "eval_rows", lambda *_: spark.range(50).select(F.col("id").alias("obj"), draw().alias("metric")))
    got = QUERIES["metric_rank"](spark, "").collect()
    assert sorted(r.low for r in got) == list(range(1, 51)) and all(r.low + r.high == 51 for r in got)


def test_metric_rank_puts_nulls_last(spark, twin):
    lines = pd.DataFrame({"l_orderkey": [1, 1, 1, 2], "l_partkey": [1, 2, 2, 3], "l_extendedprice": [5.0, 7.0, 9.0, None], "l_quantity": [1.0, 2.0, 3.0, 4.0], "l_returnflag": ["A", "N", "R", "A"]})
    twin("metric_rank", lineitem=lines, orders=pd.DataFrame({"o_orderkey": [1, 2], "o_orderpriority": ["x", "y"]}))


def test_percentiles_spread_a_group_over_tasks(spark):
    """Equal to Spark's own of groups of any kind, a null key, nulls alone and a single value too, without one task for a group."""
    from huepoint.operators import aggregate as A

    r = np.random.default_rng(3)
    rows = [("a", float(x)) for x in r.integers(0, 40, 501)] + [(None, float(x)) for x in r.random(300)] + [("b", None), ("c", 2.5), ("c", None), ("d", None), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"lo": 0.025, "mid": 0.5, "hi": 0.975, "all": 1.0}
    want = {x.k: x for x in df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in points.items()]).collect()}
    got = A.percentiles(df, "v", points, ("k",)).collect()
    assert len(got) == len(want) == 5
    for x in got:
        for n in points:
            assert x[n] == (None if want[x.k][n] is None else pytest.approx(want[x.k][n], abs=1e-12)), (x, n)
