import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from huepoint import catalog
from huepoint.queries._registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HEADLINES = ["nn_join_grid", "colour_baselines", "edge_iou", "grid_means", "percentiles", "paired_improvement", "cumprod_schedule", "json_path", "ply_roundtrip", "stream_running_cells"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", HEADLINES)
def test_queries_equal_their_sql(spark, duck, name):
    a, b = duck.sql(SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_contract(spark, duck):
    assert entry.entry(spark).count() == 3
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalog.QUERIES) <= set(queries) and len(catalog.QUERIES) > 140


@pytest.mark.parametrize("missing", ["zstandard", "xxhash", "huepoint.llm", "corpus_pipeline"])
def test_the_engine_needs_no_library_of_the_optional_part(missing):
    code = f"""
import sys, warnings
warnings.simplefilter("ignore")
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = e.queries()
assert len([n for n in names if not n.startswith("op") and n != "pipeline"]) >= 160 and "nn_join" in e.oracle_sql()
assert "pipeline" not in names
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert not done.returncode, done.stderr
