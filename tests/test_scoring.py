import pytest
from pyspark.sql import functions as F

from huepoint.operators import tables
from huepoint.plans import scoring
from huepoint.plans.generate import objects


def test_scoring_the_truth_is_perfect_and_counts_are_equal(spark):
    ref = objects(spark, 2, 120)
    more = ref.unionByName(ref.filter("point_id < 40").withColumns({"point_id": F.col("point_id") + 1000, "x": F.col("x") + 0.001}))
    p = scoring.equalised(more, ref)
    assert all(r["count"] == 120 for r in p.groupBy("object_id").count().collect())
    seeds = ref.filter("point_id % 10 = 0")
    for r in scoring.score(ref, ref, seeds).collect():
        assert r.n_pred == r.n_ref == 120 and r.cd_l1 == 0 and r.colour_swd == pytest.approx(0) and r.region_de == pytest.approx(0, abs=1e-9)


def test_chance_is_worse_than_truth(spark):
    ref = objects(spark, 2, 150)
    got = scoring.region_chance(ref, ref, ref.filter("point_id % 15 = 0")).collect()
    assert len(got) == 2 and all(r.region_de76 == pytest.approx(0, abs=1e-9) and r.chance > 5 and r.norm == pytest.approx(0, abs=1e-9) for r in got)


def test_tables(spark):
    df = spark.createDataFrame([("A", 1), ("b", 2), ("c", None)], "kind string, part long")
    assert tables.declared(df, ["part", "none", "kind"]).columns == ["part", "kind"]
    assert tables.restricted(df, "kind", ["a", "B"]).count() == 2 and tables.restricted(df, "kind", []).count() == 3
    names = spark.createDataFrame([(1, "leg")], "part long, name string")
    assert {r.kind: r["name"] for r in tables.named(df, "part", names).collect()} == {"A": "leg", "b": "part2", "c": None}
    tables.assert_disjoint(df.filter("kind = 'A'"), df.filter("kind = 'b'"), ["kind"])
    with pytest.raises(AssertionError):
        tables.assert_disjoint(df, df, ["kind"])
    bank = tables.validation_bank(spark.range(3).withColumnRenamed("id", "object_id"), 100, 4).collect()
    assert len(bank) == 12 and all(25 * r.stratum <= r.t < 25 * (r.stratum + 1) for r in bank)
