import random

import pytest

from huepoint.llm import mixing


def reference(sizes: dict, weights=(5, 2, 1), most=3):
    """Share, stop, reshare, as told."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, excess = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while excess > 1e-9 and left:
        share = {s: excess * w[s] / sum(w[x] for x in left) for s in left}
        excess = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                left.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_equal_step_by_step_sharing(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "B", "é", "z", None, "", "m", "n"]), r.choice([0, 1, 5, 400 if seed == 1 else 9])) for _ in range(60)]
    got = {x.source: x for x in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    for s, t in reference(sizes).items():
        assert got[s].source_size == sizes[s] and got[s].target == pytest.approx(t, abs=1e-6)


def test_mixture(spark):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, "w \t" * r.randint(0, 9), r.choice("aaaaabc"), i, i) for i in range(3000)], "doc_id long, text string, source string, size int, target int")
    plan = mixing.plan(docs).collect()
    again = {x.doc_id: x.copies for x in mixing.plan(docs.repartition(7)).collect()}
    assert all(again[x.doc_id] == x.copies and 0 <= x.copies <= 3 for x in plan)
    by = {}
    for x in plan:
        got = by.setdefault(x.source_size, [x.target, 0])
        got[1] += x.copies * x.size
    assert len(by) == 3 and all(abs(taken / target - 1) < 0.15 for target, taken in by.values())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in again.items() if v}


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, None, None), (1, None, "a"), (2, "x y", None), (2, "x y", None), (3, "", "a")], "doc_id long, text string, source string")
    plan = sorted(((x.doc_id or 0, x.size, x.source_size, x.target, x.copies) for x in mixing.plan(docs).collect()))
    assert plan == [(0, 0, 4, 4.0, 1), (1, 0, 0, 0.0, 0), (2, 2, 4, 4.0, 1), (2, 2, 4, 4.0, 1), (3, 0, 0, 0.0, 0)]
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for df in (mixing.plan(docs), mixing.mixed(docs)):
        assert "Python" not in (p := df._jdf.queryExecution().toString()) and "Arrow" not in p


def test_no_name_of_a_column_clashes(spark):
    names = ["__source", "__size", "__target", "__copy", "__copies", "n", "s", "i", "row", "source_size", "weight", "part", "a.b"]
    rows = [(i, f"w{i} x y", "ab"[i % 2], *[77 + k for k in range(len(names))]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert got.count() > 0 and all(tuple(r)[3:] == tuple(77 + k for k in range(len(names))) for r in got.collect())


def test_levels_of_many_sources(spark):
    """Over 200 sources of unequal sizes, against the plain resharing."""
    r = random.Random(5)
    sizes = {f"s{i:03}": r.choice([0, 1, 5, 50, 5000]) for i in range(199)} | {None: 40}
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == {x: pytest.approx(t) for x, t in reference(sizes).items()}
