import hashlib
import math
import random

import pytest

from huepoint.llm import partcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (vec_id, vector of finite numbers, label)."""
    v = [(i, [math.floor(scale * x) for x in e], y) for i, e, y in rows]
    w = len(v[0][1]) // parts
    least = {}
    for i, e, _ in v:
        least[i] = min(least.get(i, e), e)
    first = [e for _, e in sorted(least.items(), key=lambda x: (x[0] is None, x[0] or 0))][:entries]
    books = [[e[p * w : p * w + w] for e in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, e, _ in v:
                groups.setdefault(near(p, e[p * w : p * w + w])[1], []).append(e[p * w : p * w + w])
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, labels = [], {}
    for i, e, y in v:
        got = [near(p, e[p * w : p * w + w]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), y))
        labels[y] = labels.get(y, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, c, d, labels[y], sha) for i, c, d, y in out], key=str)


def result(df):
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()], key=str)


def vectors(r, n, width=64):
    return [(i, [r.choice([r.gauss(0, 0.2), 0.25, -0.125]) for _ in range(width)], r.choice([0, 1, None])) for i in range(n)]


def exact(rows):
    """As 32-bit floats hold them."""
    import numpy as np

    return [(i, [float(np.float32(x)) for x in e], y) for i, e, y in rows]


@pytest.mark.parametrize("n", [3, 70, 250])
def test_equal_to_brute_force(spark, n):
    rows = vectors(random.Random(n), n)
    got = result(partcodes.coded(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == brute(exact(rows))


def test_copies_hot_vectors_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(partcodes, "BATCH_ROWS", 64)
    r = random.Random(4)
    rows = vectors(r, 150)
    rows += [(1000 + i, rows[3][1], 1) for i in range(100)] + [(7, rows[8][1], None), (None, rows[9][1], 0), (None, rows[2][1], 0), (11, rows[11][1], rows[11][2])]
    monkeypatch.setattr("huepoint.llm._store.HOT_KEYS", 40)  # many keys are hot
    assert result(partcodes.coded(spark.createDataFrame(rows, SCHEMA))) == brute(exact(rows))


def test_rows_without_a_code(spark):
    rows = vectors(random.Random(1), 20)
    odd = [(100, None, 1), (101, [0.5] * 63 + [None], 1), (102, [float("nan")] + [0.0] * 63, 1), (103, [float("inf")] * 64, 1), (104, [-float("inf")] * 64, 1), (105, [], 1), (106, [0.1] * 63, 1), (107, [0.1] * 32, 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 as pos", "2 as code", "3 as n", "4 as row", "5 as error")
    assert result(partcodes.coded(df)) == brute(exact(rows))
    assert partcodes.coded(df.filter("vec_id >= 100 and vec_id < 106")).count() == 0
    assert partcodes.coded(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_large_components_stop_at_the_limit(spark):
    rows = [(0, [3e38] * 16, 1), (1, [-3e38] * 16, 1), (2, [0.0] * 16, 1)]
    got = {r.vec_id: r for r in partcodes.coded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].error for i in range(3)] == [0, 0, 0] and got[0].code == "00" * 16 and got[1].code == "01" * 16


def test_other_shapes_and_decoding(spark):
    rows = vectors(random.Random(2), 200, width=12)
    coded, books = partcodes.encode(spark.createDataFrame(rows, SCHEMA), parts=3, entries=200, rounds=0)
    assert books.shape == (200, 3, 4)
    back = {r.vec_id: r.v for r in coded.select("vec_id", partcodes.decoded("codes", books).alias("v")).collect()}
    assert all(abs(a - b) <= 1 / 256 for i, e, _ in rows for a, b in zip(e, back[i]))
    assert {r.error for r in coded.collect()} == {0}
