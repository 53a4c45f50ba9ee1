import random

import numpy as np
import pytest

from huepoint.llm import winnowing
from huepoint.llm._words import rolling, values


def test_words_are_those_of_the_pattern():
    import re

    text = "Ab-9_c [x]éT\u0000{q} z\x7fw中 'it's' A1"
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert [w.decode() for w in winnowing.plain_words(text.encode())] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


@pytest.mark.parametrize("width", [1, 2, 3, 6, 7])
def test_winnow_chooses_a_minimum_of_every_window(width):
    h = np.random.default_rng(width).integers(0, 40, 200).astype(np.uint64)
    at = winnowing.winnow(h, width)
    want = set()
    for i in range(len(h) - width + 1):
        x = h[i : i + width]
        want.add(i + int(np.flatnonzero(x == x.min())[-1]))
    assert at.tolist() == sorted(want)


def test_rolling_names_equal_windows_alike_and_no_others():
    w = values([b"a", b"b", b"c"] * 9 + [b"d"])
    for k in range(1, 14):
        h, names = rolling(w, k), {}
        for i in range(len(h)):
            assert names.setdefault(w[i : i + k].tobytes(), h[i]) == h[i]
        assert len(set(names.values())) == len(names)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randint(0, 25))) for i in range(25)] + [(30, "solo"), (31, "Solo! item"), (32, ""), (33, None), (34, " .. "), (35, "a a a a a a a a a a a a a")]
    items.append((40, items[3][1]))
    docs = []
    for i in range(80):
        it = (items[r.randrange(len(items))][1] or "").split()
        a = r.randint(0, max(0, len(it) - 1))
        docs.append((i, say(r.randint(0, 30)) + " " + "-".join(it[a : a + r.randint(0, 25)]).upper() + ". " + say(r.randint(0, 30))))
    return docs + [(90, None), (91, ""), (92, "!!"), (93, "a " * 40), (94, "a " * 9), (95, docs[0][1])], items


@pytest.mark.parametrize("seed,part_bytes", [(1, winnowing.PART_BYTES), (2, 700)])
def test_equals_brute_force(spark, seed, part_bytes):
    docs, items = corpus(seed)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.contamination(d, b, part_bytes=part_bytes).collect()
    enc = lambda t: t.encode() if t else None
    want = winnowing.brute_force([(i, enc(t)) for i, t in docs], [(str(i), enc(t)) for i, t in items], 10)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)


def test_empty_tables_repeats_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "x y", "q", 3), (1, "x y", "q", 3), (None, "x y", "q", 3)], "doc_id long, text string, items string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in winnowing.contamination(d, none).collect()] == [(2, 0)] * 3
    some = spark.createDataFrame([(1, "Y", 1)], "item_id long, text string, doc_id int")
    assert [(r.n_hit, r["items"]) for r in winnowing.contamination(d, some).collect()] == [(1, ["1"])] * 3
    assert winnowing.contamination(d.limit(0), some).count() == 0


def test_a_large_benchmark_stays_a_table(spark):
    """Beyond part_bytes: repeated rows, nulls and no hits as before; the pipeline's filter agrees; texts meet no exchange."""
    docs, items = corpus(3)
    d, b = spark.createDataFrame(docs + [(95, docs[0][1]), (None, docs[0][1])], "doc_id long, text string"), spark.createDataFrame(items * 2, "item_id long, text string")
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, r["items"])
    small, large = (sorted(map(key, winnowing.contamination(d, b, part_bytes=n).collect())) for n in (winnowing.PART_BYTES, 1))
    assert small == large and len(large) == len(docs) + 2
    kept = [sorted((str(r.doc_id), r.text or "") for r in winnowing.uncontaminated(d, b, part_bytes=n).collect()) for n in (winnowing.PART_BYTES, 1)]
    assert kept[0] == kept[1] and len(kept[0]) == sum(x[2] == 0 for x in small)
    windows = winnowing._windows(winnowing._Benchmark(b, 1).items, 10, 5).cache()
    assert winnowing._bitmap(windows).nbytes == winnowing.BLOCKS * winnowing.BLOCK_BITS // 8
    scan = winnowing._candidates(d, windows, 10, 5)
    assert "text" not in scan.columns and winnowing._joined(scan, windows).columns == ["size", "h", "h2", "row", "start"]
