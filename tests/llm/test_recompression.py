import random

import pytest

from huepoint.llm import recompression


def rows(spark, docs, schema="doc_id long, text string"):
    got = recompression.remove_repeats(spark.createDataFrame(docs, schema), window=12).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text.encode()) for r in got)


def corpus(seed):
    r = random.Random(seed)
    say = lambda n, v: " ".join(r.choice(v) for _ in range(n))
    words = [f"w{i}" for i in range(400)]
    passage, runs = say(40, words), "a a a a a a a a b b b b b b b b b b " * 3
    docs = [(i, say(r.randint(0, 60), words) + "\n" + passage[r.randint(0, 50) :] + " " + say(r.randint(0, 20), words)) for i in range(60)]
    docs += [(100 + i, runs[i:] + say(5, words)) for i in range(8)] + [(200 + i, say(80, ["x", "y"])) for i in range(12)]
    docs += [(300 + i, say(12, words[:2] * 3) + " end") for i in range(3)] + [(400, "x " * 300), (401, "x " * 200), (402, ""), (403, None), (404, " \t\x0b\n"), (405, "é ü " * 30)]
    return docs + [(500, docs[3][1]), (501, docs[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    want = sorted(recompression.brute_force([(i, t.encode() if t else None) for i, t in docs], 12))
    assert rows(spark, docs) == want
    assert sum(x[2] for x in want) > 1000


def test_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"t{i}" for i in range(20))
    docs = [(7, text, 1, 2), (7, text, 1, 2), (None, text, 1, 2), (8, None, 1, 2)]
    got = rows(spark, docs, "doc_id long, text string, chunk int, n_words int")
    assert [(x[0], x[2]) for x in got] == [(-1, 20), (7, 0), (7, 0), (8, 0)]


def test_empty_table(spark):
    assert rows(spark, []) == []
