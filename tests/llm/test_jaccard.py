import random

import pytest

from huepoint.llm import _words, jaccard


def run(spark, docs, schema="doc_id long, text string", k=3):
    got = jaccard.similar_documents(spark.createDataFrame(docs, schema), k=k).collect()
    return [(r.doc_id, r.n_shingles, r.component_id) for r in got]


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    passage, docs = say(30), []
    for _ in range(12):  # groups of near copies around the threshold
        base = say(r.randint(8, 90))
        for _ in range(r.randint(2, 9)):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 12))):
                x[r.randrange(len(x))] = r.choice(words)
            docs.append(" ".join(x))
    docs += [" ".join(passage + say(r.randint(0, 12))) for _ in range(30)] + [" ".join(say(40)) for _ in range(30)]
    docs += [docs[0].upper(), docs[5], docs[5], "", None, " \n", "a b", "A  b", "b a", "solo", "x " * 50, "x " * 70]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(i * 3, docs[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 2048), (3, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus(seed)
    want = jaccard.brute_force([(i, t.encode() if t else None) for i, t in docs], 3, 75)
    assert sorted(run(spark, docs)) == sorted((i, n, c) for i, (n, c) in want.items())
    assert len({c for _, c in want.values()}) < len(docs) - 30


def test_bitmaps_bound_the_overlap_from_above():
    import numpy as np

    r = np.random.default_rng(0)
    for n, m in ((10, 12), (500, 480), (70, 90)):
        a, b = (np.unique(r.integers(0, 2 * n, s).astype(np.uint64)) for s in (n, m))
        x, y = jaccard.bitmap(a, len(a)), jaccard.bitmap(b, len(b))
        w = min(len(x), len(y))
        differ = int(np.bitwise_count(jaccard.fold(x, w) ^ jaccard.fold(y, w)).sum())
        assert (len(a) + len(b) - differ) // 2 >= len(np.intersect1d(a, b))


def test_nulls_repeats_and_clashing_columns(spark):
    docs = [(5, "a b c d", 1, "x"), (5, "a b c d", 1, "x"), (None, "A b c d", 1, "x"), (None, None, 1, "x"), (3, "q r s t", 1, "x")]
    got = run(spark, docs, "doc_id long, text string, n int, component string")
    assert sorted(got, key=str) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None), (3, 2, 3)], key=str)


def test_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s"), (2, "a b c d", "t"), (4, "e f g", "s"), (6, None, "s")], "doc_id long, text string, source string")
    kept = jaccard.keep_one_of_each(docs, k=3)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_many_documents_just_below_the_threshold(spark):
    """5,000 documents that share 70 % of their shingles with each other: millions of near pairs, no link, bounded batches."""
    r = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join([*common, *(f"u{i}x{j}" for j in range(8))])) for i in range(5000)]
    rows += [(5000 + i, rows[i][1] + " end") for i in range(0, 50)] + [(6000 + i, "same text " * 3) for i in range(3000)] + [(9500 + i, r.choice(["", None, " "])) for i in range(300)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (44, i) for i in range(5000)) and all(got[5000 + i] == (45, i) for i in range(50))
    assert all(got[6000 + i] == (2, 6000) for i in range(3000)) and all(got[9500 + i] == (0, 9500 + i) for i in range(300))


@pytest.mark.parametrize("step", [jaccard._prefixes, jaccard._bitmaps])
def test_steps_without_texts_keep_no_words(step):
    _words.VALUES[b"kept"]
    assert list(step(iter([]))) == [] and not _words.VALUES
