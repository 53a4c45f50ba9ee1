import hashlib
import math
import random
import re
import zlib

import pytest

from huepoint.llm import importance

SCHEMA = "doc_id long, text string"


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + m]) for m in range(1, n + 1) for i in range(len(words) - m + 1)]


def brute(rows, target, n=2, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for into, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in features(x, n)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        words, f = features(x, n)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(can[: len(can) * percent // 100]):
        r.append(k + 1)
    return sorted([tuple(r) if len(r) == 6 else (*r, None) for r in out], key=str)


def result(df):
    return sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()], key=str)


def corpus(r, n=60):
    words = ["the", "The", "naïve", "Ünder", "x1", "42", "b", "data", "set", "q"] + [f"w{i}" for i in range(30)]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", "-", " "]) for _ in range(k))
    return [(i, text(r.choice([0, 1, 2, 19, 20, 21, 60, 300]))) for i in range(n)], [text(30) for _ in range(4)]


@pytest.mark.parametrize("n, size", [(2, 1 << 18), (2, 50), (3, 40), (1, 10)])
def test_equal_to_brute_force_however_long_texts_are_cut(spark, monkeypatch, n, size):
    monkeypatch.setattr(importance, "CHUNK_BYTES", size)
    rows, target = corpus(random.Random(n))
    rows += [(100, None), (101, ""), (102, " .,\n" * 30), (None, "a b " * 20), (5, "again " * 25), (5, "again " * 25), (103, "é" * 500), (104, "ABC" * 200 + " tail")]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(x, "?") for x in [*target, None, ""]], "text string, doc_id string")
    assert result(importance.resample(docs, bench, n=n)) == brute(rows, target, n)


def test_chunks_own_each_start_once():
    text = b"one  two three   four five six seven "
    for size in range(1, 40):
        for n in (1, 2, 3):
            pieces = list(importance.chunks_of(text, n, size))
            assert sum(owned for _, owned in pieces) == 7
            got = sorted(x for piece, owned in pieces for x in importance.buckets_of(piece, owned, n, 1 << 30)[0])
            assert got == sorted(importance.buckets_of(text, None, n, 1 << 30)[0])


def test_empty_tables_and_clashing_names(spark):
    rows, target = corpus(random.Random(5), 30)
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x,) for x in target], "text string")
    assert importance.resample(docs.limit(0), bench).count() == 0
    assert result(importance.resample(docs, bench.limit(0))) == brute(rows, [])
    named = docs.selectExpr("*", "1 as rank", "2 as row", "'s' as score", "3 as weight", "4 as owned")
    assert result(importance.resample(named, bench)) == brute(rows, target)
    got = importance.drawn(named, bench, percent=50)
    assert got.columns == named.columns and {r.doc_id for r in got.collect()} == {r[0] for r in brute(rows, target, percent=50) if r[-1]}


def test_texts_like_the_target_are_drawn_more_often(spark):
    r = random.Random(3)
    rows = [(i, " ".join(f"{'near' if i % 10 == 0 else 'far'}{r.randrange(40)}" for _ in range(40))) for i in range(400)]
    bench = spark.createDataFrame([(" ".join(f"near{r.randrange(40)}" for _ in range(200)),)], "text string")
    ids = [x.doc_id for x in importance.drawn(spark.createDataFrame(rows, SCHEMA), bench, percent=10).collect()]
    assert len(ids) == 40 and sum(i % 10 == 0 for i in ids) >= 16  # 4 by chance


def test_scores_do_not_depend_on_the_layout(spark):
    rows, target = corpus(random.Random(8), 80)
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x,) for x in target], "text string")
    assert result(importance.resample(docs.repartition(7), bench)) == result(importance.resample(docs.coalesce(1), bench))
