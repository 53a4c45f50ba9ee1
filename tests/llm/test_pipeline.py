import hashlib
import math
import random
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from huepoint.llm import jaccard, mixing, tokenids, toxicity, winnowing  # noqa: E402


def fixture(spark, folder):
    r = random.Random(11)
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(300)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(r.randint(4, 20)))) for i in range(6)]
    docs, labels = [], []
    for i in range(240):
        w = say(r.randint(3, 60))
        if r.random() < 0.2:
            w[r.randrange(len(w))] = "stinker"
        if r.random() < 0.1:
            w += items[r.randrange(6)][1].split()
        if docs and r.random() < 0.2:
            w = (docs[r.randrange(len(docs))][1] or "").split()
            if len(w) > 30:
                w[3] = "other"
        docs.append((i, " ".join(w), r.choice("aab"), len(w)))
        labels.append((i, int("stinker" in w)))
    docs += [(500, None, "b", None), (501, "", None, 0)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, source string, n_chars long"), ("labels", labels, "doc_id long, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return docs, items


def test_equals_brute_force(spark, tmp_path):
    docs, items = fixture(spark, tmp_path)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    score = lambda t: 1 / (1 + math.exp(-(model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], scorer.features(t))))))
    enc = lambda t: t.encode() if t is not None else None
    left = [d for d in docs if score(enc(d[1])) < toxicity.THRESHOLD]
    assert 20 < len(docs) - len(left) and all("stinker" not in (d[1] or "") for d in left)
    same = jaccard.brute_force([(d[0], enc(d[1])) for d in left], 5, 75)
    left = [d for d in left if same[d[0]][1] == d[0]]
    hit = {i for i, _, n, _ in winnowing.brute_force([(d[0], enc(d[1])) for d in left], [(str(i), enc(t)) for i, t in items], 10) if n}
    assert hit
    left = [d for d in left if d[0] not in hit]
    sizes, w = {}, {}
    for d in left:
        sizes[d[2]] = sizes.get(d[2], 0) + len((d[1] or "").split())
    for place, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        w[s] = mixing.WEIGHTS[place % 3]
    level, total, full = 0.0, sum(sizes.values()), set()
    while (now := (total - sum(3 * sizes[s] for s in full)) / sum(w[s] for s in w if s not in full)) > level:
        level = now
        full = {s for s in w if 3 * sizes[s] < w[s] * level}
    encoder, want, start = tokenids.Encoder(corpus_pipeline.vocabulary(), 1, "<u4"), [], 0
    for d in sorted(left):
        rate = min(3.0 * sizes[d[2]], w[d[2]] * level) / sizes[d[2]] if sizes[d[2]] else 0
        draw = int(hashlib.md5(f"{mixing.SEED}:{d[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        for _ in range(min(3, math.floor(rate) + (draw < rate - math.floor(rate)))):
            ids = encoder.exact(d[1] or "")
            want.append((d[0], start, len(ids) // 4, zlib.crc32(ids)))
            start += len(ids) // 4
    assert got == sorted(want) and len(want) > 60


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def put(spark, folder, docs, labels=(), items=()):
    extra = ", score double, n int, row long, key string"  # names that stages use themselves
    rows = [(*d, len(d[1] or ""), 0.5, 1, 2, "k") for d in docs]
    for name, data, schema in (("documents", rows, "doc_id long, text string, source string, n_chars int" + extra), ("labels", list(labels), "doc_id long, toxic int"), ("benchmark", list(items), "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_empty_tables(spark, tmp_path):
    put(spark, tmp_path, [])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


def test_repeated_ids_nulls_and_very_long_texts(spark, tmp_path):
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(20_000)}" for _ in range(n))
    long, item = say(60_000), say(14)
    near = long.split()
    near[30_000] = "changed"
    docs = [(1, say(30), "a"), (1, say(30), "a"), (1, None, None), (None, say(20), "b"), (None, None, "b"), (2, long, "b"), (3, " ".join(near), "c"), (4, f"{say(50_000)} {item}", "c"), (5, "", "a"), (6, "", "a")]
    df = put(spark, tmp_path, docs, items=[(1, item), (2, None), (3, "")])
    kept = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == df.columns, name
        if name == "toxicity":  # nothing is known to be toxic
            assert kept.count() == len(docs)
        if name == "decontamination":
            left = sorted((x.doc_id or 0, len((x.text or "").split())) for x in kept.collect())
            assert left == [(0, 0), (0, 20), (1, 0), (1, 30), (1, 30), (2, 60_000), (5, 0), (6, 0)]
    rows = sorted(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect() if x.doc_id is not None)
    assert {x[0] for x in rows} >= {1, 2} and 3 not in {x[0] for x in rows} and 4 not in {x[0] for x in rows}
    assert rows == sorted(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect() if x.doc_id is not None)
