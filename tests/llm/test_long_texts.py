"""Texts far longer than a chunk or a batch are worked on as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from huepoint.llm import _exchange, jaccard, linededup, mixing, pitmanyor, recompression, syncmers, toxicity, winnowing
from huepoint.llm.components import components

N = 120_000


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(5000)}" for _ in range(N)]
    copy = list(words)
    copy[N // 2] = "changed"
    rows = [(1, " ".join(words), "a"), (2, " ".join(copy), "b"), (3, "short text", "a"), (4, "x" * 1_000_000, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(_exchange, "CHUNK_BYTES", 10_000)
    monkeypatch.setattr(pitmanyor, "CHUNK_BYTES", 10_000)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_substrings(docs):
    got = by_id(recompression.remove_repeats(docs))
    assert (got[1].n_words, got[1].n_removed) == (N, 0) and (got[2].n_words, got[2].n_removed) == (N, N - 1) and got[2].kept_text == "changed"


def test_components_and_shingles(docs):
    got = by_id(jaccard.similar_documents(docs))
    assert got[1].component_id == got[2].component_id == 1 and got[1].n_shingles == N - 4 and (got[4].component_id, got[4].n_shingles) == (4, 1)


def test_scores(docs):
    got = by_id(pitmanyor.scored(docs))
    assert got[1].n_tokens == N + 1 and got[4].n_tokens == 2 and got[1].score > got[1].base_score


def test_benchmark_at_the_end(spark, docs):
    tail = docs.filter("doc_id = 1").select(F.concat_ws(" ", F.slice(F.split("text", " "), N - 11, 12)).alias("t")).first().t
    got = by_id(winnowing.contamination(docs, spark.createDataFrame([(7, tail)], "item_id long, text string")))
    assert (got[1].n_hit, got[2].n_hit, got[3].n_hit, got[1]["items"]) == (12, 12, 0, ["7"])


def test_the_rest(docs):
    f = by_id(syncmers.fingerprints(docs))
    assert f[2].n_chars > 600_000 and 0.5 < f[2].near_next <= 1 and f[1].near_next < 0.1
    assert by_id(linededup.remove_boilerplate(docs))[4].n_lines == 1
    assert by_id(mixing.plan(docs))[1].size == N
    s = toxicity.Scorer(toxicity.Model(["idiot"], []))
    assert s.features(b"word " * N + b"idiot")[0] > 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 300)]
    r = random.Random(2)
    r.shuffle(path)
    star = [(1000, 1001 + i) for i in range(500)]
    loops = [(5000, 5000), (5001, 5002), (5002, 5001)]
    got = {x.id: x.component for x in components(spark.createDataFrame(path + star + loops, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(501)} == {1000} and got[5002] == 5001 == got[5001]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
