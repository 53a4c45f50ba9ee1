import tracemalloc

import numpy as np
import pytest

from huepoint.llm import _exchange as X
from huepoint.llm import _words, tokenids

r = np.random.default_rng(3)


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_numbers_survive_packing(n):
    x = r.choice([0, 1, 2, 254, 255, 256, 70_000, 1 << 40], n)
    assert X.unpack(X.pack(x), n).tolist() == x.tolist()


@pytest.mark.parametrize("buckets", [1, 4, 7, 64])
@pytest.mark.parametrize("width", [4, 5, 6, 8])
def test_keys_keep_order_and_identity_in_their_buckets(buckets, width):
    keys = np.unique(np.append(r.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), np.array([0, 1, (1 << 64) - 1], np.uint64)))
    at = X.bounds(keys, buckets)
    assert at[0] == 0 and at[-1] == len(keys) and (np.diff(at) >= 0).all()
    for b in range(buckets):
        own = keys[at[b] : at[b + 1]]
        if len(own):
            got, alone = (X.unpack_keys(X.pack_keys(x, b, buckets, width), b, buckets, width) for x in (own, own[::3]))
            assert (np.diff(got.astype(np.float64)) >= 0).all() and got[::3].tolist() == alone.tolist()
            assert len(np.unique(got)) >= len(own) - (0 if width == 8 else 2)  # 0 and 1 fall together
            if width == 8:
                assert got.tolist() == own.tolist()


class Fixed:
    partitions = 3


def exchanged(spark, chunks, vals, spread, op, packed=X.pack):
    """Each chunk's answers, by Spark."""
    rows = [tuple(m.values()) for i, (k, v) in enumerate(zip(chunks, vals)) for m in X.messages(i, k, v, spread, packed).to_pylist()]
    replies = [{} for _ in chunks]
    for x in X.exchange(spark.createDataFrame(rows, X.MESSAGE), spread, op, Fixed).collect():
        replies[x.chunk][x.bucket] = bytes(x.body)
    return [X.answers(p, k, spread) for p, k in zip(replies, chunks)]


SPREADS = [X.Spread(4), X.Spread(3, 5, 2), X.Spread(2, 4, 1, 6), X.Spread(1, 7, 5)]


@pytest.mark.parametrize("spread", SPREADS, ids=str)
def test_merges_in_one_and_two_hops(spark, spread):
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 62, 40).astype(np.uint64) * np.uint64(4)
    chunks = [np.unique(r.choice(pool, 25)) for _ in range(5)]
    counts = [r.integers(0, 400, len(c)) for c in chunks]
    total = {int(k): sum(int(v[c == k][0]) for c, v in zip(chunks, counts) if (c == k).any()) for k in pool}
    for c, got in zip(chunks, exchanged(spark, chunks, counts, spread, X.Sum())):
        assert got.tolist() == [total[int(k)] for k in c]
    owners = {int(k): 0 for k in pool}
    for c, got in zip(chunks, exchanged(spark, chunks, counts, spread, X.Own())):
        assert (got >> 1).tolist() == [total[int(k)] for k in c]
        for k, g in zip(c, got):
            owners[int(k)] += int(g & 1)
    assert all(owners[int(k)] == 1 for c in chunks for k in c)


@pytest.mark.parametrize("spread", SPREADS[:2], ids=str)
def test_least_tells_keys_apart_by_their_second_half(spark, spread):
    r = np.random.default_rng(6)
    chunks, vals = [], []
    for _ in range(5):
        k, half = (r.integers(1, n, 60).astype(np.uint64) for n in (15, 4))
        k, half = np.unique(np.stack([k << np.uint64(60), half]), axis=1)
        chunks.append(k)
        vals.append(np.stack([r.integers(-50, 50, len(k)), half.view(np.int64)]))
    least = {}
    for k, (v, h) in zip(chunks, vals):
        for x in zip(k.tolist(), h.tolist(), v.tolist()):
            least[x[:2]] = min(least.get(x[:2], 99), x[2])
    for k, (v, h), got in zip(chunks, vals, exchanged(spark, chunks, vals, spread, X.Least(), X.raw)):
        assert got.tolist() == [int(least[a, b] < x) for a, b, x in zip(k.tolist(), h.tolist(), v.tolist())]


@pytest.mark.parametrize("near,far", [(3, 4)])
def test_answers_do_not_depend_on_the_layout(spark, monkeypatch, near, far):
    """The three operators over many chunks and buckets, in one hop and in two, as over one chunk."""
    from huepoint.llm import jaccard, pitmanyor, recompression

    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(words, 60))
    texts = [" ".join(r.choice(words, int(r.choice([3, 80, 200])))) + (" " + passage if r.random() < 0.3 else "") for _ in range(80)]
    texts += [t + " more" for t in texts[:25]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    ops = [recompression.remove_repeats, jaccard.similar_documents, lambda d: pitmanyor.scored(d, 1, 1)]
    wide = [sorted(map(str, (tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in op(docs).collect()))) for op in ops]
    monkeypatch.setattr(X, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(pitmanyor, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(X.Layout, "spread", lambda self, keys_per_byte, width=8: X.Spread(near, far, 3 if far > 1 else 1, width))
    for op, want in zip(ops, wide):
        assert sorted(map(str, (tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in op(docs).collect()))) == want


def test_sizes_stay_fixed_as_a_corpus_grows():
    """From a gigabyte to 100 TB: messages, buckets and merging tasks hold as many keys at most."""
    for size in (1 << 30, 1 << 40, 100 << 40):
        layout = X.Layout.__new__(X.Layout)
        layout.bytes, layout.least, layout.chunks = size, 200, size // X.CHUNK_BYTES
        s = layout.spread(0.16)
        assert size * 0.16 / s.buckets <= X.BUCKET_KEYS
        chunk_keys = X.CHUNK_BYTES * 0.16
        assert s.near <= X.FAN and chunk_keys / s.near > 1000
        if s.far > 1:
            merged = layout.chunks / s.groups * chunk_keys / s.near
            assert merged < 1.1 * X.BUCKET_KEYS and merged / s.far > 200


def test_a_missing_answer_is_an_error():
    with pytest.raises(KeyError):
        X.answers({}, np.array([5], np.uint64), X.Spread(4))


def test_a_bucket_is_merged_in_few_times_its_keys():
    keys = r.integers(0, 1 << 63, 1_000_000).astype(np.uint64) * np.uint64(2)
    vals, op = np.ones(len(keys), np.int64), X.Sum()
    tracemalloc.start()
    try:
        codes = op.codes(keys, vals)
        got = op.up(codes, int(codes.max()) + 1, vals)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    distinct, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    assert got[codes].tolist() == times[inverse].tolist()
    assert peak < 4 * keys.nbytes  # with a table of hashes 7 times


def test_a_step_begins_without_the_words_that_others_have_kept(monkeypatch):
    assert _words.VALUES in _words.MEMOS and any(x is tokenids._PIECES for x in _words.MEMOS)
    one, other = {b"a": 1}, {b"b": 2}
    monkeypatch.setattr(_words, "MEMOS", [one, other])
    _words.forget(but=other)
    assert (one, other) == ({}, {b"b": 2})
    _words.forget()
    assert not other
