import json
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from huepoint.llm import tokenids

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = ["", None, " ", "Don't  stop NOW x\x85y", "café CAFÉ İstanbul ΣΑΣ", "a\x0bb\x0cc\x1cd", "it's we're 12345 ...!!! <|endoftext|>x <|startoftext|>", "中文 テスト \U0001f600\U0001f600", "x" * 5000, "́start ̸ end"]


def test_word_by_word_equals_the_whole_text():
    e, r = tokenids.Encoder(PATH, 1, "<u4"), random.Random(5)
    pool = ODD[3:] + ["the", "Quick", "brown'll", "foéx,", "\n", "\t", "  ", "3.14", "​", "ſ", "ﬁ"]
    texts = ODD + ["".join(r.choice(pool) + r.choice(["", " ", "\n"]) for _ in range(30)) for _ in range(200)]
    for t, got in zip(texts, e.encode([t.encode() if t is not None else None for t in texts])):
        assert got == e.exact(t or ""), t


def test_plain_letters_and_marks_take_the_same_ids():
    e, r = tokenids.Encoder(PATH, 1, "<u4"), random.Random(6)
    assert e.by_word
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x131)]] + ["e"] * 60 + ["\u0301"]
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) + "".join(r.choice(marks) for _ in range(r.randint(0, 3))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)] + words[:500] + marks + [chr(c) for c in range(0xA1, 0x130)]
    for t, got in zip(texts, e.encode([t.encode() for t in texts])):
        assert got == e.exact(t), t


def test_files_round_trip(spark, tmp_path):
    docs = [(i * 7 % 101, t) for i, t in enumerate(ODD * 9)] + [(500, "same id b"), (500, "same id a"), (None, "no id")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int")
    index = tokenids.write(df, PATH, f"file://{tmp_path}/t")
    got = sorted(tokenids.read(spark, index).collect(), key=lambda r: r.start)
    e = tokenids.Encoder(PATH, 1, "<u4")
    start = 0
    for r, (i, t) in zip(got, sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or "")), strict=True):
        ids = e.exact(t or "")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    stored = json.loads((tmp_path / "t" / "index.json").read_text())
    assert stored == index and sum(x["tokens"] for x in stored) == start
    ids, off, tokens = tokenids.open_shard(stored[0]["path"], stored[0]["docs"], stored[0]["dtype"])
    assert isinstance(tokens, np.memmap) and off.dtype == np.int64 and tokens.dtype == np.uint16 and off[-1] == len(tokens)


def test_empty_table(spark):
    assert tokenids.write_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_an_encoder_reads_the_rules_alone():
    tracemalloc.start()
    try:
        assert tokenids.Encoder(PATH, 1, "<u4").by_word
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2e6  # with the whole vocabulary as JSON 20 MB
