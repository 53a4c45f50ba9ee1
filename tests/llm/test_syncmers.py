import random
import re

import xxhash

from huepoint.llm import syncmers

M = (1 << 64) - 1


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    return seed


def anchors(text, k=syncmers.K, s=syncmers.S, keep=syncmers.KEEP):
    """By brute force, with the public xxHash."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(syncmers.SYMBOL, text or "")]
    if not h:
        return []
    found = {}
    if len(h) < k:
        found[chain(h) >> 24] = 1
    g = [chain(h[j : j + s]) for j in range(len(h) - s + 1)]
    for i in range(len(h) - k + 1):
        inner = [signed(x) for x in g[i : i + k - s + 1]]
        if min(inner[0], inner[-1]) == min(inner):
            found.setdefault(chain([g[i], g[i + 2]]) >> 24, i + 1)
    return sorted(found.items())[:keep]


def test_equals_brute_force(spark):
    r = random.Random(4)
    words = ["the", "of", "a"] + [f"w{i}é" for i in range(200)] + ["x" * 40]
    docs = [(i, " \n".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 20, 300])))) for i in range(80)] + [(90, None), (91, ""), (92, "one"), (None, "a b c d e")]
    got = {x.doc_id: x for x in syncmers.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        x = got[i]
        assert (x.n_chars, x.edited) == (len(text), edited)
        a, b, c = anchors(text), anchors(edited), anchors(after)
        assert list(zip(x.anchors["hash"], x.anchors["place"])) == a
        assert list(zip(x.edited_anchors["hash"], x.edited_anchors["place"])) == b
        for other, value in ((b, x.near_edited), (c, x.near_next)):
            p, q = {h for h, _ in a}, {h for h, _ in other}
            union = sorted(p | q)[: syncmers.KEEP]
            both = sum(h in p and h in q for h in union)
            assert value == (2 * both / (len(union) + both) if union else 1.0)


def test_anchors_are_free_of_context(spark):
    r = random.Random(5)
    shared = " ".join(f"s{r.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(1, shared + " tail one"), (2, "quite another head " + shared)], "doc_id long, text string")
    a, b = (dict(zip(x.anchors["hash"], x.anchors["place"])) for x in syncmers.fingerprints(docs).orderBy("doc_id").collect())
    both = a.keys() & b.keys()
    moved = {b[h] - a[h] for h in both}
    assert len(both) >= 20 and moved == {3}


def test_repeats_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "b b", "x", 1), (1, "a a", "x", 1), (1, "a a", "x", 1), (2, "c d e f g h", "x", 1)], "doc_id long, text string, anchors string, n int")
    got = sorted((x.doc_id, x.edited) for x in syncmers.fingerprints(docs).collect())
    assert got == [(1, "a c"), (1, "a c"), (1, "b c"), (2, "c d e f a a")]
    assert syncmers.fingerprints(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    p = syncmers.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in p and "Arrow" not in p


def matched(a, b):
    """By brute force, from all anchors."""
    a, b = (dict(anchors(x, keep=None)) for x in (a, b))
    moved = [b[h] - a[h] for h in a.keys() & b.keys()]
    return 2 * sum(d == 0 or moved.count(d) > 1 for d in moved) / (len(a) + len(b)) if a or b else 1.0


def test_all_anchors_and_their_places_are_matched(spark):
    r = random.Random(6)
    own = lambda n: [f"o{r.randrange(10**9)}" for _ in range(n)]
    passage, phrases = own(60), [own(4) for _ in range(80)]
    scattered = lambda: [w for p in r.sample(phrases, len(phrases)) for w in (*own(r.randint(3, 30)), *p)]
    texts = [own(900) + passage + own(2000), own(2500) + passage + own(300), scattered(), scattered(), ["a"] * 500, ["a"] * 400, ["b", "c"], ["b", "c"], [], [], passage + ["new"] + passage[30:], passage]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert (got[i].match_edited, got[i].match_next) == (matched(text, got[i].edited), matched(text, rows[i - 1][1])), i
    both = len(dict(anchors(rows[0][1], keep=None)).keys() & dict(anchors(rows[1][1], keep=None)).keys())
    assert both > 30 and got[1].match_next > 0.01 and got[3].match_next < 0.03 and got[7].match_next == got[9].match_next == 1.0


def test_places_have_no_bound(spark):
    passage = [f"p{i}" for i in range(40)]
    a, b = " ".join([f"a{i}" for i in range(30)] + passage), " ".join([f"b{i}" for i in range(3)] + passage[:10])
    df = spark.createDataFrame([(a, b), (b, a), (a, a), (b, b), ("", a)], "x string, y string")
    for bits in (23, 4):
        out = df
        for c in "xy":
            out = syncmers.with_anchors(out, c, f"{c}_anchors", place_bits=bits)
        for row in syncmers.with_matching(out, "all_x_anchors", "all_y_anchors", "m", bits).collect():
            assert row.m == matched(row.x, row.y)
            assert list(zip(row.x_anchors["hash"], row.x_anchors["place"])) == anchors(row.x)


def test_likeness_follows_from_what_is_printed(spark, tmp_path):
    from huepoint.llm import entries

    r = random.Random(11)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(r.choices(words, k=r.choice([0, 1, 3, 4, 60, 700]))) for _ in range(40)]
    spark.createDataFrame(list(enumerate([*texts[:20], *texts[:3], *texts[20:]])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in entries.op9_document_fingerprints(spark, str(tmp_path)).collect()}
    parsed = lambda p: {h: int(at) for h, at in (x.split(":") for x in p.split(",") if x)}

    def share(a, b):
        moved = [b[h] - a[h] for h in a.keys() & b.keys()]
        return 2 * sum(d == 0 or moved.count(d) > 1 for d in moved) / (len(a) + len(b)) if a or b else 1.0

    assert max(len(parsed(x.fingerprint)) for x in rows.values()) > 300
    for i, x in rows.items():
        own, after = parsed(x.fingerprint), parsed(rows[x.next_id].fingerprint)
        assert x.near_edited == share(own, parsed(x.edited_fingerprint)) and x.near_next == share(own, after)
        assert x.next_id == (i - 1 if i else max(rows))
