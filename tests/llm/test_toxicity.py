import itertools
import math
import random

import pyarrow as pa
import pytest

from huepoint.llm import toxicity as T
from huepoint.llm._store import local_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def test_automaton_accepts_just_the_words_within_the_edits():
    r = random.Random(1)
    terms = ["idiot", "trash", "scum", "worthless", "idiom", "aa", "abcabcabc"]
    auto = T.Automaton(terms, [])
    allowed = {t: 2 if len(t) >= T.TWO_EDITS else 1 if len(t) >= T.ONE_EDIT else 0 for t in terms}
    words = set(terms) | {"", "x"}
    for t in terms:
        for _ in range(400):
            w = list(t)
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(w) + 1)
                w[i : i + r.randint(0, 1)] = r.choice(["", "a", "t", "o", "z"])
            words.add("".join(w))
    for w in words:
        want = T.EXACT if w in terms else T.FUZZY if any(distance(t, w) <= allowed[t] for t in terms) else 0
        assert auto.match(w) == want, w


def test_stems_match_beginnings():
    auto = T.Automaton([], ["lost", "lowerst"])
    assert [auto.match(w) for w in ("lost", "lostraun", "los", "lxst", "lowerstxy", "lowrstxy", "lxwrst")] == [T.STEM, T.STEM, 0, 0, T.STEM, T.FUZZY, 0]


def test_quotation_is_told_from_abuse():
    s = T.Scorer(T.Model(["idiot"], []))
    direct, quoted, german = (s.features(t.encode()) for t in ("you are an idiot now", 'he said "you are an idiot" now', "er sagte „so ein idiot“ dazu"))
    assert direct[0] > 0 and direct[3] == 0 and direct[4] > 0
    assert quoted[0] == german[0] == 0 and quoted[3] == german[3] > 0 and quoted[4] == 0
    assert s.features(None) == s.features(b"") == s.features("nice wörds".encode()) == [0.0] * 6
    assert s.features(b"Idiot, IDIOT! idi0t... idiott")[0] == pytest.approx(T.math.log1p(2))


def data(seed, n=600):
    r = random.Random(seed)
    words, bad = ["".join(r.choice("bdfgklmnprs") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)], ["wretch", "stinker", "vermin"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(bad) if r.random() < 0.6 else "zoq" + r.choice(words)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = data(7)
    d = spark.createDataFrame([(*x, "v", 1.5) for x in docs + [(9001, None), (9002, "")]], "doc_id long, text string, toxic string, score double")
    model = T.train(d, spark.createDataFrame(labels + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    assert set(model.words) >= {"wretch", "stinker", "vermin"} and "zoq" in " ".join(model.stems)
    got = {r.doc_id: (r.score, r.out) for r in T.score(d, model).select("doc_id", "score", T.held_out().alias("out")).collect()}
    assert len(got) == len(docs) + 2 and all(0 <= s <= 1 for s, _ in got.values())
    held = [(got[i][0] >= T.THRESHOLD, y) for i, y in labels if got[i][1]]
    assert len(held) > 100 and sum(p == bool(y) for p, y in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = data(8, 200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = a.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - toxic else toxic end as toxic")
    assert T.train(d, a) == T.train(d, flipped)


def test_without_training_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score(d, T.train(d, none)).collect()] == [0.0] * 3
    assert T.score(d.limit(0), T.train(d.limit(0), none)).count() == 0


def test_every_window_of_a_long_text_is_seen():
    s = T.Scorer(T.Model(["idiot"], []))
    words = (["idiot"] + ["word"] * 99) * 640
    words[32_150:32_160] = ["idiot"] * 10
    assert s.features(" ".join(words).encode())[4] == pytest.approx(T.math.log1p(10))
    r = random.Random(3)
    for _ in range(30):
        w = [r.choice(["idiot", "a", "b", "c", '"idiot', 'idiot"', '"x', 'x"', "„y", "y“"]) for _ in range(r.choice([5, 60, 900]))]
        codes = [s.code(x.encode()) for x in w]
        spans = quotations(codes)
        hits = [i for i, c in enumerate(codes) if c & 3]
        quoted = [i for i in hits if any(a <= i <= b for a, b in spans)]
        direct = [i for i in hits if i not in quoted]
        most = max((sum(abs(i - j) <= T.WINDOW for j in direct) - sum(abs(i - j) <= T.WINDOW for j in quoted) for i in direct), default=0)
        got = s.features(" ".join(w).encode())
        assert (got[3], got[4]) == (T.math.log1p(len(quoted)), T.math.log1p(max(0, most)))


def test_rare_and_short_terms_of_large_samples(spark):
    r = random.Random(5)
    words = ["".join(r.choice("bdfgklmnprs") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    text = lambda *own: " ".join([*r.choices(words, k=3), *own])
    rows = [(text("wretch"), 1) for _ in range(2000)] + [(text(w), 1) for w in ("vermin", "zx", "scum") for _ in range(12)] + [(text("slum"), 0) for _ in range(3)] + [(text(), 0) for _ in range(8000)]
    d = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    model = T.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    matched = set(model.words) | set(model.stems)
    assert {"zx", "scum"} <= matched and T.Scorer(model).match("vermin")
    s = T.Scorer(model)
    assert [bool(s.match(w)) for w in ("scum", "scvm", "sccum", "scuum", "slum", "scu", "word")] == [True, True, True, True, False, False, False]
    many = T.lexicon([(f"w{i}x", 0, 5, 0) for i in range(2500)])
    assert len(many[0]) == 2500


def quotations(codes):
    """From the last opening mark to the next closing one."""
    out, start = [], None
    for i, c in enumerate(codes):
        fresh = bool(c & 4 or c & 16 and start is None)
        if fresh:
            start = i
        if start is not None and (c & 8 or c & 16 and not fresh):
            out.append((start, i))
            start = None
    return out


def plain_features(scorer, text):
    """The features by their definition: every hit against every quotation and every other hit."""
    words = text.split()
    codes = [scorer.code(w) for w in words]
    spans = quotations(codes)
    if sum(bool(c & T.OF_PAIR) for c in codes) == 1:  # one word of a pair is none
        codes = [0 if c & T.OF_PAIR else c for c in codes]
    hits = [i for i, c in enumerate(codes) if c & 3]
    quoted = [i for i in hits if any(a <= i <= b for a, b in spans)]
    direct = [i for i in hits if i not in set(quoted)]
    best = max((sum(abs(i - j) <= T.WINDOW for j in direct) - sum(abs(i - j) <= T.WINDOW for j in quoted) for i in direct), default=0)
    kinds = [sum(codes[i] & 3 == k for i in direct) for k in (T.EXACT, T.STEM, T.FUZZY)]
    share = 1000 * len(direct) / len(words) if hits else 0
    return [math.log1p(x) for x in (*kinds, len(quoted), max(0, best), share)]


@pytest.mark.parametrize("hits", [0, 1, 10, 130, 1000, 5000])
def test_features_equal_their_definition(hits):
    r = random.Random(hits)
    scorer = T.Scorer(T.Model(["idiot", "moron", "dumb"], ["stupid"], ["house"] if hits % 20 else []))
    words = [r.choice(["plain", "words", "of", "a", "text", "house"]) for _ in range(6000 - hits)]
    for _ in range(hits):
        words.insert(r.randrange(len(words)), r.choice(["idiot", "idi0t", "stupidly", "Moron!", "dummb", '"idiot"']))
    for _ in range(40):
        words[r.randrange(len(words))] += r.choice(['"', "”", "“", "«"])
    text = " ".join(words).encode()
    assert scorer.features(text) == pytest.approx(plain_features(scorer, text))


def test_a_burst_counts_alike_wherever_it_stands():
    scorer = T.Scorer(T.Model(["idiot"], []))
    scattered = (["plain"] * 60 + ["idiot"]) * 2000
    got = {scorer.features(" ".join([*scattered[:at], *["idiot"] * 12, *scattered[at:]]).encode())[4] for at in range(61_025, 61_035)}  # too far from the scattered ones to count any
    assert len(got) == 1


def test_quotations_of_any_length():
    s = T.Scorer(T.Model(["idiot"], []))
    for n in (0, 1, 81, 91, 5000):
        words = ["he", "said", '"you', *["word"] * n, "idiot", *["word"] * n, 'there"', "and", "left"]
        assert s.features(" ".join(words).encode())[:4] == [0.0, 0.0, 0.0, math.log1p(1)], n
    stray = s.features(('"never closed ' + "word " * 50 + '"quoted idiot" then idiot').encode())
    assert (stray[0], stray[3]) == (math.log1p(1), math.log1p(1))
    assert s.features(b'an "idiot" he')[3] == s.features("un « idiot » il".encode())[3] == math.log1p(1)


def test_one_word_of_a_pair_is_none():
    s = T.Scorer(T.Model([], [], ["zoqu"]))
    assert s.features(b"a zoquar here") == [0.0] * 6 and s.features(b"zoquar zoquin")[1] == math.log1p(2)


def plain_lexicon(rows):
    """Candidates by their definition, from (text, label)."""
    toxic, other = sum(y for _, y in rows), sum(not y for _, y in rows)
    held, longer = {}, {}
    for text, y in rows:
        words = [x for w in (text or "").split() if (x := w.strip(T.STRIP).lower())]
        stems = {(w[:n], n) for w in words for n in T.STEM_SIZES if len(w) >= n}
        for x in {(w, 0) for w in words} | stems | {(t, -n) for t, n in stems if sum(v[:n] == t for v in words) > 1}:
            held.setdefault(x, [0, 0])[0 if y else 1] += 1
        if y:
            for w in words:
                for n in T.STEM_SIZES:
                    if len(w) > n:
                        longer.setdefault((w[:n], n), set()).add(w)
    around = {}
    for text, y in rows:
        if y:
            words = ["", *(w.strip(T.STRIP).lower() for w in (text or "").split()), ""]
            for p, w, q in zip(words, words[1:], words[2:]):
                for x in [(w, 0)] + [(w[:n], s * n) for n in T.STEM_SIZES if len(w) >= n for s in (1, -1)]:
                    around.setdefault(x, set()).add((p, q))
    out = []
    for (t, n), (a, b) in held.items():
        if len(around.get((t, n), ())) < max(T.SUPPORT, T.APART * a):
            continue
        odds = (a + 0.5) / (toxic + 1) / ((b + 0.5) / (other + 1))
        if a >= T.SUPPORT and odds >= T.ODDS and (n < 0 or b <= 0.02 * a):
            out.append((t, n, a, len(longer.get((t, abs(n)), ()))))
    return T.lexicon(sorted(out, key=lambda x: (-x[2], x[0], x[1])))


@pytest.mark.parametrize("seed", [1, 2])
def test_lexicon_equals_its_definition(spark, seed):
    docs, labels = data(seed, 500)
    rows = [(x, y) for (_, x), (_, y) in zip(docs, labels)]
    model = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    words, stems, pairs = plain_lexicon(rows)
    assert (sorted(model.words), sorted(model.stems), sorted(model.pairs)) == (sorted(words), sorted(stems), sorted(pairs)) and {"wretch", "stinker", "vermin"} <= set(words) and stems


def test_held_out_recall_on_the_given_labels(spark):
    """At least 0.9 of the toxic rows held out are caught, and at most 1 % of the others flagged."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = T.score(docs, T.train(docs, labels)).filter(T.held_out()).join(labels.select("doc_id", "toxic"), "doc_id")
    got = [(r.score >= T.THRESHOLD, r.toxic) for r in scores.collect() if r.toxic is not None]
    caught, toxic = sum(p for p, y in got if y), sum(y for _, y in got)
    flagged, clean = sum(p for p, y in got if not y), sum(not y for _, y in got)
    assert toxic >= 100 and caught >= 0.9 * toxic, (caught, toxic)
    assert flagged <= 0.01 * clean, (flagged, clean)


def test_copies_are_no_support(spark):
    r = random.Random(6)
    words = ["".join(r.choice("bdfgklmnprs") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    text = lambda *own: " ".join([*r.choices(words, k=30), *own, *r.choices(words, k=30)])
    copied = text("wretch", "onlyhere")
    rows = [(text("wretch"), 1) for _ in range(60)] + [(copied.replace(words[i % 9], "edited", 1), 1) for i in range(100)] + [(text(), 0) for _ in range(900)]
    d = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    assert T.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic")).words == ["wretch"]


def test_near_short_words_need_no_second_set_of_workers(spark, monkeypatch):
    counts = spark.createDataFrame([("sca", 0, 1), ("sxum", 0, 2), ("scuum", 0, 1), ("scuum", 1, 1), ("other", 0, 3), ("scum", 0, 1), ("scam", 0, 0)], "term string, size int, other long")
    own = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: own(self, data, *a, **b) if isinstance(data, pa.Table) else pytest.fail("rows that aren't Arrow's"))
    assert T.clean_near_short(counts, ["scum"]) == ["scuum", "sxum"]
    assert "ExistingRDD" not in local_rows(spark, {"key": pa.array(["a"])})._jdf.queryExecution().executedPlan().toString()
