import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from huepoint.llm import _seating as S
from huepoint.llm import _words as W
from huepoint.llm import entries
from huepoint.llm import pitmanyor as P


def corpus(seed=2, n=150):
    r = random.Random(seed)
    words = ["The", "the", "é", "of,"] + [f"w{i}" for i in range(60)]
    follow = {w: [r.choice(words) for _ in range(4)] for w in words}
    docs = []
    for i in range(n):
        w, out = r.choice(words), []
        for _ in range(r.choice([0, 1, 5, 40])):
            out.append(w)
            w = r.choice(follow[w]) if w in follow and r.random() < 0.8 else r.choice(words + [f"rare{i}"])
        docs.append((i, r.choice([" ", " \n", "\t"]).join(out)))
    return docs + [(9000, None), (9001, ""), (9002, "the the the"), (9002, "the the the"), (None, "no id")]


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def counted(docs):
    word, pair, texts = Counter(), Counter(), 0
    for i, t in docs:
        if not P.held_out(i):
            w = tokens(t)
            word.update(w)
            pair.update(zip(["<s>", *w[:-1]], w))
            texts += 1
    return word, pair, texts


def test_one_table_for_each_pair_equals_brute_force(spark):
    """The state before any sweep, which burn_in = 0 keeps: one table a pair, one a word at the parent."""
    docs = corpus()
    word, pair, texts = counted(docs)
    total, known = sum(word.values()), len(word)
    tables, customers = Counter(v for v, _ in pair), Counter(w for _, w in pair)
    once, twice = (sum(c == x for c in pair.values()) for x in (1, 2))
    d = once / (once + 2 * twice)
    parent = lambda w: (max(customers[w] - P.PARENT_DISCOUNT, 0) + (P.PARENT_STRENGTH + P.PARENT_DISCOUNT * known) / (known + 1)) / (len(pair) + P.PARENT_STRENGTH)
    want = []
    for i, t in docs:
        w, score, base = tokens(t), 0.0, 0.0
        for v, x in zip(["<s>", *w[:-1]], w):
            seen = texts if v == "<s>" else word[v]
            own = max(pair[v, x] - d, 0) if pair[v, x] else 0
            score += math.log10((own + (P.STRENGTH + d * tables[v]) * parent(x)) / (P.STRENGTH + seen))
            base += math.log10((word[x] + 0.1) / (total + 0.1 * (known + 1)))
        want.append((i, P.held_out(i), len(w), sum(word[x] > 0 for x in w), total, pytest.approx(base, abs=1e-6), pytest.approx(score, abs=1e-6)))
    got = [tuple(r) for r in P.scored(spark.createDataFrame([(*x, 1, "a") for x in docs], "doc_id long, text string, score int, chunk string"), 0, 1).collect()]
    key = lambda r: (str(r[0]), r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def brute_gibbs(pairs, d, known, sweeps, keep, seed):
    """Plain Gibbs, one customer after another, with all seats: the predictive numbers of each kept state."""
    r = random.Random(seed)
    seats, parent = {x: [] for x in pairs}, {w: [] for _, w in pairs}
    open_at = Counter()
    n = [0, 0]  # customers and tables of the parent
    base = 1 / (known + 1)

    def chance(w):
        return (sum(parent[w]) - P.PARENT_DISCOUNT * len(parent[w]) + (P.PARENT_STRENGTH + P.PARENT_DISCOUNT * n[1]) * base) / (P.PARENT_STRENGTH + n[0])

    def sit(x):
        v, w = x
        k = r.choices(range(len(seats[x]) + 1), [s - d for s in seats[x]] + [(P.STRENGTH + d * open_at[v]) * chance(w)])[0]
        if k < len(seats[x]):
            seats[x][k] += 1
            return
        seats[x].append(1)
        open_at[v] += 1
        k = r.choices(range(len(parent[w]) + 1), [s - P.PARENT_DISCOUNT for s in parent[w]] + [(P.PARENT_STRENGTH + P.PARENT_DISCOUNT * n[1]) * base])[0]
        n[0] += 1
        if k < len(parent[w]):
            parent[w][k] += 1
        else:
            parent[w].append(1)
            n[1] += 1

    def leave(x):
        v, w = x
        k = r.choices(range(len(seats[x])), seats[x])[0]
        seats[x][k] -= 1
        if seats[x][k]:
            return
        del seats[x][k]
        open_at[v] -= 1
        k = r.choices(range(len(parent[w])), parent[w])[0]
        parent[w][k] -= 1
        n[0] -= 1
        if not parent[w][k]:
            del parent[w][k]
            n[1] -= 1

    customers = [x for x, c in pairs.items() for _ in range(c)]
    for x in customers:
        sit(x)
    out = []
    for s in range(sweeps):
        for x in customers:
            leave(x)
            sit(x)
        if s >= sweeps - keep:
            out.append(({x: len(t) for x, t in seats.items()}, Counter(open_at), {w: chance(w) for w in parent}, (P.PARENT_STRENGTH + P.PARENT_DISCOUNT * n[1]) * base / (P.PARENT_STRENGTH + n[0])))
    return out


def test_registered_settings_agree_with_plain_gibbs(spark):
    """Scores at the registered burn-in and samples, against the mean of 60 states of the plain sampler."""
    docs = corpus(4, 250)
    word, pair, texts = counted(docs)
    once, twice = (sum(c == x for c in pair.values()) for x in (1, 2))
    d = once / (once + 2 * twice)
    states = brute_gibbs(dict(pair), d, len(word), 80, 60, 1)
    got = {r.doc_id: r for r in P.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    off = []
    for i, t in docs:
        w, score = tokens(t), 0.0
        for v, x in zip(["<s>", *w[:-1]], w):
            seen = texts if v == "<s>" else word[v]
            p = sum(max(pair[v, x] - d * s.get((v, x), 0), 0) + (P.STRENGTH + d * at[v]) * there.get(x, unknown) for s, at, there, unknown in states)
            score += math.log10(p / len(states) / (P.STRENGTH + seen))
        off.append((got[i].score - score) / len(w))  # for each token
    assert np.abs(off).max() < 0.15 and np.std(off) < 0.03 and abs(np.mean(off)) < 0.005


def test_tables_are_drawn_as_a_plain_sampler_draws_them():
    """Over 1,500 sweeps on a small restaurant with frequent pairs: mean numbers of tables here and at the parent."""
    r = np.random.default_rng(1)
    c = {(v, w): int(r.geometric(0.15)) for v in range(6) for w in range(15) if r.random() < 0.4} | {(0, 0): 60, (1, 0): 40}
    states = brute_gibbs(c, 0.6, 15, 1200, 1100, 2)
    keys = list(c)
    n, v, w = np.array(list(c.values())), np.array([k[0] for k in keys]), np.array([k[1] for k in keys])
    t, parents, sums = np.ones(len(n), np.int64), np.bincount(w, minlength=15).clip(0, 1), []
    model, key, word_key = (P.STRENGTH, 0.6, P.PARENT_STRENGTH, P.PARENT_DISCOUNT), np.arange(len(n)).astype(np.uint64), np.arange(15).astype(np.uint64)
    for sweep in range(1500):
        tables, customers = np.bincount(v, t, 6).astype(np.int64), np.bincount(w, t, 15).astype(np.int64)
        some = np.flatnonzero(customers)
        parents = np.minimum(np.maximum(parents, np.minimum(customers, 1)), customers)
        parents[some] = S.parent_tables(customers[some], parents[some], int(parents.sum()), 1 / 16, model, word_key[some], 2 * sweep)
        sums.append((t.sum(), t[keys.index((0, 0))], t[keys.index((1, 0))]))
        t = S.pair_tables(n, t, tables[v], customers[w], parents[w], int(customers.sum()), model, key, 2 * sweep + 1)
    got = np.mean(sums[100:], 0)
    want = np.mean([(sum(s.values()), s[0, 0], s[1, 0]) for s, *_ in states], 0)
    assert got == pytest.approx(want, rel=0.1)


@pytest.mark.parametrize("d", [0.3, 0.5, 0.75, 0.9])
def test_stirling_numbers_beyond_the_table(d):
    exact, own = S.exact_table(d, 1500), S.stirling(d)
    for c in (50, 192, 193, 400, 1500):
        t = np.unique(np.array([1, 2, 3, 7, int(c**d / 2), int(c**d), c // 2, c - 1, c]).clip(1, c))
        assert own(np.full(len(t), c), t) == pytest.approx(exact[c, t], abs=0.12)
    assert np.isneginf(own(np.array([3, 500, 5]), np.array([4, 501, 0]))).all()
    assert S.gammaln(np.array([0.1, 1, 5.5, 80])) == pytest.approx([math.lgamma(x) for x in (0.1, 1, 5.5, 80)], abs=1e-8)


def test_sweeps_help_held_out_texts_and_repeat(spark):
    docs = corpus(3, 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = ({(r.doc_id, r.n_tokens): r for r in P.scored(x).collect()} for x in (df, df.repartition(5)))
    assert all(b[k].score == pytest.approx(r.score, abs=1e-9) for k, r in a.items())
    held = [r for r in a.values() if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held) + 20


def test_untrained_and_empty(spark):
    out = next(i for i in range(100) if P.held_out(i))
    rows = P.scored(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0)]
    assert P.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_base_columns_alone_are_those_of_the_scores_and_draw_nothing(spark):
    docs = spark.createDataFrame(corpus(5, 200), "doc_id long, text string")
    alone, full = P.base_scored(docs), P.scored(docs).drop("score")
    assert sorted(map(str, alone.collect())) == sorted(map(str, full.collect()))
    assert P.base_scored(docs.limit(0)).count() == 0


def test_base_scores_count_no_pairs(spark):
    plan = entries.lm_base_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InArrow") < 12  # 300 with pairs and sweeps


def test_growth_is_worked_out_once_a_word_and_gammas_once_a_number(monkeypatch):
    """20,000 pairs of three frequent words: before, each pair's growth and gammas were worked out by themselves."""
    r, met = np.random.default_rng(3), Counter()
    word = r.integers(0, 3, 20_000)
    customers, parents = np.array([5000, 700, 5000])[word], np.array([300, 90, 300])[word]
    c, now, tables = r.integers(2, 9, len(word)), np.ones(len(word), np.int64), r.integers(5, 400, len(word))
    saddle, gammaln = S.saddle, S.gammaln
    monkeypatch.setattr(S, "saddle", lambda c, *a: (met.update(saddle=len(c)), saddle(c, *a))[1])
    monkeypatch.setattr(S, "gammaln", lambda x: (met.update(gamma=len(x)), gammaln(x))[1])
    model, key = (P.STRENGTH, 0.6, P.PARENT_STRENGTH, P.PARENT_DISCOUNT), np.arange(len(word)).astype(np.uint64)
    S.stirling(0.6), S.stirling(P.PARENT_DISCOUNT)
    met.clear()
    got = S.pair_tables(c, now, tables, customers, parents, 6000, model, key, 1)
    assert met["saddle"] == 2 and met["gamma"] < 10_000
    some = np.arange(0, len(word), 997)  # each alone, where there is nothing to share
    alone = [S.pair_tables(c[i : i + 1], now[i : i + 1], tables[i : i + 1], customers[i : i + 1], parents[i : i + 1], 6000, model, key[i : i + 1], 1)[0] for i in some]
    assert got[some].tolist() == alone


@pytest.mark.parametrize("d", [0.05, 0.5, 0.75, 0.95])
def test_saddle_points_solve_their_equation(d):
    c = np.repeat([193.0, 1e4, 1e7, 1e10], 6)
    t = np.tile([0.002, 0.01, 0.1, 0.5, 0.9, 0.998], 4) * c
    y = S.saddle(c, t, d)
    mean = d * -np.expm1(y) / -np.expm1(d * y) * np.exp((d - 1) * y)  # customers a table at that point
    assert mean[y > -600] == pytest.approx((c / t)[y > -600], rel=1e-9)


def test_distinct_words_are_those_of_bytes_split():
    texts = [None, b"", b" \t\n\x0b\x0c\r", b"A b\x1ca\x1f\xc2\xa0a\xc2\x85 \xe2\x80\x83a B", b"\xff\xfeA \x00  \xff\xfea\n", b"  lead trail  ", "É é".encode()]
    for some in (texts, texts[:3], []):
        distinct, at, sizes = W.distinct_words(some, lower=True)
        words = [W.blank_words(x, lower=True) for x in some]
        assert sizes.tolist() == [len(w) for w in words]
        assert distinct[at].tolist() == [int(v) for w in words for v in W.values(w)] and len(set(distinct.tolist())) == len(distinct)


def test_numbered_keys():
    r = np.random.default_rng(2)
    near = np.uint64(1) << np.uint64(63) | np.arange(50, dtype=np.uint64)  # equal in all leading bits
    for keys in (r.integers(0, 1 << 64, 5000, np.uint64), r.integers(0, 40, 900).astype(np.uint64), np.append(r.permutation(np.tile(near, 3)), np.uint64(3)), np.full(7, 9, np.uint64), near[:0]):
        distinct, place = W.numbered(keys)
        want, at = np.unique(keys, return_inverse=True)
        assert distinct.tolist() == want.tolist() and place.tolist() == at.tolist()
