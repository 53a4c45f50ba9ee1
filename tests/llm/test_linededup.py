import random

from huepoint.llm import linededup


def reference(docs, min_sites):
    sites = {}
    for _, text, site in docs:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(site)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    for i, text, _ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad]
        yield i, sum(bool(x.strip(" ")) for x in lines), len(lines) - len(kept), "\n".join(kept)


def rows(spark, docs, **kw):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, hash int, site string")
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in linededup.remove_boilerplate(df, **kw).collect()), key=str)


def test_equals_exact_counts_on_both_sides_of_the_threshold(spark):
    r = random.Random(3)
    docs = []
    for k in range(40):  # line k stands in k sites, some often
        for s in range(k):
            docs += [(len(docs), f"own {len(docs)}\n  line {k} \n\nline {k}\r" if r.random() < 0.5 else f"line {k}", f"site{s}")] * r.randint(1, 2)
    docs = [(i, t, s) for i, (_, t, s) in enumerate(docs)] + [(9000, None, "site1"), (9001, "", None), (9002, "line 12", None), (9003, "\n \n", "site2"), (9003, "line 30", "site2"), (9003, "line 2", "site2")]
    assert rows(spark, docs, min_sites=12) == sorted(reference(docs, 12), key=str)


def test_near_the_threshold_counts_are_exact_though_sketches_are_coarse(spark):
    docs = [(k * 1000 + s, f"line {k}", f"site{s}") for k in range(180, 221, 4) for s in range(k)]
    assert rows(spark, docs, min_sites=200, lg_k=8) == sorted(reference(docs, 200), key=str)


def test_empty_table(spark):
    assert rows(spark, [], min_sites=2) == []


def test_lines_of_a_third_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr("huepoint.llm._store.HOT_KEYS", 20)  # a twentieth of all rows is hot
    r = random.Random(5)
    docs = [(i, "\n".join(["license", "seldom" if i % 90 == 0 else f"own {i}", f"word {r.randrange(40)}"][i % 3 > 0 :]), f"site{r.randrange(30)}") for i in range(900)]
    docs += [(i, "few sites\nfew sites", f"site{i % 9}") for i in range(1000, 1300)]
    assert rows(spark, docs, min_sites=10) == sorted(reference(docs, 10), key=str)
