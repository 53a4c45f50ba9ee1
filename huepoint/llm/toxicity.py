"""Toxicity by a lexicon trie and Levenshtein automata.

Terms are learned from labelled training rows: words, and stems (word beginnings that many words share). A
word or a stem must stand in at least ``SUPPORT`` toxic texts and there far more often than in others (``ODDS``),
in next to none of these. A stem that chance puts into more of them can still be a pair: it stands in a text
if two or more of its words begin so, which chance seldom does, and needs the same odds. Copies of a text are
no support: a term needs ``SUPPORT`` different pairs of words around it in toxic texts, and one for every four of these. The bar is the same at every size of the sample. They make a trie. The automaton that accepts
all words within one edit of a term (two for terms of ``TWO_EDITS`` letters; none for short ones and for
short stems) is the product of the trie with the Levenshtein automata of its terms; its states are sets
of (trie node, edits so far), worked out the first time that a word reaches them. So a word costs a step
for each letter until no term can match it. A word of four letters also counts with one letter replaced
or doubled, unless a training text that isn't toxic has it so.

One lone hit of a pair in a text is none. A hit between quotation marks, however far apart (a
mark before a word opens, one after a word closes, the last opening counts), or a window of ``WINDOW`` words with more quoted than direct hits, counts
as quotation; a window's direct hits count as abuse. A logistic model of these window scores gives the
score. Model and lexicon learn from at most ``SAMPLE_ROWS`` labelled rows, those whose ids' hashes are
smallest; every text is scored as a whole.

Null and empty texts have no hits and get the score of such a text. Labels of unknown documents and null
labels are not used; of several labels of a document the largest counts. Without training rows of both
kinds every score is the share of toxic ones (0 if there are none at all).
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huepoint.llm._store import local_rows, stash
from huepoint.llm._words import forget, give_back

SAMPLE_ROWS, SUPPORT, ODDS, APART = 20_000, 4, 30, 0.25
STEM_SIZES = (4, 5, 6)
ONE_EDIT, TWO_EDITS, STEM_EDIT, SHORT = 5, 9, 6, 4
WINDOW = 20
MEMO_WORDS = 200_000
THRESHOLD = 0.3

STRIP = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "“”„«»‘’‚‹›…¡¿–—"
OPENING, CLOSING, EITHER = "„‹", "”›", '"“«»'  # languages use some of them both ways

EXACT, STEM, FUZZY = 1, 2, 3
OPENS, CLOSES, EITHER_WAY, OF_PAIR = 4, 8, 16, 32


class Automaton:
    """Deterministic automaton of all words near a term; its states are found as they are needed."""

    def __init__(self, words: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.edits, self.stem_edits = [-1], [-1]  # allowed at a node that ends a word or a stem
        for term, marks, allowed in [(w, self.edits, 2 if len(w) >= TWO_EDITS else 1 if len(w) >= ONE_EDIT else 0) for w in words] + [(s, self.stem_edits, 1 if len(s) >= STEM_EDIT else 0) for s in stems]:
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.edits.append(-1)
                    self.stem_edits.append(-1)
                node = self.next[node][c]
            marks[node] = max(marks[node], allowed)
        # the most edits that a term at or below each node allows: a state beyond is dead
        self.most = [max(a, b) for a, b in zip(self.edits, self.stem_edits)]
        for node in range(len(self.next) - 1, -1, -1):
            self.most[node] = max([self.most[node], *(self.most[x] for x in self.next[node].values())])
        self.reset()

    def reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.stops: list[int] = []
        self.names: dict[tuple, int] = {}
        self._state({})  # 0 is the dead state
        self.start = self._state(self._skips({0: 0}))

    def _skips(self, state: dict[int, int]) -> dict[int, int]:
        """With letters of terms left out."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for x in self.next[node].values():
                if e + 1 <= self.most[x] and state.get(x, 99) > e + 1:
                    state[x] = e + 1
                    todo.append((x, e + 1))
        return state

    def _state(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            kind = lambda marks, exact: min([exact if e == 0 else FUZZY for n, e in key if e <= marks[n]], default=0)
            self.ends.append(kind(self.edits, EXACT))
            self.stops.append(kind(self.stem_edits, STEM))
        return self.names[key]

    def _step(self, s: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[s].items():
            if e + 1 <= self.most[node]:
                out[node] = min(out.get(node, 99), e + 1)  # a letter too many
            for letter, x in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.most[x]:
                    out[x] = min(out.get(x, 99), cost)
        t = self.steps[s][c] = self._state(self._skips(out))
        return t

    def match(self, word: str) -> int:
        """EXACT, STEM, FUZZY or 0."""
        if len(self.states) > 20_000:
            self.reset()
        s, best = self.start, 99
        for c in word:
            t = self.steps[s].get(c)
            s = self._step(s, c) if t is None else t
            if not s:
                break
            if self.stops[s]:
                best = min(best, self.stops[s])
        else:
            if self.ends[s]:
                best = min(best, self.ends[s])
        return 0 if best == 99 else best


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    pairs: list[str] = field(default_factory=list)  # stems that count at two words and more
    weights: list[float] = field(default_factory=list)
    base: float = 0.0
    clean: list[str] = field(default_factory=list)  # words one edit from a word of SHORT letters that aren't misspellings of it


def edits_of_short(word: str) -> list[str]:
    """What a word of SHORT letters has in common with those that have another letter in place of one, or one twice."""
    if len(word) == SHORT:
        return [f"{word[:i]}*{word[i + 1 :]}" for i in range(SHORT)]
    if len(word) == SHORT + 1:
        return [word[:i] + word[i + 1 :] for i in range(SHORT) if word[i] == word[i + 1]]
    return []


def keys_of_short(words: list[str]) -> set[str]:
    return {x for w in words if len(w) == SHORT for x in (w, *edits_of_short(w))}


def most_in_window(direct: np.ndarray, quoted: np.ndarray) -> int:
    """The most direct less quoted hits within WINDOW words of a direct one, of all; places in order."""
    if not len(direct):
        return 0
    near = lambda x: np.searchsorted(x, direct + WINDOW, "right") - np.searchsorted(x, direct - WINDOW, "left")
    return int((near(direct) - near(quoted)).max())


class Scorer:
    def __init__(self, model: Model):
        self.automaton, self.known = Automaton(model.words, model.stems), {}
        self.pairs, self.sizes = set(model.pairs), sorted({len(t) for t in model.pairs})
        self.short, self.clean = keys_of_short(model.words), set(model.clean)

    def match(self, word: str) -> int:
        found = self.automaton.match(word)
        if not found and SHORT <= len(word) <= SHORT + 1 and word not in self.clean and any(x in self.short for x in edits_of_short(word)):
            return FUZZY
        return found

    def code(self, raw: bytes) -> int:
        """Kind of hit, plus marks: the word opens or closes a quotation, is a mark that can do either, is a hit of a pair."""
        word = raw.decode()
        core = word.strip(STRIP)
        c = self.match(core.lower()) if core else 0
        if c not in (EXACT, STEM) and any(core.lower()[:n] in self.pairs for n in self.sizes):
            c = STEM | OF_PAIR
        head, tail = word[: len(word) - len(word.lstrip(STRIP))], word[len(word.rstrip(STRIP)) :]
        if not core:
            return c | OPENS * any(x in OPENING for x in word) | CLOSES * any(x in CLOSING for x in word) | EITHER_WAY * (sum(x in EITHER for x in word) % 2)
        return c | OPENS * any(x in OPENING or x in EITHER for x in head) | CLOSES * any(x in CLOSING or x in EITHER for x in tail)

    def features(self, text: bytes | None) -> list[float]:
        words = text.split() if text else []
        known, codes = self.known, []
        if len(known) > MEMO_WORDS:
            known.clear()
        for w in words:
            c = known.get(w)
            if c is None:
                c = known[w] = self.code(w)
            codes.append(c)
        lone = sum(c >= OF_PAIR for c in codes) == 1
        hits = [(i, c & 3) for i, c in enumerate(codes) if c & 3 and not (lone and c >= OF_PAIR)]
        if not hits:
            return [0.0] * 6
        spans, open_at = [], -1  # quotations
        for i, c in enumerate(codes):
            if c & OPENS or c & EITHER_WAY and open_at < 0:
                open_at = i
            if open_at >= 0 and (c & CLOSES or c & EITHER_WAY and open_at < i):
                spans.append((open_at, i))  # in order, no two share a word
                open_at = -1
        firsts = [a for a, _ in spans]
        quoted = {i for i, _ in hits if (n := bisect_right(firsts, i)) and i <= spans[n - 1][1]}
        direct = [(i, k) for i, k in hits if i not in quoted]
        window = most_in_window(np.array([i for i, _ in direct]), np.array(sorted(quoted)))
        times = [sum(k == x for _, k in direct) for x in (EXACT, STEM, FUZZY)]
        return [*(math.log1p(t) for t in times), math.log1p(len(quoted)), math.log1p(max(0, window)), math.log1p(1000 * len(direct) / len(words))]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts hold each word (sized 0), each stem, and each stem at two words or more (sized below 0)."""
    forget()
    counts: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])

    def rows() -> pa.RecordBatch:
        k, v = list(counts), list(counts.values())
        return pa.record_batch({"term": pa.array([x[0] for x in k], pa.string()), "size": pa.array([x[1] for x in k], pa.int32()), "toxic": pa.array([x[0] for x in v], pa.int64()), "other": pa.array([x[1] for x in v], pa.int64())})

    for b in batches:
        for text, label in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
            own, begun = set(), Counter()
            for raw in (text or b"").split():
                w = raw.decode().strip(STRIP).lower()
                if w:
                    own.add((w, 0))
                    begun.update((w[:n], n) for n in STEM_SIZES if len(w) >= n)
            own.update(begun)
            own.update((t, -n) for (t, n), times in begun.items() if times > 1)
            for x in own:
                counts[x][0 if label else 1] += 1
        if len(counts) > 500_000:
            yield rows()
            counts.clear()
    yield rows()
    counts.clear()
    give_back()


def _terms_of(word: str) -> list[tuple[str, int]]:
    return [(word, 0), *((word[:n], n) for n in STEM_SIZES if len(word) >= n), *((word[:n], -n) for n in STEM_SIZES if len(word) >= n)]


def _around(candidates: set[tuple[str, int]]):
    """Each candidate in a text with the words before and after it, hashed."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for text in b["text"].to_pylist():
                words = ["", *(raw.decode().strip(STRIP).lower() for raw in (text or b"").split()), ""]
                for i in range(1, len(words) - 1):
                    own = [x for x in _terms_of(words[i]) if x in candidates]
                    if own:
                        around = zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode())
                        found.update((*x, around) for x in own)
            rows = sorted(found)
            yield pa.record_batch({"term": pa.array([r[0] for r in rows], pa.string()), "size": pa.array([r[1] for r in rows], pa.int32()), "around": pa.array([r[2] for r in rows], pa.int64())})

    return fn


def longest(real: dict[str, int]) -> set[str]:
    """Of nested stems the longest that loses next to none of the texts; ``real``: toxic texts of each."""
    sizes = {len(t) for t in real}
    beyond: dict[str, int] = defaultdict(int)  # of each beginning, the most texts of a longer stem
    for t, toxic in real.items():
        for n in sizes:
            if n < len(t):
                beyond[t[:n]] = max(beyond[t[:n]], toxic)
    kept = {s for s in real if s not in beyond or beyond[s] < 0.95 * real[s]}
    return {s for s in kept if not any(n < len(s) and s[:n] in kept and real[s[:n]] > real[s] for n in sizes)}


def lexicon(rows: list[tuple[str, int, int, int]]) -> tuple[list[str], list[str], list[str]]:
    """Words, stems and pairs from (term, size, toxic texts with it, longer words of toxic texts that begin with it) of the candidates."""
    stems = longest({t: toxic for t, n, toxic, longer in rows if n > 0 and longer >= 3})
    begins = lambda t, kept: any(t[:n] in kept for n in range(1, len(t) + 1))
    pairs = {t for t in longest({t: toxic for t, n, toxic, longer in rows if n < 0 and longer >= 3}) if not begins(t, stems)}
    return [t for t, n, *_ in rows if not n and not begins(t, stems | pairs)], sorted(stems), sorted(pairs)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept first, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(docs: DataFrame, model: Model, keep: list[str], schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = Scorer(sent.value)
        for b in batches:
            got = [scorer.features(t.as_py()) for t in b["text"]]
            yield pa.record_batch({c: b[c] for c in keep} | {"features": pa.array(got, pa.list_(pa.float64()))})

    return docs.mapInArrow(fn, f"{schema}, features array<double>")


def clean_near_short(counts: DataFrame, words: list[str]) -> list[str]:
    """The words of other than toxic texts that are one edit from one of ``words`` of SHORT letters."""
    short = sorted(keys_of_short(words))
    if not short:
        return []
    near = counts.filter(f"size = 0 and other > 0 and length(term) between {SHORT} and {SHORT + 1}").select("term", F.explode(F.udf(edits_of_short, "array<string>")("term")).alias("key"))
    keys = local_rows(counts.sparkSession, {"key": pa.array(short, pa.string())})
    own = set(words)
    return sorted(r["term"] for r in near.join(F.broadcast(keys), "key").select("term").distinct().collect() if r["term"] not in own)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """``labels(doc_id, toxic)``: training rows only. Learns from the ``sample_rows`` whose ids have the smallest hashes."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # at most sample_rows rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    base = toxic / (toxic + other) if toxic + other else 0.0
    if not toxic or not other:
        return Model(base=base)
    counts = stash(texts.select("text", "toxic").mapInArrow(_terms, "term string, size int, toxic long, other long").groupBy("term", "size").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    seen, counts = counts, counts.filter("toxic > 0")
    odds = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + 0.5) / (other + 1))
    mostly = (F.col("size") < 0) | (F.col("other") <= F.col("toxic") * 0.02)
    top = counts.filter((F.col("toxic") >= SUPPORT) & (odds >= ODDS) & mostly)
    sizes = F.explode(F.array(*[F.lit(n) for n in STEM_SIZES])).alias("size")
    words = counts.filter("size = 0").select("term", sizes).filter(F.length("term") > F.col("size"))
    longer = words.groupBy(F.expr("substr(term, 1, size)").alias("term"), "size").agg(F.count(F.lit(1)).alias("longer"))
    top = top.join(longer.withColumnRenamed("size", "letters"), (F.col("letters") == F.abs("size")) & (top["term"] == longer["term"]), "left").select(top["term"], "size", "toxic", F.coalesce("longer", F.lit(0)).alias("longer"))
    chosen = [tuple(r) for r in top.orderBy(F.desc("toxic"), "term", "size").collect()]
    around = texts.filter("toxic = 1").select("text").mapInArrow(_around({(t, n) for t, n, *_ in chosen}), "term string, size int, around long")
    apart = {(r["term"], r["size"]): r["n"] for r in around.distinct().groupBy("term", "size").agg(F.count(F.lit(1)).alias("n")).collect()}
    words, stems, pairs = lexicon([x for x in chosen if apart.get(x[:2], 0) >= max(SUPPORT, APART * x[2])])
    model = Model(words, stems, pairs, base=base, clean=clean_near_short(seen, words))
    rows = _featured(texts.select("text", "toxic", "doc_id"), model, ["doc_id", "toxic"], "doc_id long, toxic int").orderBy("doc_id", "toxic").collect()
    model.weights = logistic(np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], float)).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in 0 to 1."""
    rows = _featured(docs.select("doc_id", F.col("text").cast("binary").alias("text")), model, ["doc_id"], "doc_id long")
    if not model.weights:
        return rows.select("doc_id", F.lit(float(model.base)).alias("score"))
    total = F.lit(model.weights[0])
    for i, w in enumerate(model.weights[1:]):
        total = total + F.lit(w) * F.col("features")[i]
    return rows.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias("score"))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, in one pass; only texts go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        scorer, w = Scorer(sent.value), np.array(sent.value.weights)
        for texts in batches:
            if len(w):
                x = np.array([scorer.features(t.as_py()) for t in texts], float).reshape(len(texts), -1)
                scores = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
            else:
                scores = np.full(len(texts), sent.value.base)
            give_back()
            yield pa.array(scores < threshold)

    return docs.filter(keep(F.col("text").cast("binary")))


def fold(doc_id: str, of: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """From the labels that aren't held out."""
    return fit(docs, labels.select("doc_id", "toxic").filter(~held_out()), sample_rows)
