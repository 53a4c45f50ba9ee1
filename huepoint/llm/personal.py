"""Personal data: patterns, and a linear-chain conditional random field for what is written otherwise.

Four kinds: email, ip, card, phone. The patterns find the plain forms (``base_spans``). The field reads tokens
(runs of letters, runs of digits, single marks) as classes of word shape: case and length of words, length of
numbers, the mark itself, what stands before, and a few cue words that the labelled table holds near personal
data. It is trained from a small table of labelled snippets and decoded by Viterbi; a stretch that it finds
counts if its characters can be of the kind at all (an address once "at" and "dot" are put back, four numbers
up to 255, 12 to 19 digits that pass Luhn's test, 9 to 15 digits) and if it touches no span of the patterns.

``labelled`` makes the table from the documents: snippets of at most ``SAMPLE_DOCS`` documents (those whose ids'
hashes are smallest), each with a value of a kind, or with something that only looks like it, written in at a
word's end; so context is the corpus's own and labels are known, whether or not the sample holds personal data.
At most ``SAMPLE_ROWS`` snippets are used. A table labelled by hand with the same columns serves as well.

Spans count code points, end exclusive. Null and empty texts have no spans. Every text is read as a whole,
however long. Rows that repeat an id are a row each; other columns are ignored. Without labelled rows the
field finds nothing and the patterns' spans are all.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huepoint.llm import _chain
from huepoint.llm._words import give_back

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_ROWS, SNIPPETS = 2_000, 4_000, 2
CUES, NEAR = 64, 3
GROUP_CHARS = 1 << 20

SPAN = "array<struct<kind: int, start: bigint, end: bigint>>"
Span = tuple[int, int, int]  # start, kind, end

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_card(text: str) -> bool:
    d = digits_of(text)
    return 12 <= len(d) <= 19 and luhn(d)


def is_ip(text: str) -> bool:
    parts = re.findall("[0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start, then kind. Each character is looked at a bounded number of times."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1  # no part before an address reaches over an @
        at = text.find("@", done)
    for kind, pattern, fine in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, lambda x: 9 <= len(digits_of(x)) <= 15)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if fine(m[0])]
    return sorted(out)


# Tokens and their classes


SPACE, NEWLINE, LETTER, UPPER, DIGIT, OTHER, BREAK = 0, 1, 2, 3, 4, 5, 6  # kinds of characters; marks follow
MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
STOP = 0x110000  # between texts; no character


def _kinds() -> np.ndarray:
    out = np.full(0x250, LETTER, np.uint8)
    out[:0x21] = SPACE
    out[[0x0A, 0x0D, 0x0B, 0x0C]] = NEWLINE
    out[0x30:0x3A], out[0x41:0x5B] = DIGIT, UPPER
    for i, c in enumerate(MARKS):
        out[c] = BREAK + 1 + i
    out[0x7F:0xC0] = OTHER
    out[[0x85, 0xA0]] = SPACE
    out[0xC0:0xDF] = UPPER
    out[[0xD7, 0xF7]] = OTHER
    return out


TABLE = _kinds()
#: Lengths of words and numbers from which a new class begins.
WORD_SIZES, NUMBER_SIZES = np.array([2, 3, 4, 7]), np.array([2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 16, 17, 20])
BASE_MARK = 1  # after the class of a break
BASE_WORD = BASE_MARK + len(MARKS) + 1
BASE_NUMBER = BASE_WORD + 4 * (len(WORD_SIZES) + 1)
BASE_CUE = BASE_NUMBER + len(NUMBER_SIZES) + 2  # numbers of three digits up to 255 have their own
B = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(B), -1, 1 << 64))


def classes(cues: int) -> int:
    return 3 * (BASE_CUE + cues)


def word_hash(word: str) -> int:
    value, power = 0, 1
    for c in word:
        value, power = (value + ord(c) * power) % (1 << 64), power * int(B) % (1 << 64)
    return value


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray


def tokens_of(codes: np.ndarray, cues: np.ndarray, block: int = GROUP_CHARS) -> Tokens:
    """Of code points (STOP between texts); ``cues``: sorted hashes of lower-cased cue words. Works through blocks that end where a token does."""
    n = len(codes)
    kind = np.full(n, LETTER, np.uint8)
    low = codes < len(TABLE)
    kind[low] = TABLE[codes[low]]
    kind[(codes >= 0x2000) & (codes <= 0x200B) | (codes == 0x3000)] = SPACE
    kind[(codes >= 0x2010) & (codes <= 0x206F)] = OTHER
    kind[codes == STOP] = BREAK
    group = np.array([0, 0, 1, 1, 2, 3, 3], np.uint8)[np.minimum(kind, BREAK)]  # runs of 0 to 2 hold together
    begins = np.ones(n, bool)
    begins[1:] = (group[1:] != group[:-1]) | (group[1:] == 3)
    got: list[Tokens] = []
    at = 0
    while at < n:
        stop = min(n, at + block)
        if stop < n:
            cut = np.flatnonzero(begins[at + 1 : stop + 1])
            if len(cut):
                stop = at + 1 + int(cut[-1])
            else:  # one run holds the block
                rest = begins[stop:].argmax()
                stop = stop + int(rest) if rest or begins[stop] else n
        s = np.flatnonzero(begins[at:stop]) + at
        e = np.append(s[1:], stop)
        real = group[s] > 0
        s, e = s[real], e[real]
        g, first = group[s], kind[s]
        size = e - s
        base = np.zeros(len(s), np.int64)
        mark = g == 3
        base[mark] = np.where(first[mark] == OTHER, BASE_MARK + len(MARKS), np.where(first[mark] == BREAK, 0, first[mark].astype(np.int64) - (BREAK + 1) + BASE_MARK))
        # words: lower, capital first, all capitals, else mixed
        c = codes[at:stop].astype(np.uint64)
        upper = kind[at:stop] == UPPER
        c[upper] += np.uint64(32)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(c) - 1, B)]))
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(c) - 1, INVERSE)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power)])
        uppers = np.concatenate([np.zeros(1, np.int64), np.cumsum(upper)])
        word = g == 1
        ws, we = s[word] - at, e[word] - at
        caps = uppers[we] - uppers[ws]
        shape = np.where(caps == 0, 0, np.where((caps == 1) & upper[ws], 1, np.where(caps == we - ws, 2, 3)))
        base[word] = BASE_WORD + 4 * np.searchsorted(WORD_SIZES, size[word], "right") + shape
        if len(cues):
            value = (sums[we] - sums[ws]) * back[ws]
            place = np.minimum(np.searchsorted(cues, value), len(cues) - 1)
            known = cues[place] == value
            base[np.flatnonzero(word)[known]] = BASE_CUE + place[known]
        number = g == 2
        ns = s[number]
        three = size[number] == 3
        d = lambda k: codes[np.minimum(ns + k, n - 1)].astype(np.int64) - 48
        small = three & (100 * d(0) + 10 * d(1) + d(2) <= 255)
        base[number] = np.where(small, BASE_NUMBER + len(NUMBER_SIZES) + 1, BASE_NUMBER + np.searchsorted(NUMBER_SIZES, size[number], "right"))
        before = np.where(s > 0, kind[np.maximum(s - 1, 0)], NEWLINE)
        gap = np.where((before == NEWLINE) | (before == BREAK), 2, np.where(before == SPACE, 1, 0))
        ids = np.where(base > 0, 3 * base + gap, 0)
        got.append(Tokens(s, e, ids.astype(np.int32)))
        at = stop
    join = lambda name, kind: np.concatenate([getattr(t, name) for t in got]) if got else np.empty(0, kind)
    return Tokens(join("start", np.int64), join("end", np.int64), join("ids", np.int32))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points with breaks between them, and where each begins."""
    parts, at, first = [], 0, []
    gap = np.full(_chain.REACH, STOP, np.uint32)
    for t in texts:
        first.append(at)
        parts += [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), gap]
        at += len(t) + len(gap)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.array(first, np.int64)


# The labelled table


NAMES = "anna ben carla david elena frank grace hugo ines jonas karin leon marta nina oscar paula quentin rosa sven tina uwe vera will xenia yves zoe info sales office contact".split()
ENDS = "com org net de fr es it eu info co.uk edu".split()


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, n: int) -> str:
    body = r.choice("3456") + _number(r, n - 2)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _address(r: random.Random, word: str) -> str:
    local = r.choice([*NAMES, word, _number(r, 2)]) + r.choice(["", "", "." + r.choice(NAMES), _number(r, 2), "_" + word])
    domain = r.choice(["mail", "example", "post", "web", word, "my-site"]) + r.choice(["", "", _number(r, 1)]) + "." + r.choice(ENDS)
    a, d = r.choice([("@", ".")] * 2 + [(f"{o}{x}{c}", f"{o}{y}{c}") for x, y in (("at", "dot"), ("AT", "DOT")) for o, c in ((" ", " "), (" (", ") "), (" [", "] "), ("(", ")"), ("[", "]"), (" {", "} "), ("_", "_"))] + [(" @ ", "."), (" @ ", " . "), (" at ", "."), (" (at) ", "."), ("[at]", "."), ("@", " dot "), ("@", "[.]"), ("@", "(dot)")])
    return local.replace(".", d if r.random() < 0.7 else ".") + a + domain.replace(".", d)


def _ip(r: random.Random, word: str) -> str:
    dot = r.choice([".", "[.]", " . ", " dot ", "(.)", "[dot]", "(dot)", ". "])
    return dot.join(str(r.randrange(256)) for _ in range(4))


def _long_card(r: random.Random, word: str) -> str:
    n = r.choice([16, 16, 16, 15, 14, 13])
    d = _card(r, n)
    cuts = [0, 4, 8, 12, 16] if n == 16 else [0, 4, 10, n]
    return d if r.random() < 0.2 else r.choice([" ", "-", ".", "/", "_", "  ", " - ", ", "]).join(d[a:b] for a, b in zip(cuts, cuts[1:]))


def _phone(r: random.Random, word: str) -> str:
    n = lambda k: r.choice("123456789") + _number(r, k - 1)
    s = r.choice([" ", "-", ".", "/"])
    return r.choice([
        lambda: f"+1 ({n(3)}) {n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)}{s}{n(4)}", lambda: f"{n(3)}{s}{n(3)}{s}{n(4)}", lambda: f"1{s}{n(3)}{s}{n(3)}{s}{n(4)}", lambda: f"001{s}{n(3)}{s}{n(3)}{s}{n(4)}",
        lambda: f"+{n(2)}{s}{n(2)}{s}{n(4)}{s}{n(4)}", lambda: f"00{n(2)}{s}{n(2)}{s}{n(4)}{s}{n(4)}", lambda: f"0{n(1)}{s}{n(2)}{s}{n(2)}{s}{n(2)}{s}{n(2)}", lambda: f"({n(3)}){n(3)}-{n(4)}", lambda: f"0{n(2)}/{n(7)}", lambda: f"0{n(3)}{s}{n(6)}",
        lambda: f"+{n(11)}", lambda: f"({n(3)})-{n(3)}-{n(4)}",
    ])()


def _other(r: random.Random, word: str) -> str:
    """What looks like personal data and isn't."""
    year, month, day = r.randrange(1900, 2100), r.randrange(1, 13), r.randrange(1, 29)

    def off(n: int) -> str:
        d = _card(r, n)
        return d[:-1] + str((int(d[-1]) + r.randrange(1, 10)) % 10)

    s = r.choice(".-/")
    return r.choice([
        lambda: off(16), lambda: off(r.choice([12, 13, 14, 15, 17])), lambda: " ".join(off(16)[i : i + 4] for i in (0, 4, 8, 12)), lambda: _number(r, r.randrange(1, 12)), lambda: f"{year}{s}{month:02d}{s}{day:02d}", lambda: f"{day:02d}{s}{month:02d}{s}{year}",
        lambda: f"{day}. {month}. {year}", lambda: f"{r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}", lambda: f"{year}-{month:02d}-{day:02d} {r.randrange(24):02d}:{r.randrange(60):02d}", lambda: f"v{r.randrange(20)}.{r.randrange(30)}.{r.randrange(30)}", lambda: f"{r.randrange(20)}.{r.randrange(30)}",
        lambda: f"{r.randrange(1, 999)},{_number(r, 3)}.{_number(r, 2)}", lambda: f"${_number(r, 2)}.{_number(r, 2)}", lambda: f"{hashlib.sha1(word.encode()).hexdigest()[: r.choice([8, 16, 40])]}", lambda: f"{year}-{year + 1}", lambda: f"{_number(r, 2)}.{_number(r, 4)}, {_number(r, 2)}.{_number(r, 4)}",
        lambda: f"at {word} dot", lambda: f"{word} at {word}.", lambda: f"@{word}", lambda: f"{r.randrange(1, 99)} {word}, {_number(r, 5)}", lambda: f"({r.randrange(1, 30)}) {_number(r, 3)}", lambda: f"[{r.randrange(1, 99)}]", lambda: f"{_number(r, 3)} + {_number(r, 3)} = {_number(r, 3)}",
        lambda: f"{r.randrange(1, 20)}.{r.randrange(1, 20)}.{r.randrange(1, 20)} {word}", lambda: f"{r.randrange(300, 999)}.{r.randrange(300, 999)}.{r.randrange(99)}.{r.randrange(99)}", lambda: f"978-{_number(r, 1)}-{_number(r, 2)}-{_number(r, 6)}-{_number(r, 1)}", lambda: f"token = \"{hashlib.sha1(word.encode()).hexdigest()}\"",
    ])()


def snippets(name: str, text: str, count: int = SNIPPETS, reach: int = 60) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Pieces of a text, each with something written in, and the (kind, start, end) of what is personal in them."""
    out = []
    r = random.Random(zlib.crc32(f"{name}:{len(text)}".encode()))
    for _ in range(count):
        at = r.randrange(len(text) + 1)
        while at < len(text) and not text[at].isspace():
            at += 1
        before, after = text[max(0, at - reach) : at], text[at : at + reach]
        word = "".join(c for c in (before.split() or ["word"])[-1].lower() if c.isalpha()) or "word"
        kind = r.choice([0, 1, 2, 3, 3, None, None])
        value = _other(r, word) if kind is None else (_address, _ip, _long_card, _phone)[kind](r, word)
        lead = r.choice([" ", " ", " ", "\n", " (", ": ", " \""]) if before else ""
        whole = before + lead + value + r.choice(["", "", ".", ",", ")", ";"]) + (after if after[:1].isspace() or not after else " " + after)
        spans = [(k, s, e) for s, k, e in base_spans(whole)]
        if kind is not None:
            s = len(before) + len(lead)
            spans = [x for x in spans if x[2] <= s or s + len(value) <= x[1]] + [(kind, s, s + len(value))]
        out.append((whole, spans))
    return out


def labelled(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, count: int = SNIPPETS) -> DataFrame:
    """text, spans(kind, start, end): a small labelled table whose context is that of the documents."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for i, t in zip(b["name"].to_pylist(), b["text"].to_pylist()) for x in snippets(i, t, count)]
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in y] for _, y in got]
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch({"text": pa.array([x for x, _ in got], pa.string()), "spans": pa.array(spans, kind)})

    own = docs.join(F.broadcast(ids), "doc_id", "left_semi").filter("text is not null and text <> ''")
    return own.select(F.col("doc_id").cast("string").alias("name"), "text").mapInArrow(make, f"text string, spans {SPAN}")


# The model


@dataclass
class Model:
    chain: _chain.Chain | None = None
    cues: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))


def lower(word: str) -> str:
    """As tokens_of folds case."""
    return "".join(chr(ord(c) + 32) if ord(c) < len(TABLE) and TABLE[ord(c)] == UPPER else c for c in word)


def cue_words(rows: list[tuple[str, list[Span]]], most: int = CUES) -> list[str]:
    """Words of letters that stand in spans or up to NEAR tokens before them far more often than elsewhere, the commonest first."""
    near, all_ = Counter(), Counter()
    for text, spans in rows:
        t = tokens_of(code_points([text])[0], np.empty(0, np.uint64))
        for i, (s, e) in enumerate(zip(t.start.tolist(), t.end.tolist())):
            word = lower(text[s:e])
            if word.isalpha():
                all_[word] += 1
                reach = int(t.end[min(i + NEAR, len(t.end) - 1)])
                near[word] += any(a < e and s < b or e <= a < reach for a, _, b in spans)
    return sorted([w for w, n in near.items() if n >= 8 and n >= 0.3 * all_[w]], key=lambda w: (-near[w], w))[:most]


def fit(table: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """From ``table(text, spans)``: the ``sample_rows`` distinct rows whose texts' hashes are smallest come to the driver."""
    few = table.filter("text is not null and spans is not null").distinct().orderBy(F.xxhash64("text"), "text", F.col("spans").cast("string")).limit(sample_rows).collect()
    rows = [(r["text"], [(s["start"], s["kind"], s["end"]) for s in r["spans"]]) for r in few]
    if not any(spans for _, spans in rows):
        return Model()
    cues = np.sort(np.array([word_hash(w) for w in cue_words(rows)], np.uint64))
    sequences = []
    for text, spans in rows:
        t = tokens_of(code_points([text])[0][: len(text)], cues)
        gold = np.zeros(len(t.ids), np.int64)
        for start, kind, end in spans:
            own = np.flatnonzero((t.start < end) & (t.end > start))
            gold[own] = 2 + 2 * kind
            gold[own[:1]] = 1 + 2 * kind
        sequences.append((t.ids, gold))
    return Model(_chain.train(sequences, classes(len(cues)), 1 + 2 * len(KINDS)), cues)


PUT_BACK = [(re.compile(r"[ \t]*[_(\[{]*[ \t]*\b(?i:at)\b[ \t]*[_)\]}]*[ \t]*|(?<=[a-zA-Z0-9])[(\[{_](?i:at)[)\]}_]|[ \t]+@[ \t]*|@[ \t]+"), "@"), (re.compile(r"[ \t]*[_(\[{]*[ \t]*\b(?i:dot)\b[ \t]*[_)\]}]*[ \t]*|[(\[{_](?i:dot|\.)[)\]}_]|[ \t]+\.[ \t]*|\.[ \t]+"), ".")]
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,12}")
LONGEST = 120  # characters of a stretch that the field may add


def can_be(kind: int, text: str) -> bool:
    """Whether the characters of a stretch are those of the kind."""
    if len(text) > LONGEST:
        return False
    if kind == 0:
        text = text.replace("_at_", "@").replace("_AT_", "@").replace("_dot_", ".").replace("_DOT_", ".")
        for pattern, mark in PUT_BACK:
            text = pattern.sub(mark, text)
        return ADDRESS.fullmatch(text) is not None
    if kind == 1:
        return is_ip(text) and not re.search(r"[^0-9.,()\[\]\sdot]", text.lower())
    if kind == 2:
        return is_card(text) and not re.search(r"[^0-9\s._/,-]", text)
    return 9 <= len(digits_of(text)) <= 15 and not re.search(r"[^0-9\s()+./-]", text)


def found_spans(texts: list[str], model: Model) -> list[list[Span]]:
    """What the field adds to each text's spans of the patterns."""
    out: list[list[Span]] = [[] for _ in texts]
    if model.chain is None or not texts:
        return out
    codes, first = code_points(texts)
    t = tokens_of(codes, model.cues)
    labels = _chain.decode(model.chain, t.ids)
    inside = np.flatnonzero(labels)
    if not len(inside):
        return out
    kind = (labels[inside].astype(np.int64) - 1) // 2
    opens = np.ones(len(inside), bool)
    opens[1:] = (labels[inside[1:]] % 2 == 1) | (inside[1:] != inside[:-1] + 1) | (kind[1:] != kind[:-1])
    heads = np.flatnonzero(opens)
    tails = np.append(heads[1:], len(inside)) - 1
    for h, e in zip(heads.tolist(), tails.tolist()):
        s, stop = int(t.start[inside[h]]), int(t.end[inside[e]])
        n = int(np.searchsorted(first, s, "right")) - 1
        s, stop = s - int(first[n]), stop - int(first[n])
        k = int(kind[h])
        floor = out[n][-1][2] if out[n] else 0
        while k == 0 and floor < s and stop - s <= LONGEST and texts[n][s - 1] in LOCAL:  # an address takes in what is joined to its beginning
            s -= 1
        if can_be(k, texts[n][s:stop]):
            out[n].append((s, k, stop))
    return out


def all_spans(base: list[Span], found: list[Span]) -> list[Span]:
    """Base spans, and the found ones that touch none of them."""
    if not found:
        return base
    starts, reach = [], []  # of base spans in order: the start, and the furthest end so far
    for s, _, e in base:
        starts.append(s)
        reach.append(max(e, reach[-1] if reach else 0))
    free = [f for f in found if not (n := int(np.searchsorted(starts, f[2], "left"))) or reach[n - 1] <= f[0]]
    return sorted(base + free)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > GROUP_CHARS:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def spans_of(texts: list[str | None], model: Model) -> Iterator[tuple[list[Span], list[Span]]]:
    """Of each text: the patterns' spans, and all spans."""
    for some in _groups([t or "" for t in texts]):
        for t, found in zip(some, found_spans(some, model)):
            base = base_spans(t)
            yield base, all_spans(base, found)


def personal(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by start, then kind) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of a few hundred classes
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    listed = lambda spans: [{"kind": k, "start": s, "end": e} for s, k, e in spans]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(spans_of(b["text"].to_pylist(), sent.value))
            give_back()
            yield pa.record_batch({"doc_id": b["doc_id"], "base": pa.array([listed(x) for x, _ in got], kind), "spans": pa.array([listed(y) for _, y in got], kind)})

    return docs.select("doc_id", "text").mapInArrow(fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPAN}, spans {SPAN}")


def masked(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``<kind>`` in place of each span of ``text`` (of overlapping ones the first); null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def hide(text: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for s, k, e in spans:
            if s >= at:
                parts += [text[at:s], f"<{KINDS[k]}>"]
            at = max(at, e)
        return "".join(parts) + text[at:]

    @F.arrow_udf("string")
    def put(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.to_pylist()
            yield pa.array([None if t is None else hide(t, y) for t, (_, y) in zip(texts, spans_of(texts, sent.value))], pa.string())

    return docs.select(*[put("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def written(spans: str):
    """``kind:start:end`` of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id; n_email, n_ip, n_card, n_phone: of the patterns' spans; base_sha256: digest of these; spans: all, written out."""
    found = personal(docs, model)
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[number(k) for k in range(len(KINDS))], F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))
