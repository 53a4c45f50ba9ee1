"""How many tables a dish has: exact conditional draws for Pitman-Yor restaurants, without a list of seats.

Of c customers of one dish the seatings at t tables have total weight S(c, t), the generalized Stirling
number of the discount. So a Gibbs step need not move customers one by one: the number of tables is drawn
from its conditional, S(c, t) times what t tables cost in their restaurant and in its parent. S is exact
up to REF customers; beyond, a saddle-point form of its generating function ((1 - (1 - z)^d) / d)^t / t!,
corrected by what that form misses at REF customers and equal t / c^d (a hundredth of a unit of log S).
Dishes of up to ENUMERATED customers are drawn from all their probabilities; larger ones take STEPS
Metropolis steps of random width, which leave the same distribution unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd

from huepoint.llm._words import U64, mix

REF, ENUMERATED, STEPS = 192, 16, 12


def gammaln(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by Stirling's series from 8 on."""
    x = np.array(x, float)
    low = np.flatnonzero(x < 8)
    if len(low):
        y, log = x[low], np.ones(len(low))
        for _ in range(8):
            log *= np.where(y < 8, y, 1.0)
            y = np.where(y < 8, y + 1, y)
        x[low] = y
    i = 1 / x
    out = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i / 1260))
    out[low] -= np.log(log) if len(low) else 0
    return out


def gammaln_of(n: np.ndarray, plus: float) -> np.ndarray:
    """log of the gamma function of whole numbers plus ``plus``; where many lie close together, once for each number."""
    if len(n):
        low, high = int(n.min()), int(n.max())
        if high - low < len(n):
            return gammaln(np.arange(low, high + 1) + plus)[n - low]
    return gammaln(n + plus)


def exact_table(discount: float, most: int) -> np.ndarray:
    """log S(c, t) for all c and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.where(c > discount * t, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c]
            out[c + 1] = np.logaddexp(stay, np.append(-np.inf, out[c, :-1]))
    return out


def saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log(1 - r) of the saddle point r of the generating function, by Newton's method."""
    ratio = c / t
    y = np.minimum(np.log(ratio / discount) / (discount - 1), -np.minimum(2 * (ratio - 1) / (1 - discount), 0.5))
    y = np.minimum(y, -1e-9)
    going, log = np.arange(len(y)), np.log(ratio)
    for _ in range(9):
        x = y[going]
        one, part = -np.expm1(x), -np.expm1(discount * x)
        g = np.log(discount * one / part) + (discount - 1) * x - log[going]
        slope = discount * (1 - part) / part + (discount - 1) - (1 - one) / one
        y[going] = to = np.minimum(x - np.clip(g / slope, -3, 3), -1e-12)
        going = going[np.abs(to - x) > -1e-9 * to]  # steps square the distance, so the others are as near as they get
        if not len(going):
            break
    return y


class Stirling:
    """log S(c, t) for one discount."""

    def __init__(self, discount: float):
        self.discount = discount
        self.table = exact_table(discount, REF)
        t = np.arange(1, REF)
        self.at = np.log(t) - discount * math.log(REF)
        self.missed = self.table[REF, 1:REF] - self._form(np.full(len(t), float(REF)), t.astype(float))
        self.slope = (self.missed[1] - self.missed[0]) / (self.at[1] - self.at[0])

    def _form(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        y = saddle(c, t, self.discount)
        r, f = -np.expm1(y), -np.expm1(self.discount * y) / self.discount
        h = r * np.exp((self.discount - 1) * y) / f
        spread = np.maximum(t * h * (1 + (1 - self.discount) * r / np.exp(y) - h), 1e-300)
        return gammaln(c + 1) - gammaln(t + 1) + t * np.log(f) - c * np.log(r) - 0.5 * np.log(2 * np.pi * spread)

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """-inf where t is no possible number of tables."""
        c, t = np.broadcast_arrays(np.asarray(c, np.int64), np.asarray(t, np.int64))
        out = self.table[np.minimum(c, REF), np.clip(t, 0, REF)]
        out = np.where((t < 1) & (c > 0) | (t > c), -np.inf, out)
        if not out.size or c.max() <= REF:
            return out
        big = np.flatnonzero((c > REF) & (t >= 1) & (t < c))
        if len(big):
            b, k = c[big].astype(float), t[big].astype(float)
            x = np.log(k) - self.discount * np.log(b)
            missed = np.where(x < self.at[0], self.missed[0] + self.slope * (x - self.at[0]), np.interp(x, self.at, self.missed))
            out[big] = self._form(b, np.minimum(k, b - 0.5)) + missed
        out[(c > REF) & (t == c)] = 0.0
        return out

    def growth(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log of S(c + 1, t) / S(c, t), from the saddle point."""
        c, t = np.maximum(np.asarray(c, float), 2.0), np.asarray(t, float)
        y = saddle(c, np.minimum(t, c - 0.5), self.discount)
        return np.log((c + 1) / -np.expm1(y))


@lru_cache(8)
def stirling(discount: float) -> Stirling:
    return Stirling(discount)


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), from a hash of key and salt."""
    return ((mix(key + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(12)).astype(np.float64) + 0.5) / 2.0**52


def draw(c: np.ndarray, now: np.ndarray, target: Callable[[np.ndarray, np.ndarray], np.ndarray], key: np.ndarray, salt: int) -> np.ndarray:
    """New numbers of tables of dishes with c > 0 customers and ``now`` tables.

    target(places, t): the log probability, up to a constant for each place, of t tables at these places.
    """
    out = now.copy()
    for n in range(2, ENUMERATED + 1):
        at = np.flatnonzero(c == n)
        if len(at):
            t = np.arange(1, n + 1)
            p = target(np.repeat(at, n), np.tile(t, len(at))).reshape(-1, n)
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
            out[at] = 1 + (p < (uniform(key[at], salt) * p[:, -1])[:, None]).sum(1)
    at = np.flatnonzero(c > ENUMERATED)
    if len(at):
        t, widest = now[at], np.floor(np.log2(c[at]))
        p = target(at, t)
        for step in range(STEPS):
            u, v, w = (uniform(key[at], salt + (3 * step + i + 1 << 32)) for i in range(3))
            width = np.floor(2.0 ** np.floor(u * (widest + 1)))
            move = np.floor(v * 2 * width)  # 0 to width - 1: down, the rest: up
            to = t + np.where(move < width, -1 - move, 1 + move - width).astype(np.int64)
            ok = (to >= 1) & (to <= c[at])
            q = np.full(len(at), -np.inf)
            q[ok] = target(at[ok], to[ok])
            take = np.log(w) < q - p
            t, p = np.where(take, to, t), np.where(take, q, p)
        out[at] = t
    return out


def pair_tables(c: np.ndarray, now: np.ndarray, tables: np.ndarray, customers: np.ndarray, parents: np.ndarray, total: int, model: tuple[float, float, float, float], key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of pairs given all other tables.

    now: the pair's tables in ``tables`` (of its context), ``customers`` (at the parent, of its word) and
    ``total`` (at the parent, of all words); parents: the parent's tables of its word; model: strength and
    discount of contexts and of the parent.
    """
    strength, discount, parent_strength, parent_discount = model
    own, up = stirling(discount), stirling(parent_discount)
    others = tables - now
    rest = customers - now
    few = customers <= REF
    growth = np.zeros(len(customers))  # the same for all pairs of a word
    which, words = pd.factorize(customers[~few] + 1j * parents[~few])
    growth[~few] = up.growth(words.real, words.imag)[which]

    def target(at: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = own(c[at], t) + gammaln_of(others[at] + t, strength / discount) + t * math.log(discount)
        out -= gammaln_of(np.maximum(total - now[at], 0) + t, parent_strength)
        return out + np.where(few[at], up(np.where(few[at], rest[at] + t, 1), np.where(few[at], parents[at], 1)), t * growth[at])

    return draw(c, now, target, key, salt)


def parent_tables(customers: np.ndarray, now: np.ndarray, all_tables: int, base: float, model: tuple[float, float, float, float], key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of words at the parent, whose base gives each word the probability ``base``."""
    *_, strength, discount = model
    own, others = stirling(discount), np.maximum(all_tables - now, 0)
    cost = math.log(discount) + math.log(base)
    return draw(customers, now, lambda at, t: own(customers[at], t) + gammaln_of(others[at] + t, strength / discount) + t * cost, key, salt)
