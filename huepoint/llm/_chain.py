"""A linear-chain conditional random field over token classes: training on small tables, decoding in batches.

A token's score for a label is the sum over its neighbourhood of a weight for (offset, class, label); a pair
of labels in a row adds a weight. Label 0 is "outside"; a sequence stands between two tokens that have it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

REACH = 3  # classes so far to the left and right count
CELLS = 1 << 20  # of a batch of sequences: rows x steps


@dataclass
class Chain:
    emit: np.ndarray  # offset, class, label
    pair: np.ndarray  # label, next label

    @property
    def labels(self) -> int:
        return len(self.pair)


def empty(classes: int, labels: int) -> Chain:
    return Chain(np.zeros((2 * REACH + 1, classes, labels), np.float32), np.zeros((labels, labels), np.float32))


def emissions(chain: Chain, ids: np.ndarray) -> np.ndarray:
    """Scores (last axis: labels) of each token of sequences along the last axis of ``ids``; class 0 stands beyond both ends."""
    n = ids.shape[-1]
    around = np.pad(ids, [(0, 0)] * (ids.ndim - 1) + [(REACH, REACH)])
    out = chain.emit[0][around[..., :n]]
    for k in range(1, 2 * REACH + 1):
        out = out + chain.emit[k][around[..., k : k + n]]
    return out


def gradient(chain: Chain, ids: np.ndarray, gold: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the mean negative log-likelihood, for padded sequences (rows x steps); by forward and backward sums."""
    rows, steps = ids.shape
    labels = chain.labels
    score = emissions(chain, ids).astype(np.float64)
    score[~real] = -1e4
    score[~real, 0] = 0.0  # padding is outside
    top = score.max(-1, keepdims=True)
    e, t = np.exp(score - top), np.exp(chain.pair.astype(np.float64))
    forward, backward, scale = np.empty((steps, rows, labels)), np.empty((steps, rows, labels)), np.empty((steps, rows, 1))
    state = np.zeros((rows, labels))
    state[:, 0] = 1.0
    for i in range(steps):
        state = (state @ t) * e[:, i]
        scale[i] = state.sum(1, keepdims=True)
        state = state / scale[i]
        forward[i] = state
    state = np.ones((rows, 1)) * t[:, 0]
    end = (forward[-1] * state).sum(1, keepdims=True)
    state = state / end
    for i in range(steps - 1, -1, -1):
        backward[i] = state
        state = ((state * e[:, i]) @ t.T) / scale[i]
    after = forward * backward
    after /= after.sum(-1, keepdims=True)
    hot = np.eye(labels)[gold]
    diff = (after.transpose(1, 0, 2) - hot) * real[..., None]
    around = np.pad(ids, ((0, 0), (REACH, REACH)))
    g_emit = np.empty(chain.emit.shape)
    classes = chain.emit.shape[1]
    for k in range(2 * REACH + 1):
        cell = around[:, k : k + steps, None] * labels + np.arange(labels)
        g_emit[k] = np.bincount(cell.ravel(), diff.ravel(), classes * labels).reshape(classes, labels)
    before = np.concatenate([np.eye(labels)[np.zeros((1, rows), int)], forward[:-1]])
    expected = np.einsum("irl,irm->lm", before, backward * e.transpose(1, 0, 2) / scale) * t
    expected[:, 0] += ((forward[-1] * backward[-1]) / (forward[-1] * backward[-1]).sum(1, keepdims=True)).sum(0)
    gold_before = np.concatenate([np.zeros((rows, 1), gold.dtype), gold], 1)
    gold_after = np.concatenate([gold, np.zeros((rows, 1), gold.dtype)], 1)
    seen = np.bincount((gold_before * labels + gold_after).ravel(), minlength=labels * labels).reshape(labels, labels)
    likely = (np.log(scale).sum() + top.sum() + np.log(end).sum()) - (np.take_along_axis(score, gold[..., None], -1).sum() + (chain.pair * seen).sum())
    return g_emit / rows, (expected - seen) / rows, float(likely / rows)


def train(sequences: list[tuple[np.ndarray, np.ndarray]], classes: int, labels: int, epochs: int = 10, batch: int = 128, rate: float = 0.1, decay: float = 1e-4) -> Chain:
    """From (classes, labels) of each sequence, by Adam over batches of sequences of about equal length; the same input gives the same weights."""
    chain = empty(classes, labels)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][0]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    means, squares = [np.zeros(chain.emit.shape), np.zeros(chain.pair.shape)], [np.zeros(chain.emit.shape), np.zeros(chain.pair.shape)]
    step, draw = 0, np.random.default_rng(1)
    for epoch in range(epochs):
        for k in draw.permutation(len(batches)):
            some = [sequences[i] for i in batches[k]]
            width = max(1, max(len(x) for x, _ in some))
            ids, gold, real = (np.zeros((len(some), width), kind) for kind in (np.int64, np.int64, bool))
            for r, (x, y) in enumerate(some):
                ids[r, : len(x)], gold[r, : len(x)], real[r, : len(x)] = x, y, True
            found = gradient(chain, ids, gold, real)[:2]
            step += 1
            for w, g, m, s in zip((chain.emit, chain.pair), found, means, squares):
                g = g + decay * w
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= (rate / (1 + epoch)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return chain


def viterbi(chain: Chain, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of padded sequences (rows x steps x labels), each between two tokens outside; beyond a sequence's length 0."""
    rows, steps, labels = score.shape
    score = score.copy()
    beyond = np.arange(steps) >= lengths[:, None]
    score[beyond] = -1e6
    score[beyond, 0] = 0.0
    back = np.empty((steps, rows, labels), np.int8)
    best = np.full((rows, labels), -1e6, np.float32)
    best[:, 0] = 0.0
    for i in range(steps):
        ways = best[:, :, None] + chain.pair
        # steps beyond a sequence add nothing
        ways = np.where(beyond[:, i, None, None] & (i > lengths)[:, None, None], best[:, :, None] + np.where(np.eye(labels, dtype=bool), 0, -1e6).astype(np.float32), ways)
        back[i] = ways.argmax(1)
        best = ways.max(1) + score[:, i]
    at = (best + np.where((lengths >= steps)[:, None], chain.pair[:, 0], 0)).argmax(1)
    out = np.empty((rows, steps), np.int8)
    for i in range(steps - 1, -1, -1):
        out[:, i] = at
        at = back[i][np.arange(rows), at]
    return out


def _scores(chain: Chain, ids: np.ndarray, some: np.ndarray, block: int) -> np.ndarray:
    """As emissions(), of some tokens."""
    around = np.pad(ids, REACH)
    return np.concatenate([sum(chain.emit[k][around[some[i : i + block] + k]] for k in range(2 * REACH + 1)) for i in range(0, len(some), block)])


def decode(chain: Chain, ids: np.ndarray, block: int = 200_000) -> np.ndarray:
    """The best labels of one sequence of any length.

    A run of labels other than outside must gain something over being outside. A token's gain is at most that of its
    best label with the best pair before it, so by running sums of these a token that no run with a gain can hold
    is outside for certain. Only the stretches between such tokens are decoded, each by itself: the result is that of the whole.
    """
    n = len(ids)
    out = np.zeros(n, np.int8)
    pair = chain.pair
    enter, leave = pair.max(0)[1:] - pair[0, 0], float(pair[1:, 0].max(initial=-1e6) - pair[0, 0])
    gain = np.empty(n)
    for at in range(0, n, block):
        stop = min(n, at + block)
        lo, hi = max(0, at - REACH), min(n, stop + REACH)
        score = emissions(chain, ids[lo:hi])[at - lo : stop - lo]
        gain[at:stop] = (score[:, 1:] - score[:, :1] + enter).max(1)
    gain[ids == 0] = -1e6  # breaks are outside
    total = np.concatenate([np.zeros(1), np.cumsum(gain)])
    ending, starting = total[1:] - np.minimum.accumulate(total[:-1]), np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
    # running sums of a long sequence are right to 1e-3 and better
    open_ = np.zeros(n + 2, bool)
    open_[1:-1] = (ending + starting - gain + leave > -1e-2) & (ids > 0)
    edges = np.flatnonzero(open_[1:] != open_[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return out
    first = np.concatenate([[0], np.cumsum(ends - starts)])  # where each stretch's scores begin
    scores = _scores(chain, ids, np.flatnonzero(open_[1:-1]), block)
    order = np.argsort(ends - starts, kind="stable")
    at = 0
    while at < len(order):
        longest = int(ends[order[at]] - starts[order[at]])
        take = at + 1
        while take < len(order) and (take - at + 1) * int(ends[order[take]] - starts[order[take]]) * chain.labels <= CELLS:
            longest = int(ends[order[take]] - starts[order[take]])
            take += 1
        some = order[at:take]
        lengths = ends[some] - starts[some]
        inside = np.arange(longest) < lengths[:, None]
        where = np.where(inside, first[some][:, None] + np.arange(longest), 0)
        got = viterbi(chain, scores[where], lengths)
        out[(starts[some][:, None] + np.arange(longest))[inside]] = got[inside]
        at = take
    return out
