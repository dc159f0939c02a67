"""Linear-chain conditional random fields over many chains at once.

Chains are runs of consecutive tokens, given by their first tokens and
lengths. They are passed in blocks of BLOCK tokens, all blocks of all chains
by one token a step. A chain of several blocks is one chain all the same: the
product of a block's steps carries the state from its first token to its
last, so each block starts and ends with the exact state of its neighbours.
Emission scores come from hashed features: a token's score is the sum of the
weight rows of its features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens of a block. In training a chain of more tokens is cut into several chains; when texts are read it is not.
BLOCK = 256


def chains(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and lengths of the chains of n tokens; breaks marks tokens that begin one."""
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = breaks.copy()
    start[0] = True
    first = np.flatnonzero(start)
    return first, np.diff(first, append=n)


def blocks(first: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens and lengths of the blocks of chains, and each block's place in its chain."""
    many = -(-size // length)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    left = np.repeat(size, many) - place * length
    return np.repeat(first, many) + place * length, np.minimum(left, length), place


def _steps(first: np.ndarray, size: np.ndarray):
    """For each step the tokens met, as many as runs still go on; and the order of the runs."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    return [first[:m] + t for t, m in enumerate(alive)], order


def _ranks(place: np.ndarray):
    """For each place from 1 on, the blocks that have it; the block before each is the one with the number before."""
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(1, int(place.max(initial=0)) + 2))
    return [order[a:b] for a, b in zip(edges, edges[1:])]


@dataclass
class Field:
    """Transition scores (from, to) and scores of the first state."""

    move: np.ndarray
    start: np.ndarray

    def marginals(self, emission: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """State probabilities of each token, expected moves, and the log of all chains' sums, by forward-backward."""
        local = np.exp(emission - emission.max(1, keepdims=True))
        move = np.exp(self.move)
        steps, _ = _steps(first, size)
        alpha, beta = np.empty_like(local), np.ones_like(local)
        log = float(emission.max(1).sum())
        now = None
        for t, at in enumerate(steps):
            now = np.exp(self.start) * local[at] if t == 0 else (now[: len(at)] @ move) * local[at]
            total = now.sum(1, keepdims=True)
            log += float(np.log(total).sum())
            now /= total
            alpha[at] = now
        for t in range(len(steps) - 2, -1, -1):
            after, here = steps[t + 1], steps[t][: len(steps[t + 1])]
            back = (local[after] * beta[after]) @ move.T
            beta[here] = back / back.sum(1, keepdims=True)
        both = alpha * beta
        both /= both.sum(1, keepdims=True)
        inner = np.ones(len(emission), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        pair = alpha[at - 1][:, :, None] * move * (local[at] * beta[at])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        return both, pair.sum(0), log

    def posteriors(self, emission: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The state probabilities alone, of chains of any length."""
        local = np.exp(emission - emission.max(1, keepdims=True)).astype(np.float32)
        move, start = np.exp(self.move).astype(np.float32), np.exp(self.start).astype(np.float32)
        first, size, place = blocks(first, size, BLOCK)
        states = local.shape[1]
        enter = np.tile(start, (len(first), 1))
        leave = np.ones((len(first), states), np.float32)
        ranks = _ranks(place)
        if ranks:
            several = np.flatnonzero((place > 0) | (np.append(place[1:], 0) > 0))
            whole = np.zeros((len(first), states, states), np.float32)
            steps, order = _steps(first[several], size[several])
            product = np.zeros((len(several), states, states), np.float32)
            product[:, np.arange(states), np.arange(states)] = local[steps[0]]
            for at in steps[1:]:
                m = len(at)
                now = (product[:m].reshape(-1, states) @ move).reshape(m, states, states) * local[at][:, None, :]
                product[:m] = now / now.max((1, 2), keepdims=True)
            whole[several[order]] = product
            for own in ranks:
                last = np.einsum("bi,bij->bj", enter[own - 1], whole[own - 1])
                enter[own] = (last / last.sum(1, keepdims=True)) @ move
            for own in reversed(ranks):
                back = np.einsum("bij,bj->bi", whole[own], leave[own]) @ move.T
                leave[own - 1] = back / back.sum(1, keepdims=True)
        steps, order = _steps(first, size)
        enter, leave = enter[order], leave[order]
        alpha = np.empty_like(local)
        now = None
        for t, at in enumerate(steps):
            now = enter * local[at] if t == 0 else (now[: len(at)] @ move) * local[at]
            now /= now.sum(1, keepdims=True)
            alpha[at] = now
        ahead = None
        for t in range(len(steps) - 1, -1, -1):
            at = steps[t]
            back = leave[: len(at)].copy()
            if ahead is not None:
                more = ahead @ move.T
                back[: len(ahead)] = more / more.sum(1, keepdims=True)
            ahead = local[at] * back
            alpha[at] *= back
        return alpha / alpha.sum(1, keepdims=True)

    def best(self, emission: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The most probable states of chains of any length, by Viterbi."""
        first, size, place = blocks(first, size, BLOCK)
        states = emission.shape[1]
        enter = np.tile(self.start, (len(first), 1))
        before = np.zeros((len(first), states), np.int8)  # the best state of the token before a block's first one
        ranks = _ranks(place)
        if ranks:
            several = np.flatnonzero((place > 0) | (np.append(place[1:], 0) > 0))
            whole = np.zeros((len(first), states, states))
            steps, order = _steps(first[several], size[several])
            product = np.full((len(several), states, states), -np.inf)
            product[:, np.arange(states), np.arange(states)] = emission[steps[0]]
            for at in steps[1:]:
                m = len(at)
                product[:m] = (product[:m, :, :, None] + self.move).max(2) + emission[at][:, None, :]
            whole[several[order]] = product
            for own in ranks:
                last = (enter[own - 1][:, :, None] + whole[own - 1]).max(1)
                ways = last[:, :, None] + self.move
                before[own], enter[own] = ways.argmax(1), ways.max(1)
        steps, order = _steps(first, size)
        back = np.zeros(emission.shape, np.int8)
        score = np.empty(emission.shape)
        for t, at in enumerate(steps):
            if t == 0:
                score[at] = enter[order] + emission[at]
            else:
                ways = score[at - 1][:, :, None] + self.move
                back[at] = ways.argmax(1)
                score[at] = ways.max(1) + emission[at]
        # Of each block the paths to all states of its last token; then those that its neighbour takes.
        paths = np.tile(np.arange(states, dtype=np.int8), (len(emission), 1))
        for t in range(len(steps) - 2, -1, -1):
            after = steps[t + 1]
            paths[after - 1] = np.take_along_axis(back[after], paths[after].astype(np.int64), 1)
        end = score[first + size - 1].argmax(1) if len(first) else np.zeros(0, np.int64)
        for own in reversed(ranks):
            end[own - 1] = before[own, paths[first[own], end[own]]]
        token = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out = np.zeros(len(emission), np.int8)
        out[token] = paths[token, np.repeat(end, size)]
        return out


def fit(features: np.ndarray, own: np.ndarray, states: np.ndarray, first: np.ndarray, size: np.ndarray, count: int, buckets: int, epochs: int = 4, batch: int = 128, rate: float = 0.3, decay: float = 1e-4, forbid: tuple = (), seed: int = 1) -> tuple[Field, np.ndarray]:
    """Field and feature weights (buckets x count) by adaptive gradient steps on the log-likelihood.

    features and own are parallel: a bucket and the token that has it, sorted
    by token. forbid names moves (from, to) that never happen.
    """
    weights, gathered = np.zeros((buckets, count)), np.zeros((buckets, count))
    field = Field(np.zeros((count, count)), np.zeros(count))
    seen_move, seen_start = np.full((count, count), 1e-6), np.full(count, 1e-6)
    rng = np.random.default_rng(seed)
    bound = np.searchsorted(own, np.arange(len(states) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(first))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            n = size[chosen]
            begin = np.cumsum(n) - n
            token = np.repeat(first[chosen] - begin, n) + np.arange(n.sum())
            many = bound[token + 1] - bound[token]
            at = np.repeat(bound[token] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            bucket, row = features[at], np.repeat(np.arange(len(token)), many)
            for a, b in forbid:
                field.move[a, b] = -30.0
            emission = np.zeros((len(token), count))
            np.add.at(emission, row, weights[bucket])
            probable, moves, _ = field.marginals(emission, begin, n)
            truth = states[token]
            error = -probable
            error[np.arange(len(token)), truth] += 1
            inner = np.ones(len(token), bool)
            inner[begin] = False
            after = np.flatnonzero(inner)
            np.add.at(moves := -moves, (truth[after - 1], truth[after]), 1)
            some, place = np.unique(bucket, return_inverse=True)
            slope = np.zeros((len(some), count))
            np.add.at(slope, place, error[row])
            slope = slope / len(chosen) - decay * weights[some]
            gathered[some] += slope**2
            weights[some] += rate * slope / np.sqrt(gathered[some] + 1e-8)
            moves /= len(chosen)
            seen_move += moves**2
            field.move += rate * moves / np.sqrt(seen_move)
            starts = error[begin].sum(0) / len(chosen)
            seen_start += starts**2
            field.start += rate * starts / np.sqrt(seen_start)
    for a, b in forbid:
        field.move[a, b] = -30.0
    return field, weights
