"""Logistic mixing of hashed-context bit predictors.

Symbols are coded in binary decisions. Each predictor counts zeros and ones in a table hashed by its context
and the decision. The stretched probabilities are mixed with weights that a gate picks (how often the gating
contexts have been seen), for each predictor by how often its own context has been seen; a table of what
really followed refines the mixed probability. A mixer learns online, in one pass: what it has counted so far
predicts the next slice, whose errors move the weights, and then is counted. Counts add up over tasks; weights
are averaged by what they rest on.
"""

from __future__ import annotations

import heapq

import numpy as np

LEVELS, STEPS, CLIP = 4, 33, 8.0
#: Added to counts, decisions that are counted at once, and every which of them moves the weights.
PRIOR, SLICE, EVERY = 0.05, 1 << 16, 64
KEEP = 0.98  # of the curvature that earlier slices have left
#: Steps of a mixed value between -12 and 12 in the table of final probabilities; what a table's entry is moved by.
FINE, HALF = 3072, 512
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)


def level(n):
    return (n > 0).astype(np.int16) + (n > 2) + (n > 15)


def stretched(zeros, ones):
    return np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -CLIP, CLIP)


class Tables:
    """Where the predictors' slots lie: the first is direct (its context is the decision alone), the others
    are hashed."""

    def __init__(self, direct: int, hashed: int, bits: int):
        self.bits, self.hashed = bits, hashed
        self.offsets = np.concatenate([[0], direct + (np.arange(hashed) << bits)])
        self.size = direct + (hashed << bits)

    def slots(self, contexts: list[np.ndarray], n, node: np.ndarray) -> list[np.ndarray]:
        """Each predictor's slot for each decision, of which each symbol has ``n``: its node, in its context."""
        salt = (node.astype(np.uint64) + _U(1)) * _U(0xA0761D6478BD642F)
        out = [node.astype(np.int64)]
        for c, at in zip(contexts, self.offsets[1:].tolist(), strict=True):
            h = np.repeat(c, n)
            h ^= salt
            h *= _U(0xE7037ED1A0B428DB)
            h >>= _U(64 - self.bits)
            h += _U(at)
            out.append(h.view(np.int64))
        return out


class Mixer:
    """gate: the two predictors whose levels pick the weights."""

    def __init__(self, tables: Tables, gate: tuple[int, int]):
        self.tables, self.gate = tables, gate
        p = tables.hashed + 1
        self.weights = np.full((p, LEVELS * LEVELS * LEVELS), 1.2 / p)
        self.curved = np.full_like(self.weights, 20.0)  # of late
        self.rests = np.zeros_like(self.weights)  # in all
        self.hits = np.zeros((2, LEVELS * LEVELS * STEPS))  # ones and all, by gate and step
        self.counts = self.table = self.logs = self.parts = self.ones = None
        self.turn = 0

    # -- learning: in a task, with tables of its own ------------------------------------------
    def begin(self, known: np.ndarray | None = None) -> Mixer:
        """known: the first predictor's counts, if they are known already."""
        self.counts = np.zeros((self.tables.size, 2), np.int32)
        self.ones = np.ones(SLICE, np.int32)
        self.known = known is not None
        if self.known:
            self.counts[: len(known)] = np.minimum(known, 2**30)
        return self

    def learn(self, slots: list[np.ndarray], bit: np.ndarray) -> None:
        flat = self.counts.reshape(-1)
        for at in range(0, len(bit), SLICE):
            self.turn += 1
            some = slice(at + self.turn % EVERY, at + SLICE, EVERY)
            self._move([s[some] for s in slots], bit[some])
            right = bit[at : at + SLICE].astype(np.int64)
            for s in slots[self.known :]:
                cell = s[at : at + SLICE] << 1
                cell |= right
                np.add.at(flat, cell, self.ones[: len(cell)])

    def _move(self, slots, bit) -> None:
        seen = [self.counts[s] for s in slots]
        levels = [level(n.sum(axis=1)) for n in seen]
        x = [stretched(n[:, 0].astype(np.float64), n[:, 1].astype(np.float64)) for n in seen]
        gate = self._gate(levels)
        cells = [gate * LEVELS + v for v in levels]
        mixed = np.clip(sum(w[c] * y for w, c, y in zip(self.weights, cells, x, strict=True)), -12, 12)
        p = 1 / (1 + np.exp(-mixed))
        error, curve = bit - p, p * (1 - p)
        n = self.weights.shape[1]
        for k, (c, y) in enumerate(zip(cells, x, strict=True)):
            here = np.bincount(c, curve * y * y, n)
            self.curved[k] = KEEP * self.curved[k] + here
            self.rests[k] += here
            self.weights[k] += np.bincount(c, error * y, n) / (len(x) * self.curved[k] + 5.0)
        near = gate * STEPS + np.rint((mixed + 12) * ((STEPS - 1) / 24)).astype(np.int64)
        self.hits[0] += np.bincount(near, bit, self.hits.shape[1])
        self.hits[1] += np.bincount(near, minlength=self.hits.shape[1])

    def _gate(self, levels):
        return levels[self.gate[0]].astype(np.int64) * LEVELS + levels[self.gate[1]]

    def learned(self) -> np.ndarray:
        """What tasks add up besides counts."""
        return np.concatenate([(self.weights * self.rests).ravel(), self.rests.ravel(), self.hits.ravel()])

    # -- use ----------------------------------------------------------------------------------
    def settle(self, learned: np.ndarray, table: np.ndarray) -> Mixer:
        """With the sums of ``learned()`` and the table that ``settled`` made of all counts."""
        n = self.weights.size
        sums, rests = learned[:n].reshape(self.weights.shape), learned[n : 2 * n].reshape(self.weights.shape)
        self.weights = np.where(rests > 1, sums / np.maximum(rests, 1e-9), self.weights).astype(np.float32)
        ones, all_ = learned[2 * n :].reshape(2, LEVELS * LEVELS, STEPS)
        steps = np.arange(STEPS) * 24 / (STEPS - 1) - 12
        refine = (ones + 20 / (1 + np.exp(-steps))) / (all_ + 20)
        mixed = np.arange(FINE + 1) * 24 / FINE - 12
        p = np.stack([0.5 / (1 + np.exp(-mixed)) + 0.5 * np.interp(mixed, steps, r) for r in refine]).clip(1e-5, 1 - 1e-5)
        self.logs = np.log10(np.stack([1 - p, p], axis=2)).astype(np.float32).ravel()  # gate, mixed value, bit
        entry = np.arange(-HALF, HALF)
        self.parts = [np.concatenate([w[gate * LEVELS + (entry & 3)] * (entry >> 2) for gate in range(LEVELS * LEVELS)]).astype(np.float32) * np.float32(CLIP / 127) for w in self.weights]
        self.table, self.counts, self.curved, self.rests, self.hits, self.ones = table, None, None, None, None, None
        return self

    def log10(self, slots: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each decision."""
        found = [self.table.take(s, mode="clip") for s in slots]  # all slots are within; clipping spares a check
        gate = (found[self.gate[0]] & 3) * LEVELS + (found[self.gate[1]] & 3)
        at = gate.astype(np.int64)
        at *= 2 * HALF
        at += HALF
        mixed = self.parts[0].take(at + found[0], mode="clip")
        for part, v in zip(self.parts[1:], found[1:], strict=True):
            mixed += part.take(at + v, mode="clip")
        np.clip(mixed, -12, 12, out=mixed)
        mixed *= np.float32(FINE / 24)
        np.rint(mixed, out=mixed)
        mixed += (gate * np.int32(FINE + 1) + np.int32(FINE // 2)).astype(np.float32)  # whole numbers, exact below 2^24
        at = mixed.astype(np.int64)
        at <<= 1
        at |= bit
        return self.logs.take(at, mode="clip")


def settled(counts: np.ndarray) -> np.ndarray:
    """Counts (slots x 2) as stretched probabilities, in steps of 8/127, and levels: four times the one and the other."""
    z, o = counts[:, 0].astype(np.float64), counts[:, 1].astype(np.float64)
    return (np.rint(stretched(z, o) * (127 / CLIP)).astype(np.int16) << 2) | level(z + o)


class Code:
    """A prefix code of symbols 0 to n-1 after their counts: the nodes and bits of each symbol's path."""

    def __init__(self, counts):
        n = len(counts)
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        above = np.zeros(2 * n, np.int64)
        side = np.zeros(2 * n, np.uint8)
        top = n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[x] = above[y] = top
            side[y] = 1
            heapq.heappush(heap, (a + b, top))
            top += 1
        at, paths, sides = np.arange(n), [], []
        while (at < top - 1).any():  # all symbols climb at once; the root is top - 1
            inner = at < top - 1
            sides.append(np.where(inner, side[at], 2))
            at = np.where(inner, above[at], at)
            paths.append(at - n)
        steps, nodes = np.array(sides, np.uint8).T[:, ::-1], np.array(paths).T[:, ::-1]
        real = steps < 2
        self.length = real.sum(axis=1)
        self.start = np.cumsum(self.length) - self.length
        self.step, self.nodes = nodes[real].astype(np.int32) << 1 | steps[real], max(1, n - 1)  # both in one number, to be fetched at once

    @property
    def node(self) -> np.ndarray:
        return self.step >> 1

    @property
    def bit(self) -> np.ndarray:
        return self.step & 1

    def decisions(self, symbols: np.ndarray):
        """How many decisions each symbol has, and the node and bit of each."""
        n = self.length.take(symbols)
        first = np.cumsum(n) - n
        at = np.repeat(self.start.take(symbols) - first, n)
        at += np.arange(len(at))
        step = self.step.take(at, mode="clip")
        return n, step >> 1, step & 1

    def totals(self, counts: np.ndarray) -> np.ndarray:
        """(nodes, 2): the zeros and ones at each node that ``counts`` of the symbols give."""
        each = np.repeat(counts, self.length)
        node, bit = self.node, self.bit
        return np.stack([np.bincount(node[bit == b], each[bit == b], self.nodes) for b in (0, 1)], axis=1)
