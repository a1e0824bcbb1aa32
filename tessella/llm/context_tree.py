"""Context-tree weighting over bytes, in parts that meet at the contexts of two bytes.

A symbol is one of 256 bytes or the end of the text, told by nine binary
decisions at most: end or not, then the byte's bits. Every decision has a tree
of contexts of zero to `depth` bytes; each node has a Krichevsky-Trofimov
estimate of its counts, and a node's weighted probability is the mean of its own
estimate and the product of those of its children. The probability of a new
decision is the ratio of the root's weighted probability with and without it: a
mixture of the estimates along the path of its context, in which a node that was
never seen says one half.

Below contexts of `TOP` bytes the trees fall into many small ones (Subtrees),
which are computed wherever their byte strings lie. Their weighted
probabilities and counts are summed into the top (Top), which has no more than
256 decisions for each of 65,536 contexts, however large the corpus is.

A byte string is one number: the context's bytes, the nearest lowest, then nine
bits of the symbol. A node is its context's bytes and eight bits: 0 for the
decision on the end, else a leading one and the bits told so far.
"""

from __future__ import annotations

import math

import numpy as np

TOP = 2
END_SYMBOL = 256
U = np.uint64
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # nodes in order, zeros, ones


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of all texts in order, and where each text's begin. A text has its bytes and one end; zeros stand before it."""
    pad = bytes(depth)
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    key = np.zeros(len(raw) - depth, np.uint64)
    for k in range(depth):
        key = (key << U(8)) | raw[k : len(raw) - depth + k]
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)) * depth, sizes)
    symbol = raw[depth:][at].astype(np.uint64)
    symbol[starts + sizes - 1] = END_SYMBOL
    return (key[at] << U(9)) | symbol, starts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5."""
    shift = np.zeros_like(x)
    z = x.copy()
    while (low := z < 8).any():
        shift[low] += np.log(z[low])
        z[low] += 1
    i = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680))) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


def summed(node: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct nodes in order and the sums of their values."""
    u, at = np.unique(node, return_inverse=True)
    return (u, *(np.bincount(at, v, len(u)) for v in values))


def shortened(node: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of the same decisions in contexts of the nearest `depth` bytes."""
    return (((node >> U(8)) & U((1 << 8 * depth) - 1)) << U(8)) | (node & U(255))


def decisions(key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of nine decisions: which byte strings make it, at which nodes of whole contexts, and whether it is a one."""
    context, symbol = (key >> U(9)) << U(8), key & U(511)
    out = [(np.arange(len(key)), context, symbol == END_SYMBOL)]
    at = np.flatnonzero(symbol != END_SYMBOL)
    context, symbol = context[at], symbol[at]
    for j in range(8):
        out.append((at, context | U(1 << j) | (symbol >> U(8 - j)), (symbol >> U(7 - j) & U(1)).astype(bool)))
    return out


def _weighted(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability, and the share of the node's own estimate in it."""
    own = log_kt(a, b)
    if below is None:
        return own, np.ones(len(a))
    return np.logaddexp(own, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Mixture:
    """From a node down its path: what the estimates so far add up to, and the weight that is left for the rest."""

    def __init__(self, counts: Counts, share_own: np.ndarray, base: np.ndarray, rest: np.ndarray):
        node, a, b = counts
        part = rest * share_own
        self.node = node
        self.base = base + part * (b + 0.5) / (a + b + 1)
        self.rest = rest - part
        self.one = self.base + self.rest / 2  # of a path that ends here: what is not seen says one half


class Top:
    """Contexts of zero to TOP bytes, from the sums over the subtrees."""

    def __init__(self, node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        """Counts at contexts of TOP bytes, and the sum of the ln weighted probabilities of the subtrees under each."""
        order = np.argsort(node)
        counts: Counts = (node[order], a[order], b[order])
        below = below[order]
        levels = []
        for depth in range(TOP, -1, -1):
            weighted, own = _weighted(counts[1], counts[2], below)
            levels.append((counts, own))
            if depth:
                u, x, y, below = summed(shortened(counts[0], depth - 1), counts[1], counts[2], weighted)
                counts = (u, x, y)
        self.levels: list[Mixture] = []
        for depth, (counts, own) in enumerate(reversed(levels)):
            if depth == 0:
                base, rest = np.zeros(len(own)), np.ones(len(own))
            else:
                up = np.searchsorted(self.levels[-1].node, shortened(counts[0], depth - 1))
                base, rest = self.levels[-1].base[up], self.levels[-1].rest[up]
            self.levels.append(Mixture(counts, own, base, rest))


class Subtrees:
    """Contexts of more than TOP bytes, of all byte strings whose contexts share their TOP + 1 nearest bytes."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        self.depth = depth
        made = decisions(key)
        node, one = (np.concatenate([m[k] for m in made]) for k in (1, 2))
        times = np.concatenate([n[m[0]] for m in made])
        self.levels = [summed(node, np.where(one, 0, times), np.where(one, times, 0))]
        for d in range(depth - 1, TOP, -1):
            u, a, b = self.levels[-1]
            self.levels.append(summed(shortened(u, d), a, b))
        below, self.own = None, []
        for k, (u, a, b) in enumerate(self.levels):
            weighted, own = _weighted(a, b, below)
            self.own.append(own)
            if k + 1 < len(self.levels):
                below = np.bincount(np.searchsorted(self.levels[k + 1][0], shortened(u, depth - k - 1)), weighted, len(self.levels[k + 1][0]))
        self.weighted = weighted

    def for_top(self) -> tuple[np.ndarray, ...]:
        """Nodes of TOP bytes with their counts and the sum of the ln weighted probabilities under them."""
        u, a, b = self.levels[-1]
        return summed(shortened(u, TOP), a, b, self.weighted)

    def log10(self, key: np.ndarray, top: Top) -> np.ndarray:
        """log10 of the probability of each byte string's symbol after its context."""
        levels = list(top.levels)
        for counts, own in zip(reversed(self.levels), reversed(self.own), strict=True):
            up = np.searchsorted(levels[-1].node, shortened(counts[0], len(levels) - 1))
            levels.append(Mixture(counts, own, levels[-1].base[up], levels[-1].rest[up]))
        total = np.zeros(len(key))
        for at, node, one in decisions(key):
            p, left = np.full(len(at), 0.5), np.arange(len(at))
            for depth in range(self.depth, -1, -1):
                known = levels[depth].node
                if not len(left) or not len(known):
                    continue
                want = shortened(node[left], depth)
                place = np.minimum(np.searchsorted(known, want), len(known) - 1)
                hit = known[place] == want
                p[left[hit]] = levels[depth].one[place[hit]]
                left = left[~hit]
            total[at] += np.log10(np.where(one, p, 1 - p))
        return total
