"""The most correlated rows of two blocks of rows, exactly, in a bounded number of small matrices.

All pairs are looked at in tiles: products in single precision bound each correlation from above, and only pairs that the
bound lets among the best of either row are computed, in double precision and in one order, so that equal rows tie exactly
wherever they stand.
"""

from __future__ import annotations

import numpy as np

#: Rows and columns of a tile (some eight matrices of 1 MB), and pairs that are computed at once.
TILE, PAIRS_AT_ONCE = 512, 16384


def correlations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of each row of x with its row of y over the places that both have, and their number; NaN where either is flat."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = both.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = (np.where(both, v - (np.where(both, v, 0).sum(axis=1) / n)[:, None], 0) for v in (x, y))
        spread = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        return np.clip(np.where(spread > 1e-18, (x * y).sum(axis=1) / spread, np.nan), -1, 1), n


class Rows:
    """Rows of a block in order of id, NaN where a row has no value, and the best ``k`` peers of each found so far.

    ``floor`` is what a peer's correlation has to reach: at least that of the row's k-th best. Peers come in order of id, so
    a row whose k peers are all at 1 needs no more.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: float):
        norm = np.sqrt(np.nansum(x * x, axis=1))
        order = np.flatnonzero((norm > 0) & np.isfinite(norm))  # the rest are flat, or no numbers
        order = order[np.argsort(ids[order], kind="stable")]
        self.ids, self.x, self.k = ids[order], x[order], k
        # an upper bound of the error of the products below, as a share: three sums of a row's length, and some slack
        self.slack = 4 * (x.shape[1] + 8) * 2.0**-24
        unit = np.nan_to_num(self.x / norm[order, None])
        self.held = (~np.isnan(self.x)).astype(np.float32)
        self.value, self.square = unit.astype(np.float32), (unit * unit * (1 - self.slack)).astype(np.float32)
        self.raised = np.column_stack([unit, np.full(len(unit), np.sqrt(self.slack))]).astype(np.float32)
        self.floor = np.full(len(order), float(floor))
        self.sims, self.peers, self.counts = np.full((len(order), k), -np.inf), np.zeros((len(order), k), np.int64), np.zeros((len(order), k), np.int64)

    def tiles(self) -> list[slice]:
        return [slice(i, min(i + TILE, len(self.ids))) for i in range(0, len(self.ids), TILE)]

    def take(self, i: np.ndarray, peer: np.ndarray, sim: np.ndarray, n: np.ndarray) -> None:
        good = sim >= self.floor[i]
        if not good.any():
            return
        rows = np.unique(i[good])
        old = self.sims[rows] > -np.inf
        i = np.concatenate([np.repeat(rows, old.sum(axis=1)), i[good]])
        peer, sim, n = (np.concatenate([have[rows][old], new[good]]) for have, new in ((self.peers, peer), (self.sims, sim), (self.counts, n)))
        order = np.lexsort((peer, -sim, i))
        i, peer, sim, n = i[order], peer[order], sim[order], n[order]
        at = np.arange(len(i))
        place = at - np.maximum.accumulate(np.where(np.diff(i, prepend=-1) != 0, at, 0))
        kept = place < self.k
        for have, new in ((self.peers, peer), (self.sims, sim), (self.counts, n)):
            have[i[kept], place[kept]] = new[kept]
        worst = self.sims[rows, self.k - 1]
        self.floor[rows] = np.where(worst >= 1, 2, np.maximum(self.floor[rows], worst))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = self.sims > -np.inf
        return np.repeat(self.ids, at.sum(axis=1)), self.peers[at], self.sims[at], self.counts[at]


class Tile:
    """The matrices of one tile after the other, in the same memory: a fresh matrix costs as much as what is done with it."""

    def __init__(self):
        self._room: dict[str, np.ndarray] = {}

    def room(self, name: str, h: int, g: int, kind: type = np.float32) -> np.ndarray:
        held = self._room.setdefault(name, np.empty(TILE * TILE, kind))
        return held[: h * g].reshape(h, g)

    def product(self, name: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.matmul(left, right.T, out=self.room(name, len(left), len(right)))

    def bounds(self, a: Rows, b: Rows, r: slice, s: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n; n times the covariance sum, rounded up; n times the sums of squares, rounded down (of the first, not below 0)."""
        n, c = self.product("n", a.held[r], b.held[s]), self.product("c", a.raised[r], b.raised[s])
        x, u = self.product("x", a.value[r], b.held[s]), self.product("u", a.square[r], b.held[s])
        y, v = self.product("y", a.held[r], b.value[s]), self.product("v", a.held[r], b.square[s])
        c *= n
        c -= np.multiply(x, y, out=self.room("spare", *n.shape))
        u *= n
        x *= x
        u -= x
        if u.min() < 0:
            np.maximum(u, 0, out=u)
        v *= n
        y *= y
        v -= y
        return n, c, u, v

    def may_pass(self, a: Rows, b: Rows, r: slice, s: slice, least: int) -> np.ndarray:
        """Places in the tile where the bounds let a pair reach either row's floor."""
        n, c, u, v = self.bounds(a, b, r, s)
        spare, good = self.room("spare", *n.shape), self.room("good", *n.shape, bool)
        if min(a.floor[r].min(), b.floor[s].min()) > 0:
            one, other = ((f * f * (1 - 2e-6)).astype(np.float32) for f in (a.floor[r], b.floor[s]))
            u *= v
            u *= np.minimum(one[:, None], other, out=spare)
            c *= np.abs(c, out=spare)
            np.greater_equal(c, u, out=good)
        else:  # squares do not compare: every pair is computed
            good[:] = True
        at = np.flatnonzero(good)
        return at[n.ravel()[at] >= least]


def _seed(tile: Tile, a: Rows, b: Rows, r: slice, s: slice, least: int) -> None:
    """Floors from the roughly best of one tile, computed: the k-th of some peers is no higher than the k-th of all."""
    n, c, u, v = tile.bounds(a, b, r, s)
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = np.nan_to_num(np.where(n >= least, c / np.sqrt(u * v), -np.inf), nan=-np.inf)
    if a is b:
        np.fill_diagonal(rough, -np.inf)
    for one, other, own, at, m in ((a, b, r, s, rough), (b, a, s, r, rough.T))[: 1 if a is b else 2]:
        if m.shape[1] <= one.k:
            continue
        wide = min(one.k + 3, m.shape[1])
        near = np.argpartition(-m, wide - 1, axis=1)[:, :wide]
        sim, n = correlations(np.repeat(one.x[own], wide, axis=0), other.x[at][near.ravel()])
        itself = np.repeat(one.ids[own], wide) == other.ids[at][near.ravel()]
        sim = np.where((n >= least) & ~np.isnan(sim) & ~itself, sim, -np.inf).reshape(-1, wide)
        one.floor[own] = np.maximum(one.floor[own], np.sort(sim, axis=1)[:, -one.k])


def find(a: Rows, b: Rows, least: int) -> None:
    """Look at all pairs of a row of a and one of b (pairs within a, if b is a) with ``least`` common places.

    Tiles are visited so that each row meets its peers in order of id.
    """
    left, right, tile = a.tiles(), b.tiles(), Tile()
    if not left or not right:
        return
    for m in range(max(len(left), len(right))):
        _seed(tile, a, b, left[m % len(left)], right[m % len(right)], least)
    for i, r in enumerate(left):
        for s in right[i if a is b else 0 :]:
            x, y = np.divmod(tile.may_pass(a, b, r, s, least), s.stop - s.start)
            if a is b and r == s:
                x, y = x[x < y], y[x < y]
            for first in range(0, len(x), PAIRS_AT_ONCE):
                one, other = x[first : first + PAIRS_AT_ONCE] + r.start, y[first : first + PAIRS_AT_ONCE] + s.start
                sim, n = correlations(a.x[one], b.x[other])
                if a is b:  # both ends at once: a row's peers of smaller id are at the other end
                    a.take(np.concatenate([one, other]), a.ids[np.concatenate([other, one])], np.tile(sim, 2), np.tile(n, 2))
                else:
                    a.take(one, b.ids[other], sim, n)
                    b.take(other, a.ids[one], sim, n)
