"""Scaled forward and backward recursions over many sequences of unequal length side by side.

Sequences lie end to end in one array of emission values.  They are taken longest first, so
that the sequences still running at a step are always the first ones.  Inside, positions lie
by steps and states by rows, so that every step works on slices without a copy.

A long sequence can be taken in pieces side by side.  The product of a piece's steps tells
what it makes of any state values, so the forward values that enter each piece and the
backward values at its end are those of the whole sequence: the results don't depend on it.
"""

from __future__ import annotations

import numpy as np


def _sum_states(a: np.ndarray, out: np.ndarray) -> None:
    """Sums over the states, added up in the order in which numpy adds a row of them."""
    if len(a) == 8:
        two = a[0::2] + a[1::2]
        four = two[0::2] + two[1::2]
        np.add(four[0], four[1], out=out)
    else:
        np.sum(a, axis=0, out=out)


class Chains:
    """``emit``: (positions, states); ``lengths``: positions of each sequence, all at least 1.

    With ``symbols``, the symbol of each position, ``emit`` is (symbols, states).  With ``piece``
    longer sequences are taken in pieces of that length.
    """

    def __init__(
        self,
        emit: np.ndarray,
        lengths: np.ndarray,
        trans: np.ndarray,
        start: np.ndarray,
        piece: int | None = None,
        symbols: np.ndarray | None = None,
    ):
        self.trans, self.start = trans, start
        lengths = np.asarray(lengths, np.int64)
        whole = lengths
        pieces = -(-whole // piece) if piece else np.ones_like(whole)
        last = np.cumsum(pieces) - 1
        if piece:
            lengths = np.full(int(pieces.sum()), piece, np.int64)
            lengths[last] = whole - (pieces - 1) * piece
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        later = np.ones(len(lengths), bool)
        later[last - pieces + 1] = False
        order = np.argsort(-lengths, kind="stable")
        self.first, self.sorted, self.later = first[order], lengths[order], later[order]
        self.steps = int(lengths.max(initial=0))
        ended = np.bincount(lengths, minlength=self.steps + 1)
        #: pieces longer than t, for each t, and where the positions of a step begin
        self.running = len(lengths) - np.cumsum(ended)[: self.steps]
        self.begin = np.concatenate([[0], np.cumsum(self.running)])
        #: the positions by steps
        step = np.repeat(np.arange(self.steps), self.running)
        self.at = self.first[np.arange(len(step)) - self.begin[step]] + step
        self.emit = np.take(emit.T, self.at if symbols is None else symbols[self.at], axis=1)
        #: state values on entering each piece, and backward values at its end
        self.enter = np.tile(start, (len(lengths), 1))
        self.leave = np.ones((len(lengths), emit.shape[1]), emit.dtype)
        if self.later.any():
            self._carry(np.repeat(pieces > 1, pieces)[order], order)

    def _carry(self, of_several: np.ndarray, order: np.ndarray) -> None:
        """Values between the pieces, by the product of each piece's steps."""
        at_rows = np.flatnonzero(of_several)
        later = self.later[at_rows]
        running = np.searchsorted(-self.sorted[at_rows], -np.arange(self.steps), "left")
        trans = self.trans.astype(np.float64)
        k = len(trans)
        product = np.where(later[:, None, None], trans, np.eye(k)) * self.emit[:, at_rows].T[:, None, :]
        for t in range(1, self.steps):
            n = running[t]
            if not n:
                break
            emit = self.emit[:, self.begin[t] + at_rows[:n]].T
            step = (product[:n].reshape(-1, k) @ trans).reshape(n, k, k) * emit[:, None, :]
            product[:n] = step / step.sum(axis=(1, 2), keepdims=True)
        in_order = np.argsort(order[at_rows]).tolist()
        ends = {}
        value = self.start
        for i in in_order:
            if later[i]:
                self.enter[at_rows[i]] = value @ trans
            else:
                value = self.start
            value = value @ product[i]
            value = ends[i] = value / value.sum()
        for i, before in zip(in_order[:0:-1], in_order[-2::-1], strict=True):
            if later[i]:
                back = product[i] @ self.leave[at_rows[i]]
                self.leave[at_rows[before]] = back / (ends[before] @ back)

    def forward_steps(self) -> tuple[np.ndarray, np.ndarray]:
        """``forward`` as (states, positions by steps)."""
        alpha, scale = np.empty_like(self.emit), np.empty(self.emit.shape[1], self.emit.dtype)
        into = np.ascontiguousarray(self.trans.T)
        for t, (lo, n) in enumerate(zip(self.begin.tolist(), self.running.tolist(), strict=False)):
            a, c = alpha[:, lo : lo + n], scale[lo : lo + n]
            before = into @ alpha[:, last : last + n] if t else self.enter.T
            np.multiply(before, self.emit[:, lo : lo + n], out=a)
            _sum_states(a, c)
            a /= c
            last = lo
        return alpha, scale

    def backward_steps(self, alpha: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``backward`` from and to (states, positions by steps)."""
        gamma = np.empty_like(alpha)
        moves = np.zeros_like(self.trans, dtype=np.float64)
        b = np.ascontiguousarray(self.leave.T)
        begin, running = self.begin.tolist(), self.running.tolist()
        for t in range(self.steps - 1, -1, -1):
            lo, n = begin[t], running[t]
            some = b[:, :n]
            np.multiply(alpha[:, lo : lo + n], some, out=gamma[:, lo : lo + n])
            if t:
                w = self.emit[:, lo : lo + n] * some
                w /= scale[lo : lo + n]
                moves += alpha[:, begin[t - 1] : begin[t - 1] + n] @ w.T
                b[:, :n] = self.trans @ w
        if self.later.any():
            place = np.empty(len(self.at), np.int64)
            place[self.at] = np.arange(len(self.at))
            before = place[self.first[self.later] - 1]
            into = np.flatnonzero(self.later)
            moves += alpha[:, before] @ (self.emit[:, into] * b[:, into] / scale[into]).T
        return gamma, moves * self.trans

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Normalised forward values and their scales; the log scales sum to the likelihood."""
        alpha, scale = self.forward_steps()
        return self.by_position(alpha.T), self.by_position(scale)

    def backward(self, alpha: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior state values of every position, and expected transitions."""
        gamma, moves = self.backward_steps(np.take(alpha.T, self.at, axis=1), scale[self.at])
        return self.by_position(gamma.T), moves

    def by_position(self, by_steps: np.ndarray) -> np.ndarray:
        out = np.empty(by_steps.shape, by_steps.dtype)
        out[self.at] = by_steps
        return out

    def starts(self) -> np.ndarray:
        return self.first[~self.later]
