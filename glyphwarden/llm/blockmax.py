"""An inverted index with block maxima in one process, searched for many queries at a time.

Rows stand in blocks of BLOCK.  A block's rows are as far apart as there are blocks.  The `dense` longest lists keep the greatest impact in each
block; the others, the short lists, are short enough to be read whole: a posting is one
64-bit number, the row above its impact in steps of 2**-47 of the greatest, so a set of lists is read at
little cost and its sums are exact.  A block's bound is the greatest of these sums in it plus
the block maxima of the long lists under the query's weights, for all queries and
blocks one matrix product.  WAND's condition is then applied a block at a time: blocks of
the greatest bounds are scored first and give the threshold, what the k-th best row
reaches at least; other blocks are opened only if their bound reaches it, and of their rows only
those that reach it themselves.  What is left is scored in full, in double precision.  So no row
that could be among the k best is left out.

Memory is bounded whatever is asked: short lists are read PIECE postings at a time, and arrays as long
as the postings are made piece by piece.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4
#: Cells (queries x rows) that are worked on at a time, and blocks that are scored first.
CELLS, FIRST = 1 << 19, 40
#: Postings that are worked on at a time.
PIECE = 1 << 15
#: What single precision and the rounding of long sums may add to a sum or take from it.
ROUNDING = 2e-5
SHIFT, MOST_ROWS, COPIED = 48, 1 << 15, 64


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each range, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Index:
    """`rows` and `impact` of the postings in the order of terms 0, 1, ...; list t is starts[t] .. starts[t + 1].  At most MOST_ROWS rows."""

    def __init__(self, n: int, starts: np.ndarray, rows: np.ndarray, impact: np.ndarray, dense: int = 256):
        if n > MOST_ROWS:
            raise ValueError(f"an index holds at most {MOST_ROWS} rows")
        self.n, self.blocks = n, -(-n // BLOCK)
        size = np.diff(starts)
        dense = min(dense, int((size > 0).sum()))
        long = np.argpartition(-size, dense - 1)[:dense] if dense else np.zeros(0, np.int64)
        self.column = np.full(size.size, -1, np.int32)
        self.column[long] = np.arange(long.size)
        self.whole = np.zeros((self.blocks * BLOCK, long.size))
        for i, t in enumerate(long.tolist()):
            at = slice(int(starts[t]), int(starts[t + 1]))
            self.whole[rows[at], i] = impact[at]
        self.table = self.whole.astype(np.float32)
        most = self.table.reshape(BLOCK, self.blocks, long.size).max(axis=0) if n else np.zeros((0, long.size), np.float32)
        # what is next to 0 is a denormal number, by which products take many times as long; and no row of such a block has the term
        self.most = np.where(most > 0, np.nextafter(most, np.float32(np.inf)), np.float32(0)).T.copy()
        self.step = max(float(impact.max()) if impact.size else 0.0, 1e-30) / (1 << SHIFT - 1)
        # the short lists alone
        stay = np.repeat(self.column < 0, size)
        self.sizes = np.where(self.column < 0, size, 0)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.postings = np.empty(int(self.sizes.sum()), np.int64)
        done = 0
        for lo in range(0, stay.size, PIECE):
            at = np.flatnonzero(stay[lo : lo + PIECE]) + lo
            self.postings[done : done + at.size] = (rows[at].astype(np.int64) << SHIFT) | np.rint(impact[at] / self.step).astype(np.int64)
            done += at.size

    def best(self, begins: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, digits: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all rows whose score, rounded to `digits`, may be among the k best of its query; scores above 0.

        Query i asks terms[begins[i] : begins[i + 1]], each once; terms below 0 are in no row.  `floor` has, for each query, a score that k rows of
        other indexes reach already, or 0.
        """
        n_queries = begins.size - 1
        step = max(1, CELLS // max(self.blocks * BLOCK, 1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo in range(0, n_queries if self.n else 0, step):
            hi = min(lo + step, n_queries)
            own = begins[lo : hi + 1] - begins[lo]
            found.append(self._some(lo, own, terms[begins[lo] : begins[hi]], weights[begins[lo] : begins[hi]], k, digits, np.zeros(hi - lo) if floor is None else floor[lo:hi]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _some(self, base: int, begins: np.ndarray, terms: np.ndarray, given: np.ndarray, k: int, digits: int, floor: np.ndarray):
        n, wide = begins.size - 1, self.blocks * BLOCK
        who, known = np.repeat(np.arange(n), np.diff(begins)), terms >= 0
        who, terms, given = who[known], terms[known], given[known]
        column = self.column[terms]
        is_long = column >= 0
        weights = np.zeros((n, self.table.shape[1]), np.float32)
        weights[who[is_long], column[is_long]] = given[is_long]
        short = self._sums(n, who[~is_long], terms[~is_long], given[~is_long])
        bound = short.reshape(n, BLOCK, self.blocks).max(axis=1)
        upper = weights @ self.most
        upper *= np.float32(1 + ROUNDING)
        bound += upper
        margin = 2 * 10.0**-digits
        least = np.maximum(0.0, floor - margin)
        if self.blocks > FIRST and not floor.all():
            some = np.sort(np.argpartition(bound, self.blocks - FIRST, axis=1)[:, self.blocks - FIRST :], axis=1)
            q, r = np.repeat(np.arange(n), FIRST * BLOCK), (some[:, :, None] + np.arange(BLOCK) * self.blocks).reshape(-1)
            least = np.maximum(least, _kth(self._rough(weights, short, q, r).reshape(n, -1), k) * (1 - ROUNDING) - margin)
        open_q, open_b = np.nonzero((bound >= least[:, None]) & (bound > 0))
        q, r = np.repeat(open_q, BLOCK), (open_b[:, None] + np.arange(BLOCK) * self.blocks).reshape(-1)
        own = short[q, r] + np.repeat(upper[open_q, open_b], BLOCK)
        stay = (own >= least[q]) & (own > 0)
        q, r = q[stay], r[stay]
        scores = self._rough(weights, short, q, r)
        cuts = np.searchsorted(q, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(cuts) > k).tolist():
            reached = float(_kth(scores[None, cuts[i] : cuts[i + 1]], k)[0])
            least[i] = max(least[i], reached * (1 - ROUNDING) - margin)
        stay = scores * (1 + ROUNDING) >= least[q]
        q, r = q[stay], r[stay]
        long = np.zeros((n, self.table.shape[1]))
        long[who[is_long], column[is_long]] = given[is_long]
        exact = short[q, r] + np.einsum("ij,ij->i", long[q], self.whole[r])
        stay = exact > 0
        return q[stay] + base, r[stay], exact[stay]

    def _sums(self, n: int, q: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The sum over the short lists for each of n queries and each row; q ascends."""
        wide, size = self.blocks * BLOCK, self.sizes[t]
        out, ends, lo = np.zeros((n, wide)), np.cumsum(size), 0
        while lo < t.size:
            # some whole queries, or a part of one
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, side="right")), lo + 1)
            if hi < t.size and q[hi] != q[lo]:
                hi = int(np.searchsorted(q, q[hi]))
            first, last = int(q[lo]), int(q[hi - 1])
            # lists of a few postings are gathered together, longer ones are copied one by one
            few = size[lo:hi] < COPIED
            at = np.concatenate([np.flatnonzero(few), np.flatnonzero(~few)]) + lo
            own = size[at]
            held = self._lists(t[at], own)
            key = held >> SHIFT
            if last > first:
                key += np.repeat((q[at] - first) * wide, own)
            # whole numbers below 2**52 become doubles in place: as the lowest bits of 2**52, which is then taken away
            held &= (1 << SHIFT) - 1
            held |= 0x433 << 52
            value = held.view(np.float64)
            value -= 2.0**52
            value *= np.repeat(w[at] * self.step, own)
            out[first : last + 1] += np.bincount(key, weights=value, minlength=(last + 1 - first) * wide).reshape(-1, wide)
            lo = hi
        return out

    def _lists(self, t: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The postings of the terms end to end; those with fewer than COPIED come first."""
        few, starts = int((size < COPIED).sum()), self.starts[t]
        pieces = [self.postings[lo:hi] for lo, hi in zip(starts[few:].tolist(), (starts[few:] + size[few:]).tolist(), strict=True)]
        return np.concatenate([self.postings[spread(starts[:few], size[:few])], *pieces])

    def _rough(self, weights: np.ndarray, short: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Scores with the long lists in single precision; q ascends."""
        out = short[q, r]
        cuts = np.searchsorted(q, np.arange(weights.shape[0] + 1))
        for i in range(weights.shape[0]):
            lo, hi = cuts[i], cuts[i + 1]
            if lo < hi:
                out[lo:hi] += self.table[r[lo:hi]] @ weights[i]
        return out


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def k_best(query: np.ndarray, name: np.ndarray, score: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by rounded score, equal ones by name, with ascending queries."""
    score = np.round(score, digits)
    order = np.lexsort((name, -score, query))
    query, name, score = query[order], name[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if query.size else np.zeros(0, np.int64)
    rank = np.arange(query.size) - np.repeat(first, np.diff(np.append(first, query.size)))
    return query[rank < k], name[rank < k], score[rank < k]
