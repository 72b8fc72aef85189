"""The median of all pairwise slopes of a series, without its pairs.

A pair of points is steeper than m or not as its order by residual v - m t differs from its order by time, so that
the pairs below a slope are counted as inversions, by merging, in n log n. Between two slopes that enclose the
wanted ranks, the next one is set by interpolation or halving until few pairs lie between; those are found in the
places where the two orders differ and their slopes computed. Residuals round; a rank is taken from the pairs
between only if its slope keeps a distance from both ends that no rounding can bridge, else the ends move apart
again. Where many pairs share a slope, the ends close in on it and one of its pairs gives it.
"""

from __future__ import annotations

from collections.abc import Iterator

from evidentia.session import ship

ship(__name__)

DAY = 86_400_000_000
FEW = 4000
#: points of a series whose pairs are formed
SHORT = 64
BLOCK = 32
STEPS = 400


def inversions(order) -> int:
    """Pairs that stand in falling order in an array of whole numbers; equal ones don't count."""
    import numpy as np

    a = np.asarray(order, dtype=np.int64)
    n = len(a)
    if n < 2:
        return 0
    size = -(-n // BLOCK) * BLOCK
    top = int(a.max()) + 1
    a = np.concatenate([a, np.full(size - n, top)])
    blocks = a.reshape(-1, BLOCK)
    total = 0
    for i in range(BLOCK - 1):
        total += int((blocks[:, i : i + 1] > blocks[:, i + 1 :]).sum())
    a = np.sort(blocks, axis=1).ravel()
    width, span = BLOCK, top + 1
    while width < size:
        # all pairs of halves at once: a half's numbers are told from the others' by a multiple of the span
        block = np.arange(size) // (2 * width)
        keyed = a + block * span
        left = (np.arange(size) // width) % 2 == 0
        starts = np.searchsorted(keyed[left], np.arange(block[-1] + 2) * span)
        places = np.searchsorted(keyed[left], keyed[~left], side="right")
        total += int((starts[block[~left] + 1] - places).sum())
        keyed.sort(kind="stable")
        a = keyed - (np.arange(size) // (2 * width)) * span
        width *= 2
    return total


class Slopes:
    """Counts and finds the pairwise slopes of points at whole microseconds; points of equal time make no pair."""

    def __init__(self, us, v):
        import numpy as np

        order = np.lexsort((v, us))
        self.us, self.v = np.asarray(us, dtype=np.int64)[order], np.asarray(v, dtype=np.float64)[order]
        self.t = (self.us - self.us[0]) / DAY
        self.rank = np.unique(self.us, return_inverse=True)[1]
        each = np.bincount(self.rank).astype(object)
        n = len(self.us)
        self.pairs = int(n * (n - 1) // 2 - sum(k * (k - 1) // 2 for k in each))
        gaps = np.diff(np.unique(self.us))
        self.gap = gaps.min() / DAY if len(gaps) else 1.0

    def by(self, m: float):
        """Points by their residual of a slope, later ones first among equals."""
        import numpy as np

        return np.lexsort((-self.rank, self.v - m * self.t))

    def up_to(self, m: float) -> int:
        """Pairs whose slope is not above m, but for rounding."""
        return inversions(self.rank[self.by(m)])

    def slack(self, m: float) -> float:
        """What rounding may do to a slope that is compared with m."""
        import numpy as np

        return 8 * np.finfo(float).eps * (float(np.abs(self.v).max()) + abs(m) * float(self.t[-1])) / self.gap

    def of(self, i, j):
        return (self.v[j] - self.v[i]) / ((self.us[j] - self.us[i]) / float(DAY))

    def between(self, low: float, high: float):
        """The slopes of all pairs that are above the one and not above the other: those that change their order."""
        import numpy as np

        first, second = self.by(low), self.by(high)
        at = np.empty(len(second), dtype=np.int64)
        at[second] = np.arange(len(second))
        moved = at[first]
        # runs of places that both orders fill with the same points
        ends = np.flatnonzero(np.maximum.accumulate(moved) == np.arange(len(moved)))
        out, start = [], 0
        for end in ends:
            run = first[start : end + 1]
            if len(run) > 1:
                for k in range(len(run) - 1):
                    later = run[k + 1 :]
                    swapped = later[(at[later] < at[run[k]]) & (self.rank[later] != self.rank[run[k]])]
                    if len(swapped):
                        i, j = np.minimum(run[k], swapped), np.maximum(run[k], swapped)
                        out.append(self.of(i, j))
            start = end + 1
        return np.sort(np.concatenate(out)) if out else np.zeros(0)

    def any_between(self, low: float, high: float) -> float | None:
        """The slope of some pair between two: two neighbours of one order that stand the other way round in the other."""
        import numpy as np

        first, second = self.by(low), self.by(high)
        at = np.empty(len(second), dtype=np.int64)
        at[second] = np.arange(len(second))
        k = np.flatnonzero((np.diff(at[first]) < 0) & (self.rank[first[:-1]] != self.rank[first[1:]]))
        if not len(k):
            return None
        i, j = sorted((first[k[0]], first[k[0] + 1]))
        return float(self.of(np.int64(i), np.int64(j)))

    def ranked(self, k: int) -> float:
        """The slope of rank k, counted from 0, among all pairs."""
        import numpy as np

        steep = (float(self.v.max()) - float(self.v.min())) / self.gap
        low, high = -steep - 1.0 - 2 * self.slack(steep), steep + 1.0 + 2 * self.slack(steep)
        below, upto = 0, self.pairs
        few = max(FEW, len(self.us) // 8)
        for step in range(STEPS):
            width = high - low
            if upto - below <= few:
                slopes = self.between(low, high)
                if k - below < len(slopes):
                    s = float(slopes[k - below])
                    clear = self.slack(s)
                    if s - low > clear and high - s > clear:
                        return s
            tight = 4 * self.slack((low + high) / 2)
            if width <= tight or low + width / 2 in (low, high):
                s = self.any_between(low - tight, high + tight)
                return s if s is not None else (low + high) / 2
            if upto - below <= few:
                # too near an end: halve towards it no further, look at a wider range
                low, high = low - width, high + width
                below, upto = self.up_to(low), self.up_to(high)
                few *= 2
                continue
            share = (k + 0.5 - below) / (upto - below)
            # by turns just beyond the place where even spacing puts the rank, on either side, and in the middle
            margin = 0.02
            m = low + width * (0.5 if step % 3 == 2 else min(0.98, max(0.02, share + (margin if step % 3 else -margin))))
            c = self.up_to(m)
            if c > k:
                high, upto = m, c
            else:
                low, below = m, c
        return (low + high) / 2

    def median(self) -> float | None:
        if not self.pairs:
            return None
        a = self.ranked((self.pairs - 1) // 2)
        return a if self.pairs % 2 else (a + self.ranked(self.pairs // 2)) / 2


def median_slope(us, v) -> float | None:
    """The median slope a day; of a short series from its pairs at once."""
    import numpy as np

    if len(us) > SHORT:
        return Slopes(us, v).median()
    i, j = np.triu_indices(len(us), 1)
    order = np.lexsort((v, us))
    us, v = us[order], v[order]
    apart = us[j] != us[i]
    i, j = i[apart], j[apart]
    if not len(i):
        return None
    slopes = np.sort((v[j] - v[i]) / ((us[j] - us[i]) / float(DAY)))
    low, high = slopes[(len(slopes) - 1) // 2], slopes[len(slopes) // 2]
    return float(low if len(slopes) % 2 else (low + high) / 2)


def medians(n_keys: int):
    """For mapInArrow over rows in order of their keys: the median slope of each series of columns us and v; one series is held at a time."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, held = None, []

        def slope() -> float | None:
            return median_slope(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def made(rows: list) -> pa.RecordBatch:
            return pa.record_batch([*[pa.array([r[0][i] for r in rows], t) for i, t in enumerate(types)], pa.array([r[1] for r in rows], pa.float64())], names=[*names, "slope"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, types = batch.schema.names[:n_keys], batch.schema.types[:n_keys]
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:n_keys]], strict=True))
            us, v = batch.column("us").to_numpy(), batch.column("v").to_numpy()
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]]
            done = []
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if held and keys[start] != key:
                    done.append((key, slope()))
                    held = []
                key = keys[start]
                held.append((us[start:end], v[start:end]))
            yield made(done)
        if held:
            yield made([(key, slope())])

    return run
