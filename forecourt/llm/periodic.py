"""Periodic runs of words, found online by catchers over dyadic blocks (operator 11)."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from forecourt.llm.batches import append, fresh
from forecourt.llm.pretokens import take_ragged

SEGMENT = 1 << 17  # words appended at once; any other number gives the same runs
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NO_RUNS = np.zeros((0, 3), np.int64)


def agreeing(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places the number of equal words from there on, at most ``limit``.

    ``step`` is 1 for words to the right and -1 for words to the left.  Each round compares
    twice as many words as the one before, and pairs that have differed leave.
    """
    got, live, width = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0), 4
    while len(live):
        size = np.minimum(limit[live] - got[live], width)
        reach = take_ragged(np.zeros(len(live), np.int64), size)
        near = words[np.repeat(a[live] + step * got[live], size) + step * reach]
        far = words[np.repeat(b[live] + step * got[live], size) + step * reach]
        bad = np.where(near == far, np.repeat(size, size), reach)
        equal = np.minimum.reduceat(bad, size.cumsum() - size)
        got[live] += equal
        live = live[(equal == size) & (got[live] < limit[live])]
        width *= 2
    return got


def merged(runs: np.ndarray) -> np.ndarray:
    """Rows (period, start, end): stretches of one period that share a period's words become one."""
    if not len(runs):
        return NO_RUNS
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    period, start, end = runs.T
    apart = np.concatenate(([0], (np.diff(period) != 0).cumsum())) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    first = np.concatenate(([True], (start + apart)[1:] > reach[:-1] - period[1:]))
    at = np.flatnonzero(first)
    return np.stack([period[at], start[at], np.maximum.reduceat(end, at)], 1)


class Level:
    """The catchers of all aligned blocks of one power-of-two size.

    The catcher of the completed block [l, l + size) waits for the block's words to come
    again ``q`` places later, for the periods ``low <= q < high``.  It keeps the hash of the
    block only.  A square whose half is ``q`` has a whole aligned block in the first
    ``size`` + ``size`` words of its left half, so none is missed; a hash that comes again is compared
    word by word, so none is made up.
    """

    def __init__(self, size: int, low: int, high: int):
        self.size, self.low, self.high = size, low, high
        self.blocks = np.zeros(0, np.uint64)  # hashes of the completed blocks
        self.tail = np.zeros(0, np.uint64)  # hashes at the last places, for the next level
        self.tail_from = 0
        self.open = np.zeros((0, 2), np.int64)  # (l, q) whose comparison waits for more words
        self.runs = NO_RUNS

    def take(self, hashes: np.ndarray, begin: int) -> np.ndarray:
        """Hashes of the words at the places from ``begin`` on; gives the new (l, q)."""
        size, end = self.size, begin + len(hashes)
        at = np.arange(-(-begin // size) * size, end, size)
        self.blocks = np.concatenate([self.blocks, hashes[at - begin]])
        found, place = [np.zeros((0, 2), np.int64)], np.arange(begin, end)
        for back in range(self.low // size, self.high // size):
            block = place // size - back
            usable = int(np.searchsorted(block, 0))
            hit = np.flatnonzero(self.blocks[block[usable:]] == hashes[usable:]) + usable
            start = block[hit] * size
            found.append(np.stack([start, place[hit] - start], 1))
        return np.concatenate(found)


class Catchers:
    """Maximal runs of the words appended so far.

    ``append`` takes any number of words.  The new words complete blocks, whose catchers
    start; they advance the comparisons that had reached the end of the words; and the
    catchers whose block comes again open new ones.  A square found is merged at once with the run it
    belongs to.  Appending words one by one or all together gives the same runs.
    """

    def __init__(self, longest: int | None = None):
        """``longest``: the most words that a run can have, if that is known."""
        self.words, self.n = np.zeros(1024, np.int64), 0
        self.levels = [Level(1, 1, 2), Level(1, 2, 4)]
        self.longest = longest

    def _grow(self, words: np.ndarray) -> None:
        if self.n + len(words) > len(self.words):
            bigger = np.zeros(max(2 * len(self.words), self.n + len(words)), np.int64)
            bigger[:self.n] = self.words[:self.n]
            self.words = bigger
        self.words[self.n:self.n + len(words)] = words
        self.n += len(words)

    def append(self, words: np.ndarray) -> None:
        begin = self.n
        self._grow(words)
        hashes = self.words[begin:self.n].astype(np.uint64) * LEFT
        hashes ^= hashes >> np.uint64(29)
        for i, level in enumerate(self.levels):
            self._search(level, hashes, begin)
            if i:
                hashes, begin = self._doubled(level, hashes, begin)
        while 4 * self.levels[-1].high <= min(self.n, self.longest or self.n):
            above = self.levels[-1]
            level = Level(2 * above.size, above.high, 2 * above.high)
            self.levels.append(level)
            # A level begins when a run could first have its period, so all places are new to it.
            hashes, begin = self._all_hashes(level.size), 0
            self._search(level, hashes, begin)
            self._doubled(level, hashes, begin)

    def _all_hashes(self, size: int) -> np.ndarray:
        hashes, width = self.words[:self.n].astype(np.uint64) * LEFT, 1
        hashes ^= hashes >> np.uint64(29)
        while width < size:
            hashes = self._pair(hashes[:-width], hashes[width:])
            width *= 2
        return hashes

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = left * LEFT
        out ^= out >> np.uint64(31)
        out += right * RIGHT
        return out

    def _doubled(self, level: Level, hashes: np.ndarray, begin: int) -> tuple[np.ndarray, int]:
        """Hashes of twice the size at the places that have them now, and the first such place."""
        size = level.size
        known = np.concatenate([level.tail[len(level.tail) - max(0, begin - level.tail_from):], hashes])
        known_from = begin + len(hashes) - len(known)
        keep = min(len(known), size)
        level.tail, level.tail_from = known[len(known) - keep:].copy(), begin + len(hashes) - keep
        return self._pair(known[:-size], known[size:]), known_from

    def _search(self, level: Level, hashes: np.ndarray, begin: int) -> None:
        found = np.concatenate([level.open, self._worthwhile(level, level.take(hashes, begin))])
        if not len(found):
            return
        l, q = found.T
        limit = np.minimum(np.maximum(q, 2 * level.size), self.n - l - q)
        right = agreeing(self.words, l, l + q, limit, 1)
        left = agreeing(self.words, l - 1, l + q - 1, np.minimum(l, level.size), -1)
        level.open = found[(right == limit) & (l + q + right == self.n)]
        square = left + right >= q
        level.runs = merged(np.concatenate([level.runs, np.stack([
            q, l - left, l + q + right], 1)[square]]))

    def _worthwhile(self, level: Level, found: np.ndarray) -> np.ndarray:
        """Without the pairs that can only give again a run of a smaller period.

        A block inside a run of period p <= size / 2 comes again at every p-th place of that
        run, and each time the stretch is the run itself, so those are left out.  If it comes
        again in another run of that period, a square must join the runs' starts or their ends.
        """
        small = merged(np.concatenate([v.runs for v in self.levels if v.low <= level.size // 2] or [NO_RUNS]))
        small = small[(small[:, 0] <= level.size // 2) & (small[:, 2] - small[:, 1] >= level.size)]
        if not len(small) or not len(found):
            return found
        # Two such runs share fewer than ``size`` words, so the last start is the only candidate.
        small = small[np.argsort(small[:, 1], kind="stable")]
        period, start, end = small.T

        def inside(at):
            k = np.searchsorted(start, at, side="right") - 1
            return np.where((k >= 0) & (end[k] >= at + level.size), k, -1)
        one, two = inside(found[:, 0]), inside(found[:, 0] + found[:, 1])
        q = found[:, 1]
        both = (one >= 0) & (two >= 0) & (period[one] == period[two])
        joins = (start[two] - start[one] == q) | (start[two] <= end[one]) | np.where(
            end[two] == self.n, q >= end[two] - end[one], end[two] - end[one] == q)
        return found[~both | ((one != two) & joins)]

    def runs(self) -> np.ndarray:
        """(start, length, period) of the squares' runs by start and period, smallest periods only."""
        period, start, end = np.concatenate([v.runs for v in self.levels]).T
        order = np.lexsort((period, end, start))
        period, start, end = period[order], start[order], end[order]
        # A multiple of a run's period gives the same stretch again.
        same = np.concatenate(([False], (np.diff(start) == 0) & (np.diff(end) == 0)))[:len(start)]
        out = np.stack([start, end - start, period], 1)[~same]
        return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[np.ndarray], least: int, times: int, segment: int = SEGMENT) -> list[np.ndarray]:
    """(start, length, period) of the runs of each sequence of word numbers.

    The sequences are one stream, with a word between them that occurs nowhere else.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = (sizes + 1).cumsum() - sizes - 1
    stream = np.empty(int((sizes + 1).sum()), np.int64)
    for t, s in zip(texts, starts.tolist(), strict=True):
        stream[s:s + len(t)] = t
    stream[starts + sizes] = -1 - np.arange(len(texts))
    catchers = Catchers(int(sizes.max(initial=0)))
    for at in range(0, len(stream), segment):
        catchers.append(stream[at:at + segment])
    found = catchers.runs()
    found = found[found[:, 1] >= np.maximum(least, times * found[:, 2])]
    place = np.searchsorted(starts, found[:, 0], side="right") - 1
    found[:, 0] -= starts[place]
    cuts = np.searchsorted(place, np.arange(1, len(texts)))
    return np.split(found, cuts)


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if of every run only the first period does."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return edge.cumsum()[:n] == 0


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Add ``runs``, all periodic runs of words of every whole text, and ``collapsed``.

    Words are what ASCII white space separates.  A run is a longest stretch of words whose
    smallest period q repeats: at least ``least`` words and ``times`` * q words long.
    ``runs`` holds (start, length, period) by start, then period; ``collapsed`` the words that
    are in no run after its first period, joined by one space.  A null, empty or blank text
    has no runs and collapses to the empty text.  Works text by text without a shuffle: repeated rows have
    equal results, an empty frame stays empty, a taken column name gets an underscore.  A very
    long text takes O(n log n) steps in the task that has it, and about 200 bytes a word.
    """
    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))

    def run(offsets, raw):
        data = raw.tobytes()
        words = [data[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        found = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words], least, times)
        collapsed = []
        for w, r in zip(words, found, strict=True):
            if len(r):
                w = [w[i] for i in np.flatnonzero(kept(len(w), r)).tolist()]
            collapsed.append(b" ".join(w).decode("utf-8", "replace"))
        flat = np.concatenate(found) if found else NO_RUNS
        fields = [pa.array(flat[:, i]) for i in range(3)]
        ends = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
        items = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        return [pa.ListArray.from_arrays(pa.array(ends), items), pa.array(collapsed, pa.string())]
    return append(docs, text, run, [
        T.StructField(fresh(docs, "runs"), run_type), T.StructField(fresh(docs, "collapsed"), T.StringType())])
