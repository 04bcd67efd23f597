"""Word ranges that two texts share: from a place where they agree, along both as far as they are alike."""

from __future__ import annotations

import numpy as np

AGREE = 3  # words that agree again after some that differ, at least
#: Words of a gap at most (what lies at its two sides is two passages else), and runs beyond the point where likeness is lost.
GAP, BEYOND = 256, 4


def run(x: np.ndarray, y: np.ndarray) -> int:
    """Equal words at the beginning."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + len(differ), 4 * step
    return n


def _resumed(x: np.ndarray, y: np.ndarray, most: int) -> tuple[int, int, int]:
    """Words of both that differ, `most` of each side at most, and the words that agree after them; (0, 0, 0) if none do.

    Of all places at which AGREE words agree again the nearest counts; the run there must be as long as the gap.
    """
    if len(x) > AGREE and len(y) > AGREE and x[1] == y[1] and x[2] == y[2] and x[3] == y[3]:
        return 1, 1, run(x[1:], y[1:])  # one word differs: nothing is nearer
    reach = 4
    while True:
        reach = min(4 * reach, most)
        p, q = x[: reach + AGREE], y[: reach + AGREE]
        if len(p) < AGREE or len(q) < AGREE:
            return 0, 0, 0
        same = p[:, None] == q[None, :]
        again = same[:-2, :-2] & same[1:-1, 1:-1] & same[2:, 2:]
        a, b = np.nonzero(again)
        for k in np.lexsort((abs(a - b), np.maximum(a, b)))[:4]:
            i, j = int(a[k]), int(b[k])
            n = run(x[i:], y[j:])
            if n >= max(i, j):
                return i, j, n
        if reach >= most or (reach >= len(x) and reach >= len(y)):
            return 0, 0, 0


def _gained(words: int, gap: tuple[int, int], similarity: float) -> float:
    """What a run of agreeing words after a gap adds: positive sums mean the similarity or more.

    A run shares all its shingles but four, a gap destroys its own words' and four in either text.
    """
    return (1 - similarity) * max(0, words - 4) - similarity * (sum(gap) + 8)


def _onward(x: np.ndarray, y: np.ndarray, similarity: float, gain: float) -> list[tuple[int, int, float]]:
    """Where runs of agreeing words end in both, one after the other, and what all up to there add to the gain in front."""
    i, j, g, below = 0, 0, 0.0, 0
    ends = [(0, 0, 0.0)]
    while below <= BEYOND:
        # A gap may cost twice what has been gained: as much can be gained behind it.
        most = min(GAP, 2 + max(0, int((gain + g) / similarity)))
        a, b, n = _resumed(x[i:], y[j:], most)
        if not n:
            break
        i, j, g = i + a + n, j + b + n, g + _gained(n, (a, b), similarity)
        ends.append((i, j, g))
        below = below + 1 if gain + g < 0 else 0
    return ends


def hopeful(same: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """For each five-word shingle of a text, whether aligned_from() could make a passage of the run of shared ones it lies in.

    same: whether the other text has the shingle, anywhere. A passage without gaps has least - 4 such shingles in a row.
    Each gap of one with gaps costs as many shingles as its words (one at least) and eight, times similarity / (1 - similarity),
    and leaves no more unshared than its words and four. All gaps cost no more than the passage's shingles.
    """
    hope, price = np.zeros(len(same), bool), similarity / max(1e-9, 1 - similarity)
    if np.count_nonzero(same) < max(1, min(least - 4, 9 * price - 1e-6)):
        return hope
    around = np.zeros(len(same) + 2, bool)
    around[1:-1] = same
    ends = np.flatnonzero(around[1:] != around[:-1])
    starts, ends = ends[::2], ends[1::2]
    n, cost = (ends - starts).astype(float), np.zeros(len(starts))
    cost[1:] = np.maximum(9, starts[1:] - ends[:-1] + 4) * price
    to_right, to_left = np.cumsum(n - cost), np.cumsum(np.concatenate([[0], n[:-1]]) - cost)
    right = np.concatenate([np.maximum.accumulate(to_right[::-1])[::-1][1:], [-np.inf]]) - to_right
    left = to_left - np.concatenate([[np.inf], np.minimum.accumulate(to_left)[:-1]])
    hope[same] = np.repeat((n >= least - 4) | (n + np.maximum(np.maximum(left, right), left + right) >= -1e-6), ends - starts)
    return hope


def shingles(x: np.ndarray, words: int = 5) -> np.ndarray:
    """64-bit hashes of the runs of so many words."""
    n = max(0, len(x) - words + 1)
    joined, wide = np.zeros(n, np.uint64), x.astype(np.uint64)
    for k in range(words):
        joined *= np.uint64(0x9E3779B97F4A7C15)
        joined += wide[k : k + n]
    return joined


def shingle_hashes(x: np.ndarray, words: int = 5) -> np.ndarray:
    """The different 64-bit hashes of the runs of so many words."""
    joined = shingles(x, words)
    joined.sort()
    return joined[np.concatenate([[True], joined[1:] != joined[:-1]])] if len(joined) else joined


def likeness(x: np.ndarray, y: np.ndarray, words: int = 5) -> float:
    """Jaccard similarity of the shingle sets of two word sequences."""
    if len(x) == len(y) and (x == y).all():
        return 1.0
    a, b = shingle_hashes(x, words), shingle_hashes(y, words)
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(both) - shared)


def aligned_from(x: np.ndarray, y: np.ndarray, i: int, j: int, n: int, similarity: float, least: int) -> tuple[int, int, int, int, float]:
    """Range of x around the n equal words from i (in y from j), y's range that is like it, and their similarity.

    Words that differ are passed as far as the whole range stays alike enough, by a count of what gaps destroy; if the
    shingle sets then are not alike, the outermost run of the side that adds less goes, until they are. A range of
    fewer than `least` words is not compared; its similarity is 0.
    """
    i, j, n = _whole_run(x, y, i, j, n)
    own = (1 - similarity) * max(0, n - 4)
    right = _onward(x[i + n :], y[j + n :], similarity, own)
    to_right = max((g for _, _, g in right if own + g >= 0), default=0.0)
    left = _onward(x[:i][::-1], y[:j][::-1], similarity, own + to_right)
    while len(left) > 1 and own + to_right + left[-1][2] < 0:
        left.pop()
    while len(right) > 1 and own + left[-1][2] + right[-1][2] < 0:
        right.pop()
    while True:
        (p, q, _), (r, s, _) = left[-1], right[-1]
        a, b, c, d = i - p, i + n + r, j - q, j + n + s
        like = likeness(x[a:b], y[c:d]) if b - a >= least else 0.0
        if like >= similarity or b - a < least or len(left) == len(right) == 1:
            return a, b, c, d, like
        last = [side[-1][2] - side[-2][2] if len(side) > 1 else np.inf for side in (left, right)]
        (left if last[0] <= last[1] else right).pop()


def _whole_run(x: np.ndarray, y: np.ndarray, i: int, j: int, n: int) -> tuple[int, int, int]:
    """The longest run of equal words that has these."""
    before, after = run(x[:i][::-1], y[:j][::-1]), run(x[i + n :], y[j + n :])
    return i - before, j - before, before + n + after
