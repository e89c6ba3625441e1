"""Maximal periodic stretches of words by suffix trees of a text and its reversal.

A run of smallest period q holds a Lyndon word of q words, least among the rotations of its period in one of two
orders of the alphabet: the given one or the opposite. For each order:

1. the longest Lyndon word at a place ends where the next smaller suffix begins; the order of suffixes is the
   order of the leaves of Ukkonen's suffix tree, children in (opposite) order of their first words;
2. each of these words is a candidate period. It is extended to the right by the longest common extension of the
   places one period apart, read off the tree as the depth of the lowest common ancestor of two leaves, and to
   the left in the same way in the tree of the reversed text;
3. the lowest common ancestor is the shallowest node between two leaves on the Euler tour, found in constant
   time by a table of minima over stretches of 2**k steps.

Each text is worked on where it lies; nothing is shuffled. Trees are built only for the parts of a text in which
a run can lie at all: ``regions`` finds them without losing one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import common

LEAST, TIMES = 24, 3  # a run has at least so many words, and so many periods
_COLUMNS = {"n_words": "long", "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long",
            "runs_sha256": "string", "collapsed_sha256": "string", "runs": "array<struct<start:long,length:long,period:long>>",
            "collapsed": "string"}
_ARROW = {"long": pa.int64(), "string": pa.large_string()}


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers, with leaves in order and common extensions.

    Node 0 is the root. Edges are kept in one table under (node, first number). ``codes`` must be below ``2**32``;
    an end mark smaller than every code is added.
    """

    def __init__(self, codes: list[int]):
        text = [*codes, -1]
        self.n = len(text)
        self.start, self.end, edge = _ukkonen(text)
        self.children: list[list[tuple[int, int]]] = [[] for _ in self.start]
        for key, child in edge.items():
            self.children[key >> 33].append(((key & 0x1FFFFFFFF) - 1, child))

    def tour(self, opposite: bool = False, extensions: bool = True) -> np.ndarray:
        """Rank of every suffix by a walk over the tree; keeps the Euler tour for ``common`` on request.

        The end mark comes first in either order. The tour lists the depth of a node at each visit.
        """
        start, end, n = self.start, self.end, self.n
        rank = [0] * n
        place = 0
        tour, seen = [], [0] * n
        stack = [(0, 0, None)]  # node, depth, children still to visit
        sign = -1 if opposite else 1
        while stack:
            node, depth, left = stack.pop()
            if left is None:
                below = self.children[node]
                if not below:
                    suffix = n - depth
                    rank[suffix] = place
                    place += 1
                    seen[suffix] = len(tour)
                    tour.append(depth)
                    continue
                left = sorted(below, key=lambda c: (c[0] >= 0, sign * c[0]), reverse=True)
            tour.append(depth)
            if left:
                child = left.pop()[1]
                stack.append((node, depth, left))
                stop = end[child]
                stack.append((child, depth + (n if stop < 0 else stop) - start[child], None))
        if extensions:
            self.seen = np.array(seen)
            self.low = [np.array(tour, np.int32)]
            while len(self.low[-1]) > 1 << (len(self.low) - 1):
                width = 1 << (len(self.low) - 1)
                self.low.append(np.minimum(self.low[-1][:-width], self.low[-1][width:]))
        return np.array(rank)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j have in common at their beginnings; i differs from j."""
        a, b = self.seen[i], self.seen[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            low = self.low[k]
            out[at] = np.minimum(low[a[at]], low[b[at] - (1 << int(k)) + 1])
        return out


def _ukkonen(text: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Start and end of the edge into each node (end -1: to the end of the text), and the child by node and number."""
    start, end, link, edge = [0], [0], [0], {}
    node = reach = 0  # the active point: a node, and how many numbers of the text lie below it
    waiting = 0
    n = len(text)
    for i in range(n):
        waiting += 1
        made = 0
        while waiting:
            key = (node << 33) + text[i - reach] + 1
            child = edge.get(key, 0)
            if not child:
                edge[key] = len(start)
                start.append(i - reach)
                end.append(-1)
                link.append(0)
                if made:
                    link[made] = node
                made = 0
            else:
                stop = end[child]
                length = (i if stop < 0 else stop) - start[child]
                if stop >= 0 and reach >= length:
                    node = child
                    reach -= length
                    continue
                if text[start[child] + reach] == text[i]:
                    reach += 1
                    if made:
                        link[made] = node
                    break
                middle = len(start)
                start.append(start[child])
                end.append(start[child] + reach)
                link.append(0)
                edge[key] = middle
                leaf = middle + 1
                start.append(i)
                end.append(-1)
                link.append(0)
                edge[(middle << 33) + text[i] + 1] = leaf
                start[child] += reach
                edge[(middle << 33) + text[start[child]] + 1] = child
                if made:
                    link[made] = middle
                made = middle
            waiting -= 1
            if node == 0:
                if reach:
                    reach -= 1
            else:
                node = link[node]
    return start, end, edge


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one to the right with a smaller rank, or the end."""
    values = rank.tolist()
    n = len(values)
    out = [n] * n
    open_ = []
    for i, r in enumerate(values):
        while open_ and values[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def find_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of a sequence as rows (start, length, period), by start, then period."""
    n = len(codes)
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none
    codes = np.unique(codes, return_inverse=True)[1].tolist()
    tree, back = SuffixTree(codes), SuffixTree(codes[::-1])
    back.tour()
    found = []
    for opposite in (False, True):
        rank = tree.tour(opposite, extensions=not opposite)
        i = np.arange(n)
        period = next_smaller(rank)[:n] - i  # the end mark is the smallest suffix: at most n - i
        at = np.flatnonzero(i + period < n)
        i, period = i[at], period[at]
        right = tree.common(i, i + period)
        left = np.zeros(len(i), np.int64)
        at = np.flatnonzero(i > 0)
        # Words before i are those from n - i on in the reversed text.
        left[at] = back.common(n - i[at], n - i[at] - period[at])
        found.append(np.stack([i - left, left + period + right, period], axis=1))
    runs = np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]
    return runs[(runs[:, 1] >= least) & (runs[:, 1] >= times * runs[:, 2])]


def regions(hashes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint stretches of words outside of which no run lies, in order.

    With L >= max(least, times * q) words, every place of a run from its second period on begins a window of
    ``k`` words that also begins q places before, except for the last k - 1. So there are m = L - q - k + 1 or more such
    places in a row, where k is chosen so that m > 0, and q <= (m + k - 1) / (times - 1). A stretch of m marked
    places therefore covers all its runs when it is widened by that many words to the left and k - 1 to the right, and by
    one more on either side, so that a run of the region never ends at the region's border instead of the text's. Regions that
    overlap become one. Places whose window was last seen farther back than any period of their stretch are
    unmarked first; doing that less often than possible only leaves more to look at.
    """
    k = max(1, (least - least // times) // 2)  # half of the least repeated part
    n = len(hashes)
    if n < least:
        return []
    window = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        window = window * np.uint64(common.STEP_BASE[0]) + hashes[i : n - k + 1 + i]
    order = np.argsort(window, kind="stable")
    back = np.full(len(window), n)  # words to the last window like this one
    same = np.flatnonzero(window[order[1:]] == window[order[:-1]])
    back[order[same + 1]] = order[same + 1] - order[same]
    marked = back < n
    shortest = least - least // times - k + 1
    for _ in range(8):
        edge = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= shortest
        first, last = first[long], last[long]
        if not len(first):
            return []
        count = last - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        near = back[at] <= np.repeat((count + k - 1) // (times - 1), count)
        if near.all():
            break
        marked[:] = False
        marked[at[near]] = True
    out: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), last.tolist()):
        low, high = max(0, a - (b - a + k - 1) // (times - 1) - 1), min(n, b + k)
        while out and low <= out[-1][1]:
            low = min(low, out.pop()[0])
        out.append((low, high))
    return out


def text_runs(hashes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs of a text whose words have these hashes, by start, then period."""
    found = [find_runs(hashes[a:b], least, times) + [[a, 0, 0]] for a, b in regions(hashes, least, times)]
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equals the first, then the one of the shorter period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def describe(words: list[bytes], columns: set[str], least: int = LEAST, times: int = TIMES) -> dict:
    """What is asked for about one text."""
    if len(words) >= least:
        numbers: dict[bytes, int] = {}
        codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
        runs = text_runs(common.mix(codes + np.uint64(1)), least, times)
    else:
        runs = np.zeros((0, 3), np.int64)
    out = {"n_words": len(words), "n_runs": len(runs)}
    best = strongest(runs)
    out["start"], out["length"], out["period"] = best or (None, None, None)
    out["exponent_milli"] = None if best is None else 1000 * best[1] // best[2]
    out["runs_sha256"] = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist()).encode()).hexdigest()
    kept = words
    if len(runs):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    collapsed = b" ".join(kept)
    out["collapsed_sha256"] = hashlib.sha256(collapsed).hexdigest()
    if "collapsed" in columns:
        out["collapsed"] = collapsed.decode()
    if "runs" in columns:
        out["runs"] = [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()]
    return out


def periodic_runs(docs: DataFrame, columns: tuple[str, ...] = ("n_runs", "start", "length", "period", "runs", "collapsed"), *,
                  key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES,
                  prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Runs of words of each text, and the text with every run cut down to its first period.

    A run is a stretch of smallest period q and at least max(least, times * q) words (``times`` is 3 or more) which
    neither neighbouring word continues. ``columns`` chooses from n_words, n_runs; start, length, period and exponent_milli of the
    run with most repeats (null where there is none); runs (all, by start, then period); collapsed (kept words joined by a
    space); runs_sha256 and collapsed_sha256. ``prepare`` may change the words of a row, given its key, before they are looked at.

    A null text has no words. Each row stands for itself, so that keys may be null or repeat; other columns are not looked at. Rows
    stay in their partitions. A task holds the trees of one stretch of one text at a time.
    """
    if times < 3 or least < 2 * times:
        raise ValueError("runs of three periods and six words at least")
    rows = docs.select(F.col(f"`{key}`"), common.whole_text(f"`{text}`").alias("__text"))
    wanted = set(columns)
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = {c: _ARROW.get(_COLUMNS[c], runs_type) for c in columns}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            step = max(1, -(-batch.num_rows * common.BATCH_BYTES // max(1, texts.nbytes)))
            for at in range(0, batch.num_rows, step):
                out: dict[str, list] = {c: [] for c in columns}
                few = keys.slice(at, step)
                for name, value in zip(few.to_pylist(), texts.slice(at, step)):
                    words = (value.as_py() or b"").split()
                    row = describe(words if prepare is None else prepare(name, words), wanted, least, times)
                    for c in columns:
                        out[c].append(row[c])
                yield pa.RecordBatch.from_arrays([few, *[pa.array(out[c], types[c]) for c in columns]], names=[key, *columns])

    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} {_COLUMNS[c]}" for c in columns)
    return rows.mapInArrow(described, schema)


def plant(key: object, words: list[bytes]) -> list[bytes]:
    """Make one text in ten periodic from a word on; where and how often follows from the checksum of its key.

    Rows without a key stay as they are.
    """
    import zlib

    if key is None or not words:
        return words
    rest, kind = divmod(zlib.crc32(str(key).encode()), 10)
    if kind:
        return words
    n = len(words)
    a = rest % n
    p = 1 + (n - a) // (3 + rest % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
