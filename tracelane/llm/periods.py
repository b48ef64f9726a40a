"""Maximal periodic runs of words, found by string synchronising sets at dyadic scales.

At scale t a place is synchronising when the smallest hash among the t-word strings that start in the t + 1 places
from it on stands at the first or the last of them; strings that are themselves highly periodic (period at most t/3)
do not count.  Equal contexts of 2t words choose alike, so in a run of period q, 3t <= q < 6t, such a place comes
again q words on with an equal context: pairs of equal contexts at such distances propose the period.  Within 6t
words a context occurs a bounded number of times, for its first or last t words have a period above t/3.

What the sets leave out is found apart: periods below 6 by comparing each word with those up to five places on, and
runs whose first period is itself highly periodic, which lie where two runs of one small period meet, by lining up
these two.  Each proposal is extended to both sides by comparing hashes of strings of 2^k words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import in_arrow, raw, slices

LEAST_WORDS = 12
"""Runs are at least so many words long, and at least two periods."""

_SMALL = 5
"""Periods up to here are found by direct comparison."""


def _mixed(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + _mixed(b + np.uint64(0x632BE59BD9B4E019)))


class _Strings:
    """Hashes of all strings of 2^k words of a sequence, which say how far two places agree.

    Every document ends with a word of its own, so no agreement passes an end.
    """

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.levels = [_mixed(words.astype(np.uint64) + np.uint64(1))]

    def level(self, k: int) -> np.ndarray:
        """Hash of the 2^k words from each place on, as far as they reach."""
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(_joined(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]

    def _agree(self, a: np.ndarray, b: np.ndarray, step: int, most: int) -> np.ndarray:
        """Number of equal words from a < b on (step 1) or before them (step -1)."""
        far = np.zeros(len(a), np.int64)
        k, grow = 0, np.arange(len(a))
        while len(grow):  # how large a string agrees, at most
            width = 1 << k
            at, to = (a[grow] + far[grow], b[grow] + far[grow]) if step > 0 else (a[grow] - far[grow] - width, b[grow] - far[grow] - width)
            fits = (to + width <= self.size) & (at >= 0)
            grow, at, to = grow[fits], at[fits], to[fits]
            hashes = self.level(k)
            same = hashes[at] == hashes[to]
            grow = grow[same]
            far[grow] += width
            k += 1
        for k in range(k - 1, -1, -1):
            width, hashes = 1 << k, self.level(k)
            at, to = (a + far, b + far) if step > 0 else (a - far - width, b - far - width)
            fits = np.flatnonzero((to + width <= self.size) & (at >= 0))
            far[fits[hashes[at[fits]] == hashes[to[fits]]]] += width
        return far

    def runs(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Rows (start, end, period) of the longest stretches around ``at`` in which words ``period`` apart agree."""
        key = np.unique(period << 40 | at)
        period, at = key >> 40, key & (1 << 40) - 1
        found = np.stack([at - self._agree(at, at + period, -1, 0), at + period + self._agree(at, at + period, 1, 0), period], 1)
        return np.unique(found, axis=0)


def _small(words: np.ndarray) -> np.ndarray:
    """Stretches of period up to five that are long enough to be a run or have three periods and four words."""
    out = []
    for q in range(1, _SMALL + 1):
        same = np.zeros(max(len(words) - q, 0) + 2, np.int8)
        same[1:-1] = words[:-q] == words[q:] if len(words) > q else 0
        edge = np.flatnonzero(np.diff(same))
        start, end = edge[::2], edge[1::2] + q
        keep = end - start >= max(4, min(3 * q, LEAST_WORDS))
        out.append(np.stack([start[keep], end[keep], np.full(keep.sum(), q)], 1))
    return np.concatenate(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width + 1`` values from each place on (width a power of two)."""
    low, reach = values, 1
    while reach < width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[:-1], values[width:]) if len(low) > 1 else low[:0]


def _synchronising(hashes: np.ndarray, runs: np.ndarray, t: int) -> np.ndarray:
    """The synchronising places of scale t; ``hashes`` are those of t words, ``runs`` hold all of period up to t/3."""
    tops = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = hashes
    periodic = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    if len(periodic):
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, periodic[:, 0], 1)
        np.add.at(edge, periodic[:, 1] - t + 1, -1)
        values = np.where(np.cumsum(edge[:-1]) > 0, tops, hashes)
    least = _least(values, t)
    n = len(least)
    return np.flatnonzero((least != tops) & ((least == values[:n]) | (least == values[t : t + n])))


def _proposed(places: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal contexts between 3t and 6t - 1 words apart."""
    places = places[places < len(context)]
    order = np.argsort(context[places], kind="stable")
    places = places[order]
    name = context[places]
    at, far = [], []
    for k in range(1, len(places)):
        same = name[:-k] == name[k:]
        apart = places[k:] - places[:-k]
        near = same & (apart < 6 * t)
        if not near.any():
            break
        near &= apart >= 3 * t
        at.append(places[:-k][near])
        far.append(apart[near])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *at]), np.concatenate([empty, *far])


def _where_runs_meet(words: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of runs whose first period is highly periodic.

    Such a run lies in two stretches of one smaller period p that touch or overlap by less than p, and moves the
    content of the first on that of the second: its periods are all that line the two up and fit in both.
    """
    at, far = [], []
    long = runs[runs[:, 1] - runs[:, 0] >= 9 * runs[:, 2]]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    for (b1, e1, p), (b2, e2, p2) in zip(long[:-1].tolist(), long[1:].tolist()):
        if p != p2 or e1 < b2:
            continue
        root = words[b1 : b1 + 2 * p - 1]
        turns = np.lib.stride_tricks.sliding_window_view(root, p)
        turn = np.flatnonzero((turns == words[b2 : b2 + p]).all(1))
        if not len(turn):
            continue
        most = min(e1 - b1, e2 - b2, (e2 - b1) // 2)
        q = np.arange((b2 - b1 - int(turn[0])) % p, most + 1, p)
        q = q[(q > _SMALL) & (q > 2 * p)]
        at.append(np.maximum(b1, b2 - q))
        far.append(q)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *at]), np.concatenate([empty, *far])


def find_runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows ``(start, end, period)`` of all runs, by start and period.

    ``words``: numbers of the words of documents one after another; ``ends``: places of each document's last word,
    which must occur nowhere else.
    """
    runs = _small(words)
    whole, back = words, np.arange(len(words))
    alive = np.diff(ends, prepend=-1)  # words of documents that can still have a run
    t, strings, found = 2, _Strings(words), [runs]
    document = np.repeat(np.arange(len(ends)), alive)
    base = runs
    while strings.size >= 6 * t:
        k = t.bit_length() - 1
        places = _synchronising(strings.level(k), base, t)
        context = strings.level(k + 1)
        at, far = _proposed(places, context, t)
        if len(at):
            new = strings.runs(at, far)
            new = new[new[:, 1] - new[:, 0] >= 2 * new[:, 2]]
            base = np.concatenate([base, new])
            found.append(np.stack([back[new[:, 0]], back[new[:, 1] - 1] + 1, new[:, 2]], 1))
        # a document without equal contexts and without a highly periodic stretch has none at larger scales
        some = np.zeros(len(ends), bool)
        places = places[places < len(context)]
        both = np.stack([document[places].astype(np.uint64), context[places]], 1)
        order = np.lexsort((both[:, 1], both[:, 0]))
        twice = (both[order[:-1]] == both[order[1:]]).all(1)
        some[document[places[order[:-1][twice]]]] = True
        some[document[base[base[:, 1] - base[:, 0] >= t, 0]]] = True
        some &= alive >= 12 * t
        t *= 2
        keep = some[document]
        if keep.sum() * 2 < len(keep):
            moved = np.cumsum(keep) - 1
            held = base[keep[base[:, 0]]]
            base = np.stack([moved[held[:, 0]], moved[held[:, 1] - 1] + 1, held[:, 2]], 1)
            words, back, document = words[keep], back[keep], document[keep]
            strings = _Strings(words)
    runs = np.unique(np.concatenate(found), axis=0)
    at, far = _where_runs_meet(whole, runs)
    if len(at):
        runs = np.concatenate([runs, _Strings(whole).runs(at, far)])
    size = runs[:, 1] - runs[:, 0]
    runs = runs[(size >= LEAST_WORDS) & (size >= 2 * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a stretch has every multiple of its smallest period too
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts one after another, and how many each has."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()))
    words = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    held = np.concatenate([[0], np.cumsum(full)])[offsets]
    return words.filter(pa.array(full)), np.diff(held)


def _periodic(batches):
    for batch in slices(batches):
        words, sizes = _words(batch.column(1))
        named = words.dictionary_encode()
        ends = np.cumsum(sizes + 1) - 1
        numbers = np.empty(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(numbers), bool)
        inside[ends] = False
        numbers[inside] = named.indices.to_numpy()
        numbers[ends] = len(named.dictionary) + np.arange(len(ends))
        runs = find_runs(numbers, ends)
        document = np.searchsorted(ends, runs[:, 0])
        start = runs[:, 0] - (ends - sizes)[document]
        length, period = runs[:, 1] - runs[:, 0], runs[:, 2]
        gone = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + period, 1)
        np.add.at(gone, runs[:, 1], -1)
        kept = (np.cumsum(gone)[:-1] == 0)[inside]
        left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
        words = words.filter(pa.array(kept))
        collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), words), pa.scalar(" ", pa.large_string()))
        cuts = np.searchsorted(document, np.arange(len(sizes) + 1))
        spans = pa.StructArray.from_arrays(
            [pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]
        )
        yield {
            "id": batch.column(0),
            "n_words": sizes,
            "runs": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans),
            "collapsed": collapsed.cast(pa.string()),
        }


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_words, runs, collapsed``.

    ``runs`` lists (start, length, period), all maximal stretches of at least 12 words and two periods, in words from
    0, by start and period.  ``collapsed`` is the text without the words that stand in a run after its first period,
    joined by single blanks.  Words are what is between bytes 9 to 13 and 32.

    Rows are independent: no shuffle, any ids, repeated rows give repeated results.  Null and empty texts have no
    words, no runs and an empty collapsed text.  A text of any length is searched whole, in memory in proportion to
    its words times the logarithm of their number.
    """
    table = docs.select(F.col(id).alias("id"), raw(text).alias("text"))
    kind = dict(table.dtypes)["id"]
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return in_arrow(table, _periodic, schema).withColumnRenamed("id", id)
