"""Benchmark passages inside training documents, found by suffix arrays over shards of the training words.

Each Arrow slice of documents is a shard.  Its words become numbers of the benchmark's vocabulary (0: not in it);
a suffix that meets an unknown word, or the end of its document, within the window can match no benchmark window,
so only the other suffixes are put in order.  Every window of every test item is then binary-searched in that
order; the interval it yields holds all its places.  Overlapping places of one document join to the longest
verbatim matches.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import carried, carried_type, in_arrow, raw, slices, stored

BLOCK_BYTES = 16 << 20
"""Benchmark text that one pass over the documents searches for; a larger benchmark takes several passes."""

_TABLE = bytes(c if c >= 0x80 or chr(c).isascii() and chr(c).isalnum() else 0x20 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Words ``[0-9a-z and all beyond ASCII]+`` after lower-casing A-Z."""
    return text.lower().translate(_TABLE).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Windows:
    """The windows of one block of items: by length, in order, each with the items that hold it."""

    def __init__(self, items: list[tuple[int, bytes]], size: int):
        self.words = _Vocabulary()
        held: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in split_words(text)]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1) if n else ():
                held[n][np.array(ids[i : i + n], ">u4").tobytes()].add(item)
        self.by_length = {
            n: (np.array(sorted(w), f"S{4 * n}"), [sorted(w[k]) for k in sorted(w)]) for n, w in held.items()
        }


def _suffixes(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``at`` in the order of the ``n`` words that follow, with those words as sortable bytes."""
    keys = np.ascontiguousarray(ids[at[:, None] + np.arange(n)].astype(">u4")).view(f"S{4 * n}").ravel()
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _search(windows: Windows):
    def work(batches):
        for batch in slices(batches):
            words = [split_words(t.as_py()) for t in batch.column(1)]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            starts = np.concatenate([[0], np.cumsum(counts + 1)])
            ids = np.zeros(starts[-1], np.uint32)
            get = windows.words.__getitem__
            for s, n, w in zip(starts, counts, words):
                ids[s : s + n] = np.fromiter(map(get, w), np.uint32, n)
            stops = np.append(np.flatnonzero(ids == 0), len(ids))
            known = np.flatnonzero(ids)
            run = stops[np.searchsorted(stops, known)] - known
            change = np.zeros(len(ids) + 1, np.int64)
            items: dict[int, set[int]] = defaultdict(set)
            for n, (keys, owners) in windows.by_length.items():
                at, order = _suffixes(ids, known[run >= n], n)
                low, high = np.searchsorted(order, keys, "left"), np.searchsorted(order, keys, "right")
                for k in np.flatnonzero(high > low):
                    places = at[low[k] : high[k]]
                    np.add.at(change, places, 1)
                    np.add.at(change, places + n, -1)
                    for d in np.unique(np.searchsorted(starts, places, "right") - 1).tolist():
                        items[d].update(owners[k])
            edges = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]]))
            first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            document = np.searchsorted(starts, first, "right") - 1
            spans: list[list[dict]] = [[] for _ in words]
            for d, a, b in zip(document.tolist(), first.tolist(), end.tolist()):
                spans[d].append({"start": a - int(starts[d]), "length": b - a})
            yield {
                "id": batch.column(0),
                "n_words": counts,
                "spans": spans,
                "items": [sorted(items[d]) if d in items else [] for d in range(len(words))],
                **({"row": batch.column(2)} if batch.num_columns > 2 else {}),
            }

    return work


def _blocks(benchmark: DataFrame, item: str, text: str):
    block, held = [], 0
    for r in benchmark.select(F.col(item).cast("long").alias("i"), raw(text).alias("t")).toLocalIterator():
        if block and held + len(r.t) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r.i, bytes(r.t)))
        held += len(r.t)
    yield block


def _merged(spans: Column) -> Column:
    """Number of words covered by spans that are sorted by start and may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(state, s):
        stop = s["start"] + s["length"]
        new = F.greatest(F.lit(0).cast("long"), stop - F.greatest(s["start"], state["end"]))
        return F.struct((state["n"] + new).alias("n"), F.greatest(state["end"], stop).alias("end"))

    return F.aggregate(spans, start, step, lambda s: s["n"])


def _joined(spans: Column) -> Column:
    """Spans that are sorted by start, with those that overlap or touch made one."""
    start = F.array().cast("array<struct<start:long,length:long>>")

    def step(done, s):
        last = F.try_element_at(done, F.lit(-1))
        stop = F.greatest(last["start"] + last["length"], s["start"] + s["length"])
        longer = F.struct(last["start"].alias("start"), (stop - last["start"]).alias("length"))
        more = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        touches = (F.size(done) > 0) & (s["start"] <= last["start"] + last["length"])
        return F.when(touches, more).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, start, step)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    percent: int = 5,
    carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_words, spans, n_hit, items, contaminated``.

    An item's windows are its runs of ``window`` words; an item of fewer words is one window, an item without words
    has none.  ``spans`` (start, length, in words) are the longest stretches covered by occurrences of windows,
    ``n_hit`` the words in them, ``items`` the items with a window in the document; ``contaminated`` is
    ``n_hit > 0 and 100 * n_hit >= percent * n_words``.

    ``carry`` adds ``row``, the input row as a struct.

    The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` text.  With one block nothing is shuffled.
    With several, each row gets a key in a stored copy of the texts, one pass over them for each block is stored too, so
    that the driver holds one block at a time, and the passes are merged by that key.

    Null texts have no words.  Null item ids are dropped.  Repeated rows are judged alike.  Empty tables give no
    rows, or documents without hits.
    """
    rest = [carried(docs)] if carry else []
    table = docs.select(F.col(id).alias("id"), raw(text).alias("text"), *rest)
    kind = dict(table.dtypes)["id"]
    schema = f"id {kind}, n_words long, spans array<struct<start:long,length:long>>, items array<long>"
    schema += carried_type(docs) * carry

    def searched(rows: DataFrame, block: list[tuple], schema: str) -> DataFrame:
        return in_arrow(rows, _search(Windows([x for x in block if x[0] is not None], window)), schema)

    blocks = _blocks(benchmark, item, item_text)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        result = searched(table, block, schema)
    else:
        keyed = stored(table.withColumn("key", F.monotonically_increasing_id()))
        texts, found = keyed.select(F.col("key").alias("id"), "text"), []
        plain = "id long, n_words long, spans array<struct<start:long,length:long>>, items array<long>"
        while block is not None:
            one = searched(texts, block, plain)
            found.append(stored(one.where(F.size("items") > 0) if found else one))
            block, more = more, next(blocks, None)
        hits = found[0]
        for one in found[1:]:
            hits = hits.union(one)
        hits = hits.groupBy(F.col("id").alias("key")).agg(
            F.first("n_words").alias("n_words"),
            _joined(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        rows = keyed.select("key", "id", *["row"] * carry)
        result = rows.join(hits, "key").select("id", "n_words", "spans", "items", *["row"] * carry)
    hit = F.col("n_hit")
    return (
        result.withColumn("n_hit", _merged(F.col("spans")))
        .withColumn("contaminated", (hit > 0) & (100 * hit >= percent * F.col("n_words")))
        .withColumnRenamed("id", id)
    )
