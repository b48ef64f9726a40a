"""Near-duplicate groups of documents by Fast Similarity Sketching, banding and exact verification.

A set of word shingles is sketched in rounds: in round r every element goes to one hashed bin with the value
(r, hash); a bin keeps its smallest value.  After as many rounds as there are bins, round ``bins + i`` sends every
element to bin i, so each coordinate is filled, and two sets agree in a coordinate with probability equal to their
similarity, concentrated as for independent coordinates.  Four coordinates make a band; documents that share a
band are candidates, and a link is made only after comparing the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import CACHE_ENTRIES, components, in_arrow, raw, remembered, sieved, slices, stored

BINS, ROWS = 128, 4
"""32 bands of 4 coordinates: a pair of similarity 0.8 shares no band with probability 5e-8."""

PART_ROWS, PART_ITEMS = 1024, 1 << 21
"""Members, and elements of their differences from the hub, in one part of a bucket."""

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_ENTRIES:
            self[word] = value
        return value


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words (fewer words: the whole sequence; none: empty), sorted."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(remembered("words", _Words).__getitem__, found), _U, n)
    if n < words:
        h = np.concatenate([h, np.full(words - n, n, _U)])
    total = np.zeros(max(n - words, 0) + 1, _U)
    for j in range(words):
        total += mix(h[j : j + len(total)] + _SEEDS[j]) * (_SEEDS[j + 8] | _U(1))
    return np.unique(mix(total))


def sketch(items: np.ndarray) -> np.ndarray:
    """The ``BINS`` coordinates of a set that is not empty."""
    n = len(items)
    out = np.full(BINS, ~_U(0))
    block = max(1, 1024 // n)
    for r in range(0, BINS, block):
        rounds = np.arange(r, min(r + block, BINS), dtype=_U)
        v = mix(items[None, :] ^ _SEEDS[rounds.astype(int), None])
        np.minimum.at(out, (v >> _U(57)).ravel(), ((v & _U((1 << 56) - 1)) | (rounds[:, None] << _U(56))).ravel())
        if not (out == ~_U(0)).any():
            return out
    for i in np.flatnonzero(out == ~_U(0)):
        out[i] = (mix(items ^ _SEEDS[BINS + i]).min() & _U((1 << 56) - 1)) | _U(BINS << 56)
    return out


_FACTORS = _SEEDS[:ROWS] | _U(1)
_BANDS = _SEEDS[: BINS // ROWS]


def bands(coordinates: np.ndarray) -> np.ndarray:
    return mix((coordinates.reshape(-1, ROWS) * _FACTORS).sum(axis=1, dtype=_U) ^ _BANDS).view(np.int64)


def _sketched(words: int):
    def work(batches):
        for batch in slices(batches):
            sizes, keys, marks = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                marks.append(bands(sketch(s)) if len(s) else None)
            yield {"id": batch.column(0), "n": sizes, "key": keys, "bands": marks}

    return work


def _sets(words: int):
    def work(batches):
        for batch in slices(batches):
            found = [shingles(text.as_py(), words).view(np.int64) for text in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield {"id": batch.column(0), "items": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))}

    return work


def _stars(rows: list[tuple], percent: int) -> dict[str, list[int]]:
    """Links between different components of one group, as stars; rows: bucket, p, q, own, id, n, component, apart."""
    within = rows[0][1] == rows[0][2]
    own, n, component = (np.array([r[i] for r in rows], np.int64) for i in (3, 5, 6))
    sizes = np.array([len(r[7]) for r in rows])
    items, of = np.unique(np.concatenate([np.array(r[7], np.int64) for r in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    often = np.bincount(of, minlength=len(items)) > 1  # the others are in no intersection
    row, of = row[often[of]], (np.cumsum(often) - 1)[of[often[of]]]
    order = np.argsort(of, kind="stable")
    row, of = row[order], of[order]
    common = np.zeros((len(rows), len(rows)), np.float32)
    for start in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(of, [start, start + 2048])
        part = np.zeros((len(rows), 2048), np.float32)
        part[row[a:b], of[a:b] - start] = 1
        common += part @ part.T
    differ = sizes[:, None] + sizes[None, :] - 2 * common.astype(np.int64)
    whole = n[:, None] + n[None, :]
    linked = 100 * (whole - differ) >= percent * (whole + differ)
    linked &= component[:, None] < component[None, :]
    if not within:
        linked &= own[:, None] != own[None, :]
    x, y = np.nonzero(linked)
    label = np.arange(len(rows))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            break
        for side in (x, y):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return {"a": [rows[i][4] for i in moved], "b": [rows[i][4] for i in label[moved]]}


def _compared(percent: int):
    def work(batches):
        now, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if row[:3] != now:
                    if len(rows) > 1:
                        yield _stars(rows, percent)
                    now, rows = row[:3], []
                rows.append(row)
        if len(rows) > 1:
            yield _stars(rows, percent)

    return work


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_shingles, component_id, kept``.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``words``-word shingles
    (words: runs without ASCII white space, A-Z lower-cased).  ``component_id`` is the smallest id reachable over
    links, ``kept`` marks the document that bears it.

    Equal sets are one class at once, so copies never meet pairwise.  In each band's bucket every member is compared
    with one hub, the smallest id.  If that leaves a bucket in several components, its members are compared with each
    other by their differences from the hub: |A sym B| is that of the two differences, which are short for near copies.
    Such buckets are cut into parts, a group holds two parts, compares by matrix products and gives back stars of
    links, so neither rows nor state grow with the pairs, and no link is lost.  The driver sees counts.

    Null or blank texts have no shingles and are linked with nothing.  Null ids stay rows of their own, without
    links.  Rows that repeat an id are one vertex.  An empty table gives an empty result.
    """
    table = docs.select(F.col(id).cast("long").alias("id"), raw(text).alias("text"))
    marked = stored(in_arrow(table, _sketched(words), "id long, n long, key binary, bands array<long>"))
    classes = marked.where("id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    classes = stored(classes.where("key is not null and c > 1").select("key", "rep"))
    labelled = marked.join(classes, "key", "left").withColumn("rep", F.coalesce("rep", "id"))
    buckets = labelled.where("n > 0 and id = rep").select("id", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("c"))
    shared = shared.where("hub < last").select("bucket", "hub", (F.col("c") > 2).alias("more"))
    members = stored(buckets.join(shared, "bucket").select("bucket", "hub", "id", "n", "more"))

    pairs = stored(members.where("id <> hub").groupBy("hub", "id").agg(F.max("more").alias("more")))
    # stored first: the planner then knows the size of the ids before it decides whether their texts must be shuffled
    wanted = stored(pairs.select("id").union(pairs.select("hub")).distinct())
    chosen = sieved(table, wanted)[0].join(wanted, "id", "left_semi")
    sets = stored(in_arrow(chosen, _sets(words), "id long, items array<long>"))
    sets = sets.dropDuplicates(["id"])  # one exchange by id, which both joins below use
    both = F.size(F.array_intersect("x", "y")).cast("long")
    whole = F.size("x").cast("long") + F.size("y")
    met = pairs.join(sets.withColumnRenamed("items", "x"), "id")
    met = met.join(sets.select(F.col("id").alias("hub"), F.col("items").alias("y")), "hub")
    apart = F.array_union(F.array_except("x", "y"), F.array_except("y", "x"))
    linked = (100 * both >= percent * (whole - both)).alias("linked")
    met = stored(met.select("hub", "id", linked, F.when(F.col("more"), apart).alias("apart")))
    links = met.where("linked").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    labels = stored(components(links))

    rest = members.where("more and id <> hub").select("bucket", "hub", "id", "n").join(labels, "id", "left")
    rest = stored(rest.withColumn("component", F.coalesce("component", "id")))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q")
    rest = stored(rest.join(mixed.select("bucket"), "bucket").join(met.select("hub", "id", "apart"), ["hub", "id"]))
    weight = F.greatest(F.count("*") / PART_ROWS, F.sum(F.size("apart")) / PART_ITEMS)
    sizes = rest.groupBy("bucket").agg(F.ceil(weight).alias("cuts"))
    cut = rest.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    group = F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")
    cut = cut.select("bucket", *group, "own", "id", "n", "component", "apart")
    cut = cut.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    more = stored(in_arrow(cut, _compared(percent), "a long, b long"))
    if not more.isEmpty():
        labels = components(links.union(more))
    result = labelled.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    result = result.withColumn("component_id", F.coalesce("component", "rep"))
    return result.select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
