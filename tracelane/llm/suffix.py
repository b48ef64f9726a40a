"""Repeated strings of documents by longest-previous-factor arrays over shards of suffixes.

Any string of ``size`` bytes has an anchor: its smallest hashed part of ``PART`` bytes.  Equal strings have equal
anchors, so strings are dealt by anchor and no repeat crosses shards.  The strings of one document that share an
anchor are one stretch of text.  Stretches with equal bytes are one class, counted before anything is shuffled
whole: with two members every string in them repeats.  Of anchors with different stretches, one stretch a class goes
to the anchor's shard, in document order.

In a shard, suffixes are put in order to the depth ``size`` by doubling ranks.  Suffixes that agree to that depth stand
together, ordered by place; then the previous smaller place of a suffix is its neighbour before, the next smaller
place's counterpart the one after.  A suffix with the first has a previous factor of at least ``size`` bytes (it is a
later copy); without it but with the second it is the first of several copies.

With words for units, a text is the row of its words' 64-bit hashes, and all the rest is done on these.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import carried, carried_type, in_arrow, raw, remembered, sieved, slices, stored
from tracelane.llm.minhash import mix

SHARD_BYTES = 1 << 20
"""Stretches whose suffixes are ordered at once."""
HOT_BYTES = 4 << 20
"""Stretches of one anchor that one task takes; the strings of a larger anchor are counted by digest instead."""

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5)


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the two bases and of their inverses, at least ``n`` of each."""
    powers = remembered("powers", list)
    if not powers or len(powers[0][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        powers[:] = [
            (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(b))])),
             np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(pow(b, -1, 1 << 64)))])))
            for b in _BASES
        ]
    return powers


class Hashes:
    """Hashes of any part of a text: differences of running sums, moved to the start."""

    def __init__(self, text: np.ndarray):
        self.tables = _tables(len(text) + 1)
        letters = text.astype(_U) + _U(1)
        self.sums = [np.concatenate([[_U(0)], np.cumsum(letters * p[: len(text)])]) for p, _ in self.tables]

    def of(self, which: int, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        sums, back = self.sums[which], self.tables[which][1]
        return mix((sums[end] - sums[start]) * back[start])


_BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, that is what ``bytes.split`` gives."""
    text = np.frombuffer(data, np.uint8)
    edges = np.diff(np.concatenate([[True], _BLANK[text], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    h = Hashes(text)
    return mix(h.of(0, start, end) ^ mix(h.of(1, start, end) + (end - start).astype(_U))), start


def _units(data: bytes, words: bool) -> np.ndarray:
    return words_of(data)[0] if words else np.frombuffer(data, np.uint8)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each run of ``width``."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    grid = np.full(rows * width, ~_U(0))
    grid[: len(keys)] = keys
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(text: np.ndarray, size: int, part: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, start and length of each stretch of a text of at least ``size`` units."""
    h = Hashes(text)
    n = len(text)
    parts = h.of(0, slice(0, n - part + 1), slice(part, n + 1))
    # the upper half orders; ties go to the first place, alike in every copy
    keys = (parts & ~_U(0xFFFFFFFF)) | np.arange(len(parts), dtype=_U)
    at = (_least(keys, size - part + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    end = last + size
    content = h.of(1, first, end) ^ mix((end - first).astype(_U))
    return parts[at[first]], content, first, end - first


def _merged(start: np.ndarray, length: np.ndarray) -> list[dict]:
    """Stretches in order of their starts as maximal runs."""
    if not len(start):
        return []
    end = np.maximum.accumulate(start + length)
    cut = np.flatnonzero(start[1:] > end[:-1]) + 1
    begin, last = start[np.append(0, cut)], end[np.append(cut, len(end)) - 1]
    return [{"start": a, "length": n} for a, n in zip(begin.tolist(), (last - begin).tolist())]


def _anchored(size: int, part: int, first: bool, words: bool):
    def work(batches):
        for batch in slices(batches):
            out = {k: [] for k in ("n_bytes", "own", "found")}
            for value in batch.column(1):
                data = value.as_py()
                text = _units(data, words)
                own, found = [], []
                if len(text) >= size:
                    anchor, content, start, length = stretches(text, size, part)
                    pairs = np.rec.fromarrays([anchor, content])
                    _, once, of, count = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
                    again = count[of] > 1
                    if first:
                        again[once] = False
                    own = _merged(start[again], length[again])
                    found = [
                        {"anchor": a, "content": c, "start": s, "length": n, "times": t}
                        for a, c, s, n, t in zip(
                            anchor[once].view(np.int64).tolist(), content[once].view(np.int64).tolist(),
                            start[once].tolist(), length[once].tolist(), np.minimum(count, 2).tolist(),
                        )
                    ]
                out["n_bytes"].append(len(data))
                out["own"].append(own)
                out["found"].append(found)
            yield {"id": batch.column(0), **out}

    return work


def _cut_out(words: bool):
    def work(batches):
        for batch in slices(batches):
            out = {k: [] for k in ("anchor", "id", "start", "hot", "data")}
            for id, text, wanted in zip(*(batch.column(i) for i in range(3))):
                data = _units(text.as_py(), words)
                for w in wanted.as_py():
                    out["anchor"].append(w["anchor"])
                    out["id"].append(id.as_py())
                    out["start"].append(w["start"])
                    out["hot"].append(w["hot"])
                    out["data"].append(data[w["start"] : w["start"] + w["length"]].tobytes())
            yield out

    return work


def repeats(parts: list[bytes], size: int, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the strings of ``size`` units that repeat in the joined ``parts`` (inside one part each), with the
    previous smaller and next larger place of an equal one, -1 where there is none."""
    text = np.frombuffer(b"".join(parts), _U if words else np.uint8)
    lengths = [len(p) // text.itemsize for p in parts]
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))
    depth, rank = 1 if words else min(8, size), np.zeros(len(text), np.int64)
    at = np.flatnonzero(room >= depth)
    word = text[at].astype(_U)
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    for i in range(1, depth):
        word = word << _U(8) | padded[at + i]
    _, rank[at] = np.unique(word, return_inverse=True)
    while depth < size:
        deeper = min(2 * depth, size)
        at = at[room[at] >= deeper]
        both = rank[at].astype(_U) << _U(32) | rank[at + deeper - depth].astype(_U)
        order, of, count = np.unique(both, return_inverse=True, return_counts=True)
        shared = count[of] > 1  # what differs here differs at any depth; only its own part is passed over
        next_rank = np.zeros(len(text), np.int64)
        next_rank[at] = of
        rank, depth = next_rank, deeper
        if not shared.any():
            return (np.empty(0, np.int64),) * 3
    suffixes = at[np.argsort(rank[at], kind="stable")]
    same = np.diff(rank[suffixes]) == 0
    before = np.full(len(suffixes), -1)
    after = np.full(len(suffixes), -1)
    before[1:][same] = suffixes[:-1][same]
    after[:-1][same] = suffixes[1:][same]
    some = (before >= 0) | (after >= 0)
    return suffixes[some], before[some], after[some]


def _runs(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs covered by strings of ``size`` bytes at sorted places."""
    gap = np.flatnonzero(np.diff(starts) > size)
    return starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + size


def _sharded(size: int, first: bool, words: bool):
    def flush(rows: list[tuple]):
        rows.sort(key=lambda r: (r[1], r[2]))  # document order: an earlier place is an earlier copy
        parts = [r[3] for r in rows]
        places, before, _ = repeats(parts, size, words)
        if first:
            places = places[before >= 0]
        places.sort()
        begin = np.cumsum([0, *(len(p) // (8 if words else 1) for p in parts)])
        of = np.searchsorted(begin, places, "right") - 1
        out = {"id": [], "start": [], "length": []}
        for k in np.unique(of):
            a, b = _runs(places[of == k] - begin[k] + rows[k][2], size)
            out["id"] += [rows[k][1]] * len(a)
            out["start"] += a.tolist()
            out["length"] += (b - a).tolist()
        return out

    def work(batches):
        rows, held, now, size_now = [], 0, None, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != now and held > SHARD_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
                now = row[0]
                rows.append(row)
                held += len(row[3])
        if rows:
            yield flush(rows)

    return work


def _digests(size: int, words: bool):
    def work(batches):
        for batch in batches:
            for id, start, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                units = np.frombuffer(data, _U if words else np.uint8)
                h = Hashes(units)
                n = len(units) - size + 1
                yield {
                    "x": h.of(0, slice(0, n), slice(size, len(units) + 1)).view(np.int64),
                    "y": h.of(1, slice(0, n), slice(size, len(units) + 1)).view(np.int64),
                    "id": [id] * n,
                    "start": np.arange(start, start + n),
                }

    return work


def repeated_spans(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 400, keep: str = "first", words: bool = False
) -> DataFrame:
    """``id, spans`` (array of start, length, in units, may overlap) for documents with repeated strings.

    Units are bytes or, with ``words``, words.  A string of ``size`` units counts as repeated if it also starts elsewhere, in the same document or another one;
    with ``keep="first"`` its first place (by id, then start) does not count, with ``keep="none"`` all places do.
    """
    if keep not in ("first", "none") or size < 16:
        raise ValueError("keep is 'first' or 'none', and size at least 16")
    first = keep == "first"
    part = max(8, size * 8 // 25)
    table = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), raw(text).alias("text"))
    stretch = "struct<anchor:long,content:long,start:long,length:long,times:int>"
    schema = f"id long, n_bytes long, own array<struct<start:long,length:long>>, found array<{stretch}>"
    marked = stored(in_arrow(table.where(F.length("text") >= size), _anchored(size, part, first, words), schema))
    found = marked.select("id", F.explode("found").alias("f")).select("id", "f.*")

    anchors = found.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select("anchor")
    # copies meet here, with the first place of each class; single anchors are gone
    shared = stored(found.join(anchors, "anchor").select("anchor", "content", "id", "start", "length", "times"))
    place = F.struct("id", "start", "length")
    classes = shared.groupBy("anchor", "content").agg(F.sum("times").alias("c"), F.min(place).alias("p"))
    classes = stored(classes.select("anchor", "content", "c", "p.*"))
    several = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.col("length") * (8 if words else 1)).alias("bytes")).where("k > 1")

    copies = classes.where("c > 1").select("anchor", "content", F.col("id").alias("i"), F.col("start").alias("s"))
    members = shared.join(copies, ["anchor", "content"])
    if first:
        members = members.where("id <> i or start <> s")
    spans = members.select("id", "start", "length")

    hot = (F.col("bytes") > HOT_BYTES).alias("hot")
    wanted = classes.join(several.select("anchor", hot), "anchor")
    # stored first: the planner then knows its size before it decides whether the texts of these ids must be shuffled
    wanted = stored(wanted.groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "length", "hot")).alias("wanted")))
    pieces = in_arrow(
        sieved(table, wanted)[0].join(wanted, "id").select("id", "text", "wanted"),
        _cut_out(words),
        "anchor long, id long, start long, hot boolean, data binary",
    )
    pieces = stored(pieces)
    columns = ["anchor", "id", "start", "data"]
    cold = pieces.where("not hot").select(*columns)
    cold = cold.repartition("anchor").sortWithinPartitions("anchor")
    spans = spans.union(in_arrow(cold, _sharded(size, first, words), "id long, start long, length long"))
    strings = in_arrow(pieces.where("hot").select(*columns), _digests(size, words), "x long, y long, id long, start long")
    seen = strings.groupBy("x", "y").agg(F.count("*").alias("c"), F.min(F.struct("id", "start")).alias("p")).where("c > 1")
    seen = seen.select("x", "y", F.col("p.id").alias("i"), F.col("p.start").alias("s"))
    again = strings.join(seen, ["x", "y"])
    if first:
        again = again.where("id <> i or start <> s")
    spans = spans.union(again.select("id", "start", F.lit(size).cast("long").alias("length")))
    own = marked.select("id", F.explode("own").alias("o")).select("id", "o.*")
    return spans.union(own).groupBy("id").agg(F.collect_set(F.struct("start", "length")).alias("spans"))


def _covered(text: bytes, spans: list[dict] | None, whole: bool) -> list[tuple[int, int]]:
    """Maximal runs of the spans; ``whole``: without the letters they cut through."""
    merged: list[list[int]] = []
    for a, n in sorted((s["start"], s["length"]) for s in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], a + n)
        else:
            merged.append([a, a + n])
    if whole:
        for run in merged:
            while run[0] < run[1] and text[run[0]] & 0xC0 == 0x80:
                run[0] += 1
            while run[0] < run[1] < len(text) and text[run[1]] & 0xC0 == 0x80:
                run[1] -= 1
    return [(a, b) for a, b in merged if a < b]


def _removed(whole: bool, words: bool, full: bool):
    def work(batches):
        for batch in slices(batches):
            out = {k: [] for k in ("n_bytes", "removed", "kept", "kept_sha256")}
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = text.as_py()
                runs = _covered(data, spans.as_py(), whole and not words)
                if words and runs:  # each word with the blanks behind it, the first also with those before it
                    begin = np.append(words_of(data)[1], len(data)).tolist()
                    runs = [(begin[a] if a else 0, begin[b]) for a, b in (np.minimum(r, len(begin) - 1).tolist() for r in runs)]
                    runs = [(a, b) for a, b in runs if a < b]
                at, parts = 0, []
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                out["n_bytes"].append(len(data))
                out["removed"].append([{"start": a, "length": b - a} for a, b in runs])
                out["kept"].append(kept if runs or full else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rest = {"row": batch.column(3)} if batch.num_columns > 3 else {}
            yield {"id": batch.column(0), **out, **rest}

    return work


def remove_repeats(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 400,
    keep: str = "first",
    whole_letters: bool = True,
    carry: bool = False,
    words: bool = False,
    full: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_bytes, removed, kept, kept_sha256``.

    Every byte that a repeated string of ``size`` bytes covers goes: with ``keep="first"`` the first copy (by id,
    then place) stays, with ``keep="none"`` none does.  ``removed`` lists the maximal runs (start, length);
    ``kept`` is the rest, null when nothing was removed unless ``full``; ``whole_letters`` keeps UTF-8 letters that a run would cut.
    ``carry`` adds ``row``, the input row as a struct, so that no join has to bring it back.

    With ``words``, ``size`` counts words: bytes between blanks (ASCII white space).  Rows of ``size`` equal words are
    repeated whatever blanks stand between them, and words go whole, with the blanks behind them.

    Null and short texts lose nothing.  Rows with a null id lose nothing and are no copies of others.  Rows that
    repeat an id should have equal texts: they are one place, and each is cut alike.  Matches never cross documents.
    An empty table gives no rows.
    """
    spans = stored(repeated_spans(docs, id, text, size, keep, words))
    # a row that is carried has the text already; it crosses the network once, and only if it may lose something
    table = docs.select(F.col(id).cast("long").alias("id"), carried(docs) if carry else raw(text).alias("text"))
    schema = "id long, n_bytes long, removed array<struct<start:long,length:long>>, kept binary, kept_sha256 string"
    whole = raw(F.col(f"row.`{text}`")).alias("text") if carry else F.col("text")
    some, others = sieved(table, spans)
    joined = some.join(spans, "id", "left").unionByName(others.withColumn("spans", F.lit(None)))
    joined = joined.select("id", whole, "spans", *["row"] * carry)
    done = in_arrow(joined, _removed(whole_letters, words, full), schema + carried_type(docs) * carry)
    return done.withColumnRenamed("id", id)
