"""Packing by minimum bin slack: for each window the multiset of remaining lengths that fills it best.

Lengths are whole numbers up to the capacity, so what is left to pack is a histogram of bounded size.  The longest
piece left opens a window; a bitset of reachable sums over the other lengths finds the fullest window, and walking
the bitsets back gives how many pieces of each length fill it.  As pieces of a length are alike, the window is made
as often as the counts allow.  A window that no multiset fills is filled by cutting a piece.  The plan says which
ranks of each length go where; the pieces get their ranks in Spark and never pass through the driver.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelane.llm.common import flat, in_arrow, places, raw, remembered, slices, stored

SLICE_BYTES = 8 << 20
"""Text that one pass over its distinct parts takes; a longer document makes a slice of its own."""

_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: the pre-tokens of the byte-level vocabulary."""

_LETTER, _DIGIT, _MARK, _APOSTROPHE, _BLANK, _SPACE, _OTHER, _MAYBE_SPACE = range(8)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    for b in range(128):
        if chr(b).isalpha():
            kinds[b] = _LETTER
        elif chr(b).isdigit():
            kinds[b] = _DIGIT
    kinds[ord("'")] = _APOSTROPHE
    kinds[9:14] = _SPACE
    kinds[ord(" ")] = _BLANK
    kinds[0x80:] = _OTHER
    kinds[[0xC2, 0xE1, 0xE2, 0xE3]] = _MAYBE_SPACE  # fixed value: first bytes of the spaces beyond ASCII
    return kinds


_KINDS = _kinds()


def _pairs(rule) -> np.ndarray:
    return np.array([rule(a, b) for a in range(8) for b in range(8)])


def _between(a: int, b: int) -> bool:
    if a < _BLANK and b < _BLANK:
        return a != b and a != _APOSTROPHE and (a, b) != (_MARK, _APOSTROPHE)
    return a < _BLANK and b in (_BLANK, _SPACE) or a == _SPACE and (b < _BLANK or b == _OTHER)


_BETWEEN = _pairs(_between)
_BEFORE = _pairs(lambda a, b: a in (_BLANK, _SPACE) and (b < _BLANK or b == _OTHER))


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in the texts ``data[offsets[i]:offsets[i + 1]]`` where a pre-token surely starts.

    A white-space byte before something else is a pre-token of its own or, as a blank, the head of what follows; a
    change between ASCII letters, digits, marks and white space starts a pre-token, except behind an apostrophe.
    Next to bytes beyond ASCII only white space is judged.
    """
    kind = _KINDS[data]
    pair = kind[:-1] << 3 | kind[1:]
    ends = offsets[(offsets > 0) & (offsets < len(data))]
    pair[ends - 1] = 0
    start = np.zeros(len(data), bool)
    start[1:] = _BETWEEN[pair]
    start[:-1] |= _BEFORE[pair]
    start[0] = True
    start[ends] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of many texts at once with one byte-level vocabulary file: each distinct part of them is encoded once.

    Merges of such a file are made in the order of the ids they give, so the distinct parts, one a line, are encoded
    in one call by the library for ranked vocabularies, and the ids of line ends cut the answer.
    """

    def __init__(self, path: str):
        import tiktoken

        from tracelane.llm.tokens import PrefixCounter

        known = PrefixCounter(path)  # checks the kind of file and reads its vocabulary
        made = [known.ids[a + b] for a, b in known.ranks]
        if made != sorted(made):
            raise ValueError("merges must be in the order of the ids they give")
        self.special = [s.encode() for s in known.special]
        with open(path, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}
        self.coder = tiktoken.Encoding("file", pat_str=_PIECES, mergeable_ranks=known.ids, special_tokens=added)
        self.line = known.ids[b"\n"]

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts one after another and their numbers."""
        data, offsets = flat(parts)
        kind = _KINDS[data]
        odd = kind >= _BLANK
        odd &= kind != _OTHER
        odd[offsets[:-1]] &= kind[offsets[:-1]] != _BLANK
        odd = np.add.reduceat(odd, offsets[:-1]) > 0  # white space inside: not to be set one a line
        sizes = np.diff(offsets)
        odd |= (sizes == 1) & (kind[offsets[:-1]] == _BLANK)
        lines = np.flatnonzero(~odd)
        text = np.full(int(sizes[lines].sum()) + len(lines), ord("\n"), np.uint8)
        text[places(np.cumsum(sizes[lines] + 1) - sizes[lines] - 1, sizes[lines])] = data[
            places(offsets[lines], sizes[lines])
        ]
        ids = self.coder.encode_to_numpy(text.tobytes().decode("utf-8", "replace"), disallowed_special=())
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(lines):
            raise ValueError("a part of a text holds a line end")
        each = np.zeros(len(parts), np.int64)
        each[lines] = np.diff(ends, prepend=-1) - 1
        rest = [self.coder.encode_ordinary(parts[int(i)].as_py().decode("utf-8", "replace")) for i in np.flatnonzero(odd)]
        each[odd] = [len(r) for r in rest]
        out = np.zeros(int(each.sum()), np.uint32)
        firsts = np.cumsum(each) - each
        out[places(firsts[lines], each[lines])] = ids[ids != self.line]
        out[places(firsts[odd], each[odd])] = [x for r in rest for x in r]
        return out, each

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a binary column without nulls."""
        data, offsets = flat(column)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(column)
        cuts = np.append(part_starts(data, offsets), len(data))
        parts = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]
        ).dictionary_encode()
        ids, each = self._parts(parts.dictionary)
        at = parts.indices.to_numpy()
        sizes = each[at]
        all_ids = ids[places((np.cumsum(each) - each)[at], sizes)]
        starts = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(cuts, offsets)]
        found = [all_ids[a:b] for a, b in zip(starts, starts[1:])]
        for special in self.special:  # the library's default: a special string inside a text is one id
            for row in np.flatnonzero(pc.count_substring(column, special).to_numpy(zero_copy_only=False)):
                text = column[int(row)].as_py().decode("utf-8", "replace")
                found[row] = self.coder.encode_to_numpy(text, allowed_special="all")
        return found


def encoder(path: str) -> Encoder:
    return remembered(f"Encoder {path}", lambda: Encoder(path))


def _pieces(path: str, capacity: int, last: int):
    def work(batches):
        texts, seen = encoder(path).texts, np.zeros(capacity + 1, np.int64)
        end = np.array([last], "<u4")
        task = TaskContext.get().partitionId()
        for batch in slices(batches, limit=SLICE_BYTES):
            out = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "own", "ids")}
            for row, ids in enumerate(texts(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity].tobytes()
                    n = len(part) // 4
                    out["row"].append(row)
                    out["start"].append(at)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(len(ids))
                    out["own"].append(int(seen[n]))
                    out["ids"].append(part if n < capacity else None)
                    seen[n] += 1
            rows = pa.array(out.pop("row"), pa.int64())
            yield {"id": batch.column(0).take(rows), "task": [task] * len(rows), **out}

    return work


def pieces(docs: DataFrame, tokenizer: str, id: str, text: str, capacity: int, last: int) -> DataFrame:
    """``id, task, start, length, ids_crc32, doc_tokens, own, ids``: texts' ids and ``last``, cut at the capacity.

    ``own`` numbers the pieces of one length and task; ``ids`` is given for pieces shorter than the capacity.
    """
    table = docs.select(F.col(id).alias("id"), raw(text).alias("text"))
    kind = dict(table.dtypes)["id"]
    schema = f"id {kind}, task int, start long, length long, ids_crc32 long, doc_tokens long, own long, ids binary"
    return in_arrow(table, _pieces(tokenizer, capacity, last), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``counts`` (length: pieces) with the largest sum up to ``room``, as length: pieces taken."""
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for n in sorted(counts, reverse=True):
        most = min(counts[n], room // n)
        times = 1
        while most > 0:  # 1, 2, 4, ... pieces give every number up to the count
            some = min(times, most)
            steps.append((n, some, sums))
            sums |= sums << n * some & mask
            most -= some
            times *= 2
        if sums >> room & 1:
            break
    total = sums.bit_length() - 1
    taken: dict[int, int] = {}
    for n, some, before in reversed(steps):
        if not before >> total & 1:
            taken[n] = taken.get(n, 0) + some
            total -= n * some
    return taken


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows ``(length, low, high, start, part, first, each, sequence, offset)``.

    The pieces of ``length`` with rank r in [low, high) give ``part`` ids from ``start`` on to the sequence
    ``sequence + (first + r - low) // each`` at ``offset + (first + r - low) % each * part``.

    Windows take the longest part left and what fills them best with it.  What a window lacks then is cut from the
    longest part left; what is left at last fills windows of powers of two, which need no padding.  So no window
    needs any.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    pool: dict[int, list[tuple[int, int, int, int]]] = {n: [(n, 0, c, 0)] for n, c in left.items()}
    rows: list[tuple[int, ...]] = []
    made = 0

    def take(part: int, pieces: int) -> list[tuple[int, int, int, int]]:
        left[part] -= pieces
        if not left[part]:
            del left[part]
        got = []
        while pieces:
            length, low, high, start = pool[part].pop()
            some = min(pieces, high - low)
            got.append((length, low, low + some, start))
            if low + some < high:
                pool[part].append((length, low + some, high, start))
            pieces -= some
        return got

    def put(part: int, each: int, times: int, offset: int) -> None:
        first = 0
        for length, low, high, start in take(part, each * times):
            rows.append((length, low, high, start, part, first, each, made, offset))
            first += high - low

    def cut(part: int, head: int, times: int, offset: int) -> None:
        first = 0
        for length, low, high, start in take(part, times):
            rows.append((length, low, high, start, head, first, 1, made, offset))
            first += high - low
            pool.setdefault(part - head, []).append((length, low, high, start + head))
        left[part - head] = left.get(part - head, 0) + times

    total = sum(n * c for n, c in left.items())
    while left:
        window = capacity if total >= capacity else 1 << total.bit_length() - 1
        longest = max(left)
        chosen = {longest: 1} if longest <= window else {}
        rest = dict(left)
        if chosen:
            rest[longest] -= 1
        for n, c in fullest({n: c for n, c in rest.items() if c}, window - sum(chosen)).items():
            chosen[n] = chosen.get(n, 0) + c
        lack = window - sum(n * c for n, c in chosen.items())
        after = {n: c - chosen.get(n, 0) for n, c in left.items()}
        torn = max((n for n, c in after.items() if c), default=0)  # longer than what is lacking, or it would fit
        times = min((left[n] // c for n, c in chosen.items()), default=left[torn] if torn else 0)
        if lack:
            times = max(1, min(times, left[torn] // (chosen.get(torn, 0) + 1)))
        times = max(1, min(times, total // window)) if window == capacity else 1
        offset = 0
        for n in sorted(chosen, reverse=True):
            put(n, chosen[n], times, offset)
            offset += n * chosen[n]
        if lack:
            cut(torn, lack, times, offset)
        total -= window * times
        made += times
    return np.array(sorted(rows), np.int64).reshape(-1, 9)


def _lookup(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of rank ranges that share their parts, where each range's plan rows start, and those rows' numbers."""
    keys, ends, members = [], [0], []
    for length in np.unique(rows[:, 0]):
        mine = np.flatnonzero(rows[:, 0] == length)
        lows = np.unique(rows[mine, 1])
        spans = [[] for _ in lows]
        for row in mine:
            a, b = np.searchsorted(lows, rows[row, 1:3])
            for span in spans[a:b]:
                span.append(row)
        for low, span in zip(lows, spans):
            keys.append(int(length) << 44 | int(low))
            members += sorted(span, key=lambda r: rows[r, 3])
            ends.append(len(members))
    return np.array(keys, np.int64), np.array(ends, np.int64), np.array(members, np.int64)


def pack(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = 1024, last: int = 0
) -> DataFrame:
    """One row per piece: ``<id>, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A text's ids and the id ``last`` are cut at the capacity; what is shorter is packed by minimum bin slack and cut
    again only where no multiset of pieces fills a window.  Every sequence is full, but for at most log2(capacity)
    last ones, whose lengths are powers of two.  Sequences are numbered from 0 and filled from offset 0 without gaps.

    The driver gets the histogram of lengths, at most ``capacity`` rows.  Its plan grows with the number of
    different lengths, not with their counts.  Pieces are ranked by running sums of the counts per task, so no
    length meets in one task; the ids of pieces that the plan cuts are fetched by a join of those pieces alone.

    Null and empty texts give one piece with the id ``last``; texts may be of any length.  Repeated rows, also with
    equal or null ids, are packed once each.  An empty table gives no rows.  Other columns are not looked at.
    """
    cut = stored(pieces(docs, tokenizer, id, text, capacity, last))
    sizes = cut.groupBy("length", "task").count()
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = plan(counts, capacity)
    keys, ends, members = _lookup(rows)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")
    sizes = sizes.select("length", "task", before.alias("before"))
    ranked = cut.drop("ids").join(sizes, ["length", "task"])
    names = ["id", "task", "start", "length", "ids_crc32", "doc_tokens", "own"]
    kind = dict(cut.dtypes)["id"]
    schema = (
        f"id {kind}, task int, start long, length long, ids_crc32 long, doc_tokens long, own long,"
        "skip long, part long, sequence_id long, offset long"
    )

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(7).to_numpy()
            span = np.searchsorted(keys, length << 44 | rank, "right") - 1
            parts = ends[span + 1] - ends[span]
            source = np.repeat(np.arange(len(length)), parts)
            nth = np.arange(len(source)) - np.repeat(np.cumsum(parts) - parts, parts)
            run = rows[members[ends[span][source] + nth]]
            at = run[:, 5] + rank[source] - run[:, 1]
            yield {
                **{n: c.take(pa.array(source)) for n, c in zip(names, batch.columns)},
                "skip": run[:, 3],
                "part": run[:, 4],
                "sequence_id": run[:, 7] + at // run[:, 6],
                "offset": run[:, 8] + at % run[:, 6] * run[:, 4],
            }

    placed = in_arrow(ranked.select(*names, (F.col("before") + F.col("own")).alias("rank")), place, schema)
    first = [F.col("id").alias(id), (F.col("start") + F.col("skip")).alias("start"), F.col("part").alias("length")]
    rest = ["doc_tokens", "sequence_id", "offset"]
    if not len(rows) or (np.diff(ends) == 1).all():
        return placed.select(*first, "ids_crc32", *rest)
    placed = stored(placed)
    whole = placed.where("part = length").select(*first, "ids_crc32", *rest)
    torn = placed.where("part < length").join(cut.select("task", "length", "own", "ids"), ["task", "length", "own"])
    sub = F.substring("ids", (F.col("skip") * 4 + 1).cast("int"), (F.col("part") * 4).cast("int"))
    torn = torn.select(*first, F.crc32(sub).alias("ids_crc32"), *rest)
    return whole.union(torn)
