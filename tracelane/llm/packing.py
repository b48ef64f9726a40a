"""Packing of tokenized documents into sequences: dominance reduction, then best fit, on counts of lengths.

Lengths are whole numbers up to the capacity, so the instance is a histogram of bounded size.  The plan is made on it
and says which ranks of each length go to which sequences; the documents' pieces get their ranks in Spark and never
pass through one task.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelane.llm.common import CACHE_ENTRIES, flat, in_arrow, places, raw, remembered, slices, stored
from tracelane.llm.tokens import byte_letters

SLICE_BYTES = 1 << 20
"""Text that one pass over its distinct parts takes; a longer document makes a slice of its own."""

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
    kinds[0x80:] = _ODD
    kinds[[0, ord("'"), ord("<")]] = _ODD  # the mark of an end; contractions; special strings
    return kinds


_KINDS = _kinds()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class WordEncoder:
    """Ids of many texts at once with one vocabulary of word ends (``</w>``): each distinct part is encoded once.

    Between ASCII white space the library splits words of plain letters, digits and marks where the kind changes and
    after each digit.  Such parts are encoded by the library for ranked vocabularies, as merges are made in the order
    of the ids they give; the byte 0 stands for the word end.  Other words go through the tokenizer's own library,
    and a bounded number of them is remembered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, end, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        if end != "</w>":
            raise ValueError("only vocabularies of word ends are supported")
        tokens = list(letters) + [c + end for c in letters]
        for merge in model["merges"]:
            tokens.append("".join(merge.split(" ") if isinstance(merge, str) else merge))
        made = [ids[t] for t in tokens[512:]]
        if made != sorted(made):
            raise ValueError("merges must be in the order of the ids they give")
        ranks, self.ids = {}, []
        for token in tokens:
            body = bytes(letters[c] for c in token.removesuffix(end))
            if len(token) > 1 and 0 in body:
                continue  # no part with the byte 0 is encoded this way
            ranks[body + b"\0" * token.endswith(end)] = len(self.ids)
            self.ids.append(ids[token])
        self.ids = np.array(self.ids, np.uint32)
        self.last = np.array([t.endswith(b"\0") for t in ranks])
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def _odd(self, parts: list[bytes]) -> list[bytes]:
        if len(self.known) + len(parts) > CACHE_ENTRIES:
            self.known.clear()  # frequent words come back at once
        new = [p for p in parts if p not in self.known]
        found = self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in new], add_special_tokens=False)
        self.known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(new, found))
        return [self.known[p] for p in parts]

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts one after another and their numbers."""
        data, offsets = flat(parts)
        odd = np.add.reduceat(_KINDS[data] == _ODD, offsets[:-1]) > 0
        sizes = np.diff(offsets)
        plain = np.flatnonzero(~odd)
        n = sizes[plain]
        text = np.zeros(int(n.sum()) + len(plain), np.uint8)
        text[places(np.cumsum(n + 1) - n - 1, n)] = data[places(offsets[plain], n)]
        ranks = self.coder.encode_to_numpy(text.tobytes().decode(), disallowed_special=())
        each = np.zeros(len(parts), np.int64)
        each[plain] = np.diff(np.flatnonzero(self.last[ranks]), prepend=-1)
        rest = self._odd(parts.filter(pa.array(odd)).to_pylist())
        each[odd] = [len(r) // 4 for r in rest]
        out = np.zeros(int(each.sum()), np.uint32)
        firsts = np.cumsum(each) - each
        out[places(firsts[plain], each[plain])] = self.ids[ranks]
        out[places(firsts[odd], each[odd])] = np.frombuffer(b"".join(rest), "<u4")
        return out, each

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a binary column without nulls."""
        data, offsets = flat(column)
        kind = _KINDS[data]
        full = kind != _SPACE
        if not full.any():
            return [np.zeros(0, np.uint32)] * len(column)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = full.copy()
        word[1:] &= ~full[:-1] | edge[1:-1]
        number = np.cumsum(word, dtype=np.int32) - 1  # one value a byte: kept small
        odd = np.bincount(number[kind == _ODD], minlength=int(word.sum())) > 0
        start = word.copy()
        inner = full[1:] & full[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        start[1:] |= inner & ~odd[number[1:]]
        starts = np.flatnonzero(start)
        sizes = np.add.reduceat(full, starts, dtype=np.int64)  # white space follows words only
        kept = np.where(odd[number], data, _LOWER[data])[places(starts, sizes)]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        parts = pa.Array.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(kept)]
        ).dictionary_encode()
        ids, each = self._parts(parts.dictionary)
        at = parts.indices.to_numpy()
        n = each[at]
        all_ids = ids[places((np.cumsum(each) - each)[at], n)]
        begin = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]
        return [all_ids[a:b] for a, b in zip(begin, begin[1:])]


def encoder(path: str) -> WordEncoder:
    return remembered(f"WordEncoder {path}", lambda: WordEncoder(path))


def _pieces(path: str, capacity: int, last: int):
    def work(batches):
        texts, end = encoder(path).texts, np.array([last], "<u4")
        for batch in slices(batches, limit=SLICE_BYTES):
            out = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32")}
            for row, ids in enumerate(texts(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out["row"].append(row)
                    out["piece"].append(i)
                    out["start"].append(at)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
            yield {"id": batch.column(0).take(pa.array(out.pop("row"), pa.int64())), **out}

    return work


def pieces(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = 4096, last: int = 1
) -> DataFrame:
    """``<id>, piece, start, length, ids_crc32``: token ids of each text and the id ``last``, cut at the capacity."""
    table = docs.select(F.col(id).alias("id"), raw(text).alias("text"))
    kind = dict(table.dtypes)["id"]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    return in_arrow(table, _pieces(tokenizer, capacity, last), schema).withColumnRenamed("id", id)


def _dominating(lengths: list[int], left: dict[int, int], n: int, capacity: int) -> int | None:
    """What a piece of length ``n`` shares a sequence with in some best packing: 0 for nothing, a length, None if
    sets of three pieces don't settle it.

    A set dominates another if its pieces can be swapped for groups of the other's that are no longer.  An exact
    complement dominates all; the longest piece that fits dominates if no two others fit, or if no three do and it
    is as long as any two that fit.
    """
    rest = capacity - n
    others = {m: left[m] - (m == n) for m in lengths[: bisect_right(lengths, rest)]}
    fitting = [m for m, c in others.items() if c]
    if not fitting:
        return 0
    best = fitting[-1]
    least = [m for m in fitting[:3] for _ in range(min(3, others[m]))][:3]
    if best == rest or len(least) < 2 or least[0] + least[1] > rest:
        return best
    if len(least) == 3 and sum(least) <= rest:
        return None
    a = np.array(fitting)
    single = np.array([others[m] == 1 for m in fitting])
    room = np.minimum(rest - a, a)
    mate = np.searchsorted(a, room, "right") - 1
    mate -= (mate == np.arange(len(a))) & single
    pairs = np.where(mate >= 0, a + a[mate], 0)
    return best if pairs.max() <= best else None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, low, high, each, sequence, offset)``: the pieces of that length with rank r in [low, high)
    go to sequence ``sequence + (r - low) // each`` at ``offset + (r - low) % each * length``.

    First the reduction: for each length from the longest down, a sequence is fixed where a set of at most two
    pieces dominates every other choice (``_dominating``).  As all pieces of a length are alike, a set is fixed as
    often as both lengths last.  As what is fixed leaves fewer choices to the rest, the lengths are gone through
    until nothing more is fixed.  The remainder is packed by falling length, each piece into the fullest sequence
    that takes it.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(n: int, pieces: int, each: int, sequence: int, offset: int) -> None:
        runs.append((n, used[n], used[n] + pieces, each, sequence, offset))
        used[n] += pieces
        left[n] -= pieces
        if not left[n]:
            del left[n]
            lengths.remove(n)

    lengths = sorted(left)
    fixed = -1
    while fixed != made:
        fixed = made
        for n in sorted(left, reverse=True):
            while n in left:
                best = _dominating(lengths, left, n, capacity)
                if best is None:
                    break
                if best == n:
                    times = left[n] // 2
                    put(n, 2 * times, 2, made, 0)
                else:
                    times = min(left[n], left[best]) if best else left[n]
                    put(n, times, 1, made, 0)
                    if best:
                        put(best, times, 1, made, n)
                made += times

    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def room(r: int, sequence: int, times: int) -> None:
        if r and times:
            if r not in free:
                free[r] = []
                rooms.insert(bisect_right(rooms, r), r)
            free[r].append((sequence, times))

    for n in sorted(left, reverse=True):
        while n in left:
            at = bisect_right(rooms, n - 1)
            if at == len(rooms):
                each = capacity // n
                r, sequence = capacity, made
                times = -(-left[n] // each)
                made += times
            else:
                r = rooms[at]
                each = r // n
                sequence, times = free[r].pop()
                if not free[r]:
                    del free[r], rooms[at]
            whole = min(times, left[n] // each)
            some = left[n] - whole * each if whole < times else 0
            some = min(some, each - 1) if some else 0
            if whole:
                put(n, whole * each, each, sequence, capacity - r)
                room(r - each * n, sequence, whole)
            if some:
                put(n, some, some, sequence + whole, capacity - r)
                room(r - some * n, sequence + whole, 1)
            if r < capacity:
                room(r, sequence + whole + bool(some), times - whole - bool(some))
    return runs


def pack(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    last: int = 1,
    rank_rows: int = 20_000,
) -> DataFrame:
    """One row per piece: ``<id>, piece, start, length, ids_crc32, sequence_id, offset``.

    A text's ids and the id ``last`` are cut into pieces of ``capacity``, the last may be shorter; pieces are never
    cut again.  Sequences are numbered from 0 and filled from offset 0 without gaps.

    Pieces of a length are ranked within hashed parts of about ``rank_rows`` rows; the counts of (length, part) are
    at most as many as the pieces, and their running sums are windows over the parts of one length.  The driver gets
    the histogram, at most ``capacity`` rows, and returns the plan, of the same order.

    Null and empty texts give one piece with the id ``last``.  Repeated rows are packed once each.  Empty tables
    give an empty result.
    """
    cut = stored(pieces(docs, tokenizer, id, text, capacity, last))
    held = cut.groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in held}
    runs = sorted(plan(counts, capacity))
    parts = max(1, sum(counts.values()) // rank_rows // 8)
    spread = F.pmod(F.xxhash64(id, "piece", "ids_crc32"), F.lit(parts)).alias("part")
    parted = cut.select("*", spread)
    sizes = parted.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    sizes = sizes.select("length", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy(id, "piece"))
    ranked = parted.withColumn("own", own).join(sizes, ["length", "part"])
    rank = (F.col("before") + F.col("own") - 1).alias("rank")
    table = np.array(runs, np.int64).reshape(-1, 6)
    kind = dict(cut.dtypes)[id]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, at = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = table[np.searchsorted(keys, length << 44 | at, "right") - 1]
            extra = at - run[:, 1]
            yield {
                **{name: batch.column(i) for i, name in enumerate(("id", "piece", "start", "length", "ids_crc32"))},
                "sequence_id": run[:, 4] + extra // run[:, 3],
                "offset": run[:, 5] + extra % run[:, 3] * length,
            }

    placed = in_arrow(ranked.select(F.col(id).alias("id"), "piece", "start", "length", "ids_crc32", rank), place, schema)
    return placed.withColumnRenamed("id", id)
