"""Exact token counts at every byte prefix of a text, by dynamic programming over the last token.

Merging byte pairs by rank is prefix-closed: the encoding of a prefix that ends where a token ends is the first part
of the whole encoding.  So each prefix of a pre-token has one last token t for which the token before it and t stay
apart when encoded together, and ``count[i] = count[i - len(t)] + 1``.  The table of a pre-token is computed once and
remembered; a document's table is the tables of its pre-tokens one after another, kept as one signed byte a prefix
(the change of the count), so the count of any prefix is a sum, and a budget is found without encoding again.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import CACHE_ENTRIES, in_arrow, raw, remembered, slices

PART_ENTRIES = 2 * CACHE_ENTRIES
"""Blank-led parts of texts that a worker remembers with their tables."""

_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: the pre-tokens of the byte-level vocabulary."""


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _signed(table: bytes) -> int:
    return sum(x - 256 if x > 127 else x for x in table)


class PrefixCounter:
    """Prefix tables for one tokenizer file (byte-level BPE without a normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        kind = data["pre_tokenizer"]
        if data["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("only byte-level tokenizers without a normalizer are supported")
        letters = byte_letters()
        decode = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in data["added_tokens"] if t["special"]]
        self.ids = {decode(s): i for s, i in data["model"]["vocab"].items() if s not in self.special}
        self.longest = max(map(len, self.ids))
        self.ranks = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[decode(a), decode(b)] = rank
        self.find = regex.compile(_PIECES).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.tables: dict[str, tuple[int, bytes]] = {}
        self.parts: dict[str, tuple[int, bytes]] = {}

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        ranks = self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stay(self, a: bytes, b: bytes) -> bool:
        """Whether ``a + b`` is encoded as a, b (a empty: whether b is one token)."""
        pair = (a, b)
        known = self.apart.get(pair)
        if known is None:
            known = self._merged([bytes([x]) for x in a + b]) == ([a, b] if a else [b])
            if len(self.apart) < 4 * CACHE_ENTRIES:
                self.apart[pair] = known
        return known

    def changes(self, word: bytes) -> tuple[int, bytes]:
        """Token count of a pre-token and the change of the count at each of its bytes."""
        ids, apart, longest = self.ids, self.apart, self.longest
        last, count, start = [b""], [0], 0
        steps = bytearray()
        for end in range(1, len(word) + 1):
            token = word[start:end]  # exactly one start fits; most often the token has grown by this byte
            if not (token in ids and (apart.get((last[start], token)) or self._stay(last[start], token))):
                for start in range(end - 1, max(end - longest, 0) - 1, -1):
                    token = word[start:end]
                    if token in ids and (apart.get((last[start], token)) or self._stay(last[start], token)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            count.append(count[start] + 1)
            steps.append((count[end] - count[end - 1]) & 255)
        return count[-1], bytes(steps)

    def _table(self, word: str) -> tuple[int, bytes]:
        found = self.tables.get(word)
        if found is None:
            data = word.encode()
            if word[0] == "'" and len(word) > 1:  # a contraction is one pre-token only when whole
                found = self._stepwise([self._plain(data[:i]) for i in range(len(data) + 1)])
            else:
                found = self.changes(data)
            if len(self.tables) < CACHE_ENTRIES:
                self.tables[word] = found
        return found

    @staticmethod
    def _stepwise(counts: list[int]) -> tuple[int, bytes]:
        return counts[-1], bytes((b - a) & 255 for a, b in zip(counts, counts[1:]))

    def _plain(self, data: bytes) -> int:
        return sum(self.changes(p.encode())[0] for p in self.find(data.decode("utf-8", "ignore")))

    def _slow(self, text: str) -> tuple[int, bytes]:
        """Pre-token by pre-token.  A white-space run is one pre-token while the prefix ends with it, but gives its
        last letter to what follows."""
        total, steps, before, owed = 0, [], "", 0
        for word in self.find(text):
            n, table = self._table(word)
            if owed:
                table, owed = bytes([(table[0] - owed) & 255]) + table[1:], 0
            if before.isspace() and word[0].isspace():
                k = len(word[0].encode())
                run = self.changes((before + word[0]).encode())[1][-k:]
                owed = _signed(run) - _signed(table[:k])
                if k < len(table):
                    table, owed = run + bytes([(table[k] - owed) & 255]) + table[k + 1 :], 0
                else:
                    table = run
            total += n
            steps.append(table)
            before = word
        return total, b"".join(steps)

    def _part(self, part: str) -> tuple[int, bytes]:
        """A blank and what follows it up to the next one, which starts a pre-token."""
        found = self.parts.get(part)
        if found is None:
            words = self.find(" " + part)
            found = self.changes(words[0].encode()) if len(words) == 1 else self._slow(" " + part)
            if len(self.parts) < PART_ENTRIES:
                self.parts[part] = found
        return found

    def prefixes(self, text: str) -> tuple[int, bytes]:
        """Token count of the whole text and the change of the count at each UTF-8 byte."""
        if self.special and self.cut.search(text):  # the library's default: a special string is one token
            total, steps, at = 0, [], 0
            for m in self.cut.finditer(text):
                begun = text[at : m.start()]
                n, table = self.prefixes(begun)
                partly = [self.prefixes(begun + m[0][:i])[0] for i in range(len(m[0]))]
                total += n + 1
                steps += [table, self._stepwise([*partly, n + 1])[1]]
                at = m.end()
            n, table = self.prefixes(text[at:])
            return total + n, b"".join([*steps, table])
        if not text:
            return 0, b""
        parts = text.split(" ")
        if len(parts) > 1 and all(parts[1:]) and not _space_after_space(text):
            known = self.parts
            first = self._slow(parts[0]) if parts[0] else (0, b"")
            found = [first, *(known.get(p) or self._part(p) for p in parts[1:])]
            return sum(f[0] for f in found), b"".join([f[1] for f in found])
        return self._slow(text)


_space_after_space = regex.compile(r"\s (?=\S)| \s").search


def counter(path: str) -> PrefixCounter:
    return remembered(f"PrefixCounter {path}", lambda: PrefixCounter(path))


def count_at(steps: bytes, end: int) -> int:
    """Token count of the first ``end`` bytes."""
    return int(np.frombuffer(steps, np.int8, end).sum(dtype=np.int64))


def fitting(steps: bytes, budget: int) -> int:
    """Length in bytes of the longest prefix with at most ``budget`` tokens."""
    totals = np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])
    return int(np.flatnonzero(totals <= budget)[-1])


def _prefix_tables(path: str):
    def work(batches):
        tables = counter(path)
        for batch in slices(batches):
            texts = [t.as_py() for t in batch.column(1)]
            found = [tables.prefixes(t.decode("utf-8", "replace")) for t in texts]
            yield {
                "id": batch.column(0),
                "n_bytes": list(map(len, texts)),
                "n_tokens": [f[0] for f in found],
                "steps": [f[1] for f in found],
            }

    return work


def prefix_counts(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_bytes, n_tokens, steps``.

    ``steps`` holds one signed byte for each UTF-8 byte of the text: by how much the token count of the prefix that
    ends there exceeds that of the prefix one byte shorter (:func:`count_at` and :func:`fitting` read it).
    ``n_tokens`` is the count of the longest prefix.  ``tokenizer`` is the path of a byte-level BPE file that every
    executor has.  A special token's string counts as that token once whole.  Prefixes that end inside a UTF-8
    character are counted by their bytes.

    Null and empty texts have no bytes and no tokens.  Rows are independent: no shuffle, any ids, repeated rows give
    repeated results.  Bytes that are not UTF-8 are counted as U+FFFD.
    """
    table = docs.select(F.col(id).alias("id"), raw(text).alias("text"))
    kind = dict(table.dtypes)["id"]
    schema = f"id {kind}, n_bytes long, n_tokens long, steps binary"
    return in_arrow(table, _prefix_tables(tokenizer), schema).withColumnRenamed("id", id)
