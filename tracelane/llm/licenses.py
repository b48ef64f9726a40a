"""Short licence notices in texts, also with slips: exact seeds find candidates, bounded-error matching verifies them.

A notice that occurs with at most k edits, cut in k + 1 pieces, keeps one piece whole.  The pieces of all notices are
sought in one pass; around each find the ``regex`` library matches the whole notice with at most k edits and gives
the span and the edits.  Every seed's window is searched apart, as the best match of a longer stretch would hide those
before it; finds are taken best first, and what they leave of other windows is searched again.
"""

from __future__ import annotations

import bisect
import heapq

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import in_arrow, raw, slices
from tracelane.llm.decontaminate import split_words

# Phrases that are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further notices and the labels of their own.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "redistribution and use in source and binary forms with or without modification": "bsd-text",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "bsd 3 clause license": "bsd",
    "boost software license": "boost",
    "creative commons attribution": "cc-attribution",
    "all rights reserved": "reserved",
}

LETTERS_PER_EDIT = 9
"""A notice of n letters may have n // LETTERS_PER_EDIT edits, so that shorter ones than this must be exact."""


class Search:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for text, label in [*phrases.items(), *notices.items()]:
            k = len(text) // LETTERS_PER_EDIT
            name = regex.escape(text, literal_spaces=True)
            fuzzy = regex.compile(rf"(?b)(?:{name}){{e<={k}}}") if k else regex.compile(name)
            self.notices.append((text, label, k, fuzzy, text in phrases))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((len(self.notices) - 1, a))
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    @staticmethod
    def _finds(fuzzy: regex.Pattern, least: int, text: str, spans: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Matches (start, end, edits) inside the spans, those with fewest edits first, none overlapping another."""
        heap: list[tuple[int, int, int, int, int]] = []

        def seek(a: int, b: int) -> None:
            if b - a >= least and (m := fuzzy.search(text, a, b)):
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for a, b in spans:
            seek(a, min(b, len(text)))
        found: list[tuple[int, int, int]] = []  # by start; as none overlaps another, also by end
        while heap:
            slips, start, end, a, b = heapq.heappop(heap)
            at = bisect.bisect_left(found, (start,))
            if at and found[at - 1][1] > start:
                at -= 1
            if at < len(found) and found[at][0] < end:
                start, end, _ = found[at]
            else:
                found.insert(at, (start, end, slips))
            seek(a, min(b, start))
            seek(max(a, end), b)
        return found

    def __call__(self, words: list[str]) -> tuple[list[dict], list[int]]:
        """Matches in order (notice, label, first word, last word, edits) and the starts of the exact phrases."""
        text = f" {' '.join(words)} "
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, uses) in self.seeds.iter(text):
            for k, at in uses:
                notice, _, edits, _, _ = self.notices[k]
                start = end + 1 - size - at
                windows.setdefault(k, set()).add((max(0, start - edits - 1), start + len(notice) + edits + 1))
        if not windows:
            return [], []
        blanks = [i for i, c in enumerate(text) if c == " "]
        matches, exact = set(), set()
        for k, spans in windows.items():
            notice, label, edits, fuzzy, counted = self.notices[k]
            if counted:
                whole = f" {notice} "
                for a, b in spans:
                    at = text.find(whole, max(0, a - 1), b + 2)
                    while at >= 0:
                        first = bisect.bisect_left(blanks, at)
                        matches.add((first, first + notice.count(" "), k, 0))
                        exact.add(first)
                        at = text.find(whole, at + 1, b + 2)
            if edits or not counted:
                for start, end, slips in self._finds(fuzzy, len(notice) - edits, text, spans):
                    found = text[start:end]
                    first = bisect.bisect_right(blanks, start + len(found) - len(found.lstrip())) - 1
                    last = bisect.bisect_left(blanks, end - len(found) + len(found.rstrip())) - 1
                    if slips or not counted:
                        matches.add((first, max(first, last), k, slips))
        rows = [
            {"notice": self.notices[k][0], "label": self.notices[k][1], "first": a, "last": b, "edits": e}
            for a, b, k, e in sorted(matches)
        ]
        return rows, sorted(exact)


def _scanned(phrases: dict[str, str], notices: dict[str, str]):
    def work(batches):
        search = Search(phrases, notices)
        for batch in slices(batches):
            out = {k: [] for k in ("n_words", "spans", "places", "base_labels", "labels", "score")}
            for text in batch.column(1):
                words = [w.decode("utf-8", "replace") for w in split_words(text.as_py())]
                spans, exact = search(words)
                at = set(exact)
                base = {s["label"] for s in spans if not s["edits"] and s["first"] in at and s["notice"] in phrases}
                every = {
                    s["label"] if s["notice"] not in phrases or not s["edits"] else f"near-{s['label']}" for s in spans
                }
                out["n_words"].append(len(words))
                out["spans"].append(spans)
                out["places"].append(exact)
                out["base_labels"].append(sorted(base))
                out["labels"].append(sorted(every | base))
                out["score"].append(max((1 - s["edits"] / len(s["notice"]) for s in spans), default=0.0))
            yield {"id": batch.column(0), **out}

    return work


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
) -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_words, spans, places, base_labels, labels, score``.

    Texts become words of a-z (A-Z lower-cased), 0-9 and letters beyond ASCII, joined by blanks.  ``places`` are
    the words at which a phrase of ``phrases`` stands whole, ``base_labels`` their labels.  ``spans`` are all finds
    of phrases and notices with at most one edit for every ``LETTERS_PER_EDIT`` letters: notice, label, first and last
    word, edits.  ``labels`` adds the labels of ``notices``, and ``near-<label>`` for phrases with edits.  ``score``
    is the share of letters kept in the best find, 0 without one.

    Null and empty texts have no words and no finds; rows are independent, whole texts are read, nothing is shuffled.
    """
    table = docs.select(F.col(id).alias("id"), raw(text).alias("text"))
    kind = dict(table.dtypes)["id"]
    span = "struct<notice:string,label:string,first:long,last:long,edits:int>"
    schema = (
        f"id {kind}, n_words long, spans array<{span}>, places array<long>, "
        "base_labels array<string>, labels array<string>, score double"
    )
    return in_arrow(table, _scanned(phrases, notices), schema).withColumnRenamed("id", id)
