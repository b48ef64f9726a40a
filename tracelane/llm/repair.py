"""Repair of conversations whose turns lack, repeat, break off or come in the wrong order, by weighted CYK parsing.

The grammar of sound conversations ``(s?(ua)+)?`` has one nonterminal for each pair of states of its automaton; in
Chomsky normal form ``[p q]`` is ``[p r] [r q]``, or one row kept, given another role or deleted.  Rows may also be
put in anywhere, so every cell is closed under insertions before and after its rows.  A cell holds, for its span of
rows, the cheapest edits of each nonterminal as (cost, audit); cells of neighbouring spans are combined bottom-up by
span length.  As the nonterminals name both ends' states, all splits of a span give the same cell, so each span is
combined at one split.  Two audits of one span and cost are never one the start of the other (a further letter could
only be an insertion, which costs), so the smallest audit of a whole is made of smallest audits of its parts.

Conversations are sorted by range, so that a long one goes over several tasks.  Each task parses blocks of bounded
size; conversations that surely begin and end within a task are finished there.  Of the others only cells are
combined further, in rounds, and their blocks are then repaired each on its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelane.llm.common import in_arrow, pa_schema, stored

BLOCK_ROWS = 64
"""Rows (rows deleted one after another for one reason count once) that are parsed together."""

FAN = 32
"""Neighbouring spans that one round combines."""

REROLE, DELETE, INSERT, BREAK = 2, 3, 2, 1
"""Costs of a new role, a deletion, an inserted row, and of a kept row that breaks off."""

_STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
"""Automaton of ``(s?(ua)+)?``: from the start (0) or behind s (1), u (2) and a (3)."""
_STATES, _SOUND = range(4), (0, 3)
_ROLES = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"

Cell = dict  # (state before, state after) -> (cost, audit)


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in _STATES:
            if (r, q) in right:
                more, rest = right[r, q]
                new = (cost + more, audit + rest)
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def _insertions() -> Cell:
    """The cell of an empty span: nothing but insertions."""
    cell: Cell = {(p, p): (0, "") for p in _STATES}
    one = {(p, q): (INSERT, "I") for (p, s), q in _STEPS.items() if s in _ROLES}
    for _ in _STATES:
        for key, new in combine(cell, one).items():
            cell[key] = min(cell.get(key, new), new)
    return cell


EMPTY = _insertions()


def _closed(cell: Cell) -> Cell:
    return combine(combine(EMPTY, cell), EMPTY)


def _row_cell(initial: str, broken: bool) -> Cell:
    """The cell of one row that may be kept, get another role or be deleted."""
    more = BREAK if broken else 0
    cell: Cell = {(p, p): (DELETE, "D") for p in _STATES}
    for (p, s), q in _STEPS.items():
        edits = [(more, "K")] if s == initial else []
        if s in _ROLES:
            edits.append((REROLE + more, "R"))
        if edits:
            cell[p, q] = min([*edits, cell.get((p, q), edits[0])])
    return _closed(cell)


_ROW_CELLS = {(i, b): _row_cell(i, b) for i in ("s", "u", "a", "") for b in (False, True)}


def _deleted_cell(rows: int) -> Cell:
    return _closed({(p, p): (DELETE * rows, "D" * rows) for p in _STATES})


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def breaks_off(text: str) -> bool:
    """Whether the last letter that is not white space ends no sentence."""
    return text.rstrip(_SPACE)[-1:] not in (".", "!", "?")


@dataclass
class Span:
    """What is known of neighbouring rows of a conversation: its cell, counts, and what meets its neighbours."""

    cell: Cell = field(default_factory=lambda: EMPTY)
    rows: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    first: str | None = None
    last: str | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def then(self, o: Span) -> Span:
        if not o.rows:
            return self
        if not self.rows:
            return o
        return Span(
            combine(self.cell, o.cell),
            self.rows + o.rows,
            o.low if self.low is None else self.low,
            self.high if o.high is None else o.high,
            self.turns + o.turns - (self.high is not None and self.high == o.low),
            self.first,
            o.last,
            self.blank + o.blank,
            self.duplicate + o.duplicate,
            self.truncated + o.truncated,
            self.illegal + o.illegal + (self.last + o.first not in _LEGAL),
        )

    def best(self) -> tuple[int, str]:
        return min(self.cell[0, q] for q in _SOUND if (0, q) in self.cell)

    def report(self) -> dict:
        cost, audit = self.best()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "cost": cost, "audit": audit} | {
            k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal")
        }

    def packed(self) -> dict:
        cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in self.cell.items()]
        return {**self.__dict__, "cell": cells}

    @staticmethod
    def unpacked(d: dict) -> Span:
        return Span(**{**d, "cell": {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in d["cell"]}})


_SPAN_TYPE = (
    "struct<cell:array<struct<p:int,q:int,cost:long,audit:string>>,rows:long,low:long,high:long,turns:long,"
    "first:string,last:string,blank:long,duplicate:long,truncated:long,illegal:long>"
)
_ITEM_TYPE = "array<struct<rows:long,role:string,text:string>>"
_TURN_TYPE = "array<struct<edit:string,role:string,text:string>>"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def parse(spans: list[Span]) -> Span:
    """The span of all, combined bottom-up by span length."""
    while len(spans) > 1:
        pairs = [a.then(b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0] if spans else Span()


def repaired(items: list[dict], audit: str, before: int, odd: bool) -> list[dict]:
    """Turns that ``audit`` makes of ``items``; ``before`` turns precede, ``odd`` says whether all are odd in number.

    A sound conversation of an odd number of turns begins with s, so a turn's place says its role.
    """
    out, rows = [], iter(items)
    item, left = None, 0
    for edit in audit:
        if edit != "I" and not left:
            item = next(rows)
            left = item["rows"]
        left -= edit != "I"
        if edit == "D":
            continue
        role = _ROLES["u" if (before + len(out)) % 2 == odd else "a"]
        if edit == "K":
            out.append({"edit": edit, "role": item["role"], "text": item["text"]})
        else:
            out.append({"edit": edit, "role": role, "text": "" if edit == "I" else item["text"]})
    return out


def _lines(turns: list[dict]) -> bytes:
    return "".join(f"\n{t['role']}:{t['text']}" for t in turns).encode("utf-8", "surrogatepass")


def _kept_length(audit: str) -> int:
    return len(audit) - audit.count("D")


def _block(items: list[dict], spans: list[Span]) -> dict:
    return {"span": parse(spans).packed(), "items": items}


def _finished(items: list[dict], spans: list[Span]) -> dict:
    report = parse(spans).report()
    turns = repaired(items, report["audit"], 0, _kept_length(report["audit"]) % 2 == 1)
    return {**report, "turns": turns, "repaired_sha256": hashlib.sha256(_lines(turns)[1:]).hexdigest()}


def _rows(batches):
    """Sorted rows as Python values: conversation, turn, role, digest, blank, rows, text."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _parsed(names: list[str]):
    def work(batches):
        task = TaskContext.get().partitionId()
        held: list[dict] = []

        def give():
            out = {n: [row.get(n) for row in held] for n in names}
            held.clear()
            return out

        begun = False
        for id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            items, spans, own, kept = [], [], 0, None
            for _, turn, role, digest, blank, n, text in rows:
                if text is not None:  # comes just before the line that counts it
                    kept = (turn, role, digest)
                    rest, broken = 1, breaks_off(text)
                    cell, count = _ROW_CELLS[_initial(role), broken], {"truncated": int(broken)}
                else:
                    rest = n - (kept is not None and kept == (turn, role, digest))
                    if not rest:
                        continue
                    cell, count = _deleted_cell(rest), {"blank" if blank else "duplicate": rest}
                initial = _initial(role)
                spans.append(
                    Span(cell, rest, turn, turn, int(turn is not None), initial, initial, illegal=rest - 1, **count)
                )
                items.append({"rows": rest, "role": role, "text": text})
                if len(items) == BLOCK_ROWS:
                    held.append({"id": id, "task": task, "own": own, **_block(items, spans)})
                    items, spans, own = [], [], own + 1
            # only what follows tells whether the conversation ends here, so the last one always stays open
            open_ = (id, items, spans, own, begun)
            if begun:
                held.append(_close(last, task))
                if len(held) >= 1000:
                    yield give()
            last, begun = open_, True
        if begun:
            id, items, spans, own, _ = last
            held.append({"id": id, "task": task, "own": own, **_block(items, spans)})
        if held:
            yield give()

    return work


def _close(conversation: tuple, task: int) -> dict:
    id, items, spans, own, inner = conversation
    if inner and not own:
        return {"id": id, "task": task, "own": own, **_finished(items, spans)}
    return {"id": id, "task": task, "own": own, **_block(items, spans)}


def _combined(batches):
    for batch in batches:
        spans = [parse([Span.unpacked(s["span"]) for s in row]).packed() for row in batch.column(2).to_pylist()]
        yield {"id": batch.column(0), "idx": batch.column(1), "span": spans}


def _ended(batches):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    for batch in batches:
        reports = [Span.unpacked(s).report() for s in batch.column(1).to_pylist()]
        yield {"id": batch.column(0), **{n: [r[n] for r in reports] for n in names}}


def _shares(batches):
    """Each block's part of the audit: rows' edits, with the insertions before them; the last has those behind too."""
    for batch in batches:
        for id, audit, blocks in zip(*(c.to_pylist() for c in batch.columns)):
            odd, before, at = _kept_length(audit) % 2 == 1, 0, 0
            out = {"idx": [], "share": [], "before": []}
            for i, block in enumerate(blocks):
                end, rows = at, block["rows"]
                while rows:
                    rows -= audit[end] != "I"
                    end += 1
                if i == len(blocks) - 1:
                    end = len(audit)
                out["idx"].append(block["idx"])
                out["share"].append(audit[at:end])
                out["before"].append(before)
                before += _kept_length(audit[at:end])
                at = end
            n = len(blocks)
            yield {"id": pa.array([id] * n, batch.schema.field(0).type), **out, "odd": [odd] * n}


def _repaired(batches):
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns[2:]))
        yield {"id": batch.column(0), "idx": batch.column(1), "turns": [repaired(*r) for r in rows]}


def _digests(kind: pa.DataType):
    def work(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for id, blocks in groupby(rows, key=lambda r: r[0]):
            digest, begun = hashlib.sha256(), False
            for block in blocks:
                lines = _lines(block[2])
                digest.update(lines if begun else lines[1:])
                begun |= bool(lines)
            yield {"id": pa.array([id], kind), "repaired_sha256": [digest.hexdigest()]}

    return work


def repair(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the report, one row per conversation, and the repaired turns.

    The report: ``<id>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  ``gaps`` counts
    missing numbers between the smallest and largest turn.  A row is blank without a letter that is not white space,
    else a duplicate if its role and text came before, else truncated if it does not end in ``.!?``; ``illegal``
    counts neighbours whose roles do not follow one another.  ``audit`` spells the cheapest edits (K keep, R other
    role, D delete, I insert), the smallest in ASCII order among equals, that leave roles like ``s?(ua)+`` or
    nothing; blank and duplicate rows must go, truncated ones that stay cost one more.  The digest is that of the
    repaired lines ``role:text``.

    The repaired turns: ``<id>, idx, turns``, blocks of (edit, role, text) in the order of idx; conversations of which
    nothing is left may lack.

    Rows are ordered by turn (nulls first), role and MD5 of the text; equal rows come one after another.  Null roles
    and texts are empty.  Conversations with the id null are one conversation; rows with a null in every other column
    are blank rows.  A conversation of any length is cut into blocks, texts may be of any length, and rows that repeat
    are counted before they are shuffled.  Only one line of digest work goes through a conversation's blocks in turn,
    and its audit is one value.  An empty table gives empty tables.
    """
    rows = turns.select(
        F.col(id).alias("id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return repair_counted(rows.withColumn("rows", F.lit(1)), id)


def repair_counted(rows: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`repair`, of ``id, turn, role, text, rows``; a line of 0 rows only names its conversation."""
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    blank = (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank")
    some = F.col("rows") > 0
    counted = rows.select(
        "id",
        F.when(some, F.col("turn")).alias("turn"),
        F.when(some, F.col("role")).otherwise("").alias("role"),
        F.when(some, digest).alias("digest"),
        F.when(some, blank).otherwise(True).alias("blank"),
        "rows",
    )
    counted = counted.groupBy("id", "turn", "role", "digest", "blank").agg(F.sum("rows").cast("long").alias("rows"))
    kept = rows.where(some & ~blank).groupBy("id", "role", "text")
    kept = kept.agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    kept = kept.select("id", "first.turn", "role", digest, F.lit(False).alias("blank"), F.lit(1).cast("long").alias("rows"), "text")
    both = counted.withColumn("text", F.lit(None).cast("string")).unionByName(kept)
    order = ["id", "turn", "role", "digest"]  # a line and the one that counts it are never in different tasks
    both = both.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").isNull())
    kind = dict(rows.dtypes)["id"]
    schema = (
        f"id {kind}, task int, own long, {_REPORT}, repaired_sha256 string, turns {_TURN_TYPE}, "
        f"span {_SPAN_TYPE}, items {_ITEM_TYPE}"
    )
    names = [part.split()[0] for part in f"id x, task x, own x, {_REPORT}, repaired_sha256 x, turns x, span x, items x".split(", ")]
    parsed = stored(in_arrow(both, _parsed(names), schema))
    whole = parsed.where("audit is not null")
    report, repaired_turns = _joined(parsed.where("audit is null"), kind)
    named = F.col("id").alias(id)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    report = whole.select("id", *counts).union(report.select("id", *counts)).select(named, *counts)
    repaired_turns = whole.select("id", F.lit(0).cast("long").alias("idx"), "turns").union(repaired_turns)
    return report, repaired_turns.select(named, "idx", "turns")


def _joined(blocks: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Report and turns of conversations in several blocks."""

    def meet(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        """Join on equal ids, null among them, and the columns named."""
        b = b.select(F.col("id").alias("other"), *[F.col(c).alias(f"other_{c}" if c in more else c) for c in b.columns if c != "id"])
        on = F.col("id").eqNullSafe(F.col("other"))
        for name in more:
            on &= F.col(name) == F.col(f"other_{name}")
        return a.join(b, on)

    sizes = blocks.groupBy("id", "task").agg((F.max("own") + 1).alias("n"))
    before = (F.sum("n").over(Window.partitionBy("id").orderBy("task")) - F.col("n")).alias("before")
    sizes = sizes.select("id", "task", before)
    idx = (F.col("before") + F.col("own")).alias("idx")
    blocks = stored(meet(blocks, sizes, "task").select("id", idx, "span", "items"))
    spans = blocks.select("id", "idx", "span")
    span_schema = f"id {kind}, idx long, span {_SPAN_TYPE}"
    while not spans.where("idx > 0").isEmpty():
        group = spans.groupBy("id", F.expr(f"idx div {FAN}").alias("idx"))
        group = group.agg(F.array_sort(F.collect_list(F.struct(spans["idx"].alias("at"), "span"))).alias("spans"))
        spans = stored(in_arrow(group, _combined, span_schema))
    ended = stored(in_arrow(spans.select("id", "span"), _ended, f"id {kind}, {_REPORT}"))
    held = blocks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "span.rows"))).alias("blocks"))
    held = meet(ended, held).select("id", "audit", "blocks")
    shares = in_arrow(held, _shares, f"id {kind}, idx long, share string, before long, odd boolean")
    work = meet(blocks, shares, "idx").select("id", "idx", "items", "share", "before", "odd")
    done = in_arrow(work, _repaired, f"id {kind}, idx long, turns {_TURN_TYPE}")
    one = pa_schema(blocks.sparkSession, f"id {kind}").field(0).type
    inorder = done.repartition("id").sortWithinPartitions("id", "idx")
    digests = in_arrow(inorder, _digests(one), f"id {kind}, repaired_sha256 string")
    return meet(ended, digests).select(*ended.columns, "repaired_sha256"), done
