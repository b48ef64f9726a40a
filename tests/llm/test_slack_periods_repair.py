"""Packing by bin slack, periodic runs and conversation repair against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tracelane.llm import periods, queries, repair, slack  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTES)


def ids_of(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    bits = ["a", "b", " ", "  ", "\n", "'", "'s", "é", "1", ".", "!", "\xa0", "\t", "ñ", "中", "T", "ll", "re", "\x1c"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# --- packing by bin slack ---------------------------------------------------------------------------------------


def test_ids_are_those_of_the_library():
    import pyarrow as pa

    odd = ["", "a\n\n", "b\n\nT", "x <|endoftext|> y<|endoftext|>", "é\n\n b", "'s don't 'rest", "　 a", *texts(1, 3000)]
    found = slack.Encoder(BYTES).texts(pa.array([t.encode() for t in odd], pa.binary()))
    assert [f.tolist() for f in found] == [ids_of(t) for t in odd]


def test_fullest_is_the_best_multiset():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        taken = slack.fullest(counts, room)
        assert all(0 < k <= counts[n] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_id_once_and_leaves_no_padding(seed):
    rng = random.Random(seed)
    for capacity in (8, 16, 64):
        counts = {rng.randint(1, capacity): rng.choice([1, 2, 3, 40]) for _ in range(rng.randint(0, capacity))}
        cover, fill = {}, {}
        for length, low, high, start, part, first, each, sequence, offset in slack.plan(counts, capacity).tolist():
            for rank in range(low, high):
                at = first + rank - low
                cover.setdefault((length, rank), []).append((start, part))
                fill.setdefault(sequence + at // each, []).append((offset + at % each * part, part))
        assert set(cover) == {(n, r) for n, c in counts.items() for r in range(c)}
        for (length, _), parts in cover.items():
            assert joined(parts) == length
        sizes = [joined(parts) for parts in fill.values()]
        short = [s for s in sizes if s < capacity]
        assert all(s <= capacity and s & (s - 1) == 0 for s in short) and len(set(short)) == len(short)


def joined(parts: list[tuple[int, int]]) -> int:
    end = 0
    for start, size in sorted(parts):
        assert start == end
        end += size
    return end


def check_packed(rows, docs: list[tuple], capacity: int, last: int) -> None:
    by_doc, fill = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for id, text in docs:
        want.setdefault(id, []).append([*ids_of(text), last])
    assert set(by_doc) == set(want)
    for id, all_ids in want.items():
        assert sum(r["length"] for r in by_doc[id]) == sum(map(len, all_ids))
        assert {r["doc_tokens"] for r in by_doc[id]} == set(map(len, all_ids))
        if len(all_ids) == 1:
            ids = np.array(all_ids[0], "<u4")
            assert joined([(r["start"], r["length"]) for r in by_doc[id]]) == len(ids)
            for r in by_doc[id]:
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for parts in fill.values():
        size = joined(parts)
        assert size == capacity or size < capacity and size & (size - 1) == 0


def test_packing_of_awkward_rows(spark):
    rng = random.Random(5)
    docs = [(1, None), (2, ""), (3, "word " * 3000), (None, "no id"), (None, "no id"), (5, "again"), (5, "again")]
    docs += [(100 + i, " ".join(rng.choice(["to", "pack", "a", "sequence"]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    docs += [(1000 + i, "the very same text " * 4) for i in range(40)]
    table = spark.createDataFrame([(i, t, "x", 7, 8) for i, t in docs], "doc_id long, text string, length string, start int, task int")
    rows = slack.pack(table.repartition(3), BYTES, capacity=64, last=0).collect()
    check_packed(rows, docs, 64, 0)
    assert any(r["start"] % 64 and r["length"] < r["doc_tokens"] for r in rows)  # some piece was cut again
    assert slack.pack(table.limit(0), BYTES).count() == 0


# --- periodic runs ----------------------------------------------------------------------------------------------


def all_runs(w: list) -> list[tuple[int, int, int]]:
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                seen.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def sequences(seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        kind, n = rng.random(), rng.randint(0, 220)
        if kind < 0.25:
            out.append([rng.randint(0, 1) for _ in range(n)])
        elif kind < 0.55:
            d = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 70))] * rng.randint(1, 5)
            if rng.random() < 0.5:
                d[rng.randrange(len(d))] = 9
            out.append([rng.randint(0, 3) for _ in range(rng.randint(0, 20))] + d)
        elif kind < 0.85:  # two stretches of one small period that do not line up
            u = [rng.randint(0, 1) for _ in range(rng.randint(1, 4))]
            a = u * rng.randint(5, 30) + u[: rng.randint(0, len(u))]
            b = u * rng.randint(5, 30) + u[: rng.randint(0, len(u))]
            out.append(a + [7] * rng.randint(0, 1) + b + u[:1] * rng.randint(0, 2) + a)
        else:
            x, y = [0], [0, 1]
            while len(y) < n:
                x, y = y, y + x
            out.append(y)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_runs_against_all_periods(seed):
    docs = sequences(seed)
    numbers, ends = [], []
    for i, d in enumerate(docs):
        numbers += d
        ends.append(len(numbers))
        numbers.append(10**6 + i)
    found = [[] for _ in docs]
    for s, e, q in periods.find_runs(np.array(numbers), np.array(ends)).tolist():
        i = int(np.searchsorted(ends, s))
        found[i].append((s - ends[i] + len(docs[i]), e - s, q))
    assert found == [all_runs(d) for d in docs]


def plain_periods(id: int | None, text: str | None) -> tuple:
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(id).encode()) if id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    milli = best[1] * 1000 // best[2] if runs else None
    return id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["the", "a", "été", "x\x1cy", "中", "of"]
    docs = [(None, "a b c " * 9), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "aba " * 40), (5, "aba " * 40)]
    docs.append((6, " ".join(rng.choice(vocabulary) for _ in range(500)) * 3))
    for i in range(7, 400):
        words = [rng.choice(vocabulary + [str(i)]) for _ in range(rng.randint(1, 60))]
        docs.append((i, rng.choice(["", " "]) + rng.choice([" ", "\n", " \t "]).join(words * rng.choice([1, 1, 3]))))
    table = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, n int, runs string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert rows.columns[2:5] == ["start", "length", "period"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rows.collect()), key=key) == sorted((plain_periods(*d) for d in docs), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs if i is not None) > 20


def test_a_very_long_text_has_its_runs(spark):
    rng = random.Random(8)
    block = [rng.choice("abcdefgh") for _ in range(7000)]
    text = " ".join(["w", *block, *block, *block[:100], "z", *["u v"] * 30_000])
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periods.periodic_runs(table).first()
    found = [(r["start"], r["length"], r["period"]) for r in row["runs"]]
    assert (1, 14_100, 7000) in found and (14_102, 60_000, 2) in found
    assert row["n_words"] == 74_102
    assert periods.periodic_runs(table.limit(0)).count() == 0


# --- conversation repair ----------------------------------------------------------------------------------------


def plain_damage(rows: list[tuple]) -> dict:
    """Rows after damage of each conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(kept, key=order) for c, kept in out.items()}


def plain_repair(rows: list[tuple]) -> tuple:
    """Shortest edits by the automaton, row by row."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(cells):
        for _ in range(4):
            for q, (cost, audit, out) in list(cells.items()):
                for s, role in (("u", "user"), ("a", "assistant")):
                    if (q, s) in step:
                        new = (cost + 2, audit + "I", out + [f"{role}:"])
                        at = step[q, s]
                        if at not in cells or new < cells[at]:
                            cells[at] = new
        return cells

    cells = inserted({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(q, cell, new=new):
            if q not in new or cell < new[q]:
                new[q] = cell

        for q, (cost, audit, out) in cells.items():
            offer(q, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if (q, role[:1]) in step:
                offer(step[q, role[:1]], (cost + more, audit + "K", out + [f"{role}:{text}"]))
            for s, other in (("u", "user"), ("a", "assistant")):
                if (q, s) in step:
                    offer(step[q, s], (cost + 2 + more, audit + "R", out + [f"{other}:{text}"]))
        cells = inserted(new)
    cost, audit, out = min(cells[q] for q in (0, 3) if q in cells)
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    says = ["yes.", "no!", "why?", "so", "", " \t", "yes.", "long " * 30 + ".", "été.", None]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [None, *range(140)]:
        turn = rng.choice([0, -3, 10**6])
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(says) if rng.random() < 0.5 else f"t{turn}."))
            turn += rng.choice([1, 1, 1, 1, 2, 0])
    rows += [(500, t, ["user", "assistant"][t % 2], f"turn {t}" + rng.choice([".", ".", ""])) for t in range(900)]
    rows += [(501, 7, "user", "the same.")] * 700 + [(501, t, "assistant", "the same.") for t in range(300)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_repair_query(spark, tmp_path, seed):
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, 3, "x") for r in rows], "conv_id long, turn long, role string, text string, rows int, id string")
    table.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    assert found.columns[:3] == ["conv_id", "gaps", "blank"]
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    want = {c: plain_repair(kept) for c, kept in plain_damage(rows).items()}
    assert got == want


def test_repair_over_many_tasks(spark, tmp_path):
    rows = conversations(7)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    spread = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in spread}
    for k, v in spread.items():
        spark.conf.set(k, v)
    try:
        found = queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {c: plain_repair(kept) for c, kept in plain_damage(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in found} == want


def test_repaired_turns_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "FAN", 3)
    rows = conversations(4)
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    report, turns = repair.repair(table.repartition(4))
    report = {r["conv_id"]: r for r in report.collect()}
    blocks = {}
    for r in sorted(turns.collect(), key=lambda r: r["idx"]):
        blocks.setdefault(r["conv_id"], []).extend(r["turns"])
    assert len(report) == len({r[0] for r in rows}) and len(blocks[500]) > 800
    for conv, r in report.items():
        lines = [f"{t['role']}:{t['text']}" for t in blocks.get(conv, [])]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r["repaired_sha256"]
        assert [t["edit"] for t in blocks.get(conv, [])] == [e for e in r["audit"] if e != "D"]
    empty = repair.repair(table.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_cells_against_all_edits():
    """Every way to edit up to four rows, with up to two insertions in each gap."""
    from itertools import product

    sound = re.compile(r"(s?(ua)+)?")
    for initials in product("sua", repeat=3):
        best = None
        for edits in product(["K", "Ru", "Ra", "D"], repeat=3):
            for gaps in product(["", "u", "a", "ua", "au"], repeat=4):
                out, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * len("".join(gaps))
                for i, e, gap in zip(initials, edits, gaps[1:]):
                    out += {"K": i, "D": ""}.get(e, e[-1]) + gap
                    audit += e[0] + "I" * len(gap)
                    cost += {"K": 0, "D": 3}.get(e, 2)
                if sound.fullmatch(out):
                    best = min(best or (cost, audit), (cost, audit))
        spans = [repair.Span(repair._ROW_CELLS[i, False], 1, first=i, last=i) for i in initials]
        assert repair.parse(spans).best() == best


def test_word_ids_are_those_of_the_library():
    import pyarrow as pa

    from tracelane.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(9)
    made = [" ".join("".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz.,9A") for _ in range(rng.randint(1, 14))) for _ in range(8)) for _ in range(1500)]
    odd = ["", " ", "<|endoftext|> a<|startoftext|>", "it's OK. 123abc", "\x00 a\x00b", "İÉé", "x\x1cy ''s", *texts(7, 2000), *made]
    found = packing.WordEncoder(path).texts(pa.array([t.encode() for t in odd], pa.binary()))
    assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in odd]
