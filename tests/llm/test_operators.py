"""The training-data operators against brute force on small tables with nulls, repeats, ties and clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelane.llm import chat, common, decontaminate, embeddings, licenses, minhash, packing, quality, suffix, tokens, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
KIND = "doc_id long, text string, id string, n int, key string, row string"


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): random words, copies, near copies, shared passages, and odd rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(180).split(), say(90)
    out = [(i, say(rng.randint(0, 120))) for i in range(25)]
    for i in range(25, 45):
        near = list(base)
        for _ in range(rng.randint(0, 12)):
            near[rng.randrange(len(near))] = rng.choice(words)
        out.append((i, " ".join(near)))
    out += [(i, f"{say(20)} {passage}\n{say(10)}") for i in range(45, 52)]
    out += [(52, None), (53, ""), (54, " \n\t "), (55, "One"), (56, "oNE"), (57, "ab" * 700), (58, out[3][1]), (59, out[3][1])]
    out += [(60, "Licensed under the APACHE License. Gnu general pubic license, mit license mit license!"), (None, out[4][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, None, "r") for i, t in texts], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("words, part", [(4, 1024), (5, 3)])
def test_near_duplicates(docs, none, texts, words, part, monkeypatch):
    monkeypatch.setattr(minhash, "PART_ROWS", part)
    sets, known = Sets(), {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        known[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids = [i for i, _ in texts if i is not None]
    for a in ids:
        for b in ids:
            both = len(known[a] & known[b])
            if a < b and both and 100 * both >= 80 * len(known[a] | known[b]):
                sets.join(a, b)
    found = by_id(minhash.near_duplicates(docs, words=words))
    assert len(found) == len(texts) and found[None]["kept"]
    for i in ids:
        r = found[i]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(known[i]), sets.find(i), sets.find(i) == i)
    assert any(sets.find(i) < i for i in range(26, 45))
    assert not minhash.near_duplicates(none).collect()


def test_near_duplicates_compare_all_components_of_a_bucket(spark, monkeypatch):
    """All documents in one bucket, links only between some: none is lost behind the hub."""
    monkeypatch.setattr(minhash, "bands", lambda c: np.zeros(1, np.int64))
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(9):
        base = [f"w{g}_{k}" for k in range(60)]
        for j in range(4):
            i = g + 9 * j
            near = list(base)
            near[rng.randrange(60)] = "other"
            rows.append((i, " ".join(near)))
            want[i] = g
    marked = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1)
    assert {r["doc_id"]: r["component_id"] for r in marked.collect()} == want


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [False, True])
def test_repeats(docs, none, texts, keep, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_BYTES", 0 if hot else 1 << 30)
    size, seen, first = 120, Counter(), {}
    data = sorted((i, (t or "").encode()) for i, t in texts if i is not None)
    for i, b in data:
        for s in range(len(b) - size + 1):
            seen[b[s : s + size]] += 1
            first.setdefault(b[s : s + size], (i, s))
    found = by_id(suffix.remove_repeats(docs, size=size, keep=keep, whole_letters=False))
    assert len(found) == len(texts) and not found[None]["removed"]
    gone = 0
    for i, b in data:
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            if seen[w] > 1 and (keep == "none" or first[w] != (i, s)):
                cover[s : s + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        r = found[i]
        assert r["n_bytes"] == len(b) and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert sum(x["length"] for x in r["removed"]) == cover.sum()
        assert (b if r["kept"] is None else r["kept"]) == kept
        gone += int(cover.sum())
    assert gone > 2000
    assert not suffix.remove_repeats(none, size=size).collect()


def test_repeats_keep_whole_letters_and_rows(spark):
    text = "é" * 400
    rows = [(1, f"a{text}b", 7), (2, f"{text}", 8)]
    done = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, extra int"), size=100, carry=True)
    for r in done.collect():
        (r["kept"] or b"").decode()
        assert r["row"]["extra"] == r["doc_id"] + 6


@pytest.mark.parametrize("bits", [common.SIEVE_BITS, 3 << 15, 8])
def test_sieve_keeps_each_row_and_loses_no_id(spark, bits, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    rows = [(i % 3000 if i % 50 else None, f"{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, `a.b` string")
    some, others = (part.collect() for part in common.sieved(df, spark.range(0, 3000, 7)))
    assert sorted(r["a.b"] for r in some + others) == sorted(r[1] for r in rows)
    assert not [r for r in others if r["id"] is not None and r["id"] % 7 == 0]
    if bits == common.SIEVE_BITS and bits > 1 << 20:
        assert len(some) < 700  # about a seventh of the rows


def met_by_joins(spark, monkeypatch, module, work, run):
    """Rows of texts that ``run`` joins with more than a broadcast table on the way to the operator's ``work``."""
    plans = []

    def in_arrow(df, f, schema):
        if f.__qualname__.startswith(work):
            plans.append(df)
        return common.in_arrow(df, f, schema)

    monkeypatch.setattr(module, "in_arrow", in_arrow)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no table were small
    try:
        run().collect()
        return [df._jdf.queryExecution().sparkPlan().toString() for df in plans]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_that_lose_nothing_are_not_shuffled(spark, docs, monkeypatch):
    run = lambda: suffix.remove_repeats(docs, size=120, carry=True)
    for work in ("_cut_out", "_removed"):
        (plan,) = met_by_joins(spark, monkeypatch, suffix, work, run)
        joins = plan.count("SortMergeJoin")
        assert joins == 1 and plan.count("getbit") == (2 if work == "_removed" else 1), plan
        assert ("Union" in plan) == (work == "_removed")  # the others pass by the join


def test_quality_joins_no_texts(spark, docs, monkeypatch):
    labels = spark.range(0, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    run = lambda: quality.score(docs, labels, F.lit(True), F.lit(True), carry=True)
    for plan in met_by_joins(spark, monkeypatch, quality, "_measured", run):
        assert "Join" not in plan
    for plan in met_by_joins(spark, monkeypatch, quality, "score.<locals>.measured_again", run):
        assert "Join" not in plan


def test_contamination(spark, docs, none, texts):
    rng = random.Random(8)
    passage = next(t for i, t in texts if i == 46).split()
    items = [(1, " ".join(passage[25:60])), (2, "One"), (3, None), (4, "..."), (5, " ".join(passage[30:44])), (10, "zz yy"), (None, "ab")]
    benchmark = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    windows = defaultdict(set)
    for i, t in items:
        w = decontaminate.split_words((t or "").encode())
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            windows[tuple(w[k : k + n])].add(i)
    found = by_id(decontaminate.contamination(docs, benchmark))
    for i, t in texts:
        w = decontaminate.split_words((t or "").encode())
        hit, of = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    of |= windows[tuple(w[k : k + n])]
        r = found[i]
        assert (r["n_words"], r["n_hit"], sorted(r["items"])) == (len(w), len(hit), sorted(of))
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert sum(r["contaminated"] for r in found.values()) >= 7 and rng
    assert not decontaminate.contamination(none, benchmark).collect()
    empty = decontaminate.contamination(docs, benchmark.limit(0))
    assert not any(r["n_hit"] for r in empty.collect())


def test_contamination_in_blocks(spark, docs, monkeypatch):
    items = [(k, t) for k, t in enumerate(r["text"] for r in docs.where("doc_id between 40 and 50").collect())]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    unique = docs.where("doc_id is not null")
    pick = lambda df: {r["doc_id"]: (r["n_hit"], sorted(r["items"])) for r in df.collect()}
    whole = pick(decontaminate.contamination(unique, benchmark))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert pick(decontaminate.contamination(unique, benchmark)) == whole


def test_contamination_in_blocks_keeps_rows_apart(spark, monkeypatch):
    say = lambda *numbers: " ".join(f"w{k}" for k in numbers)
    benchmark = [(k, say(*range(40 * k, 40 * k + 30))) for k in range(6)] + [(9, say(*range(20, 35), *range(40, 50)))]
    both = f"{benchmark[0][1]} {benchmark[1][1]} {say(*range(900, 940))}"
    rows = [(None, benchmark[k][1]) for k in range(4)] + [(None, say(*range(700, 730)))] * 2
    rows += [(7, benchmark[4][1]), (7, benchmark[5][1]), (7, benchmark[5][1]), (8, both), (8, both), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    show = lambda df: sorted(map(repr, df.collect()))
    whole = {carry: show(decontaminate.contamination(docs, items, carry=carry)) for carry in (False, True)}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    for carry, want in whole.items():
        assert len(want) == len(rows)
        assert show(decontaminate.contamination(docs, items, carry=carry)) == want


def test_token_counts(docs, none, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    found = by_id(tokens.prefix_counts(docs, BYTE))
    for i, t in texts:
        t = t or ""
        r = found[i]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(library.encode(t).ids))
        assert len(r["steps"]) == len(t.encode())
    text = next(t for i, t in texts if i == 46)
    steps = found[46]["steps"]
    for end in range(0, len(text), 7):
        assert tokens.count_at(steps, len(text[:end].encode())) == len(library.encode(text[:end]).ids)
    assert tokens.count_at(steps, tokens.fitting(steps, 50)) <= 50
    assert not tokens.prefix_counts(none, BYTE).collect()


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    library, mine, rng = Tokenizer.from_file(BYTE), tokens.counter(BYTE), random.Random(1)
    parts = ["a", "b", "ing", " ", "  ", "\n", "'re", "'", "1", "é", " ", ".", "!!", "\t", "<|endoftext|>", "the", " the", "🙂"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        n, steps = mine.prefixes(text)
        assert n == len(library.encode(text).ids)
        for end in range(len(text) + 1):
            assert tokens.count_at(steps, len(text[:end].encode())) == len(library.encode(text[:end]).ids)


def first_fit(lengths, capacity):
    """Number of sequences of first fit by falling length."""
    filled = []
    for n in sorted(lengths, reverse=True):
        at = next((k for k, b in enumerate(filled) if b + n <= capacity), len(filled))
        filled[at : at + 1] = [(filled[at] if at < len(filled) else 0) + n]
    return len(filled)


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    found = packing.pack(docs, WORD, capacity=64).collect()
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            want[i, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= first_fit([r["length"] for r in found], 64)
    assert not packing.pack(none, WORD).collect()


def test_packing_plan():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([7, 10, 20, 50])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        room, ranks = Counter(), defaultdict(set)
        for n, low, high, each, sequence, offset in packing.plan(counts, capacity):
            for r in range(low, high):
                s = sequence + (r - low) // each
                assert offset + (r - low) % each * n + n <= capacity
                room[s] += n
                ranks[n].add(r)
        assert {n: len(r) for n, r in ranks.items()} == counts and max(room.values()) <= capacity
        assert len(room) <= first_fit([n for n, c in counts.items() for _ in range(c)], capacity) + 1


def fewest(lengths, capacity):
    """Fewest sequences, by trying every set that the longest piece can share one with."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for mask in range(1 << len(rest)):
        chosen = [n for i, n in enumerate(rest) if mask >> i & 1]
        if first + sum(chosen) <= capacity:
            best = min(best, 1 + fewest([n for i, n in enumerate(rest) if not mask >> i & 1], capacity))
    return best


def test_packing_reduction_keeps_a_best_packing():
    rng = random.Random(4)
    settled = Counter()
    for _ in range(60):
        capacity = rng.choice([7, 10, 13])
        pieces = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 7))), reverse=True)
        left = Counter(pieces)
        for n in left:
            best = packing._dominating(sorted(left), left, n, capacity)
            settled[best is not None] += 1
            if best is not None:
                rest = sorted((left - Counter([n] + [best] * (best > 0))).elements(), reverse=True)
                assert fewest(pieces, capacity) == 1 + fewest(rest, capacity), (pieces, n, best)
    assert min(settled.values()) > 10


def test_packing_plan_fixes_every_exact_complement():
    # 6 + 3 + 1 is open as three pieces fit, yet 5 + 5 and 8 + 2 behind it are fixed
    counts = {6: 4, 5: 2, 3: 4, 1: 9, 8: 1, 2: 1}
    runs = packing.plan(counts, 10)
    ends = Counter()
    for n, low, high, each, sequence, offset in runs:
        for r in range(low, high):
            ends[sequence + (r - low) // each] += n
    assert sum(v == 10 for v in ends.values()) >= 2
    assert len({s for s in ends}) == -(-sum(n * c for n, c in counts.items()) // 10)
    assert len({run[4] for run in packing.plan({5: 1, 1: 1}, 10)}) == 1


def test_conversations(spark):
    rows = [
        (1, 10, None, "user", "hi ### x", 0.0), (1, 11, 10, "assistant", "a\\b</turn>", 0.2), (1, 12, 10, "assistant", "better", 0.9),
        (1, 13, 11, "user", "deep", 0.1), (1, 14, 13, "assistant", None, 0.1), (1, 14, 13, "assistant", None, 0.1),
        (2, 1, 2, "user", "ring", 1.0), (2, 2, 1, "user", "ring", 1.0), (2, 3, 2, "user", "below", 1.0),
        (3, 5, 99, None, "orphan", None), (None, 1, None, "user", "x", 0.0),
    ]
    messages = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double")
    best = {r["tree"]: r for r in chat.conversations(messages).collect()}
    assert set(best) == {1, 3}
    assert chat.parse_turns(best[1]["formatted"]) == [("user", "hi ### x"), ("assistant", "better")]
    assert chat.parse_turns(best[3]["formatted"]) == [("", "orphan")]
    both = sorted(len(chat.parse_turns(r["formatted"])) for r in chat.conversations(messages, branches=2).where("tree = 1").collect())
    assert both == [2, 4]
    assert not chat.conversations(messages.limit(0)).collect()


def test_chat_template_is_reversible():
    rng = random.Random(3)
    parts = ["\\", "#", "###", "### ", "</turn>", ":", "\n", "n", "a", "assistant", "### Assistant: ", "é", "</", "turn>"]
    say = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(2000):
        turns = [(rng.choice([say(4), "assistant"]), say(8)) for _ in range(rng.randint(0, 4))]
        text, mask = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_linear_conversations_keep_repeated_turns(spark):
    rows = [(1, 0, "user", "a", "z"), (1, 1, "assistant", "b", "z"), (1, 1, "assistant", "b", "z"), (1, None, "system", None, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    out = chat.read_back(chat.conversations(chat.linear_trees(turns))).collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in out] == [(4, 2)]


def test_licenses(docs, none, texts):
    found = by_id(licenses.scan(docs))
    r = found[60]
    assert r["places"] == [3, 9, 11] and r["base_labels"] == ["apache", "mit"]
    assert "near-gpl" in r["labels"] and r["score"] == 1.0
    assert [(s["first"], s["last"], s["edits"]) for s in r["spans"] if s["notice"].startswith("gnu general")] == [(5, 8, 1)]
    assert found[52]["n_words"] == 0 and not found[53]["spans"] and len(found) == len(texts)
    assert not licenses.scan(none).collect()


def test_licenses_in_a_row():
    search = licenses.Search(licenses.PHRASES, licenses.NOTICES)
    found = lambda text: [(s["label"], s["first"], s["last"], s["edits"]) for s in search(text.split())[0]]
    slipped = [("mit", k, k + 1, 1) for k in (0, 2, 4)]
    assert found("mit licence mit licence mit licence mit license") == [*slipped, ("mit", 6, 7, 0)]
    assert found("mit license mit licence") == [("mit", 0, 1, 0), ("mit", 2, 3, 1)]
    assert found("mozila publc license mozilla public license") == [("mpl", 0, 2, 2), ("mpl", 3, 5, 0)]
    assert search("mit license mit license".split())[1] == [0, 2]
    for label, notice in [(v, k) for k, v in licenses.NOTICES.items()]:
        n, slip = notice.count(" ") + 1, notice[:-3] + notice[-2:]  # one letter less
        of = [s[1:] for s in found(f"{slip} {slip} {notice} {slip} {notice}") if s[0] == label]
        assert of == [(n * j, n * j + n - 1, int(j not in (2, 4))) for j in range(5)], label


def test_warc(spark, tmp_path):
    rows = [
        (3, "http://a/\r\nx ü", "<p>one</p>\r\n\r\nWARC/1.1\r\n", 1), (1, None, "<p>one</p>\r\n\r\nWARC/1.1\r\n", 1),
        (5, "http://b/", None, 1), (4, "http://c/", "", 1), (9, "http://d/", "ö" * 5000, 1), (None, "http://e/", "alone", 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id int")
    warc.write(pages, str(tmp_path / "w"), date="2026-01-01T00:00:00Z")
    read = by_id(warc.read(spark, str(tmp_path / "w")), "page_id")
    assert {i: (r["record_type"], r["refers_to"]) for i, r in read.items()} == {
        1: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("revisit", 4), 9: ("response", None), None: ("response", None),
    }
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert read[i]["payload_bytes"] == len(data)
        assert read[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert read[i]["payload"] == (data if read[i]["record_type"] == "response" else None)
    warc.write(pages, str(tmp_path / "v"), date="2026-01-01T00:00:00Z", least=1)
    assert {r["page_id"] for r in warc.read(spark, str(tmp_path / "v")).where("record_type = 'revisit'").collect()} == {3}
    warc.write(pages.limit(0), str(tmp_path / "u"), date="2026-01-01T00:00:00Z")
    assert not warc.read(spark, str(tmp_path / "u")).collect()


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_embeddings(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((240, 24))
    centre = rng.standard_normal(24)
    x[100:160] = centre + 0.22 * rng.standard_normal((60, 24))
    x[160:170] = x[0]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(500, None, "e"), (501, [0.0] * 24, "e"), (502, [float("nan")] * 24, "e"), (503, [None] * 24, "e"), (504, [1.0, 2.0], "e"), (505, [2.0, 4.0], "e")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").repartition(3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    found = by_id(embeddings.near_duplicates(table), "vec_id")
    links = sum(found[i]["n_links"] for i in range(240))
    assert 0.95 * linked.sum() <= links <= linked.sum() and linked.sum() > 100
    assert all(found[i]["n_links"] <= linked[i].sum() for i in range(240))
    assert all(found[i]["component_id"] == 0 and found[i]["n_links"] == 10 for i in [0, *range(160, 170)])
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(500, 504))
    assert (found[504]["n_links"], found[505]["component_id"]) == (1, 504)
    assert not embeddings.near_duplicates(table.limit(0)).collect()


def test_calibrated_count():
    k = embeddings.calibrated(48, 0.8664, 0.001)
    draws = (np.random.default_rng(0).random((20_000, 48)) < 0.8664).sum(axis=1)
    assert (draws < k).mean() < 0.003 and (draws < k + 2).mean() > 0.001


def test_quality(spark, none):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta of the and to in it was".split()) for _ in range(60)) + "."
    bad = lambda: " ".join([rng.choice(["BUY!!", "###", "NOW!!"])] * 60)
    rows = [(i, bad() if i % 3 == 0 else good()) for i in range(400)] + [(900, None), (901, "")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    fit, calibrate = F.col("doc_id") % 5 < 3, F.col("doc_id") % 5 == 3
    found = by_id(quality.score(table, labels, fit, calibrate))
    assert all(0 <= r["score"] <= 1 for r in found.values()) and len(found) == len(rows)
    right = [(found[i]["score"] >= 0.5) == (i % 3 > 0) for i in range(300, 400)]
    assert sum(right) >= 97
    again = by_id(quality.score(table, labels, fit, calibrate, carry=True))
    assert {i: r["score"] for i, r in again.items()} == {i: r["score"] for i, r in found.items()}
    blank = by_id(quality.score(table, labels.limit(0), fit, calibrate))
    assert {r["score"] for r in blank.values()} == {0.5}
    assert not quality.score(none, labels, fit, calibrate).collect()


def test_isotonic_steps():
    steps = quality.isotonic(np.array([10, 20, 30]), np.array([3.0, 1.0, 4.0]), np.array([4.0, 4.0, 4.0]))
    assert steps[0] == steps[25] == 0.5 and steps[30] == 1.0 and (np.diff(steps) >= 0).all()


def test_quality_calibrated_by_other_groups(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta of the and to in it was".split()
    text = lambda share: " ".join("NOW!!" if rng.random() < share else rng.choice(words) for _ in range(80)) + "."
    shares = [rng.random() for _ in range(500)]
    rows = [(i, text(s)) for i, s in enumerate(shares)] + [(None, "of the"), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rng.random() > s)) for i, s in enumerate(shares)], "doc_id long, quality int")
    group = F.col("doc_id") % 5
    found = quality.score(table, labels, group != 0, group != 0, group=group).collect()
    scores = {r["doc_id"]: r["score"] for r in found if r["doc_id"] not in (None, 3)}
    assert len(found) == 502 and all(0 < r["score"] < 1 for r in found)
    assert len(set(scores.values())) > 250
    held = [i for i in scores if i % 5 == 0]
    order = np.argsort(np.argsort([scores[i] for i in held]))
    assert np.corrcoef(order, [-shares[i] for i in held])[0, 1] > 0.9
    # labels of the group left out decide nothing
    turned = labels.withColumn("quality", F.when(group == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score(table, turned, group != 0, group != 0, group=group).collect()}
    assert all(abs(again[i] - scores[i]) < 1e-6 for i in scores)


def test_calibration_rises_between_the_steps():
    bins, rows = np.array([10, 20, 30, 40]), np.array([4.0, 4.0, 4.0, 4.0])
    curve = quality.calibration(bins, np.array([0.0, 3.0, 1.0, 4.0]), rows)
    assert (np.diff(curve) > 0).all() and curve[25] == 0.5 and 0 < curve[0] < curve[10] < 0.04
    assert 0.96 < curve[40] < curve[-1] < 1
    assert set(quality.calibration(np.array([]), np.array([]), np.array([]))) == {0.5}


def test_workers_let_go_of_other_operators_memory(spark):
    def found(batches):
        import gc

        for batch in batches:
            kinds = Counter(type(x).__name__ for x in gc.get_objects())
            yield {"id": batch.column(0), "n": [kinds["WordEncoder"] + kinds["PrefixCounter"] + kinds["_Words"]] * len(batch)}

    some = spark.createDataFrame([(i, f"a few words of text {i}") for i in range(8)], "id long, text string").repartition(8)
    probe = common.in_arrow(some, found, "id long, n long")
    for done in (
        minhash.near_duplicates(some, id="id"),
        packing.pieces(some, WORD, id="id"),
        tokens.prefix_counts(some, BYTE, id="id"),
    ):
        assert len(done.collect()) == 8
        assert [r["n"] for r in probe.collect()] == [0] * 8


def test_memory_passes_from_operator_to_operator(monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    monkeypatch.setattr(common, "_owner", [""])
    common.begun("a")
    first = common.remembered("x", list)
    common.begun("a")
    assert common.remembered("x", list) is first
    common.begun("b")
    assert not common._held and common.remembered("x", list) is not first
