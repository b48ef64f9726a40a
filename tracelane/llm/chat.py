"""Conversations from reply trees: root-to-leaf paths, branches ranked by score, each chosen path one formatted text.

Messages know their parent only.  Iterative self-joins double the distance each message can look up (parent,
grandparent, ...), so a tree of depth d takes log2(d) rounds; with each jump goes the sum of the scores on the way.
Branches are ranked by the sums at their leaves, and only the chosen paths are spelled out.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelane.llm.common import in_arrow, stored

END = "</turn>"
_MARK = re.compile(r"\\|(?=###|</turn>)")
_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n((?:[^\\]|\\.)*?)</turn>\n", re.S)


def escape(text: str) -> str:
    """Put a backslash before backslashes, ``###`` and ``</turn>``, so that no text holds a control string bare."""
    return _MARK.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _role(role: str) -> str:
    return re.sub(r"[\\:\n]", lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns and the (start, end) letters of the turns of role ``learn``: the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {_role(role)}:\n", escape(text)
        if role == learn:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def parse_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    found, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at letter {at}")
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], m[1])
        found.append((role, unescape(m[2])))
        at = m.end()
    return found


def _formatted(learn: str):
    def work(batches):
        for batch in batches:
            out = {"tree": batch.column(0), "leaf": batch.column(1), "text": [], "mask": []}
            for turns in batch.column(2):
                text, mask = format_turns([(t["role"], t["text"]) for t in turns.as_py()], learn)
                out["text"].append(text)
                out["mask"].append([{"start": a, "end": b} for a, b in mask])
            yield out

    return work


def chosen_paths(messages: DataFrame, branches: int) -> DataFrame:
    """``tree, leaf, message, height`` for the ``branches`` best root-to-leaf paths of each tree.

    ``messages``: tree, message, parent (null at a root; a parent that is missing counts as none), score.  Message
    ids are unique in a tree.
    """
    nodes = messages.select("tree", "message", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = nodes.select("tree", F.col("message").alias("parent"), F.lit(True).alias("there"))
    up = nodes.join(there, ["tree", "parent"], "left").select(
        "tree", "message", F.when(F.col("there"), F.col("parent")).alias("up"), "score"
    )
    jumps = [stored(up)]
    rows = jumps[0].count()
    while 1 << (len(jumps) - 1) <= rows and not jumps[-1].where("up is not null").isEmpty():
        now = jumps[-1]
        over = now.select("tree", F.col("message").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        jumps.append(
            stored(
                now.join(over, ["tree", "up"], "left").select(
                    "tree", "message", F.col("next").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")
                )
            )
        )
    inner = jumps[0].where("up is not null").select("tree", F.col("up").alias("message")).distinct()
    rooted = jumps[-1].where("up is null")  # what hangs on a ring of parents never comes to an end
    leaves = rooted.join(inner, ["tree", "message"], "left_anti").select("tree", F.col("message").alias("leaf"), "score")
    if branches == 1:
        best = F.max(F.struct("score", (-F.col("leaf")).alias("first"))).alias("b")
        picked = leaves.groupBy("tree").agg(best).select("tree", (-F.col("b.first")).alias("leaf"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        picked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    path = picked.select("tree", "leaf", F.col("leaf").alias("message"), F.lit(0).cast("long").alias("height"))
    for k in range(len(jumps) - 2, -1, -1):  # every height is a sum of powers of two
        jump = jumps[k].where("up is not null").select("tree", "message", "up")
        higher = path.join(jump, ["tree", "message"]).select(
            "tree", "leaf", F.col("up").alias("message"), (F.col("height") + (1 << k)).alias("height")
        )
        path = stored(path.union(higher))
    return path


def conversations(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """One row per chosen branch: ``tree, leaf, formatted, mask``.

    ``messages``: tree long, message long, parent long (null at a root), role, text, score double (null: 0).  The
    ``branches`` best leaves of a tree are those with the largest sum of scores from the root, ties to the smaller
    id; each gives one text of all turns from its root, marked ``### role:`` ... ``</turn>``, in which turns' own
    control strings are escaped reversibly, and the mask of ``learn`` turns as (start, end) letters.

    A path is one text, so its turns meet in one row; nothing else does.  Null texts and roles are empty.  Rows with
    a null tree or message, and messages on a ring of parents, are on no path.  Rows repeating a message id keep one
    (the least role, text).  An empty table gives no rows.
    """
    known = messages.where("tree is not null and message is not null")
    known = known.select(
        F.col("tree").cast("long").alias("tree"),
        F.col("message").cast("long").alias("message"),
        F.col("parent").cast("long").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    known = known.groupBy("tree", "message").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
    known = known.select("tree", "message", "m.role", "m.text", "m.parent", "m.score")
    path = chosen_paths(known, branches)
    turn = F.struct((-F.col("height")).alias("at"), "role", "text")
    spelled = path.join(known, ["tree", "message"]).groupBy("tree", "leaf")
    spelled = spelled.agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    schema = "tree long, leaf long, text string, mask array<struct<start:long,end:long>>"
    return in_arrow(spelled, _formatted(learn), schema).withColumnRenamed("text", "formatted")


def linear_trees(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations kept as numbered turns, as reply trees: each row answers the one before it.

    Rows are ordered by turn, then role and text; the number in that order is the message id, so rows that repeat a
    turn follow one another.  Null turns come first.  A conversation's rows meet in one window, as in its text.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(
        F.col(id).cast("long").alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    ).where("tree is not null")
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("message") > 1, F.col("message") - 1)
    return rows.select("tree", "message", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _read_back(learn: str):
    def work(batches):
        for batch in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for formatted, mask in zip(batch.column(1), batch.column(2)):
                text = formatted.as_py()
                turns = parse_turns(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask.as_py())
                out["n_turns"].append(len(turns))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out["turns_sha256"].append(hashlib.sha256(whole.encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield {"tree": batch.column(0), **out}

    return work


def read_back(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """``tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all from the formatted texts."""
    schema = "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_arrow(formatted.select("tree", "formatted", "mask"), _read_back(learn), schema)
