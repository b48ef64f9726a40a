"""Quality scores of documents: random Fourier features of text statistics, ridge regression, isotonic calibration.

The features ``cos(w x + b)`` with normal w approximate a Gaussian kernel on the standardised statistics.  Their
normal equations are sums, so every partition adds up its own and the parts are added by row; the driver solves
systems of fixed size.  Labelled rows calibrate the raw scores that a fit without their own group gives them: counts
per narrow bin of the score, then pooling of adjacent violators, give rising steps, and straight lines between the
middles of the steps a score that never falls as the raw score rises.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import carried, carried_type, in_arrow, raw, slices, stored

FEATURES = 256
RIDGE = 1e-3
"""Weight of the penalty for each row of the fit."""
BINS = 4000
"""Bins of the raw score between -1 and 2 in which calibration counts labels."""
SEED = 7

STATISTICS = (
    "words mean_letters spread_letters unique top adjacent short capitals upper_words digits marks odd_marks "
    "ends bare_marks lines repeated_lines entropy longest_run"
).split()

_UPPER, _DIGIT = np.zeros(256), np.zeros(256)
_UPPER[65:91] = _DIGIT[48:58] = 1
_MARK = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)], float)
_ODD = _MARK.copy()
_ODD[[ord(c) for c in ".,;:'\"-()?"]] = 0
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)], float)


def statistics(text: bytes) -> list[float]:
    """The ``STATISTICS`` of a whole text; all 0 for a blank one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    letters = max(1.0, counts @ _LETTER)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    same = np.fromiter(map(bytes.__eq__, words[1:], words[:-1]), bool, n - 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    run = int((edges[1::2] - edges[::2]).max()) + 1 if len(edges) else 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts[counts > 0] / size
    return [
        np.log1p(n),
        min(float(lengths.mean()), 40.0),
        min(float(lengths.std()), 40.0),
        len(seen) / n,
        max(seen.values()) / n,
        float(same.mean()) if n > 1 else 0.0,
        float((lengths <= 3).mean()),
        counts @ _UPPER / letters,
        sum(map(bytes.isupper, words)) / n,
        counts @ _DIGIT / size,
        counts @ _MARK / size,
        counts @ _ODD / size,
        sum(w.endswith((b".", b"!", b"?")) for w in words) / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        np.log1p(len(lines)) / np.log1p(n),
        1 - len(set(lines)) / len(lines),
        float(-(share * np.log(share)).sum()),
        run / n,
    ]


def _measured(batches):
    for batch in slices(batches):
        yield {"id": batch.column(0), "x": [[float(v) for v in statistics(t.as_py())] for t in batch.column(1)]}


class Kernel:
    """Random Fourier features of statistics standardised by ``mean`` and ``spread``."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 0, spread, 1.0)
        self.w = rng.standard_normal((len(mean), FEATURES)) / np.sqrt(len(mean) / 2)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def _sums(kernel: Kernel):
    def work(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            group = batch.column(2).to_numpy()
            if batch.num_rows:
                z = kernel(_matrix(batch.column(0)))
                both = np.column_stack([z, batch.column(1).to_numpy()])
            for g in np.unique(group).tolist():
                own = group == g
                totals[g] = totals.get(g, 0) + z[own].T @ both[own]
        for g, total in totals.items():
            yield {"part": [g] * len(total), "row": list(range(len(total))), "sums": list(total)}

    return work


def _solved(sums: np.ndarray, rows: float) -> np.ndarray:
    penalty = RIDGE * rows * np.append(np.ones(FEATURES), 0) + 1e-9
    return np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1])


def _scored(kernel: Kernel, weights: np.ndarray, keep: int, others: dict[int, np.ndarray] | None = None):
    """The first ``keep`` columns and the bin of the raw score; ``others``: weights for groups, which column 1 names."""

    def work(batches):
        for batch in batches:
            z = kernel(_matrix(batch.column(keep))) if batch.num_rows else np.zeros((0, FEATURES + 1))
            raw_score = z @ weights
            if others:
                group = batch.column(1).to_numpy()
                for g, own_weights in others.items():
                    own = group == g
                    raw_score[own] = z[own] @ own_weights
            yield {**{n: batch.column(i) for i, n in enumerate(batch.schema.names[:keep])}, "bin": binned(raw_score)}

    return work


def binned(score: np.ndarray) -> np.ndarray:
    return np.clip((score + 1) * (BINS / 3), 0, BINS - 1).astype(np.int64)


def isotonic(bins: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rising step function over all ``BINS`` that fits the labels of the bins best (0.5 without any)."""
    blocks: list[list[float]] = []
    for b, s, n in sorted(zip(bins.tolist(), ones.tolist(), rows.tolist())):
        blocks.append([b, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, s2, n2 = blocks.pop()
            blocks[-1][1] += s2
            blocks[-1][2] += n2
    if not blocks:
        return np.full(BINS, 0.5)
    place = np.searchsorted([x[0] for x in blocks], np.arange(BINS), "right") - 1
    return np.array([x[1] / x[2] for x in blocks])[np.maximum(place, 0)]


def calibration(bins: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The steps of ``isotonic`` as points at the mean bins of their rows, joined by straight lines.

    Steps of 0 and 1 move inwards by half a row in all rows, and the lines end at 0 and 1 outside the bins, so that
    scores still differ beyond the outermost steps.
    """
    steps = isotonic(bins, ones, rows)
    if not len(bins):
        return steps
    bins = bins.astype(np.int64)
    values, of = np.unique(steps[bins], return_inverse=True)
    middle = np.bincount(of, bins * rows) / np.bincount(of, rows)
    edge = 0.5 / rows.sum()
    values = np.clip(values, edge, 1 - edge)
    return np.interp(np.arange(BINS), np.concatenate([[-1], middle, [BINS]]), np.concatenate([[0], values, [1]]))


def score(
    docs: DataFrame,
    labels: DataFrame,
    fit: Column,
    calibrate: Column,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    carry: bool = False,
    group: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``<id>, score`` between 0 and 1, higher where label 1 is likelier.

    ``labels`` (id, label 0 or 1): ``fit`` and ``calibrate`` are conditions on the id that choose the rows for the
    regression and for the calibration; all such rows are used.  ``group``, a whole number made from the id (a few
    values), lets rows serve for both: a row of a group is then calibrated by the fit of all rows of other groups.
    Statistics see whole texts and nothing else.
    ``carry`` adds ``row``, the input row as a struct; then texts are measured again where they lie.  No text is joined.

    Rows of ``labels`` with a null id, a null label or one that is neither 0 nor 1 are left out; labels that repeat
    an id count as rows; null and empty texts have statistics 0 and are scored like others, as are rows with a null id
    and repeated rows.  Very long texts are measured whole, one at a time.  Without rows to fit or to calibrate every
    score is 0.5.  An empty table gives no rows.
    """
    table = docs.select(F.col(id).alias("id"), raw(text).alias("text"))
    kind = dict(table.dtypes)["id"]
    measured = stored(in_arrow(table, _measured, f"id {kind}, x array<double>"))
    number = F.lit(None) if group is None else group
    known = labels.select(
        F.col(id).alias("id"),
        F.col(label).cast("double").alias("y"),
        fit.alias("f"),
        calibrate.alias("c"),
        F.coalesce(number.cast("int"), F.lit(-1)).alias("g"),
    )
    known = known.where("id is not null and y in (0.0, 1.0) and (f or c)")
    rows = stored(known.join(measured, "id").select("x", "y", "f", "c", "g"))
    training = rows.where("f").select("x", "y", "g")
    each = [F.element_at("x", i + 1) for i in range(len(STATISTICS))]
    moments = training.select(F.count("*"), *[F.avg(e) for e in each], *[F.stddev_pop(e) for e in each]).first()
    others: dict[int, np.ndarray] = {}
    if moments[0]:
        middle = 1 + len(STATISTICS)
        kernel = Kernel(np.array(moments[1:middle], float), np.array(moments[middle:], float))
        parts = in_arrow(training, _sums(kernel), "part int, row int, sums array<double>")
        # sums in column order keep one row a group and matrix row, however many partitions add to it
        added = parts.groupBy("part", "row").agg(
            F.array(*[F.sum(F.element_at("sums", i + 1)) for i in range(FEATURES + 2)]).alias("sums")
        )
        sums: dict[int, np.ndarray] = {}
        for r in added.collect():
            sums.setdefault(r["part"], np.zeros((FEATURES + 1, FEATURES + 2)))[r["row"]] = r["sums"]
        total = sum(sums.values())
        weights = _solved(total, moments[0])
        for g, own in sums.items():
            if g >= 0:  # the last feature is 1, so its sum of squares is the number of rows
                others[g] = _solved(total - own, moments[0] - own[FEATURES, FEATURES])
    else:
        kernel, weights = Kernel(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))), np.zeros(FEATURES + 1)
    held = in_arrow(rows.where("c").select("y", "g", "x"), _scored(kernel, weights, 2, others), "y double, g int, bin long")
    bins = held.groupBy("bin").agg(F.sum("y").alias("ones"), F.count("*").alias("rows")).collect()
    curve = calibration(*(np.array([r[i] for r in bins], float) for i in range(3))) if moments[0] else np.full(BINS, 0.5)

    def calibrated(batches):
        for columns in _scored(kernel, weights, 1)(batches):
            yield {"id": columns["id"], "score": curve[columns["bin"]]}

    def measured_again(batches):
        for batch in slices(batches):
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], float).reshape(batch.num_rows, -1)
            found = curve[binned(kernel(x) @ weights)] if len(x) else np.empty(0)
            yield {"id": batch.column(0), "score": found, "row": batch.column(2)}

    if carry:
        whole = docs.select(F.col(id).alias("id"), raw(text).alias("text"), carried(docs))
        done = in_arrow(whole, measured_again, f"id {kind}, score double" + carried_type(docs))
    else:
        done = in_arrow(measured, calibrated, f"id {kind}, score double")
    return done.withColumnRenamed("id", id)
