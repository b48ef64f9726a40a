"""Near-duplicate vectors by counting collisions on many one-dimensional projections.

A vector's place on a projection is a whole number of eighths of the window's half width; two vectors collide there
when each lies in the window centred on the other.  For a pair at the threshold a collision has a known probability
(the difference of the places is normal), so the count that such a pair reaches with probability ``1 - MISS`` is
known too: pairs that count fewer collisions are dropped, the others verified in double precision.

So that not all pairs are counted, projections are also taken in tables of a few, and only pairs that collide in all
of a table's are counted.  Vectors are sorted into the table's cells (twice the half width wide, so a window touches
two cells a projection) and a vector visits the cells its window touches.  The number of projections in a table
grows with the logarithm of the number of vectors, and the number of tables so that the recall stays the same.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import components, in_arrow, stored

COUNTED = 48
"""Projections counted besides those of the tables."""
MISS = 0.001
"""Probability that the count drops a pair at the threshold."""
TABLE_MISS = 0.005
"""Probability that a pair at the threshold collides in no table."""
WIDTH = 1.6
"""Half width of a window in standard deviations of the difference at the threshold (about 1.5 after rounding)."""
CELL_ROWS = 4096
"""Vectors of a cell that one group takes; larger cells are cut, each visitor goes to all parts."""
BLOCK = 512
SEED = 20
_HIT = math.erf(1.5 / math.sqrt(2))


class Setup:
    """Numbers of projections for ``rows`` vectors and a cosine threshold below 1."""

    def __init__(self, rows: int, cosine: float):
        distance = math.sqrt(2 - 2 * cosine)
        self.cosine, self.half = cosine, WIDTH * distance
        far = math.erf(self.half / 2)  # two unrelated unit vectors collide about so often
        self.depth = min(8, max(1, math.ceil(math.log(max(rows, 2) / 2000) / -math.log(far))))
        self.tables = max(1, math.ceil(math.log(TABLE_MISS) / math.log(1 - _HIT**self.depth)))
        self.least = calibrated(COUNTED, _HIT, MISS)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Whole-number places of unit vectors on all projections."""
        number = self.tables * self.depth + COUNTED
        axes = np.random.default_rng(SEED + unit.shape[1]).standard_normal((unit.shape[1], number))
        return np.clip(np.rint(unit @ axes * (8 / self.half)), -127, 127).astype(np.int8)


def calibrated(number: int, hit: float, miss: float) -> int:
    """Largest count that a binomial of ``number`` and ``hit`` reaches with probability ``1 - miss`` at least."""
    below, k = 0.0, 0
    while True:
        below += math.comb(number, k) * hit**k * (1 - hit) ** (number - k)
        if below > miss:
            return k
        k += 1


def _marked(batches):
    for batch in batches:
        keys, vectors = [], []
        for value in batch.column(1):
            v = value.as_py()
            if v is None or None in v:
                v = []
            v = np.array(v, np.float64) + 0.0
            good = len(v) and np.isfinite(v).all() and v.any()
            keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if good else None)
            vectors.append(v.tobytes() if good else None)
        yield {"id": batch.column(0), "key": keys, "vector": vectors}


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _celled(setup: Setup, narrow: bool):
    """Rows of the cells: role 0 in the own cell, 1 visiting the own cell, 2 visiting a later one."""

    def work(batches):
        for batch in batches:
            ids, sizes, vectors = (np.array(batch.column(i).to_pylist(), object) for i in range(3))
            lengths = np.array([len(v) // 8 for v in vectors])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                places = setup.places(_unit(list(vectors[at])))
                rows, cells, roles = [], [], []
                for t in range(setup.tables):
                    p = places[:, t * setup.depth : (t + 1) * setup.depth].astype(np.int64)
                    own = _packed(t, p >> 4)
                    rows.append(np.arange(len(at)))
                    cells.append(own)
                    roles.append(np.zeros(len(at), np.int64))
                    if narrow:
                        continue
                    rows.append(np.arange(len(at)))
                    cells.append(own)
                    roles.append(np.ones(len(at), np.int64))
                    low, high = (p - 8) >> 4, (p + 8) >> 4
                    for choice in range(1 << setup.depth):
                        bits = (choice >> np.arange(setup.depth) & 1).astype(bool)
                        cell = _packed(t, np.where(bits, high, low))
                        fresh = (~bits | (high > low)).all(axis=1) & (cell > own)
                        rows.append(np.flatnonzero(fresh))
                        cells.append(cell[fresh])
                        roles.append(np.full(int(fresh.sum()), 2))
                rows, cell = np.concatenate(rows), np.concatenate(cells)
                if narrow:
                    yield {"cell": cell, "d": np.full(len(rows), d)}
                    continue
                role = np.concatenate(roles)
                held = [p.tobytes() for p in places]
                for a in range(0, len(rows), 20_000):
                    r = rows[a : a + 20_000]
                    yield {
                        "cell": cell[a : a + 20_000],
                        "d": np.full(len(r), d),
                        "role": role[a : a + 20_000],
                        "id": ids[at][r].tolist(),
                        "size": sizes[at][r].tolist(),
                        "places": [held[i] for i in r],
                        "vector": vectors[at][r].tolist(),
                    }

    return work


def _packed(table: int, cell: np.ndarray) -> np.ndarray:
    """Table and cell in one number; a cell's coordinate is within +-8, so 6 bits hold it and its neighbours."""
    out = np.full(len(cell), table, np.int64)
    for j in range(cell.shape[1]):
        out = out << 6 | (cell[:, j] + 32)
    return out


def _matched(setup: Setup):
    depth, tables = setup.depth, setup.tables

    def pairs(group, q0: int, q1: int):
        """Verified pairs of visitors q0..q1 with the vectors of the group's cell, in this table first."""
        q, x = group["visit_places"][q0:q1], group["places"]
        t = group["table"]
        own = group["visit_role"][q0:q1] == 1
        met = None
        for j in range(t * depth, (t + 1) * depth):
            near = np.abs(q[:, None, j].astype(np.int16) - x[None, :, j]) <= 8
            met = near if met is None else met & near
        a, b = np.nonzero(met)
        allowed = np.where(own[a], group["visit_id"][q0 + a] < group["id"][b], group["visit_id"][q0 + a] != group["id"][b])
        a, b = a[allowed], b[allowed]
        for s in range(0, len(a), 1 << 16):
            i, k = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            count = np.zeros(len(i), np.int16)
            for c in range(0, COUNTED, 12):  # a dozen at a time, dropping pairs that can't reach the count
                cut = slice(tables * depth + c, tables * depth + c + 12)
                count += (np.abs(q[i, cut].astype(np.int16) - x[k, cut]) <= 8).sum(axis=1, dtype=np.int16)
                able = count + (COUNTED - c - 12) >= setup.least
                i, k, count = i[able], k[able], count[able]
            for u in range(t):  # counted in the first table where the pair meets
                cut = slice(u * depth, (u + 1) * depth)
                new = ~(np.abs(q[i, cut].astype(np.int16) - x[k, cut]) <= 8).all(axis=1)
                i, k = i[new], k[new]
            good = np.einsum("ij,ij->i", group["visit_unit"][q0 + i], group["unit"][k]) >= setup.cosine
            yield q0 + i[good], k[good]

    def solve(data: list[tuple], visits: list[tuple], cell: int):
        if not data or not visits:
            return
        group = {
            "table": cell >> (6 * depth),
            "id": np.array([r[3] for r in data], np.int64),
            "size": np.array([r[4] for r in data], np.int64),
            "places": np.frombuffer(b"".join(r[5] for r in data), np.int8).reshape(len(data), -1),
            "unit": _unit([r[6] for r in data]),
            "visit_id": np.array([r[3] for r in visits], np.int64),
            "visit_size": np.array([r[4] for r in visits], np.int64),
            "visit_role": np.array([r[2] for r in visits]),
            "visit_places": np.frombuffer(b"".join(r[5] for r in visits), np.int8).reshape(len(visits), -1),
            "visit_unit": _unit([r[6] for r in visits]),
        }
        found = [p for q0 in range(0, len(visits), BLOCK) for p in pairs(group, q0, min(q0 + BLOCK, len(visits)))]
        if not found:
            return
        a, b = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
        if not len(a):
            return
        left, right = group["visit_id"][a], group["id"][b]
        ids, of = np.unique(np.concatenate([left, right]), return_inverse=True)
        n = np.zeros(len(ids), np.int64)
        x, y = of[: len(a)], of[len(a) :]
        np.add.at(n, x, group["size"][b])
        np.add.at(n, y, group["visit_size"][a])
        label = np.arange(len(ids))
        while True:  # the group's links as stars: no more edges than vectors
            low = np.minimum(label[x], label[y])
            if (label[x] == low).all() and (label[y] == low).all():
                break
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            label = label[label]
        yield {"id": ids, "n": n, "root": ids[label]}

    def work(batches):
        now, data, visits = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                key = row[0], row[1], row[7]
                if key != now or len(visits) >= 4 * CELL_ROWS:
                    if now:
                        yield from solve(data, visits, now[0])
                    visits = []
                    if key != now:
                        now, data = key, []
                (visits if row[2] else data).append(row)
        if now:
            yield from solve(data, visits, now[0])

    return work


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per row of ``vectors``: ``<id>, n_links, component_id, kept``.

    Vectors of one length are linked when their cosine in double precision is at least ``cosine`` (between 0 and 1,
    below 1); pairs are sought as above, none below the threshold is linked.  ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the smallest id reachable, ``kept`` marks the vector that bears it.

    Equal vectors are one class, searched once.  Pairs are counted and verified where they meet, each in the first
    table in which it collides; only counts per vector and stars of links leave a group.

    Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing.  Rows with a
    null id get no links and are kept.  Rows repeating an id and a vector are linked as equal vectors.  An empty
    table gives no rows.
    """
    table = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    marked = stored(in_arrow(table, _marked, "id long, key binary, vector binary"))
    good = marked.where("key is not null and id is not null")
    classes = good.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    several = stored(classes.where("size > 1"))
    labelled = marked.join(several, "key", "left")
    labelled = labelled.withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    labelled = labelled.withColumn("size", F.coalesce("size", F.lit(1)))
    single = labelled.where("key is not null and id = rep").select("id", "size", "vector")
    single = stored(single.where("size = 1").union(single.where("size > 1").dropDuplicates(["id", "vector"])))
    setup = Setup(single.count(), cosine)

    counts = in_arrow(single, _celled(setup, True), "cell long, d long").groupBy("cell", "d").count()
    hot = stored(counts.where(F.col("count") > CELL_ROWS).select("cell", "d", F.ceil(F.col("count") / CELL_ROWS).alias("cuts")))
    schema = "cell long, d long, role long, id long, size long, places binary, vector binary"
    rows = in_arrow(single, _celled(setup, False), schema).join(hot, ["cell", "d"], "left")
    cuts = F.coalesce("cuts", F.lit(1))
    parts = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("id"), cuts))).otherwise(F.sequence(F.lit(0).cast("long"), cuts - 1))
    rows = rows.withColumn("part", F.explode(parts)).drop("cuts")
    rows = rows.repartition("cell", "d", "part").sortWithinPartitions("cell", "d", "part", "role")
    found = stored(in_arrow(rows.select(*schema_names(schema), "part"), _matched(setup), "id long, n long, root long"))

    links = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    result = labelled.join(links, "rep", "left").join(joined, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return result.select(
        F.col("id").alias(id),
        (F.when(F.col("rep").isNull() | F.col("key").isNull(), 0).otherwise(F.col("size") - 1 + F.coalesce("n", F.lit(0)))).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
