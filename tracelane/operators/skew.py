"""Joins and ordered scans that stay balanced when one key holds a large share of the rows.

Two situations occur throughout the library:

* many rows pick up one row of facts per key (``salted_left_join``): rows of heavy keys are spread over as
  many sub-keys as their number calls for and the matching fact row is copied to each of them.  The
  heavy-key list is a bounded top-k of a narrow, map-side combined count, so broadcasting it is safe at
  any data size;
* rows are ordered inside a group (``carried``): a group is cut into blocks of its integer position, each
  block is scanned on its own, and what a block needs from its neighbours arrives through a
  one-row-per-block summary.  No task ever holds a whole group.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000  # rows of one key beyond which it is spread, and rows per sub-key from there on
HOT_KEYS = 100_000  # at most this many keys are spread; any other key holds < 1/100,000 of all rows
NULL_SLICES = 65_536  # sub-keys over which rows with a null key are spread
BLOCK = 65_536  # positions of an ordered group handled together
TASK_ROWS = 1_000_000  # rows that one task takes of rows dealt by their number (``spread``)
FEW_ROWS = 100_000  # rows up to which a side of a join may be sent to all tasks (``few``)


def hot_keys(
    rows: DataFrame, keys: list[str], min_rows: int | None = None, most: int = HOT_KEYS
) -> DataFrame:
    """The (at most ``most``) keys with at least ``min_rows`` rows (default ``HOT_ROWS``).

    ``__slices`` is the number of sub-keys that gives each about ``min_rows`` rows.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return heaviest(counts, keys, min_rows, most)


def heaviest(
    counts: DataFrame,
    keys: list[str],
    min_rows: int | None = None,
    most: int = HOT_KEYS,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """As ``hot_keys``, from one row per key with its (known or expected) number of ``__rows``.

    ``also`` names further columns of ``counts`` to keep.
    """
    min_rows = HOT_ROWS if min_rows is None else min_rows
    top = counts.filter(F.col("__rows") >= min_rows).orderBy(F.desc("__rows"), *keys).limit(most)
    slices = F.ceil(F.col("__rows") / F.lit(min_rows)).cast("int").alias("__slices")
    return top.select(*keys, slices, *also)


def _same(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> Column:
    def pair(k: str) -> Column:
        return left[k].eqNullSafe(right[f"__r_{k}"]) if null_safe else left[k] == right[f"__r_{k}"]

    return reduce(lambda a, b: a & b, [pair(k) for k in keys])


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: list[str],
    hot: DataFrame | None = None,
    *,
    null_safe: bool = False,
    keep_slice: bool = False,
) -> DataFrame:
    """Left join of ``left`` to ``right`` with heavy keys of ``left`` spread by a hash of ``spread``.

    ``hot`` may give the heavy keys (``hot_keys``) counted elsewhere, for example on the bare scan under a
    costly ``left``.  With plain equality, rows with a null key can match nothing and are spread as well.
    """
    added = [c for c in right.columns if c not in keys]
    own = left.columns
    clash = set(added) & set(own)
    if clash:
        raise ValueError(f"columns on both sides besides the keys: {sorted(clash)}")
    if hot is None:
        hot = hot_keys(left, keys)
    marks = F.broadcast(hot.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__slices"))
    digest = F.xxhash64(*[F.col(c) for c in spread])

    marked = left.join(marks, _same(left, marks, keys, null_safe), "left")
    slice_of = F.coalesce(F.pmod(digest, F.col("__slices")).cast("int"), F.lit(0))
    if not null_safe:
        no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        slice_of = F.when(no_key, F.pmod(digest, F.lit(NULL_SLICES)).cast("int")).otherwise(slice_of)
    sliced = marked.select(*own, slice_of.alias("__slice"))

    last = F.coalesce(F.col("__slices"), F.lit(1)) - F.lit(1)
    copies = right.join(marks, _same(right, marks, keys, null_safe), "left").select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *added,
        F.explode(F.sequence(F.lit(0), last)).alias("__r_slice"),
    )
    on = _same(sliced, copies, keys, null_safe) & (sliced["__slice"] == copies["__r_slice"])
    extra = ["__slice"] if keep_slice else []
    return sliced.join(copies, on, "left").select(*own, *added, *extra)


def attach_group_facts(
    rows: DataFrame, keys: list[str], aggs: list[Column], spread: list[str]
) -> DataFrame:
    """Give every row the aggregates of its group (a grouped ``mutate``) without a whole-group window."""
    facts = rows.groupBy(*keys).agg(*aggs)
    return salted_left_join(rows, facts, keys, spread, null_safe=True)


def block_of(position: Column, size: int | None = None) -> Column:
    """Number of the block (of ``size`` positions, default ``BLOCK``) around a position.

    Block 0 lies around position 0, so that an ordinary group with a few negative positions is one block.
    """
    size = BLOCK if size is None else size
    return F.floor((position + F.lit(size // 2)) / F.lit(size)).cast("long")


def blocked(rows: DataFrame, keys: list[str], position: Column, size: int | None = None) -> DataFrame:
    """Add ``__block`` (see ``block_of``) and bring the rows of each block together."""
    return rows.withColumn("__block", block_of(position, size)).repartition(*keys, "__block")


def carried(
    rows: DataFrame,
    keys: list[str],
    summary: list[Column],
    carry: Callable[[DataFrame, Window, Window], DataFrame],
    only: Column | None = None,
) -> DataFrame:
    """Join to every row of a block what the other blocks of its group pass on.

    ``rows`` has ``keys`` and ``__block``.  ``summary`` aggregates one block; ``carry(blocks, before,
    order)`` adds columns named ``__c_...`` to the summary rows, given a window over all earlier blocks and
    a plain ordered one.  Groups that fit into one block take no part, so their ``__c_`` columns are null;
    ``only`` may tell in advance which rows belong to larger groups.
    """
    order = Window.partitionBy(*keys).orderBy("__block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows if only is None else rows.filter(only)).groupBy(*keys, "__block").agg(*summary)
    several = F.lag("__block").over(order).isNotNull() | F.lead("__block").over(order).isNotNull()
    passed = carry(blocks.withColumn("__several", several), before, order).filter("__several")
    names = [c for c in passed.columns if c.startswith("__c_")]
    return rows.join(passed.select(*keys, "__block", *names), [*keys, "__block"], "left")


def spread(rows: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """Deal rows by ``keys`` over as many tasks as their number calls for (``TASK_ROWS`` each, counted first).

    Left to itself Spark goes by the bytes shuffled, which say little of rows that compress well or become many
    (``times`` tells how many) later in the same task.
    """
    return rows.repartition(tasks_for(rows, times), *keys)


def tasks_for(rows: DataFrame, times: int = 1) -> int:
    return max(1, -(-rows.count() * times // TASK_ROWS))


def few(rows: int) -> bool:
    """Whether a side of a join with so many (counted) rows may be sent to all tasks.

    Left to itself Spark goes by the compressed bytes of the files below, which a few joins and levels later say little
    of the rows; a table that it broadcasts for them passes through the driver whole.
    """
    return rows <= FEW_ROWS


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tracelane-checkpoint-")
    context.setCheckpointDir(shared)


def range_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Cut rows into consecutive, evenly filled ``__block`` ranges of any sort key.

    The cut points are sampled, so the result is materialised once and every later use sees the same
    blocks, also after losing an executor.
    """
    ranged = rows.repartitionByRange(*order).withColumn("__block", F.spark_partition_id())
    return checkpointed(ranged)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 0 in the order of a sort key, without bringing them all to one task.

    Each range of the sorted rows (``range_blocks``) is numbered on its own, after the rows of earlier ranges; the
    ranges' sizes are a table of one row per range, the side of the join that is sent to all tasks.
    """
    blocks = range_blocks(rows, order)
    sizes = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__block")) - F.col("__size")
    own = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    ahead = F.broadcast(sizes.select("__block", before.alias("__before")))
    placed = blocks.withColumn("__own", own).join(ahead, "__block")
    return placed.select(*rows.columns, (F.col("__before") + F.col("__own") - 1).cast("long").alias(name))


def last_known_before(
    rows: DataFrame, group: list[str], order: str, values: list[str], names: list[str]
) -> DataFrame:
    """Per row, the last non-null of each of ``values`` among the group's earlier rows.

    For any orderable ``order`` column and groups of any size (see ``range_blocks``).
    """
    blocks = range_blocks(rows, [*group, order])
    inside = Window.partitionBy(*group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summary = [
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"__last_{v}") for v in values
    ]

    def carry(blocks, before, _order):
        return blocks.withColumns(
            {f"__c_{v}": F.last(f"__last_{v}", ignorenulls=True).over(before) for v in values}
        )

    joined = carried(blocks, group, summary, carry)
    found = [
        F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"__c_{v}")).alias(n)
        for v, n in zip(values, names)
    ]
    return joined.select(*rows.columns, *found)
