"""What several operators need: tables in the shared folder, bounded slices of Arrow batches, bounded caches."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
"""Text that one numpy pass takes at once; a longer document makes a slice of its own."""

SIEVE_BITS = 1 << 26
"""Bits (8 MB at most) by which rows are told apart that surely meet none of some ids; a million ids let 1.5 % more by."""
MAP_BITS = 1 << 15
"""Bits of one of Spark's bitmaps."""

CACHE_ENTRIES = 300_000
"""Words a Python worker remembers.  Later new words are computed each time they occur, with the same result."""


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only for a local session that names none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tracelane-")
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sieved(df: DataFrame, ids: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose id may be in ``ids``, and those whose id surely isn't: together all rows, each once.

    A bitmap of hashed ids goes to all tasks, so that a join with ``ids`` has to move only the first rows' texts.  Its
    size is bounded: beyond some ten million ids more rows come by for nothing, which only the join then drops.
    """
    place = F.pmod(F.xxhash64(F.col(id).cast(ids.schema[id].dataType)), F.lit(SIEVE_BITS))
    part, at = F.floor(place / MAP_BITS).alias("_part"), (place % MAP_BITS).alias("_at")
    maps = ids.select(part, at).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    marked = df.select("*", part, at).join(F.broadcast(stored(maps)), "_part", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(met).select(*columns), marked.where(~met).select(*columns)


def raw(text: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(b""))


def carried(df: DataFrame) -> Column:
    """The whole row as one struct ``row``, to pass through an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def carried_type(df: DataFrame) -> str:
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields)
    return f", row struct<{fields}>"


_lock, _held, _owner = threading.RLock(), {}, [""]


def remembered(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task for the operator at work, made when it is first asked for."""
    with _lock:
        if name not in _held:
            _held[name] = make()
        return _held[name]


def begun(owner: str) -> None:
    """Let go of what another operator remembers: Spark's workers outlive their tasks and serve one after another."""
    with _lock:
        if _owner[0] != owner:
            _held.clear()
            _owner[0] = owner


def released() -> None:
    """Give free memory back to the system; allocators else keep the most that any task of a worker needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def in_arrow(
    df: DataFrame, work: Callable[[list[pa.RecordBatch]], Iterator[dict] | Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with ``work`` called for each batch and giving columns as dicts of lists or arrays.

    A worker's memory is that of one operator, the module of ``work``: what others remembered goes when a task begins,
    what the task no longer needs when it ends.
    """
    fields = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(work.__module__)
        for columns in work(batches):
            arrays = [
                c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                for f in fields
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)
        columns = arrays = c = None
        released()

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the binary column at place ``text`` holds about ``limit`` bytes in each."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and its offsets in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i], ..., starts[i] + sizes[i] - 1`` one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of ``edges`` (a, b): ``id, component``, for ids that have an edge.

    Alternating large and small stars: every id's neighbours move to its smallest neighbour until each component
    is one star.  A round costs two grouped minima and two joins on the edges left; the edges stay in the shared
    folder, only a count and a checksum reach the driver.  Hubs are joined, never collected; AQE splits them.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = stored(
            large.join(small, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
    found = now.groupBy("a").agg(F.min("b").alias("m"))
    return found.select(F.col("a").alias("id"), F.col("m").alias("component")).union(
        found.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
    )
