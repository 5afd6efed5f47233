"""Helpers shared by the corpus operators: slim tables, prefix sums and group facts."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairband.session import scratch_path

BATCH_BYTES = 8 << 20
_TRIM = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)  # only where the C library has it


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table, read with Spark only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage without depending on the executors that computed it: every
    later use reads the files, also after executors were lost.
    """
    path = scratch_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later plan reads."""
    for table in tables:
        spark, path = table.sparkSession, table.__dict__.pop("written_to", None)
        if path is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def python_workers(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Get Python workers ready: batches of about ``size`` bytes, however long the texts are, and this package.

    Where the workers' module path does not hold the package already (``PYTHONPATH``
    or the working folder), Spark sends it to them once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if root in {Path.cwd(), *map(Path, os.environ.get("PYTHONPATH", "").split(os.pathsep))} or getattr(context, "_fairband_sent", False):
        return
    package = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "fairband"), "zip", root, "fairband")
    context.addPyFile(package)
    context._fairband_sent = True


_HELD: dict = {}


def held(key, make):
    """A large helper (a vocabulary, say) that a worker process keeps between its tasks; it keeps one at a time."""
    if key not in _HELD:
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Let go of the helper that earlier tasks of this worker left, and return free memory to the system."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns of the given names called otherwise, and what gives a result its names back."""
    before, taken = docs.columns, {c.lower() for c in docs.columns}
    if not taken & {n.lower() for n in names}:
        return docs, lambda result: result
    own, after = {n.lower() for n in names}, []
    for c in before:
        new = c
        while new.lower() in own or (new != c and new.lower() in taken):
            new += "_"
        after.append(new)
    return docs.toDF(*after), lambda result: result.toDF(*before)


def upper_63(value: Column) -> Column:
    """A 64-bit hash as a non-negative long that keeps the hash's unsigned order."""
    return F.shiftrightunsigned(value, 1)


def running(df: DataFrame, value: str, within: list[str], cells: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the row and all rows before it.

    Rows are ordered by ``cells`` and then ``order`` inside each ``within`` group.
    The cells take few distinct values however large the table is: their totals
    give every cell its offset, and the exact running sum is made inside each
    cell, so no task sees more than one cell's rows.  ``within`` and ``cells`` hold
    no nulls.
    """
    keys = [*within, *cells]
    before = Window.partitionBy(*within).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*keys).agg(F.sum(value).alias("_cell_total"))
               .select(*keys, F.coalesce(F.sum("_cell_total").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("_inside", F.sum(value).over(inside))
            .join(offsets, keys).withColumn(name, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset"))


def with_group_facts(rows: DataFrame, key: str, salt: Column, facts: dict[str, tuple], salts: int = 64) -> DataFrame:
    """Join every row with aggregates of its group, however large the group is.

    ``facts`` maps an output column to (aggregate of a row column, row column,
    aggregate that merges partial results).  ``salt`` splits a group's rows over
    up to ``salts`` parts: parts are aggregated first, their results merged per
    group, and the merged result returns once to each part that exists.  Small
    groups have as many parts as rows at most, so nothing is multiplied.
    """
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    parts = rows.groupBy(key, "_salt").agg(*[first(column).alias(out) for out, (first, column, _) in facts.items()])
    groups = (parts.groupBy(key).agg(*[merge(out).alias(out) for out, (_, _, merge) in facts.items()],
                                     F.collect_set("_salt").alias("_salts"))
              .select(key, F.explode("_salts").alias("_salt"), *facts))
    return rows.join(groups, [key, "_salt"]).drop("_salt")


BLOCK_BITS = 32768  # bits of one built-in bitmap
MOST_FILTER_BITS = 1 << 28  # 32 MB: bounds every filter that is broadcast


def filter_blocks(rows: int, bits_per_row: int = 16, max_filter_bits: int = MOST_FILTER_BITS) -> int:
    """Blocks of a Bloom filter for ``rows`` keys, never more than ``max_filter_bits`` in all."""
    return max(1, min(rows * bits_per_row, max_filter_bits) // BLOCK_BITS)


def filter_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def filter_bits(key: Column, hashes: int) -> list[Column]:
    """The bits of a key in its block (up to four)."""
    spread = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.shiftrightunsigned(spread, 16 * i), F.lit(BLOCK_BITS)).cast("int") for i in range(hashes)]


def filter_bitmaps(keys: DataFrame, key: Column, blocks: int, hashes: int, least_hits: int = 1) -> DataFrame:
    """Per block the bitmap of the bits that ``least_hits`` or more rows hit: ``(block, bitmap)``, 4 KB each."""
    # one offset per block and bit; the built-in bitmap buckets count from 1
    position = F.explode(F.array(*[filter_block(key, blocks) * BLOCK_BITS + b + 1 for b in filter_bits(key, hashes)]))
    hit = keys.select(position.alias("position")).groupBy("position").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least_hits)
    return (hit.groupBy((F.bitmap_bucket_number("position") - 1).alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bitmap")))


def filter_hit(bitmap: Column, bits: list[Column]) -> Column:
    """Whether all bits are set; false where there is no bitmap."""
    out = bitmap.isNotNull()
    for bit in bits:
        byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        out = out & (F.getbit(byte, F.pmod(bit, F.lit(8))) == 1)
    return F.coalesce(out, F.lit(False))


def maybe_among(rows: DataFrame, keys: DataFrame, key: str, hashes: int = 3) -> DataFrame:
    """The rows whose ``key`` is among ``keys``, and some others: a look at a bounded filter before a join."""
    blocks = filter_blocks(keys.count())
    bitmaps = filter_bitmaps(keys, F.col(key), blocks, hashes).withColumnsRenamed({"block": "__block", "bitmap": "__bitmap"})
    return (rows.join(F.broadcast(bitmaps), filter_block(F.col(key), blocks) == F.col("__block"))
            .filter(filter_hit(F.col("__bitmap"), filter_bits(F.col(key), hashes))).drop("__block", "__bitmap"))
