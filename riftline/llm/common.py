"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor and the driver see.

    A local session without that setting gets a temporary folder; on a cluster that would be a disk of the driver alone,
    so that the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="riftline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/riftline/{uuid.uuid4().hex}"


def materialise(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage so that a lost executor never replays the work before it, and gives the
    optimiser true sizes, so that it broadcasts a side only when that side is really small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialised tables; only what nothing reads any more, since a later write holds its result."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def sweep(spark: SparkSession) -> None:
    """Have executors drop the broadcasts of queries that are over. Spark's cleaner waits for the driver to collect its
    garbage, and a driver with little to do hardly ever does, while such tables pile up in the executors."""
    gc.collect()
    time.sleep(1.5)  # the bridge to the driver's virtual machine hands over once a second what Python let go
    spark._jvm.System.gc()


#: Texts of a batch that are Python strings at a time.
TEXTS = 256
_HELD: dict[tuple, Any] = {}


def held(name: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps for its next tasks: one thing at a time."""
    if name not in _HELD:
        let_go()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """Operators that follow each other share their workers: what one kept does not add to the memory of the next."""
    _HELD.clear()


def taken(batches: Iterable[Any], *, keep: bool = False) -> Iterator[Any]:
    """The batches of a task. What the operators before ``held`` is let go first, unless to ``keep`` it; and what Arrow's
    memory pool no longer uses goes back to the system before each batch, instead of some 70 MB staying for good."""
    if not keep:
        let_go()
    pa.default_memory_pool().release_unused()
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def strings(column: pa.Array) -> Iterator[str | None]:
    """Texts of a column, ``TEXTS`` as Python strings at a time."""
    for k in range(0, len(column), TEXTS):
        yield from column.slice(k, TEXTS).to_pylist()


def if_few(names: DataFrame, *, most: int = 1_000_000) -> DataFrame:
    """``names`` (a materialised table of a column or two) to be broadcast, if its rows are counted and few; else as it is."""
    return F.broadcast(names) if names.count() <= most else names


def row_keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Add ``_rk``, which tells apart rows that share a (possibly null) key but not the text.

    Rows equal in both keep one ``_rk``: whatever is derived from key and text is equal for them.
    """
    return df.withColumn("_rk", F.struct(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h")))


def number_within(df: DataFrame, group: str, order: list[str], out: str, *, buckets: int = 256) -> DataFrame:
    """Gapless numbers from 0 in each ``group``, without sorting any group in one task.

    Rows of a group spread over ``buckets`` by a hash of the ``order`` columns; a window numbers each
    bucket, and the running sum of the bucket counts (``buckets`` rows a group) shifts the numbers.
    ``df`` is read twice, so pass a materialised frame.
    """
    d = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        d.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(F.col(group).alias("_g"), F.col("_b").alias("_gb"), "_shift")
    )
    inside = Window.partitionBy(group, "_b").orderBy(*order)
    numbered = d.withColumn("_i", F.row_number().over(inside) - 1)
    return (
        numbered.join(shift, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_gb")))
        .withColumn(out, (F.col("_i") + F.col("_shift")).cast("long"))
        .drop("_i", "_b", "_g", "_gb", "_shift")
    )


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
