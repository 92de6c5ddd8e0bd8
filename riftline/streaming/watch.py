"""Watching a folder of file versions: what settles goes through the batch pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

VERSIONS = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("seen", T.TimestampType())])
#: Silence after which a version counts as the one that stays, and how late events may come.
QUIET_MS, LATE = 350, "1 second"


def newest(versions: DataFrame) -> DataFrame:
    """Of several versions of a file in one batch, the newest: the last event wins."""
    order = Window.partitionBy("file_id").orderBy(F.desc("seen"), F.desc("text"))
    return versions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def settled(versions: DataFrame, quiet_ms: int = QUIET_MS, late: str = LATE) -> DataFrame:
    """file_id, path, text, seen: versions after which a file was quiet for ``quiet_ms``, over all batches of a stream.

    The state of a file is its newest version so far. A version goes out when one of the same file follows at
    ``quiet_ms`` or later, or when the event time of the stream has passed that moment, whatever batch that is in; one
    that is followed sooner never does. Versions older than the one held change nothing, and of equal times the larger
    text counts. The state of a silent file leaves with its version.
    """
    kinds = {f.name: f.dataType.simpleString() for f in versions.schema.fields}
    out = ", ".join(f"{c} {kinds[c]}" for c in ("file_id", "path", "text", "seen"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        gone = []
        if state.hasTimedOut:
            gone.append((key[0], *held))
            state.remove()
        else:
            for row in pd.concat(list(batches)).sort_values(["seen", "text"], na_position="first")[["path", "text", "seen"]].itertuples(index=False):
                now = tuple(None if pd.isna(v) else v for v in row)
                if held is not None and now[2] - held[2] >= pd.Timedelta(milliseconds=quiet_ms):
                    gone.append((key[0], *held))
                if held is None or now[2] >= held[2]:
                    held = now
            state.update(held)
            state.setTimeoutTimestamp(max(int(held[2].timestamp() * 1000) + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(gone, columns=["file_id", "path", "text", "seen"])

    keyed = versions.where("seen IS NOT NULL").withWatermark("seen", late).groupBy("file_id")
    return keyed.applyInPandasWithState(step, out, f"path {kinds['path']}, text {kinds['text']}, seen {kinds['seen']}", "append", GroupStateTimeout.EventTimeTimeout)


def watch(
    spark: SparkSession, folder: str, out: str, checkpoint: str, review: Callable[[DataFrame], DataFrame], schema: T.StructType = VERSIONS, *, quiet_ms: int | None = None, files_a_batch: int | None = None
):
    """Start the stream; each batch's findings are written under its own number, so that a retry replaces them.

    quiet_ms: review all versions that stay that long (``settled``), and no others; else the newest of each batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        review(newest(batch) if quiet_ms is None else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    reader = spark.readStream.schema(schema)
    versions = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)
    rows = versions if quiet_ms is None else settled(versions, quiet_ms)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
