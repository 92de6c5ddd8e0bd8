"""Tables that are written once, and relations that grow or shrink until nothing changes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back: a lost executor replays nothing before it.

    A local session without that setting gets a temporary folder.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="riftline-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(start: DataFrame, edges: DataFrame, at: str, to: str) -> DataFrame:
    """``start`` and all rows from which an edge leads, over any number of edges, to a row of it.

    edges has the columns of ``start`` that name a row, with ``at`` for the beginning of an edge, and ``to`` for its end;
    it is joined on them all. Each round follows the edges into rows that are new, so that circles end.
    """
    names = start.columns
    seen = new = settled(start.distinct())
    edges = settled(edges.distinct())
    on = [c for c in names if c in edges.columns and c != at]
    while new.take(1):
        ends = new.withColumnRenamed(at, to)
        found = edges.join(ends, [*on, to]).select(*names).distinct()
        new = settled(found.join(seen, names, "left_anti"))
        seen = seen.unionByName(new)
    return seen


def resolved(open_: DataFrame, needs: DataFrame, at: str, to: str) -> DataFrame:
    """Rows of ``open_`` all of whose ``needs`` (``at`` needs ``to``) are resolved; rows on circles never are."""
    on = [c for c in open_.columns if c != at]
    open_, needs = settled(open_.distinct()), settled(needs.distinct())
    done, n, before = open_.join(needs, [*on, at], "left_anti"), -1, -2
    while n > before:
        done, before = settled(done), n
        n = done.count()
        waiting = needs.join(done.withColumnRenamed(at, to), [*on, to], "left_anti").select(*on, at).distinct()
        done, last = open_.join(waiting, [*on, at], "left_anti"), done
    return last
