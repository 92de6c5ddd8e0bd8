"""Jump consistent hashing: stable keys to shards without a ring table.

A key's shard depends on the key and the number of shards alone. Growing from n to n + 1 shards moves
about 1 / (n + 1) of the keys, all of them into the new shard. The published algorithm (Lamping and
Veach, 2014) follows a key's pseudo-random jumps; here a whole Arrow batch of keys jumps at once.

Defined cases: a null key hashes like any other value (all null keys share a shard); equal keys share a
shard; a null text has no bytes (size = ``overhead``, checksum 0); an empty table gives an empty result;
columns of the input other than key and text are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.llm.common import materialise, number_within

#: Fixed value of the published algorithm: the multiplier of its linear congruential generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, for all keys of the batch together."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    at = np.zeros(len(state), dtype=np.int64)
    while live.size:
        shard[live] = at
        moved = state[live] * MULTIPLIER + np.uint64(1)
        state[live] = moved
        stride = float(1 << 31) / ((moved >> np.uint64(33)).astype(np.float64) + 1.0)
        at = ((shard[live] + 1) * stride).astype(np.int64)
        inside = at < shards
        live, at = live[inside], at[inside]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a key column of any type."""

    @F.pandas_udf("int")
    def of(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return of(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str, text: str, *, shards: int, overhead: int = 8) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard (with one more shard) and slot (gapless in each shard).

    The text is read once and never shuffled: only the five narrow columns are.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = materialise(
        df.select(
            F.col(key).alias(key),
            (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            shard_of(F.col(key), shards).alias("shard"),
            shard_of(F.col(key), shards + 1).alias("grown_shard"),
        )
    )
    return number_within(narrow, "shard", [key, "text_crc32", "size"], "slot")


def query(docs: DataFrame, shards: int = 24) -> DataFrame:
    return assign_shards(docs, "doc_id", "text", shards=shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
