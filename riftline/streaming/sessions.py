"""Agent sessions: turns in which a finding came up again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEDGER = "session_id long, fingerprint string, turns long, over boolean, ts timestamp"
_STATE = "last timestamp, fingerprints array<string>, turns array<long>"


def windows(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """session_id, start, end, turns, findings: sessions end after ``gap`` without a turn. Batch or stream."""
    rows = turns.withWatermark("ts", late) if turns.isStreaming else turns
    found = rows.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("turns"), F.approx_count_distinct("fingerprint").alias("findings") if turns.isStreaming else F.count_distinct("fingerprint").alias("findings"))
    return found.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns", "findings")


def ledger(turns: DataFrame, limit: int = 2, idle_minutes: int = 30) -> DataFrame:
    """For each turn and finding, the turns it has come up in within the session, as a stream.

    A turn is the rows of a session that share ``turn_id``; a finding counts once a turn. A pause of
    ``idle_minutes`` or more starts the session anew. State of a silent session leaves by event-time timeout.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, names, counts = state.get if state.exists else (None, [], [])
        seen = dict(zip(names, counts, strict=True))
        rows = pd.concat(list(batches)).sort_values(["ts", "turn_id", "fingerprint"])
        out = []
        for _, turn in rows.groupby("turn_id", sort=False):
            at = turn["ts"].min()
            if last is not None and at - last >= pd.Timedelta(minutes=idle_minutes):
                seen = {}
            for name in turn["fingerprint"].unique():
                seen[name] = seen.get(name, 0) + 1
                out.append((key[0], name, seen[name], seen[name] >= limit, at))
            last = turn["ts"].max()
        state.update((last, list(seen), list(seen.values())))
        state.setTimeoutTimestamp(int(last.timestamp() * 1000) + idle_minutes * 60_000)
        yield pd.DataFrame(out, columns=["session_id", "fingerprint", "turns", "over", "ts"])

    keyed = turns.withWatermark("ts", "10 minutes").groupBy("session_id")
    return keyed.applyInPandasWithState(step, LEDGER, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
