"""The watched folder over several batches: the version that stays is reviewed, and only that."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riftline.streaming import watch

START = dt.datetime(2024, 1, 1)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def staying(events, quiet, end):
    """Versions that no other of their file follows within ``quiet``, as far as the time of the stream has come."""
    out = []
    for file in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == file), key=lambda e: (e[3], e[2]))
        for k, e in enumerate(own):
            follows = own[k + 1][3] if k + 1 < len(own) else None
            if (follows - e[3] >= dt.timedelta(milliseconds=quiet)) if follows else (end >= e[3] + dt.timedelta(milliseconds=quiet)):
                out.append((file, e[2]))
    return sorted(out)


def run(spark, tmp_path, batches, quiet):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, watch.VERSIONS).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        (source,) = (tmp_path / f"w{k}").glob("part-*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        source.rename(tmp_path / "in" / f"{k:03}.parquet")
        watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), lambda df: df.select("file_id", "text"), quiet_ms=quiet).awaitTermination()
    return sorted(str((r.file_id, r.text)) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_last_version_across_batches(spark, tmp_path):
    batches = [
        [(1, "a", "one", at(0)), (1, "a", "two", at(100)), (2, "b", "x", at(0))],
        [(1, "a", "three", at(300)), (2, "b", "y", at(900))],  # follows the second version soon, in another batch
        [(3, "c", "late clock", at(5000))],
        [(3, "c", "end", at(20_000)), (4, "d", None, at(20_000))],
        [(9, "z", "clock", at(60_000))],
    ]
    wanted = [(1, "three"), (2, "x"), (2, "y"), (3, "end"), (3, "late clock"), (4, None)]
    assert run(spark, tmp_path, batches, 350) == sorted(map(str, wanted))


def test_batches_do_not_matter(spark, tmp_path):
    r = random.Random(9)
    events = sorted(((r.randrange(4), "p", f"v{k}", at(r.randrange(0, 6000, 50))) for k in range(60)), key=lambda e: e[3])
    cuts = sorted(r.sample(range(1, 60), 4))
    batches = [events[a:b] for a, b in zip([0, *cuts], [*cuts, 60], strict=True)]
    found = run(spark, tmp_path, [*batches, [(99, "z", "clock", at(60_000))]], 350)
    assert found == sorted(map(str, staying(events, 350, at(60_000))))
    assert len(found) < len(events)


def test_newest_in_a_batch(spark):
    rows = [(1, "a", "old", at(0)), (1, "a", "new", at(5)), (2, "b", "x", at(0))]
    found = watch.newest(spark.createDataFrame(rows, watch.VERSIONS)).select("file_id", "text", F.lit(1)).collect()
    assert sorted((r.file_id, r.text) for r in found) == [(1, "new"), (2, "x")]
