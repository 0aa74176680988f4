"""The drive as one stream: rules, restarts, lateness, and the same log as from all rows at once."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.streaming.drive_state import KEEP_US, Drive, _Seen, drive_log, stream_drive_log

SCHEMA = "drive_id string, us long, kind string, fix_us long, lat double, lng double, accuracy double, speed_mps double, score double, seq int, decision string, event_key string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def row(at: float, kind: str, **more: object) -> dict:
    names = ["fix_us", "lat", "lng", "accuracy", "speed_mps", "score", "seq", "decision", "event_key"]
    place = {"lat": 12.9, "lng": 77.6, "accuracy": 5.0, "speed_mps": 8.0} if kind == "fix" else {}
    return dict.fromkeys(names) | {"at_us": round(at * 1e6), "kind": kind} | place | more


def log(*rows: dict) -> list[dict]:
    drive, seen, out = Drive(), _Seen(), []
    for r in rows:
        out += drive.take(r, seen)
    return out + drive.wait(1 << 62)


def test_bursts() -> None:
    frames = lambda *times: [row(t, "frame", score=t) for t in times]
    told = lambda out: [(r["at_us"] / 1e6, r["frames"], r["best"]) for r in out if r["kind"] == "burst"]
    assert told(log(row(0, "fix"), *frames(0.1, 0.2, 0.3, 0.5, 0.7))) == [(0.5, 3, 2)]  # 0.2 is too early for the second, 0.5 is the third
    assert told(log(row(0, "fix"), *frames(0.1, 0.28, 2.5))) == [(2.46, 2, 1)]  # the third's wait, from 0.46 on, is over
    assert told(log(row(0, "fix"), *frames(2.0, 4.18))) == [(6.36, 2, 1)]  # a frame in the last moment of its wait counts
    assert told(log(row(0, "fix"), *frames(2.3))) == [(4.48, 1, 0)] and told(log(row(0, "fix"), *frames(2.1))) == []  # 2.1 is between two waits
    assert told(log(row(0, "fix"), *frames(7.0))) == []
    # An empty burst is as if never opened: the next fix is again the first. While one is open, fixes do not count.
    out = log(row(0, "fix"), row(1, "fix", lat=13.0), row(7, "fix", lat=12.95), *frames(7.1, 7.3, 7.5), row(8, "fix", lat=12.95), row(20, "stop"))
    assert [(r["kind"], r.get("lat")) for r in out] == [("burst", 12.95), ("stop", None)]
    assert told(log(row(0, "fix", fix_us=-11_000_000), *frames(0.1))) == []  # a stale fix
    assert told(log(row(0, "fix"), *frames(0.1), row(0.2, "stop"))) == [(0.2, 1, 0)]


def test_sightings_leave_after_30_days() -> None:
    day = 86_400
    seen = lambda at, key, decision="accept": row(at, "verdict", decision=decision, event_key=key, seq=1)
    out = log(seen(0, "a"), seen(1, "b", "reject"), seen(2, "b"), seen(30 * day, "a"), seen(30 * day + 1, "a"), seen(60 * day + 1, "a"), seen(90 * day + 2, "a"), seen(91 * day, None))
    assert [r["repeated"] for r in out] == [False, None, False, True, True, True, False, None]
    assert [(r["checked"], r["found"], r["already"]) for r in out][-1] == (8, 3, 1)


def drives(seed: int) -> list[tuple]:
    """Drives with gaps, missing and late frames, several days and a return after 30 days; times in microseconds."""
    r, rows = random.Random(seed), []
    for d in range(4):
        t = r.randrange(10**6)
        for part in range(2):
            for n in range(25):
                t += r.choice([400_000, 900_000, 2_500_000, 9_000_000])
                rows.append((f"d{d}", t, "fix", t - r.choice([0, 0, 0, 11_000_000]), 12.9 + r.random() / 500, 77.6, float(r.choice([4, 40])), float(r.choice([0, 5, 12])), None, None, None, None))
                for _ in range(r.randint(0, 4)):
                    rows.append((f"d{d}", t + r.randrange(0, 3_000_000), "frame", None, None, None, None, None, float(r.randrange(5)), None, None, None))
                if r.random() < 0.5:
                    rows.append((f"d{d}", t + 500_000, "verdict", None, None, None, None, None, None, n, r.choice(["accept", "reject"]), r.choice(["k1", "k2", "k3", None])))
            if r.random() < 0.7:
                rows.append((f"d{d}", t + 100_000, "stop", *[None] * 9))
            t += r.choice([5_000_000, KEEP_US + 3_600_000_000])
    rows += [("end", t + 10 * KEEP_US, "stop", *[None] * 9), (None, 5, "fix", *[None] * 9), ("d0", None, "fix", *[None] * 9), ("d0", 7, "odd", *[None] * 9)]
    return rows


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.timestamp_micros("us"), "fix_at": F.timestamp_micros("fix_us")})


def plain(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_restarts_and_equals_the_batch(spark: SparkSession, tmp_path: Path, seed: int) -> None:
    """Rows in small files, shuffled within the delay, by a query that is stopped and started from its checkpoint."""
    rows = drives(seed)
    want = plain(drive_log(table(spark, rows)))
    assert len({r[2] for r in want}) == 3 and any(r[4] not in (None, 3) for r in want) and {r[10] for r in want} == {None, True, False}
    r = random.Random(seed)
    timed = sorted((x for x in rows if x[1] is not None), key=lambda x: x[1] + r.randrange(0, 8_000_000))  # up to 8 s late
    source, out, size = str(tmp_path / "in"), str(tmp_path / "out"), -(-len(timed) // 9)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        for n in range(9):
            table(spark, timed[n * size : (n + 1) * size]).coalesce(1).write.mode("append").parquet(source)
            if n in (3, 5, 8):  # what has come so far, then the query ends; the next one goes on from the checkpoint
                stream = spark.readStream.schema(table(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(source)
                query = stream_drive_log(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(out)
                assert query.awaitTermination(300) and query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = plain(spark.read.parquet(out))
    # The very last row's own time is never passed by the watermark.
    assert got == [w for w in want if w[0] != "end"]
