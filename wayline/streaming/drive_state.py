"""A drive as one stateful stream: fixes open bursts, frames fill them, verdicts count, and each state leaves in time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline.streaming.drives import gate

#: Frames of a burst, microseconds between them, wait for each, and how long a sighting is kept.
FRAMES, SPACING_US, WAIT_US = 3, 180_000, 2_000_000
KEEP_US = 30 * 24 * 60 * 60 * 1_000_000
KINDS = ("fix", "frame", "verdict", "stop")
#: What a drive's rows have besides drive_id and at: a fix has its own time, place, accuracy and speed, a frame its score,
#: a verdict the burst's number, the decision and the key of what was seen.
FIELDS = ["kind", "fix_at", "lat", "lng", "accuracy", "speed_mps", "score", "seq", "decision", "event_key"]
ROW = "at_us long, kind string, fix_us long, lat double, lng double, accuracy double, speed_mps double, score double, seq int, decision string, event_key string"
LOG = (
    "drive_id string, at_us long, kind string, seq int, frames int, best int, score double, lat double, lng double,"
    " decision string, repeated boolean, checked int, found int, already int"
)
NAMES = [part.split()[0] for part in LOG.split(",")]


@dataclass
class Drive:
    """Where a drive stands after the rows so far. Times are microseconds."""

    captured: tuple[float, float, float] | None = None
    seq: int = 0
    opened: tuple[int, float, float] | None = None
    attempt: int = 0
    begins: int = 0
    scores: list[float] = field(default_factory=list)
    checked: int = 0
    found: int = 0
    already: int = 0

    def deadline(self) -> int | None:
        """When the frame that is waited for is given up."""
        return self.begins + WAIT_US if self.opened else None

    def _next(self, at: int, begins: int) -> list[dict]:
        self.attempt += 1
        self.begins = begins
        return self.close(at) if self.attempt == FRAMES else []

    def close(self, at: int) -> list[dict]:
        """Ends the open burst with the frames it has; without any it is as if it had never been opened."""
        if not self.opened:
            return []
        (opened, lat, lng), scores = self.opened, self.scores
        self.opened, self.scores = None, []
        if not scores:
            return []
        self.seq += 1
        self.captured = (opened / 1e6, lat, lng)
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return [{"at_us": at, "kind": "burst", "seq": self.seq, "frames": len(scores), "best": best, "score": scores[best], "lat": lat, "lng": lng}]

    def wait(self, until: int) -> list[dict]:
        """Gives up every frame whose time is over before `until`."""
        out = []
        while self.opened and self.deadline() < until:
            end = self.deadline()
            out += self._next(end, end + SPACING_US)
        return out

    def take(self, r: dict, sightings: Any) -> list[dict]:
        """The next row in order; `sightings` maps the keys seen to (time seen last, whether seen again)."""
        at, out = r["at_us"], self.wait(r["at_us"])
        if r["kind"] == "fix" and not self.opened:
            fix = {"now": at / 1e6, "ts": (at if r["fix_us"] is None else r["fix_us"]) / 1e6} | {c: r[c] for c in ("lat", "lng", "accuracy", "speed_mps")}
            if gate([fix], self.captured)[0][0]:
                self.opened, self.attempt, self.begins, self.scores = (at, r["lat"], r["lng"]), 0, at, []
        elif r["kind"] == "frame" and self.opened and at >= self.begins:
            self.scores.append(r["score"])
            out += self._next(at, at + SPACING_US)
        elif r["kind"] == "verdict":
            self.checked += 1
            repeated = None
            if r["decision"] == "accept" and r["event_key"] is not None:
                known = sightings.get(r["event_key"])
                repeated = known is not None and at - known[0] <= KEEP_US
                self.found += not repeated
                self.already += repeated and not known[1]
                sightings.put(r["event_key"], (at, repeated))
            out.append({"at_us": at, "kind": "verdict", "seq": r["seq"], "decision": r["decision"], "repeated": repeated, **self.counts()})
        elif r["kind"] == "stop":
            out += self.close(at)
            out.append({"at_us": at, "kind": "stop", "seq": self.seq, **self.counts()})
        return out

    def counts(self) -> dict:
        return {"checked": self.checked, "found": self.found, "already": self.already}


class _Seen(dict):
    """Sightings of a drive whose rows are all here."""

    put = dict.__setitem__


def _order(r: dict) -> tuple:
    """Rows of one time: fixes, frames, verdicts, stops; then by all that they have, so that arrival does not matter."""
    return r["at_us"], KINDS.index(r["kind"]), json.dumps([r[c] for c in sorted(r)])


def _records(frame: pd.DataFrame) -> list[dict]:
    rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
    whole = ("at_us", "fix_us", "seq")
    return [r | {c: int(r[c]) for c in whole if r[c] is not None} for r in rows]


def _log(drive_id: str, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[({"drive_id": drive_id} | r).get(c) for c in NAMES] for r in rows], columns=NAMES, dtype=object)


def _given(rows: DataFrame) -> DataFrame:
    kinds = F.col("kind").isin(*KINDS) & F.col("drive_id").isNotNull() & F.col("at").isNotNull()
    micros = {"at_us": F.unix_micros("at"), "fix_us": F.unix_micros("fix_at")}
    return rows.where(kinds).select("drive_id", "at", *[F.col(c) for c in FIELDS if c != "fix_at"], *[c.alias(n) for n, c in micros.items()])


def drive_log(rows: DataFrame) -> DataFrame:
    """What drives did, LOG, from all their rows: each burst when it closed, each verdict with the counters, each stop.

    `rows` has drive_id, at (timestamp) and FIELDS. A fix that the capture gate lets through opens a burst; up to three
    frames fill it, 180 ms apart at least, and each is waited for two seconds; while it is open no other fix counts. A burst with
    fewer frames closes with those, one with none counts nothing. An accepted verdict of a key sighted within 30 days is repeated.

    Rows with another kind, without a drive or without a time are left out; of rows at one time fixes come first, then frames, verdicts and stops.
    """

    def fold(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        drive, seen, out = Drive(), _Seen(), []
        for r in sorted(_records(frame.drop(columns=["drive_id"])), key=_order):
            out += drive.take(r, seen)
        return _log(key[0], out + drive.wait(1 << 62))

    return _given(rows).drop("at").groupBy("drive_id").applyInPandas(fold, LOG)


class DriveProcessor(StatefulProcessor):
    """`drive_log` on a stream. Rows wait in the state until the watermark has passed them and are then taken in order, so
    the log is that of all rows, however they arrive within the watermark's delay. Timers of event time close bursts whose
    frames never come and drop sightings after 30 days (Spark's own time to live counts the clock on the wall, so a replay would keep other sightings)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.drive = handle.getValueState("drive", "state string")
        self.sightings = handle.getMapState("sightings", "event_key string", "last_us long, repeated boolean")

    def get(self, key: str) -> tuple[int, bool] | None:
        return tuple(self.sightings.getValue((key,))) if self.sightings.containsKey((key,)) else None

    def put(self, key: str, seen: tuple[int, bool]) -> None:
        self.sightings.updateValue((key,), seen)
        self.handle.registerTimer((seen[0] + KEEP_US) // 1000 + 1)

    def _advance(self, key: tuple[Any, ...], new: list[dict], watermark_ms: int) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROW.split(", ")]
        rows = [dict(zip(names, r)) for r in self.waiting.get()] + new
        known = self.drive.get()
        drive = Drive(**json.loads(known[0])) if known else Drive()
        now, out = watermark_ms * 1000, []
        for r in sorted((r for r in rows if r["at_us"] <= now), key=_order):
            out += drive.take(r, self)
        out += drive.wait(now + 1)
        rest = [r for r in rows if r["at_us"] > now]
        self.waiting.clear()
        if rest:
            self.waiting.put([tuple(r[c] for c in names) for r in rest])
        self.drive.update((json.dumps(asdict(drive)),))
        for at in {min((r["at_us"] for r in rest), default=None), drive.deadline()} - {None}:
            self.handle.registerTimer(max(at, now) // 1000 + 1)
        if out:
            yield _log(key[0], out)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [c.split()[0] for c in ROW.split(", ")]
        new = [r for frame in rows for r in _records(frame[names])]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        old = [k for k, v in self.sightings.iterator() if v[0] + KEEP_US < now * 1000]
        # Rows that wait may still repeat a sighting of before; they are taken first.
        yield from self._advance(key, [], now)
        for k in old:
            if self.sightings.containsKey(k) and self.sightings.getValue(k)[0] + KEEP_US < now * 1000:
                self.sightings.removeKey(k)

    def close(self) -> None:
        pass


def stream_drive_log(rows: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """`drive_log` over a stream of rows that come at most `delay` late; later ones are dropped. The stream needs the RocksDB
    state store. What closes with a time-out is told when other rows move the watermark past it."""
    given = _given(rows.withWatermark("at", delay))
    return given.groupBy("drive_id").transformWithStateInPandas(DriveProcessor(), LOG, "append", "eventTime")
