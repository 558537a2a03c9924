"""Clips on a stream of triggers: starts and stops as they come, ends by timers.

Each intersection has a state: triggers that wait until the watermark has passed them,
and the clips that run, no more than the cap.  They are the decisions of
``clips.admission`` and ``clips.takeover`` on a table with the same triggers.
"""

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phasegrid.operators.clips import MAX_DURATION_SEC

CLIPS = "intersection_id string, trigger_id string, start_us bigint, camera_id string, end_us bigint, ended_by string, feed_end_us bigint, drop_reason string, trigger string"
START, STOP = "start", "stop"


@dataclass
class Recorder:
    """The clips of an intersection that run: id -> [start, latest end, camera, end of its feed, trigger]."""

    cap: int | None
    running: dict[str, list] = field(default_factory=dict)

    def ended(self, ident: str, at: int, why: str) -> tuple:
        """The row of a clip that ends, and no longer runs."""
        start, _, camera, feed_end, text = self.running.pop(ident)
        return ident, start, camera, at, why, at if feed_end is None else min(at, feed_end), None, text

    def expired(self, before: int) -> list[tuple]:
        """Ends the clips whose time is up before an instant, the earliest first."""
        due = sorted((clip[1], ident) for ident, clip in self.running.items() if clip[1] < before)
        return [self.ended(ident, at, "max_duration") for at, ident in due]

    def instant(self, us: int, stops: set[str], starts: list[tuple[str, int, str | None, str]]) -> list[tuple]:
        """Rows that an instant's triggers give: stops first, then starts (id, latest end, camera, trigger) by id.

        A start whose id stops at the same instant makes a clip without length.
        """
        out = self.expired(us)
        out += [self.ended(ident, us, "stop") for ident in sorted(stops & set(self.running))]
        out += self.expired(us + 1)
        for ident, limit, camera, text in starts:
            reason = "duplicate" if ident in self.running else "camera" if camera is None else "cap" if self.cap is not None and len(self.running) >= self.cap else None
            if reason:
                out.append((ident, us, camera, None, None, None, reason, text))
                continue
            for clip in self.running.values():  # frames of a camera go to its newest clip
                if clip[2] == camera and clip[3] is None:
                    clip[3] = us
            self.running[ident] = [us, limit, camera, None, text]
            if limit <= us or ident in stops:
                out.append(self.ended(ident, min(limit, us), "stop" if ident in stops and limit >= us else "max_duration"))
        return out


def stream_clips(triggers: DataFrame, cap: int | None = 2, delay: str = "10 seconds", clock: DataFrame | None = None) -> DataFrame:
    """Clips of a stream of triggers: intersection_id, trigger_id, action, us, max_duration_sec, camera_id, and whatever else a start carries.

    A dropped start is a row with its drop_reason once the watermark has passed it; a
    recorded one is a row when its clip ends, by a stop or when its time is up, with the
    end of its feed (see ``takeover``).  ``trigger`` is the start as JSON.  Repeats of an
    id's start at one instant count once; triggers later than ``delay`` are dropped by
    Spark, which counts them in the query's progress.  Rows with other actions than
    start, stop and extend only tell the time, as do those of ``clock``, a stream
    (intersection_id, us).
    """
    limit = F.col("us") + (F.coalesce("max_duration_sec", F.lit(MAX_DURATION_SEC)) * 1_000_000).cast("bigint")
    action = F.when(F.col("action") == "start", START).when(F.col("action").isin("stop", "extend"), STOP)
    rows = triggers.select("intersection_id", "trigger_id", action.alias("what"), "us", limit.alias("limit_us"), "camera_id", F.to_json(F.struct(*triggers.columns)).alias("trigger"))
    if clock is not None:
        rows = rows.unionByName(clock.select("intersection_id", "us"), allowMissingColumns=True)
    rows = rows.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)
    columns = [c.split()[0] for c in CLIPS.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        recorder, waiting, out = Recorder(cap), [], []
        if held.exists:
            running, saved = map(json.loads, held.get)
            recorder, waiting = Recorder(cap, running), saved
        if not held.hasTimedOut:
            for b in batches:
                for us, what, ident, limit_us, camera, text in zip(b["us"], b["what"], b["trigger_id"], b["limit_us"], b["camera_id"], b["trigger"], strict=True):
                    if what not in (START, STOP):
                        continue
                    waiting.append([int(us), what, ident, int(limit_us), camera if isinstance(camera, str) else None, text])
        upto = held.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r[0], r[1], r[2], r[3], r[4] or "", r[5]))
        ready = [r for r in waiting if r[0] < upto]
        waiting = waiting[len(ready) :]
        for us, group in groupby(ready, key=lambda r: r[0]):
            stops, starts = set(), {}
            for _, what, ident, limit_us, camera, text in group:
                if what == STOP:
                    stops.add(ident)
                else:
                    starts.setdefault(ident, (ident, limit_us, camera, text))
            out += recorder.instant(us, stops, list(starts.values()))
        out += recorder.expired(upto)
        deadlines = [clip[1] for clip in recorder.running.values()] + [r[0] for r in waiting[:1]]
        if deadlines:
            held.update((json.dumps(recorder.running), json.dumps(waiting)))
            held.setTimeoutTimestamp(max(upto // 1000 + 1, min(deadlines) // 1000 + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame([(*key, *r) for r in out], columns=columns).astype({c: "Int64" for c in ("start_us", "end_us", "feed_end_us")})

    return rows.groupBy("intersection_id").applyInPandasWithState(step, CLIPS, "running string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
