"""The stateful operators on streams: change detection, the pair evaluator, daily routines."""

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phasegrid.operators.changes import MASK, changed_bits
from phasegrid.operators.pairs import PAIR, of_pairs
from phasegrid.operators.resolver import RELOAD, TRIGGERS, PairMachine, Params, reload_rows
from phasegrid.operators.schedule import FIRINGS, Marks, with_reloads

#: The side of rows that only tell the time.
TICK = "tick"
CHANGES = "intersection_id string, kind string, num int, us bigint, seq bigint, old_state string, new_state string, initial boolean"


def stream_changes(states: DataFrame, late: bool = False) -> DataFrame:
    """Changes of each (intersection, kind, num) of a stream of states.

    A key's state is its last (us, seq, state).  Rows of a micro-batch are put in
    order; rows no newer than the last one are late and change nothing.  With ``late``
    they are in the output too, their state in new_state, and a column ``late`` tells
    them apart; the query's progress counts them as ``changes.late_rows`` either way.
    """
    columns = [c.split()[0] for c in CHANGES.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get if held.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "seq"])
        out = []
        for us, seq, state in zip(rows["us"], rows["seq"], rows["state"], strict=True):
            if last is not None and (us, seq) <= (last[0], last[1]):
                out.append((*key, us, seq, None, state, False, True))
                continue
            if last is None or state != last[2]:
                out.append((*key, us, seq, last[2] if last is not None else None, state, last is None, False))
            last = (int(us), int(seq), state)
        if last is not None:
            held.update(last)
        yield pd.DataFrame(out, columns=[*columns, "late"])

    found = states.groupBy("intersection_id", "kind", "num").applyInPandasWithState(step, f"{CHANGES}, late boolean", "us bigint, seq bigint, state string", "append", GroupStateTimeout.NoTimeout)
    counted = found.observe("changes", F.count_if("late").alias("late_rows"))
    return counted if late else counted.filter(~F.col("late")).drop("late")


def stream_mask_changes(masks: DataFrame) -> DataFrame:
    """The changes of ``changes.mask_changes``, of a stream of masks such as ``stream_masks`` gives: polls in order.

    A mask's state is its last (us, seq) and what was set.
    """
    names = ["us", "seq", "one", "two", "three"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get if held.exists else None
        out = []
        for width, *now in sorted(pd.concat(list(batches))[["width", *names]].itertuples(index=False, name=None), key=lambda r: r[1:3]):
            now = tuple(map(int, now))
            if last is None or (now[:2] > tuple(last[:2]) and now[2:] != tuple(last[2:])):
                out.append((*key, int(width), *now, *(last[2:] if last is not None else (None, None, None))))
            if last is None or now[:2] > tuple(last[:2]):
                last = now
        held.update(last)
        yield pd.DataFrame(out, columns=["intersection_id", "kind", "base_num", "width", *names, "was_one", "was_two", "was_three"]).astype({c: "Int32" for c in ("was_one", "was_two", "was_three")})

    schema = "intersection_id string, kind string, base_num int, width int, us bigint, seq bigint, one int, two int, three int, was_one int, was_two int, was_three int"
    found = masks.groupBy(*MASK).applyInPandasWithState(step, schema, "us bigint, seq bigint, one int, two int, three int", "append", GroupStateTimeout.NoTimeout)
    then = F.struct(*[F.col(f"was_{c}").alias(c) for c in ("one", "two", "three")])
    return changed_bits(found.withColumn("now", F.struct("one", "two", "three")).withColumn("then", F.when(F.col("was_one").isNotNull(), then)))


def stream_pairs(edge: DataFrame, pairs: DataFrame, params: Params, delay: str = "10 seconds", reloads: DataFrame | None = None, clock: DataFrame | None = None) -> DataFrame:
    """Triggers of all pairs from a stream of edges (intersection_id, detector_id, us, seq, is_on).

    Edges wait in the state until the watermark has passed them, then go through the
    machine in order; deadlines fire as event time reaches them, by an event-time
    timer where no edge comes.  Edges later than ``delay`` are dropped by Spark.

    ``reloads``: a second stream, of new configurations (see ``resolver.reload_rows``).
    They go to the pairs' states and wait there like edges, so each takes effect at its
    instant, without a restart, as in a table.  Both streams share one watermark: the
    slow one doesn't hold the other up.

    ``clock``: a stream (intersection_id, us) that moves time on while no edge comes.
    """
    rows = of_pairs(edge, pairs).select(*PAIR, "side", "us", "seq", "is_on", "threshold_us")
    if reloads is not None:
        rows = rows.unionByName(reload_rows(reloads, pairs))
    if clock is not None:
        rows = rows.unionByName(clock.select("intersection_id", F.lit("").alias("pair_key"), F.lit(TICK).alias("side"), "us", F.lit(-2).cast("bigint").alias("seq"), F.lit(False).alias("is_on"), F.lit(0).cast("bigint").alias("threshold_us")))
    rows = rows.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)
    columns = [c.split()[0] for c in TRIGGERS.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        ident = "|".join(key)
        waiting, machine = [], None
        if held.exists:
            text, saved = held.get
            waiting, machine = [tuple(e) for e in json.loads(saved)], PairMachine.load(text, params)
        if not held.hasTimedOut:
            for b in batches:
                for us, seq, side, is_on, threshold in zip(b["us"], b["seq"], b["side"], b["is_on"], b["threshold_us"], strict=True):
                    if side == TICK:
                        continue
                    machine = machine or PairMachine(int(threshold), params)
                    waiting.append((int(us), int(seq), side, int(threshold) if side == RELOAD else bool(is_on)))
        upto = held.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready, out = [e for e in waiting if e[0] < upto], []
        waiting = waiting[len(ready) :]
        for us, group in groupby(ready, key=lambda e: e[0]):
            out += machine.feed(us, [(side, on) for _, _, side, on in group], ident)
        if machine is not None:
            out += machine.advance(upto - 1, ident)
            held.update((machine.dump(), json.dumps(waiting)))
            held.setTimeoutTimestamp(max(upto // 1000 + 1000, (waiting[0][0] // 1000 + 1) if waiting else 0))
        yield pd.DataFrame([(*key, *t) for t in out], columns=columns)

    return rows.groupBy(*PAIR).applyInPandasWithState(step, TRIGGERS, "machine string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_firings(due: DataFrame, reloads: DataFrame | None = None, delay: str = "1 hour") -> DataFrame:
    """The firings of ``schedule.firings`` from a stream of due routines and, if given, one of new schedules.

    Both wait in their intersection's state until the watermark has passed them.  Marks
    of dates that are over in every zone are let go.
    """
    rows = with_reloads(due, reloads).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)
    columns = [c.split()[0] for c in FIRINGS.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        marks, waiting, out = Marks(), [], []
        if held.exists:
            fired, labels, saved = map(json.loads, held.get)
            marks, waiting = Marks(fired, labels), saved
        if not held.hasTimedOut:
            for b in batches:
                for us, turn, label, date, labels in zip(b["us"], b["turn"], b["label"], b["local_date"], b["labels"], strict=True):
                    waiting.append([int(us), int(turn), label or "", date or "", list(labels) if turn == 0 else []])
        upto = held.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [r for r in waiting if r[0] < upto]
        waiting = waiting[len(ready) :]
        for us, turn, label, date, labels in ready:
            if turn == 0:
                marks.reload(labels)
            elif marks.due(label, date):
                out.append((*key, label, date, us))
        marks.expire(str(pd.Timestamp(max(upto, 0), unit="us").date() - pd.Timedelta(days=2)))
        held.update((json.dumps(marks.fired), json.dumps(marks.labels), json.dumps(waiting)))
        if waiting:
            held.setTimeoutTimestamp(max(upto // 1000 + 1, waiting[0][0] // 1000 + 1))
        yield pd.DataFrame(out, columns=columns)

    return rows.groupBy("intersection_id").applyInPandasWithState(step, FIRINGS, "fired string, labels string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_once_a_day(due: DataFrame, delay: str = "1 day") -> DataFrame:
    """Firings (intersection_id, label, local_date, fire_us) of a stream, one for each label and date."""
    return due.withColumn("ts", F.timestamp_micros("fire_us")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["intersection_id", "label", "local_date"])


def stream_current_state(states: DataFrame) -> DataFrame:
    """The last state of each key; for the update output mode."""
    return states.groupBy("intersection_id", "kind", "num").agg(F.max_by("state", F.struct("us", "seq")).alias("state"), F.max("us").alias("us"))
