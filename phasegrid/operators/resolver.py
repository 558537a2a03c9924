"""The pair evaluator: an event-time state machine for each pair.

Sequential suppression (cooldown, one active disagreement at a time) can't be said
with windows, so edges, which are few, go through a small machine in time order.
Rows of a pair arrive sorted and one by one; memory holds one machine, whatever
the number of a pair's edges.
"""

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.operators.pairs import PAIR, of_pairs

TRIGGERS = "intersection_id string, pair_key string, trigger_id string, action string, rule int, side string, fire_us bigint, disagreement_sec double, max_duration_sec double, pulse_us bigint"
#: The side of rows that stand for a new configuration.
RELOAD = "reload"
#: Later than any instant.
NEVER = (1 << 62) - 1


@dataclass
class Params:
    """Spans of the machine, in microseconds."""

    post_roll_us: int = 20_000_000
    cooldown_us: int = 60_000_000
    pre_roll_us: int = 10_000_000
    max_duration_us: int = 300_000_000


@dataclass
class PairMachine:
    """One pair's state.  Edges of an instant apply before the deadlines of that instant."""

    threshold: int
    params: Params
    on: dict = field(default_factory=lambda: {"a": False, "b": False})
    since: dict = field(default_factory=lambda: {"a": None, "b": None})
    spans: dict = field(default_factory=lambda: {"a": [], "b": []})
    pending: list = field(default_factory=list)  # (verdict instant, side, on, off)
    differ_from: int | None = None
    active: str | None = None
    agree_from: int | None = None
    cooling_to: int | None = None
    now: int | None = None

    def feed(self, us: int, group: list[tuple[str, bool | int]], ident: str) -> list[tuple]:
        """Applies the edges of one instant, and new configurations, which come with their threshold; returns the triggers of deadlines before it."""
        out = self.advance(us - 1, ident)
        for side, threshold in group:
            if side == RELOAD:
                self.reload(threshold)
        for side, is_on in group:
            if side == RELOAD:
                continue
            if is_on and not self.on[side]:
                self.since[side] = us
            elif not is_on and self.on[side]:
                began, other = self.since[side], "b" if side == "a" else "a"
                self.spans[side].append((began, us))
                if 0 < us - began < self.threshold:
                    self.pending.append((us + self.threshold, side, began, us))
                if not self.on[other]:
                    self.cooling_to = None
            self.on[side] = is_on
        self.now = us
        self.settle(us)
        for side in "ab":  # what no verdict can ask for any more
            self.spans[side] = [s for s in self.spans[side] if s[1] > us - 3 * self.threshold - 1]
        return out

    def reload(self, threshold: int | None = None) -> None:
        """A new configuration: states and cooldown stay; timers, pending verdicts and an active disagreement go."""
        self.threshold = threshold or self.threshold
        self.pending.clear()
        self.differ_from = self.active = self.agree_from = None

    def settle(self, us: int) -> None:
        """Starts and stops the timers that the sides' states ask for."""
        differ = self.on["a"] != self.on["b"]
        if self.active:
            self.agree_from = None if differ else us if self.agree_from is None else self.agree_from
        elif self.cooling_to is None:
            self.differ_from = (us if self.differ_from is None else self.differ_from) if differ else None

    def advance(self, to: int, ident: str) -> list[tuple]:
        """Runs all deadlines up to ``to``, the earliest first."""
        out = []
        while True:
            due = [
                (self.cooling_to if self.cooling_to is not None else NEVER, 0),
                (self.differ_from + self.threshold if self.differ_from is not None and not self.active and self.cooling_to is None else NEVER, 1),
                (self.agree_from + self.params.post_roll_us if self.active and self.agree_from is not None else NEVER, 2),
                (min((p[0] for p in self.pending), default=NEVER), 3),
            ]
            at, what = min(due)
            if at > to:
                return out
            if what == 0:
                self.cooling_to = None
                self.differ_from = at if self.on["a"] != self.on["b"] else None
            elif what == 1:
                self.active, self.agree_from = self.name(ident, at, 1), None
                out.append((self.active, "start", 1, "a" if self.on["a"] else "b", at, self.threshold / 1e6, self.params.max_duration_us / 1e6, None))
                self.differ_from = None
            elif what == 2:
                out.append((self.active, "stop", 1, None, at, 0.0, self.params.max_duration_us / 1e6, None))
                self.active = self.agree_from = self.differ_from = None
                self.cooling_to = at + self.params.cooldown_us
            else:
                verdict = min(self.pending)
                self.pending.remove(verdict)
                if not self.active and self.cooling_to is None and self.orphan(*verdict):
                    _, side, began, ended = verdict
                    length = self.params.pre_roll_us + (ended - began) + self.params.post_roll_us + self.threshold
                    out.append((self.name(ident, at, 2), "start", 2, side, at, round((ended - began) / 1e6, 3), round(length / 1e6, 3), began))
                    self.differ_from = None
                    self.cooling_to = at + self.params.cooldown_us

    def orphan(self, at: int, side: str, began: int, ended: int) -> bool:
        """Whether the partner was off throughout the window."""
        other = "b" if side == "a" else "a"
        spans = self.spans[other] + ([(self.since[other], NEVER)] if self.on[other] else [])
        return not any(s <= ended + self.threshold and e > began - self.threshold for s, e in spans)

    @staticmethod
    def name(ident: str, at: int, rule: int) -> str:
        """A trigger id that a replay gives again."""
        return hashlib.sha256(f"{ident}|{at}|{rule}".encode()).hexdigest()

    def dump(self) -> str:
        """The state as text."""
        return json.dumps({k: v for k, v in self.__dict__.items() if k != "params"})

    @classmethod
    def load(cls, text: str, params: Params) -> "PairMachine":
        state = json.loads(text)
        state["pending"] = [tuple(p) for p in state["pending"]]
        state["spans"] = {k: [tuple(s) for s in v] for k, v in state["spans"].items()}
        return cls(params=params, **state)


def reload_rows(reloads: DataFrame, pairs: DataFrame) -> DataFrame:
    """New configurations as rows beside edges, one for each pair: side RELOAD, before the edges of their instant.

    ``reloads``: (intersection_id, us), after which thresholds are those of ``pairs``; or
    (intersection_id, pair_key, us, threshold_us), a row for each pair with its new one.
    """
    cuts = reloads if "pair_key" in reloads.columns else reloads.select("intersection_id", "us").join(pairs.select(*PAIR, "threshold_us"), "intersection_id")
    return cuts.select(*PAIR, F.lit(RELOAD).alias("side"), "us", F.lit(-1).cast("bigint").alias("seq"), F.lit(False).alias("is_on"), "threshold_us")


def resolve_pairs(edge: DataFrame, pairs: DataFrame, params: Params, horizon_us: int | None = None, reloads: DataFrame | None = None) -> DataFrame:
    """The triggers of all pairs: starts and stops, in the columns of TRIGGERS; pulse_us is when an orphan began.

    Deadlines after ``horizon_us`` don't fire; without one it is the last edge of the
    pair.  ``reloads``: new configurations (see ``reload_rows``), which cut the state of
    each of their pairs (see ``PairMachine.reload``).
    """
    rows = of_pairs(edge, pairs).select(*PAIR, "side", "us", "seq", "is_on", "threshold_us")
    if reloads is not None:
        rows = rows.unionByName(reload_rows(reloads, pairs))
    rows = rows.repartition(*PAIR).sortWithinPartitions(*PAIR, "us", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine, at, group, found = None, None, None, [], []

        def flush() -> None:
            if machine is not None and group:
                found.extend((*key, *t) for t in machine.feed(at, group, "|".join(key)))
                group.clear()

        def close() -> None:
            if machine is not None:
                flush()
                found.extend((*key, *t) for t in machine.advance(horizon_us if horizon_us is not None else at, "|".join(key)))

        columns = [c.split()[0] for c in TRIGGERS.split(", ")]
        for batch in batches:
            for i, p, side, us, is_on, threshold in zip(batch["intersection_id"], batch["pair_key"], batch["side"], batch["us"], batch["is_on"], batch["threshold_us"], strict=True):
                if (i, p) != key:
                    close()
                    key, machine, at = (i, p), PairMachine(int(threshold), params), None
                if us != at:
                    flush()
                    at = us
                group.append((side, int(threshold) if side == RELOAD else bool(is_on)))
            yield pd.DataFrame(found, columns=columns)
            found.clear()
        close()
        yield pd.DataFrame(found, columns=columns)

    return rows.mapInPandas(run, TRIGGERS)


def thin(df: DataFrame, key: tuple[str, ...], us: str, gap_us: int) -> DataFrame:
    """Rows that stay when each kept row silences its key for ``gap_us``: the cooldown alone."""
    rows = df.repartition(*key).sortWithinPartitions(*key, us)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, free = None, 0
        for batch in batches:
            keep = []
            for k, t in zip(batch[list(key)].itertuples(index=False, name=None), batch[us], strict=True):
                stays = k != last or t >= free
                if stays:
                    last, free = k, t + gap_us
                keep.append(stays)
            yield batch[keep]

    return rows.mapInPandas(run, df.schema)


def horizon_of(edge: DataFrame) -> int | None:
    """The last instant of the input."""
    return edge.agg(F.max("us")).first()[0]
