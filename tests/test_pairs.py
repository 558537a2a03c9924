"""The pair evaluator on golden traces, against a tick replay, on a stream; and the candidate operators."""

import os
import random

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import pairs, resolver, rules
from phasegrid.streaming.stateful import stream_pairs

S = 1_000_000
PARAMS = resolver.Params()


def chatter():
    edges = [("A", 1, 0), ("A", 0, 30), ("B", 1, 0)]
    for k in range(12):
        if 2.5 * k + 2 < 30:
            edges.append(("B", 0, 2.5 * k + 2))
            edges.append(("B", 1, 2.5 * k + 2.5)) if 2.5 * k + 2.5 < 30 else None
    return edges


#: name: (edges as (side, on, second), expected (action, rule, second) triggers)
GOLDEN = {
    "missed_call": ([("A", 1, 10), ("A", 0, 30)], [("start", 1, 12), ("stop", 1, 50)]),
    "exactly_threshold": ([("A", 1, 10), ("B", 1, 12), ("A", 0, 20), ("B", 0, 20)], []),
    "re_divergence": ([("A", 1, 10), ("A", 0, 30), ("A", 1, 40), ("A", 0, 45)], [("start", 1, 12), ("stop", 1, 65)]),
    "orphan": ([("A", 1, 10), ("A", 0, 11)], [("start", 2, 13)]),
    "partner_overlaps": ([("A", 1, 10), ("A", 0, 11), ("B", 1, 12.5), ("B", 0, 13)], []),
    "edge_at_window_end": ([("A", 1, 10), ("A", 0, 11), ("B", 1, 13), ("B", 0, 14.9)], [("start", 2, 16.9)]),
    "chatter": (chatter(), []),
    "early_reset": ([("A", 1, 10), ("A", 0, 11), ("A", 1, 40), ("A", 0, 41)], [("start", 2, 13), ("start", 2, 43)]),
    "cooldown_holds": ([("A", 1, 10), ("A", 0, 11), ("A", 1, 20), ("B", 1, 20.5), ("A", 0, 70), ("B", 0, 90)], [("start", 2, 13), ("start", 1, 75), ("stop", 1, 110)]),
    "no_rule2_while_active": ([("A", 1, 10), ("B", 1, 40), ("A", 0, 41), ("B", 0, 41.5)], [("start", 1, 12), ("stop", 1, 61.5)]),
    "open_at_horizon": ([("A", 1, 199)], []),
    "divergence": ([("B", 1, 0), ("A", 1, 0), ("A", 0, 8), ("A", 1, 9), ("A", 0, 9.5), ("B", 0, 10)], []),
    "chatter_end": ([("B", 1, 0), ("A", 1, 0), ("A", 0, 10), ("A", 1, 10.4), ("A", 0, 12), ("A", 1, 12.5), ("A", 0, 14), ("B", 0, 14.2)], []),
}


def inputs(spark, traces):
    rows = [(name, "1" if side == "A" else "2", round(t * S), k, bool(on)) for name, edges in traces.items() for k, (side, on, t) in enumerate(sorted(edges, key=lambda e: e[2]))]
    edge = spark.createDataFrame(rows, "intersection_id string, detector_id string, us bigint, seq bigint, is_on boolean")
    dets = [(name, d, int(d), "radar", 1, o, "C", 2.0) for name in traces for d, o in (("1", "2"), ("2", "1"))]
    found = spark.createDataFrame(dets, "intersection_id string, detector_id string, ordinal int, type string, phase int, paired_detector_id string, camera_id string, lag_threshold_sec double")
    return edge, pairs.detector_pairs(found)


def fired(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["fire_us"]):
        out.setdefault(r["intersection_id"], []).append((r["action"], r["rule"], r["fire_us"] / S))
    return out


def test_golden_traces(spark):
    edge, pair = inputs(spark, {n: e for n, (e, _) in GOLDEN.items()})
    rows = resolver.resolve_pairs(edge, pair, PARAMS, 200 * S).collect()
    assert fired(rows) == {n: want for n, (_, want) in GOLDEN.items() if want}
    lengths = {(r["intersection_id"], r["fire_us"]): r["max_duration_sec"] for r in rows if r["rule"] == 2}
    assert lengths["orphan", 13 * S] == 33.0 and lengths["edge_at_window_end", round(16.9 * S)] == 33.9


def test_swapped_sides_give_the_same(spark):
    swapped = {n: [("B" if s == "A" else "A", on, t) for s, on, t in e] for n, (e, _) in GOLDEN.items()}
    edge, pair = inputs(spark, swapped)
    assert fired(resolver.resolve_pairs(edge, pair, PARAMS, 200 * S).collect()) == {n: want for n, (_, want) in GOLDEN.items() if want}


def replay(edges, horizon, tick=0.1):
    """The written contract looked at every tenth of a second: times on even tenths, spans in whole numbers of ticks."""
    thr, post, cool = 20, 200, 600
    at = {}
    for s, on, t in edges:
        at.setdefault(round(t * 10), []).append((s, bool(on)))
    on, since, spans, pend, out = {"A": False, "B": False}, {}, {"A": [], "B": []}, [], []
    differ = active = agree = None
    cooling = None
    for now in range(int(horizon * 10) + 1):
        for s, x in at.get(now, []):
            o = "B" if s == "A" else "A"
            if x and not on[s]:
                since[s] = now
            if not x and on[s]:
                spans[s].append((since[s], now))
                if 0 < now - since[s] < thr:
                    pend.append((now + thr, s, since[s], now))
                if not on[o]:
                    cooling = None
            on[s] = x
        apart = on["A"] != on["B"]
        if cooling is not None and now >= cooling:
            cooling, differ = None, now if apart else None
        if active:
            agree = None if apart else now if agree is None else agree
        elif cooling is None:
            differ = (now if differ is None else differ) if apart else None
        if not active and cooling is None and differ is not None and now >= differ + thr:
            out.append(("start", 1, now / 10))
            active, agree, differ = True, None, None
        elif active and agree is not None and now >= agree + post:
            out.append(("stop", 1, now / 10))
            active = agree = differ = None
            cooling = now + cool
        for p in sorted(p for p in pend if p[0] == now):
            _, s, a, b = p
            o = "B" if s == "A" else "A"
            theirs = spans[o] + ([(since[o], 10**9)] if on[o] else [])
            if not active and cooling is None and not any(x <= b + thr and y > a - thr for x, y in theirs):
                out.append(("start", 2, now / 10))
                differ, cooling = None, now + cool
    return out


def test_random_traces_against_a_replay(spark):
    rnd, traces = random.Random(8), {}
    for n in range(40):
        edges = []
        for side in "AB":
            t, on = rnd.randint(0, 60) / 10, True
            while t < 400:
                edges.append((side, int(on), t))
                t = round(t + rnd.choice((0.4, 0.8, 1.4, 2.6, 5.2, 30.2, 70.4)) + rnd.randint(0, 3) / 5, 1)
                on = not on
        traces[f"T{n}"] = edges
    edge, pair = inputs(spark, traces)
    got = fired(resolver.resolve_pairs(edge, pair, PARAMS, 500 * S).collect())
    for name, edges in traces.items():
        assert got.get(name, []) == replay(edges, 500), name


def test_stream_equals_batch(spark, tmp_path):
    late = 1000  # all times later by this: a stream's watermark starts at the epoch
    traces = {n: [(s, on, t + late) for s, on, t in e] for n, (e, _) in GOLDEN.items()} | {"clock": [("A", 1, late + 900), ("A", 0, late + 1900), ("A", 1, late + 2900)]}
    edge, pair = inputs(spark, traces)
    for k, (lo, hi) in enumerate(((0, 20), (20, 100), (100, 1000), (1000, 2000), (2000, 9000))):
        folder = tmp_path / "in" / f"part={k}"
        edge.filter((F.col("us") >= (late + lo) * S) & (F.col("us") < (late + hi) * S)).coalesce(1).write.parquet(str(folder))
        for f in folder.glob("*.parquet"):  # the source takes older files first
            os.utime(f, (1_600_000_000 + k, 1_600_000_000 + k))
    source = spark.readStream.schema(edge.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_pairs(source, pair, PARAMS).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    early = [r for r in spark.table("fired").collect() if r["fire_us"] < (late + 500) * S]
    shifted = {n: [(a, r, t + late) for a, r, t in want] for n, (_, want) in GOLDEN.items() if want}
    assert fired(early) == shifted | {"open_at_horizon": [("start", 1, 201.0 + late)]}


def test_orphans_and_compat(spark):
    edge, pair = inputs(spark, {n: e for n, (e, _) in GOLDEN.items()})
    found = rules.rule2_candidates(pairs.pulses(edge), pair)
    contract = {(r["intersection_id"], r["side"], r["fire_us"] / S) for r in rules.orphan_pulses(found, pairs.on_intervals(edge), pair).collect()}
    compat = {(r["intersection_id"], r["side"], r["fire_us"] / S) for r in rules.orphan_pulses(found, pairs.on_intervals(edge), pair, compat=True).collect()}
    assert ("orphan", "a", 13.0) in contract and ("partner_overlaps", "b", 15.0) not in contract
    assert ("divergence", "a", 11.5) in compat - contract and ("chatter_end", "a", 16.0) in compat - contract and ("partner_overlaps", "b", 15.0) in compat


def test_pairs_cameras_and_dangling(spark):
    rows = [("I", "10", 1, "radar", 1, "9", "C1", 5.0), ("I", "9", 2, None, None, "10", "", None), ("I", "7", 3, "loop", 2, "99", None, None), ("J", "1", 1, "loop", 2, "2", None, None), ("J", "2", 2, "loop", 2, "1", None, None)]
    dets = spark.createDataFrame(rows, "intersection_id string, detector_id string, ordinal int, type string, phase int, paired_detector_id string, camera_id string, lag_threshold_sec double")
    got = {r["intersection_id"]: r for r in pairs.detector_pairs(dets).collect()}
    assert (got["I"]["pair_key"], got["I"]["det_a"], got["I"]["det_b_type"], got["I"]["cameras"], got["I"]["threshold_us"]) == ("10:9", "10", "unknown", ["C1"], 5 * S)
    assert got["J"]["cameras"] == ["all"] and got["J"]["threshold_us"] == 2 * S
    assert [r["detector_id"] for r in pairs.dangling_partners(dets).collect()] == ["7"]


@pytest.mark.parametrize("horizon", [None, 100 * S])
def test_state_survives_a_dump(horizon):
    machine = resolver.PairMachine(2 * S, PARAMS)
    machine.feed(10 * S, [("a", True)], "x")
    again = resolver.PairMachine.load(machine.dump(), PARAMS)
    assert again == machine and again.advance(horizon or 50 * S, "x") == machine.advance(horizon or 50 * S, "x")


def test_a_new_configuration_cuts_the_state(spark):
    edge, pair = inputs(spark, {n: GOLDEN[n][0] for n in ("missed_call", "orphan", "cooldown_holds")})
    cuts = spark.createDataFrame([("missed_call", 15 * S), ("orphan", 12 * S), ("cooldown_holds", 30 * S)], "intersection_id string, us bigint")
    got = fired(resolver.resolve_pairs(edge, pair, PARAMS, 200 * S, cuts).collect())
    assert got["missed_call"] == [("start", 1, 12), ("start", 1, 17), ("stop", 1, 50)]  # begun anew, its start is lost
    assert "orphan" not in got  # the verdict was pending
    assert got["cooldown_holds"] == GOLDEN["cooldown_holds"][1]  # the cooldown stays
