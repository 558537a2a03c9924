"""Streams from samples to clips, each against the same operator on a table with the same rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import changes, clips, decode, pairs, resolver, schedule
from phasegrid.sources import oids, samples
from phasegrid.sources.triggers import pair_payloads
from phasegrid.streaming import polls, running, stateful
from phasegrid.streaming.clips import stream_clips
from tests.test_pairs import GOLDEN, PARAMS, fired, inputs

S = 1_000_000
#: Instants of streams are later than this: a watermark starts at the epoch.
BASE = 1_700_000_000 * S


def source(spark, folder, parts):
    """A stream that takes the tables one after the other, a micro-batch each."""
    for k, df in enumerate(parts):
        place = folder / f"part={k}"
        df.coalesce(1).write.parquet(str(place))
        for f in place.glob("*.parquet"):  # older files first
            os.utime(f, (1_600_000_000 + k, 1_600_000_000 + k))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, tmp_path, name):
    """(rows, progress) of a stream that is run to the end of its input."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"state_{name}")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return df.sparkSession.table(name).collect(), query.recentProgress


def cut_by(df, us, bounds):
    """The rows from each bound to before the next."""
    return [df.filter((F.col(us) >= lo) & (F.col(us) < hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def readings(rnd, n):
    """Polls of two intersections: some fail part-way, some lack a colour, some read an identifier twice."""
    rows, seq = [], 0
    for k in range(n):
        for i in ("I", "J"):
            names = [oid for oid in (*oids.lamp_oids(1), *oids.lamp_oids(3), *[f"{oids.PHASE}.{c}.1" for c in (5, 6, 7)], f"{oids.DETECTOR}.1", f"{oids.DETECTOR}.2", f"{oids.OUTPUT}.4", f"{oids.RING}.1") if rnd.random() > 0.05]
            names += [f"{oids.DETECTOR}.2"] * (rnd.random() < 0.1)
            fails = rnd.randrange(len(names)) if rnd.random() < 0.4 else len(names)
            for j, oid in enumerate(names):
                seq += 1
                rows.append((i, BASE + k * S, seq, oid, rnd.choice((0, 1, 2, 5, 255)), "OK" if j != fails and (j < fails or rnd.random() < 0.5) else "ERR"))
    return rows


def test_polls_on_a_stream(spark, tmp_path):
    rows = readings(random.Random(3), 30)
    table = spark.createDataFrame(rows, samples.SAMPLES)
    clock = spark.createDataFrame([("Z", BASE + 900 * S, 10**6, f"{oids.RING}.1", 0, "OK")], samples.SAMPLES)
    late = spark.createDataFrame([("I", BASE + 3 * S, 10**6 + 1, f"{oids.DETECTOR}.1", 77, "OK"), ("J", BASE + 2 * S, 10**6 + 2, f"{oids.OUTPUT}.4", 1, "OK")], samples.SAMPLES)
    shuffled = table.filter(F.col("poll_us") >= BASE + 20 * S).unionByName(late)
    # readings of a poll come in two micro-batches, and polls out of order, but not later than the delay
    early = table.filter(F.col("poll_us") < BASE + 20 * S)
    parts = [early.filter("seq % 2 = 0"), early.filter("seq % 2 = 1"), clock.withColumn("poll_us", F.lit(BASE + 19 * S)), shuffled, clock]
    dim = oids.oid_dim(spark)
    found = polls.stream_polls(source(spark, tmp_path / "in", parts), dim, "12 seconds")
    got, progress = run(polls.stream_masks(found).drop("ts"), tmp_path, "masks")
    want = decode.masks(table, dim)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(*got[0].asDict()).collect()))
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == 2
    kept, _ = run(polls.stream_usable(polls.stream_polls(source(spark, tmp_path / "again", parts), dim, "12 seconds")), tmp_path, "kept")
    batch = decode.usable(decode.resolve(table, dim))
    kept = [r for r in kept if r["intersection_id"] != "Z"]  # the clock's own poll
    assert sorted(map(tuple, kept)) == sorted(map(tuple, batch.select(*kept[0].asDict()).collect()))


def test_mask_changes_on_a_stream(spark, tmp_path):
    dim = oids.oid_dim(spark)
    table = decode.masks(spark.createDataFrame(readings(random.Random(5), 25), samples.SAMPLES), dim).cache()
    got, _ = run(stateful.stream_mask_changes(source(spark, tmp_path / "in", cut_by(table, "us", [BASE, BASE + 7 * S, BASE + 8 * S, BASE + 99 * S]))), tmp_path, "bits")
    assert len(got) > 100
    assert sorted(map(str, got)) == sorted(map(str, changes.mask_changes(table).collect()))


def test_late_states_are_counted(spark, tmp_path):
    schema = "intersection_id string, kind string, num int, us bigint, seq bigint, state string"
    rnd = random.Random(2)
    first = [("I", "phase", n, t * S, t, rnd.choice(("RED", "GREEN"))) for n in (1, 2) for t in range(10, 20)]
    planted = [("I", "phase", 1, 12 * S, 1, "DARK"), ("I", "phase", 1, 19 * S, 19, "DARK"), ("I", "phase", 2, 3 * S, 3, "DARK")]
    second = [("I", "phase", n, t * S, t, rnd.choice(("RED", "GREEN"))) for n in (1, 2) for t in range(20, 25)]
    parts = [spark.createDataFrame(rows, schema) for rows in (first, planted + second)]
    rows, progress = run(stateful.stream_changes(source(spark, tmp_path / "in", parts), late=True), tmp_path, "late")
    assert sorted((r["num"], r["us"], r["new_state"]) for r in rows if r["late"]) == sorted((n, us, s) for _, _, n, us, _, s in planted)
    assert sum(p["observedMetrics"]["changes"]["late_rows"] for p in progress if "changes" in p["observedMetrics"]) == len(planted)
    want = changes.changes(spark.createDataFrame(first + second, schema).withColumn("code", F.lit(0)))
    columns = ("num", "us", "old_state", "new_state", "initial")
    assert sorted(str([r[c] for c in columns]) for r in rows if not r["late"]) == sorted(str([r[c] for c in columns]) for r in want.collect())


TRIGGER = "intersection_id string, trigger_id string, action string, us bigint, max_duration_sec double, camera_id string, reason string"


def random_triggers(rnd, n):
    """Few ids and instants, so that starts repeat, and stops, starts and ends fall together."""
    rows = []
    for _ in range(n):
        i, t = rnd.choice("IJ"), BASE + rnd.randrange(120) * S
        rows.append((i, f"T{rnd.randrange(9)}", rnd.choice(("start", "start", "stop", "extend")), t, rnd.choice((0.0, 1.0, 5.0, 5.0, 20.0)), None, "r"))
    # all of an id's starts at an instant are the same
    return [(*r[:4], float(hash_of(r) % 4 * 5), (None, "C1", "C2")[hash_of(r) % 3], "r") for r in rows]


def hash_of(row):
    return sum(map(ord, f"{row[0]}{row[1]}{row[3]}")) * 7 // 3


@pytest.mark.parametrize("cap", [2, None])
def test_clips_on_a_stream(spark, tmp_path, cap):
    table = spark.createDataFrame(random_triggers(random.Random(11), 400), TRIGGER)
    clock = spark.createDataFrame([("I", "clock", "stop", BASE + 9_000 * S, 0.0, None, "r"), ("J", "clock", "stop", BASE + 9_000 * S, 0.0, None, "r")], TRIGGER)
    bounds = [BASE, BASE + 30 * S, BASE + 31 * S, BASE + 90 * S, BASE + 121 * S]
    rows, _ = run(stream_clips(source(spark, tmp_path / "in", [*cut_by(table, "us", bounds), clock]), cap), tmp_path, f"clips_{cap}")
    batch = clips.admission(clips.with_ends(table), cap).cache()
    taken = clips.takeover(batch.filter("drop_reason IS NULL")).select("intersection_id", "trigger_id", "start_us", "camera_id", "end_us", "ended_by", "feed_end_us")
    columns = taken.columns
    assert sorted(str([r[c] for c in columns]) for r in rows if r["drop_reason"] is None) == sorted(str(list(r)) for r in taken.collect())
    dropped = batch.filter("drop_reason IS NOT NULL").select("intersection_id", "trigger_id", "start_us", "drop_reason").collect()
    assert sorted((r["intersection_id"], r["trigger_id"], r["start_us"], r["drop_reason"]) for r in rows if r["drop_reason"]) == sorted(map(tuple, dropped))
    assert {r["drop_reason"] for r in rows} >= {None, "duplicate", "camera"} and ("cap" in {r["drop_reason"] for r in rows}) == (cap is not None)
    assert all('"reason":"r"' in r["trigger"] for r in rows)


def test_a_clip_ends_by_a_timer(spark, tmp_path):
    """Nothing else comes for the intersection: its state's timer ends the clip."""
    rows = [("I", "T", "start", BASE, 30.0, "C1", "r")]
    clock = [("other", "T", "stop", BASE + t * S, 0.0, None, "r") for t in (20, 400)]
    parts = [spark.createDataFrame(r, TRIGGER) for r in (rows, clock[:1], clock[1:])]
    got, _ = run(stream_clips(source(spark, tmp_path / "in", parts)), tmp_path, "timer")
    assert [(r["trigger_id"], r["end_us"] - BASE, r["ended_by"]) for r in got] == [("T", 30 * S, "max_duration")]


@pytest.mark.parametrize("by_pair", [False, True])
def test_a_reload_on_a_stream(spark, tmp_path, by_pair):
    names = ("missed_call", "orphan", "cooldown_holds", "re_divergence", "no_rule2_while_active")
    late = 1000
    traces = {n: [(s, on, t + late) for s, on, t in GOLDEN[n][0]] for n in names}
    edge, pair = inputs(spark, traces)
    at = {"missed_call": 15, "orphan": 12, "cooldown_holds": 30, "no_rule2_while_active": 11}
    cuts = spark.createDataFrame([(n, (late + t) * S) for n, t in at.items()], "intersection_id string, us bigint")
    if by_pair:
        cuts = cuts.join(pair.select("intersection_id", "pair_key"), "intersection_id").select("intersection_id", "pair_key", "us", F.lit(5 * S).cast("bigint").alias("threshold_us"))
    bounds = [late * S, (late + 12) * S, (late + 40) * S, (late + 300) * S]
    clock = edge.limit(1).withColumn("us", F.lit((late + 2_000) * S).cast("bigint")).withColumn("is_on", F.lit(False))
    edges = source(spark, tmp_path / "edges", [*cut_by(edge, "us", bounds), clock])
    reloads = source(spark, tmp_path / "reloads", cut_by(cuts, "us", bounds[:3]))
    rows, _ = run(stateful.stream_pairs(edges, pair, PARAMS, reloads=reloads), tmp_path, f"reloaded_{by_pair}")
    got = fired([r for r in rows if r["fire_us"] < (late + 500) * S])
    want = fired(resolver.resolve_pairs(edge, pair, PARAMS, (late + 500) * S, cuts).collect())
    assert got == want and want["missed_call"] != [(a, r, t + late) for a, r, t in GOLDEN["missed_call"][1]]
    assert by_pair == (want["missed_call"][1] == ("start", 1, late + 20))


DUE = "intersection_id string, label string, local_date string, fire_us bigint"


def test_a_day_with_a_reload_fires_each_label_once(spark, tmp_path):
    day = 86_400 * S
    due, at = [], BASE - BASE % day
    for d in range(3):
        date = f"2023-11-{14 + d}"
        for label, hour in (("am", 8), ("noon", 12), ("pm", 17)):
            due += [("I", label, date, at + d * day + hour * 3600 * S + tick * 10 * S) for tick in range(4)]  # a scheduler looks several times a minute
    due += [("J", "am", "2023-11-14", at + 9 * 3600 * S)]
    reloads = [("I", at + 8 * 3600 * S + 15 * S, ["am", "noon"]), ("I", at + day + 3600 * S, ["am", "noon", "pm"]), ("I", at + 2 * day + 8 * 3600 * S + 5 * S, ["noon"]), ("I", at + 2 * day + 8 * 3600 * S + 15 * S, ["am"])]
    table = spark.createDataFrame(due, DUE)
    cuts = spark.createDataFrame(reloads, "intersection_id string, us bigint, labels array<string>")
    batch = sorted(map(tuple, schedule.firings(table, cuts).collect()))
    assert [(i, label, date, (us - at) // (3600 * S)) for i, label, date, us in batch] == [
        ("I", "am", "2023-11-14", 8), ("I", "am", "2023-11-15", 32), ("I", "am", "2023-11-16", 56), ("I", "am", "2023-11-16", 56),  # the mark went with the label
        ("I", "noon", "2023-11-14", 12), ("I", "noon", "2023-11-15", 36), ("I", "pm", "2023-11-15", 41), ("J", "am", "2023-11-14", 9),
    ]
    clock = spark.createDataFrame([("Z", "x", "2024-01-01", at + 40 * day)], DUE)
    bounds = [at, at + 8 * 3600 * S + 12 * S, at + day, at + 4 * day]
    stream = stateful.stream_firings(source(spark, tmp_path / "due", [*cut_by(table, "fire_us", bounds), clock]), source(spark, tmp_path / "cuts", cut_by(cuts, "us", bounds)), "1 hour")
    rows, _ = run(stream, tmp_path, "firings")
    assert sorted(map(tuple, rows)) == batch
    plain = schedule.firings(table).collect()
    assert len(plain) == 10 == len({(r["intersection_id"], r["label"], r["local_date"]) for r in plain})


def test_once_a_day(spark, tmp_path):
    due = [("I", "am", "2023-11-14", BASE), ("I", "am", "2023-11-14", BASE + 10 * S), ("I", "am", "2023-11-15", BASE + 86_400 * S), ("I", "pm", "2023-11-14", BASE), ("J", "am", "2023-11-14", BASE)]
    parts = [spark.createDataFrame(rows, DUE) for rows in (due[:1], due[1:])]
    rows, _ = run(stateful.stream_once_a_day(source(spark, tmp_path / "in", parts)), tmp_path, "daily")
    assert sorted((r["intersection_id"], r["label"], r["local_date"]) for r in rows) == sorted({r[:3] for r in due})


def test_samples_to_clips_continuously(spark, tmp_path):
    """Two intersections, a pair of detectors each: what the stages put out is what the operators make of all samples at once."""
    rnd, rows, seq = random.Random(21), [], 0
    on = {(i, d): False for i in "IJ" for d in (0, 1)}
    for k in range(400):  # polls half a second apart
        for i in "IJ":
            for d in (0, 1):
                on[i, d] ^= rnd.random() < (0.06 if on[i, d] else 0.02)
            seq += 1
            rows.append((i, BASE + k * S // 2, seq, f"{oids.DETECTOR}.1", on[i, 0] + 2 * on[i, 1], "OK" if rnd.random() > 0.02 else "ERR"))
    table = spark.createDataFrame(rows, samples.SAMPLES)
    dets = spark.createDataFrame([(i, d, n, "radar", 1, o, c, 2.0) for i in "IJ" for n, (d, o, c) in enumerate((("1", "2", "C1"), ("2", "1", "C2")))], "intersection_id string, detector_id string, ordinal int, type string, phase int, paired_detector_id string, camera_id string, lag_threshold_sec double")
    cams = spark.createDataFrame([("I", "C1"), ("I", "C2"), ("J", "C2")], "intersection_id string, camera_id string")
    zones = spark.createDataFrame([("I", "UTC"), ("J", "UTC")], "intersection_id string, timezone string")
    params = resolver.Params(post_roll_us=3 * S, cooldown_us=5 * S, max_duration_us=6 * S)
    site = running.Site(oids.oid_dim(spark), pairs.detector_pairs(dets), zones, cams, params, cap=1, delay="2 seconds")
    clock = spark.createDataFrame([(i, BASE + t * S, 10**6, f"{oids.DETECTOR}.1", 0, "OK") for i in "IJ" for t in (600, 1200)], samples.SAMPLES)
    parts = [*cut_by(table, "poll_us", [BASE, BASE + 60 * S, BASE + 61 * S, BASE + 900 * S]), clock.filter(f"poll_us = {BASE + 600 * S}"), clock.filter(f"poll_us > {BASE + 600 * S}")]
    stages = running.Running(spark, str(tmp_path / "site"), site)
    stream = source(spark, tmp_path / "in", parts[:2])
    stages.start(stream, once=True)
    source(spark, tmp_path / "more", parts[2:])
    for k in (0, 1, 2):  # more samples come, and all stages go on where they were
        os.rename(tmp_path / "more" / f"part={k}", tmp_path / "in" / f"part={k + 2}")
    for _ in range(2):
        stages.start(stream, once=True)
    before = BASE + 300 * S
    changed = changes.mask_changes(decode.masks(table.unionByName(clock), site.dim))
    assert sorted(map(str, stages.table("changes").filter(F.col("us") < before).collect())) == sorted(map(str, changed.filter(F.col("us") < before).collect()))
    fired_rows = resolver.resolve_pairs(running.edges_of(changed), site.pairs, params, BASE + 600 * S)
    documents = pair_payloads(fired_rows, site.pairs, zones).filter(F.col("event_timestamp") * S < before)
    text = lambda df: sorted(map(str, df.collect()))
    assert text(stages.table("triggers").filter(F.col("event_timestamp") * S < before)) == text(documents)
    taken = clips.takeover(clips.admission(clips.with_ends(running.clip_triggers(documents, cams)), 1).filter("drop_reason IS NULL"))
    columns = ("intersection_id", "trigger_id", "start_us", "camera_id", "end_us", "ended_by", "feed_end_us")
    got = stages.table("clips").filter(F.col("start_us") < before)
    assert text(got.filter("drop_reason IS NULL").select(*columns)) == text(taken.select(*columns))
    assert taken.count() > 5 and got.filter("drop_reason = 'cap' OR drop_reason = 'camera'").count() > 0
