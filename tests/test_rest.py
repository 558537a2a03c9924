"""Parts of the library that no registered query reaches."""

import uuid

from pyspark.sql import functions as F

from phasegrid.functions import signals
from phasegrid.operators import changes, clips, decode, pairs, rules, schedule
from phasegrid.sources import config, oids, samples
from phasegrid.sources import triggers as trig
from phasegrid.streaming import stateful

TRIGGER = "intersection_id string, trigger_id string, action string, us bigint, max_duration_sec double, cameras array<string>, pre_roll_sec double, reason string"
S = 1_000_000


def test_samples_are_read_as_a_table_and_as_a_stream(spark, tmp_path):
    rows = [("I", k, k, f"{oids.RING}.{1 + k % 4}", k, "OK") for k in range(8)] + [("I", 9, 9, f"{oids.DETECTOR}.1", 1, "OK")]
    spark.createDataFrame(rows, samples.SAMPLES).write.parquet(str(tmp_path / "in"))
    table = samples.read_samples(spark, str(tmp_path / "in"))
    rings = decode.rings(decode.resolve(table, oids.oid_dim(spark))).collect()
    assert sorted((r["ring"], r["us"], r["value"]) for r in rings) == sorted((1 + k % 4, k, k) for k in range(8))
    states = decode.states(samples.read_samples(spark, str(tmp_path / "in")), oids.oid_dim(spark))
    states.write.parquet(str(tmp_path / "states"))
    source = spark.readStream.schema(states.schema).parquet(str(tmp_path / "states"))
    stateful.stream_current_state(source).writeStream.format("memory").outputMode("update").queryName("current").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(str, spark.table("current").collect())) == sorted(map(str, changes.current_state(states).collect()))
    assert samples.read_samples(spark, str(tmp_path / "in"), stream=True).isStreaming


def test_lamp_identifiers_fall_back_to_the_first_group():
    assert oids.lamp_oids(2) == tuple(f"{oids.PHASE}.{c}.2" for c in (2, 3, 4))
    assert oids.lamp_oids(3) == tuple(f"{oids.OVERLAP}.{c}.1" for c in (2, 3, 4))
    assert oids.lamp_oids() == oids.lamp_oids(1) == oids.lamp_oids(9)


def test_a_decoder_is_added(spark, monkeypatch):
    monkeypatch.setattr(decode, "DECODERS", dict(decode.DECODERS))
    decode.register_decoder("rings", lambda r: decode.rings(r).select("intersection_id", F.lit("ring").alias("kind"), F.col("ring").alias("num"), "us", F.col("us").alias("seq"), F.col("value").alias("code"), F.col("value").cast("string").alias("state")))
    rows = [("I", 1, 1, f"{oids.RING}.2", 7, "OK"), ("I", 1, 2, f"{oids.OUTPUT}.3", 1, "OK")]
    got = decode.states(spark.createDataFrame(rows, samples.SAMPLES), oids.oid_dim(spark)).collect()
    assert {(r["kind"], r["num"], r["state"]) for r in got} == {("ring", 2, "7"), ("output", 3, "ON")}


def test_watched_ranges_and_texts(spark):
    df = spark.createDataFrame([("phase", n, "GREEN") for n in range(1, 17)] + [("detector", 5, "ACTIVE")], "kind string, num int, state string")
    assert sorted(r["num"] for r in changes.watched(df, [2, 99, 4]).collect()) == [2, 4]
    assert sorted(r["num"] for r in decode.in_range(df, "phase", 3, 6).collect()) == [3, 4, 5]
    assert df.filter("num = 5 AND kind = 'detector'").select(signals.status_text(F.col("kind"), F.col("num"), F.col("state")).alias("t")).first()["t"] == "Detector 5: ACTIVE"
    rows = spark.createDataFrame([("I", 1, "phase", 1, "RED"), ("I", 1, "phase", 2, "GREEN"), ("I", 1, "ped", 1, "RED")], "intersection_id string, us bigint, kind string, num int, state string")
    assert {r["kind"]: [(m["num"], m["state"]) for m in r["members"]] for r in changes.snapshots(rows).collect()} == {"phase": [(1, "RED"), (2, "GREEN")], "ped": [(1, "RED")]}


def test_unknown_detectors_have_no_pair(spark):
    pair = spark.createDataFrame([("I", "1:2", "1", "2", 5)], "intersection_id string, pair_key string, det_a string, det_b string, threshold_us bigint")
    edge = spark.createDataFrame([("I", "1", 1), ("I", "9", 2), ("J", "1", 3)], "intersection_id string, detector_id string, us bigint")
    assert [(r["side"], r["us"]) for r in pairs.of_pairs(edge, pair).collect()] == [("a", 1)]


def test_labels_and_cameras_that_survive(spark):
    routines = spark.createDataFrame([("I", 0, "am", "8:00"), ("I", 1, None, "9:30")], "intersection_id string, ordinal int, label string, time string").withColumns({"duration_sec": F.lit(1.0), "cameras": F.lit(None).cast("array<string>"), "reason": F.lit(None).cast("string"), "pre_roll_sec": F.lit(None).cast("double")})
    fired = spark.createDataFrame([("I", "am"), ("I", "9:30"), ("I", "gone"), ("J", "am")], "intersection_id string, label string")
    assert sorted((r["intersection_id"], r["label"]) for r in schedule.surviving_labels(fired, routines).collect()) == [("I", "9:30"), ("I", "am")]
    dets = spark.createDataFrame([("I", "1", "C1"), ("I", "2", "C9"), ("I", "3", None)], "intersection_id string, detector_id string, camera_id string")
    cams = spark.createDataFrame([("I", "C1")], "intersection_id string, camera_id string")
    assert [r["detector_id"] for r in config.dangling_cameras(dets, cams).collect()] == ["2"]


def test_poll_statistics_count_writes(spark):
    read = spark.createDataFrame([("I", 1, "OK"), ("I", 1, "ERR"), ("I", 2, "OK")], "intersection_id string, poll_us bigint, status string")
    done = spark.createDataFrame([("I", "OK"), ("J", "ERR")], "intersection_id string, status string")
    assert {r["intersection_id"]: (r["reads"], r["writes"], r["errors"]) for r in changes.poll_stats(read, done).collect()} == {"I": (2, 1, 1), "J": (0, 1, 1)}


def test_a_second_start_is_a_duplicate_only_while_the_clip_runs(spark):
    rows = [("I", "T", "start", 0, 10.0), ("I", "T", "start", 5 * S, 10.0), ("I", "T", "start", 20 * S, 10.0), ("I", "T", "stop", 24 * S, None), ("I", "T", "start", 25 * S, 1.0), ("J", "T", "start", 5 * S, 1.0)]
    df = spark.createDataFrame(rows, "intersection_id string, trigger_id string, action string, us bigint, max_duration_sec double")
    life = sorted((r["intersection_id"], r["start_us"] // S, r["end_us"] // S, r["ended_by"]) for r in clips.lifecycle(df).collect())
    assert life == [("I", 0, 10, "max_duration"), ("I", 20, 24, "stop"), ("I", 25, 26, "max_duration"), ("J", 5, 6, "max_duration")]
    got = clips.admission(clips.with_ends(df).withColumn("camera_id", F.when(F.col("start_us") != 25 * S, "C")))
    assert sorted((r["intersection_id"], r["start_us"] // S, r["drop_reason"] or "") for r in got.collect()) == [("I", 0, ""), ("I", 5, "duplicate"), ("I", 20, ""), ("I", 25, "camera"), ("J", 5, "")]


def test_frames_meet_clips_of_their_own_intersection(spark):
    clip = spark.createDataFrame([("A", "T1", "C1", 10 * S, 20 * S, 5.0), ("B", "T2", "C1", 10 * S, 20 * S, 5.0)], "intersection_id string, trigger_id string, camera_id string, start_us bigint, end_us bigint, pre_roll_sec double")
    frames = spark.createDataFrame([("A", "C1", 12 * S, 1), ("A", "C1", 9 * S, 0)], "intersection_id string, camera_id string, frame_us bigint, seq bigint")
    assert [r["trigger_id"] for r in clips.preroll_frames(clip, frames, 15.0, S).collect()] == ["T1"]
    assert [(r["trigger_id"], r["place"]) for r in clips.frame_manifest(clips.windows(clips.takeover(clip)), frames, S).orderBy("place").collect()] == [("T1", 1), ("T1", 2)]


def shuffled(spark, df):
    """(rows, records that their stages wrote for shuffles)."""
    sc = spark.sparkContext
    sc.setJobGroup(group := uuid.uuid4().hex, "")
    try:
        rows = df.collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {x for j in tracker.getJobIdsForGroup(group) for x in tracker.getJobInfo(j).stageIds}
    return rows, sum(store.lastStageAttempt(x).shuffleWriteRecords() for x in stages)


def crowd(spark):
    """Clips and frames of one camera, 300 each, 60 at an instant: all lie within each other's hour."""
    clip = spark.createDataFrame([("A", f"T{k}", "C1", k // 60 * S, 9000 * S, 3600.0) for k in range(300)], "intersection_id string, trigger_id string, camera_id string, start_us bigint, end_us bigint, pre_roll_sec double")
    return clip, spark.createDataFrame([("A", "C1", k // 60 * S, k) for k in range(300)], "intersection_id string, camera_id string, frame_us bigint, seq bigint")


def test_manifests_shuffle_clips_and_frames_not_their_pairs(spark):
    clip, frames = crowd(spark)
    rows, written = shuffled(spark, clips.frame_manifest(clips.windows(clips.takeover(clip)), frames, 3600 * S))
    last = {max(f"T{k}" for k in range(60 * t, 60 * t + 60)) for t in range(5)}  # of an instant's ids the last one goes on until the next instant
    want = {(f"T{k}", p + 1, p * S, 60 * p) for k in range(300) for p in range(k // 60 + (f"T{k}" in last))}
    assert {(r["trigger_id"], r["place"], r["frame_us"], r["seq"]) for r in rows} == want and len(rows) == len(want)
    assert written < 3_000  # 300 clips, 300 frames, a few times


def test_prerolls_shuffle_clips_and_frames_not_their_pairs(spark):
    clip, frames = crowd(spark)
    rows, written = shuffled(spark, clips.preroll_frames(clip, frames, 3 / 3600, 3600 * S))
    want = {(f"T{k}", (k // 60 - 1) * S, k // 60 * 60 - n) for k in range(60, 300) for n in (1, 2, 3)}
    assert {(r["trigger_id"], r["frame_us"], r["seq"]) for r in rows} == want and len(rows) == len(want)
    assert written < 3_000  # 300 clips, 300 frames, a few times


def test_zone_texts_through_clock_changes(spark):
    rows = [(1_705_320_000 * S, "America/Boise"), (1_720_000_000 * S, "America/Boise"), (0, "No/Where"), (0, None), (1_720_000_000 * S, "Asia/Kolkata"), (1_720_000_000 * S, "Europe/Paris")]
    got = [r["t"] for r in spark.createDataFrame(rows, "us bigint, zone string").select(clips.zone_text(F.col("us"), F.col("zone")).alias("t")).collect()]
    assert got == ["2024-01-15 05:00:00 MST", "2024-07-03 03:46:40 MDT", "1970-01-01 00:00:00 UTC", "1970-01-01 00:00:00 UTC", "2024-07-03 15:16:40 IST", "2024-07-03 11:46:40 CEST"]
    assert [r["t"] for r in spark.createDataFrame(rows[2:4], "us bigint, zone string").select(signals.local_text(F.col("us"), F.col("zone"), "yyyy HH").alias("t")).collect()] == ["1970 00", "1970 00"]


def test_texts_of_the_rules(spark):
    row = spark.range(1).select(
        rules.describe_rule1(F.lit("1"), F.lit("2"), F.lit(2.0), F.lit(2.0)).alias("a"), rules.describe_rule2(F.lit("1"), F.lit(0.5), F.lit(10 * S), F.lit(12_500_000), F.lit(2 * S)).alias("b"), rules.describe_stop(20.0).alias("c"), rules.rule_name(F.lit(2)).alias("d")
    ).first()
    assert tuple(row) == ("detector '1' ON, detector '2' OFF for 2.0s (threshold=2.0s)", "orphan on detector '1': orphan pulse duration=0.5s window=[8.000, 12.500]", "Rule 1 recording stopped after 20.0s post-roll", "rule2_orphan_pulse")


def test_triggers_are_handled_oldest_first(spark):
    df = spark.createDataFrame([("b", 2.0), ("c", 1.0), ("a", 2.0)], "trigger_id string, event_timestamp double")
    assert [r["trigger_id"] for r in trig.oldest_first(df).collect()] == ["c", "a", "b"]


def test_changes_of_masks_are_those_of_states(spark, sf_dir):
    rows, dim = samples.samples(spark, sf_dir), oids.oid_dim(spark)
    key = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    columns = ("intersection_id", "kind", "num", "us", "seq", "old_state", "new_state", "initial")
    assert key(changes.mask_changes(decode.masks(rows, dim)), *columns) == key(changes.changes(decode.states(rows, dim)), *columns)
    columns = ("intersection_id", "kind", "num", "us", "state")
    at = 1_705_000_000_000_000
    assert key(changes.mask_state(decode.masks(rows, dim), at), *columns) == key(changes.current_state(decode.states(rows, dim), at), *columns)


def test_zone_texts_of_tables_are_those_of_columns(spark):
    zones = ["America/Boise", "No/Where", None, "Asia/Kolkata", "Europe/Paris", "Asia/Kathmandu", "Australia/Lord_Howe", "UTC"]
    df = spark.createDataFrame([(us * S + 7, z) for us in (0, 946_684_800, 1_705_320_000, 1_720_000_000, 1_900_000_000) for z in zones], "us bigint, zone string")
    both = clips.with_zone_text(df, "us", "zone", "joined").withColumn("plain", clips.zone_text(F.col("us"), F.col("zone"))).collect()
    assert len(both) == 40 and all(r["joined"] == r["plain"] for r in both)
    assert clips.with_zone_text(df, "us", "zone", "joined").columns == ["us", "zone", "joined"]
