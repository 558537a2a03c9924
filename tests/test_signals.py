"""Decoding, changes, configuration, schedule, clips and trigger documents."""

import json

from pyspark.sql import functions as F

from phasegrid.functions import signals
from phasegrid.operators import changes, clips, decode, schedule
from phasegrid.sources import config, oids
from phasegrid.sources import triggers as trig
from phasegrid.streaming import stateful

SAMPLE = "intersection_id string, poll_us bigint, seq bigint, oid string, value int, status string"


def sampled(spark, rows):
    return spark.createDataFrame(rows, SAMPLE)


def test_every_mask_comes_back(spark):
    rows = [("I", m, m, f"{oids.DETECTOR}.3", m, "OK") for m in range(256)]
    out = decode.states(sampled(spark, rows), oids.oid_dim(spark))
    masks = out.groupBy("us").agg(F.sum(F.col("code") * F.expr("CAST(power(2, num - 17) AS INT)")).alias("m"), F.count("*").alias("n")).collect()
    assert len(masks) == 256 and all(r["m"] == r["us"] and r["n"] == 8 for r in masks)


def test_lamp_priority_and_incomplete_groups(spark):
    lamps = [("I", 1, k, f"{oids.PHASE}.{c}.1", v, "OK") for k, (c, v) in enumerate(((2, 0b1), (3, 0b10), (4, 0b101)))]
    lamps += [("I", 2, 9, f"{oids.PHASE}.2.1", 255, "OK"), ("I", 3, 1, "1.2.3", 1, "OK")]
    got = {r["num"]: r["state"] for r in decode.states(sampled(spark, lamps), oids.oid_dim(spark)).collect()}
    assert got == {1: "GREEN", 2: "YELLOW", 3: "GREEN"} | {n: "DARK" for n in range(4, 9)}
    assert decode.unresolved(sampled(spark, lamps), oids.oid_dim(spark)).count() == 1


def test_failed_polls(spark):
    rows = [("I", 1, k, f"{oids.PHASE}.{c}.1", 1, "OK") for k, c in enumerate((2, 3, 4))] + [("I", 1, 3, f"{oids.OVERLAP}.2.1", 1, "ERR")]
    rows += [("I", 1, 4, f"{oids.DETECTOR}.1", 1, "OK"), ("I", 1, 5, f"{oids.DETECTOR}.2", 1, "ERR"), ("I", 1, 6, f"{oids.OUTPUT}.1", 1, "OK"), ("I", 1, 7, f"{oids.OUTPUT}.2", 1, "ERR"), ("I", 1, 8, f"{oids.OUTPUT}.3", 1, "OK")]
    got = {(r["kind"], r["num"]) for r in decode.states(sampled(spark, rows), oids.oid_dim(spark)).collect()}
    assert got == {("phase", n) for n in range(1, 9)} | {("output", 1)}


def test_addressing(spark):
    got = spark.range(0, 67).select("id", signals.detector_group(F.col("id")).alias("g"), signals.detector_bit(F.col("id")).alias("b")).collect()
    assert all((r["g"], r["b"]) == (((r["id"] - 1) // 8, (r["id"] - 1) % 8) if 1 <= r["id"] <= 64 else (None, None)) for r in got)
    fps = spark.createDataFrame([(30.0, 2.0), (0.0, 2.0), (None, 0.01)], "f double, p double").select(signals.frames_kept(F.col("f"), F.col("p")).alias("n")).collect()
    assert [r["n"] for r in fps] == [60, 30, 1]


def test_changes_events_and_state(spark):
    rows = [("I", 10 * k, k, f"{oids.DETECTOR}.1", m, "OK") for k, m in enumerate((0, 0, 1, 1, 0))]
    st = decode.states(sampled(spark, rows), oids.oid_dim(spark))
    found = changes.changes(st)
    assert found.filter("initial").count() == 8 and found.filter("NOT initial").count() == 2
    events = changes.expand_events(found)
    assert changes.subscribe(events, "detector_off").count() == 9 and changes.subscribe(events, "detector_on", 1).count() == 1
    assert changes.active(changes.current_state(st, 25), "detector", "ACTIVE").first()["nums"] == [1]
    seen = []
    errors = changes.route(events, {"detector_on": lambda df: seen.append(df.count()), "detector_off": lambda df: 1 / 0})
    assert seen == [1] and list(errors) == ["detector_off"]
    shot = changes.snapshots(st).filter("us = 20").select(changes.member(F.col("members"), F.lit(1)).alias("one"), changes.member(F.col("members"), F.lit(99)).alias("none")).first()
    assert (shot["one"], shot["none"]) == ("ACTIVE", None)


def test_stream_changes_equal_batch(spark, tmp_path):
    rows = [("I", 10 * k, k, f"{oids.DETECTOR}.1", (k * 37) % 256, "OK") for k in range(30)]
    st = decode.states(sampled(spark, rows), oids.oid_dim(spark))
    for lo in (0, 100, 200):
        st.filter((F.col("us") >= lo) & (F.col("us") < lo + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(st.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful.stream_changes(source).writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    columns = ["intersection_id", "kind", "num", "us", "old_state", "new_state", "initial"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(spark.table("changed")) == key(changes.changes(st))


def test_config_file_defaults_and_lookup(spark, tmp_path):
    sound = {"intersection_id": "I", "controller_ip": "192.0.2.1", "snmp_port": 1, "timezone": "UTC", "cameras": {"C1": {"url": "rtsp://u:p@camera.invalid/1", "pre_roll_sec": 5}, "C2": {"url": "x"}}, "detectors": {"1": {"type": "radar", "phase": 2, "camera_id": "C1"}}, "poll_interval_sec": 0.2, "routine_recordings": [{"time": "8:00", "duration_sec": 60}]}
    (tmp_path / "c.json").write_text(json.dumps({"I": sound, "J": {"cameras": {"C": {}}, "detectors": {"1": {"type": "laser", "camera_id": "X"}}}}, indent=1))
    (tmp_path / "broken.json").write_text("[1]")
    blobs = config.read_config_file(spark, str(tmp_path / "c.json"))
    loaded = config.load_config(blobs)
    assert [r["intersection_id"] for r in config.listed_ids(blobs).collect()] == ["I", "J"]
    assert loaded.intersections.first()["polls_fast"] and loaded.cameras.count() == 2 and loaded.routines.first()["time"] == "8:00"
    assert loaded.errors.first()["errors"] == ["camera C missing url", "detector 1 has type laser", "detector 1 missing phase", "detector 1 names camera X", "missing controller_ip", "missing intersection_id", "missing snmp_port", "missing timezone"]
    assert config.stream_map(loaded.cameras).first()["streams"]["C1"] == "rtsp://camera.invalid/1"
    assert config.roll_defaults(loaded.cameras).first()["pre_roll_sec"] == 5.0
    assert config.broken_files(spark, str(tmp_path / "*.json")).count() == 1
    wanted = spark.createDataFrame([("I", "C1"), ("I", "C9")], "intersection_id string, camera_id string")
    assert {r["camera_id"]: r["missing"] for r in config.looked_up(wanted, loaded.cameras, ("intersection_id", "camera_id")).collect()} == {"C1": False, "C9": True}
    raw = spark.createDataFrame([('{"a":{"b":{"c":5}}}',), ("nonsense",), (None,)], "raw string")
    got = [r["v"] for r in config.settings_with_default(raw, '{"a":{"b":{"c":1}}}').select(signals.setting(F.col("raw"), "a.b.c", "0").alias("v")).collect()]
    assert got == ["5", "1", "1"]


def test_clock_changes(spark):
    rows = [("I", 0, "early", "02:30", "America/Boise"), ("I", 1, "late", "01:30", "America/Boise"), ("J", 0, "odd", "8:5", "No/Where")]
    df = spark.createDataFrame(rows, "intersection_id string, ordinal int, label string, time string, timezone string").withColumns({"duration_sec": F.lit(60.0), "cameras": F.lit(None).cast("array<string>"), "reason": F.lit(None).cast("string"), "pre_roll_sec": F.lit(None).cast("double")})
    zones = schedule.known_zones(spark)
    spring = schedule.due_routines(df, zones, "2024-03-09", "2024-03-11").filter("label = 'early'").collect()
    assert sorted(str(r["local_date"]) for r in spring) == ["2024-03-09", "2024-03-11"]
    autumn = schedule.due_routines(df, zones, "2024-11-03", "2024-11-03").collect()
    assert {r["label"]: r["fire_us"] // 60_000_000 % 1440 for r in autumn} == {"early": 9 * 60 + 30, "late": 7 * 60 + 30, "odd": 8 * 60 + 5}


def test_cap_takeover_and_log(spark):
    rows = [("I", f"T{k}", "start", k * 1_000_000, 100.0, ["all"], 2.0, "detector_disagreement") for k in range(3)] + [("I", "T9", "start", 9_000_000, 100.0, ["none"], 2.0, "x"), ("I", "T0", "stop", 5_000_000, None, None, None, None), ("I", "T0", "start", 1, 1.0, ["all"], 0.0, "x"), ("I", "T7", "stop", 5, None, None, None, None)]
    t = spark.createDataFrame(rows, "intersection_id string, trigger_id string, action string, us bigint, max_duration_sec double, cameras array<string>, pre_roll_sec double, reason string")
    life = clips.lifecycle(t).withColumn("camera_id", clips.target_camera(F.col("cameras"), F.array(F.lit("C1"))))
    out = clips.admission(life)
    assert {r["trigger_id"]: r["drop_reason"] for r in out.collect()} == {"T0": None, "T1": None, "T2": "cap", "T9": "camera"}
    feeds = {r["trigger_id"]: (r["ended_by"], r["feed_end_us"]) for r in clips.takeover(out.filter("drop_reason IS NULL")).collect()}
    assert feeds == {"T0": ("stop", 1_000_000), "T1": ("max_duration", 101_000_000)}
    meta = F.struct(*[F.lit("r").alias(n) for n in ("rule", "det_a", "det_b", "description")])
    log = clips.discrepancy_log(out.withColumn("timezone", F.lit("UTC")).withColumn("metadata", meta)).collect()
    assert sorted(r["Video_Filename"] for r in log) == ["T0_C1_0.mp4", "T1_C1_1.mp4"]
    frames = spark.createDataFrame([("I", "C1", 0, 0)], "intersection_id string, camera_id string, frame_us bigint, seq bigint")
    assert clips.preroll_frames(life.withColumn("pre_roll_sec", F.lit(0.0)), frames, 15.0, 1_000_000).count() == 0


def test_trigger_documents_round_trip(spark, tmp_path):
    meta = F.from_json(F.lit('{"rule":"rule1","det_a":"1"}'), trig.METADATA)
    df = spark.createDataFrame([("T1", "start", 1.5), ("T2", "pause", 2.0), (None, "stop", 3.0)], "trigger_id string, action string, event_timestamp double").withColumns({"reason": F.lit("r"), "intersection_id": F.lit("I"), "timezone": F.lit("UTC"), "cameras": F.array(F.lit("all")), "pre_roll_sec": F.lit(1.0), "post_roll_sec": F.lit(1.0), "max_duration_sec": F.lit(9.0), "metadata": meta})
    trig.write_triggers(df, str(tmp_path / "t"))
    (tmp_path / "t" / "broken.json").write_text("{nonsense\n")
    valid, bad = trig.read_triggers(spark, str(tmp_path / "t"), multi_line=False)
    assert [(r["trigger_id"], r["metadata"]["rule"]) for r in valid.collect()] == [("T1", "rule1")]
    assert sorted(r["errors"][-1] for r in bad.cache().collect()) == ["missing trigger_id", "no JSON", "unknown action pause"]
    name = spark.range(1).select(trig.trigger_file_name(F.lit(1_500_000), F.lit("UTC"), F.lit("abcdefghijk")).alias("n")).first()["n"]
    assert name == "trigger_19700101T000001500000_abcdefgh.json"
    log = spark.createDataFrame([("a", "b")], "x string, y string")
    trig.append_log(log, str(tmp_path / "log"))
    trig.append_log(log, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
