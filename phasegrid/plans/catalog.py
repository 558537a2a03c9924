"""The registered queries of the library and their SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions import signals
from phasegrid.operators import changes, clips, decode, pairs, resolver, rules, schedule
from phasegrid.plans import views as v
from phasegrid.sources import config, oids, samples
from phasegrid.sources import triggers as trig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- samples, addressing, decoding ---------------------------------------------------------------


@query(f"WITH {v.RAW} SELECT kind, grp, channel, COUNT(*) AS n, CAST(SUM(value) AS BIGINT) AS total FROM res GROUP BY ALL")
def oid_resolution(spark, sf_dir):
    rows = decode.resolve(samples.samples(spark, sf_dir), oids.oid_dim(spark))
    return rows.groupBy("kind", "grp", "channel").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {v.USED} SELECT intersection_id, kind, grp, poll_us, red, yellow, green FROM polls")
def poll_assembly(spark, sf_dir):
    rows = decode.usable(decode.resolve(samples.samples(spark, sf_dir), oids.oid_dim(spark)))
    return decode.assemble(rows).select("intersection_id", "kind", "grp", "poll_us", "red", "yellow", "green")


def _decoded(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return v.states(spark, sf_dir, kind).select("intersection_id", "num", "us", "state")

    run.__name__ = f"{kind}_decode"
    query(f"WITH {v.STATES} SELECT intersection_id, num, us, state FROM st WHERE kind = '{kind}'")(run)


for _kind in ("phase", "overlap", "ped", "detector", "output"):
    _decoded(_kind)


@query("SELECT CAST(l_linenumber * 11 + l_partkey % 10 AS INTEGER) AS num, CASE WHEN l_linenumber * 11 + l_partkey % 10 <= 64 THEN CAST((l_linenumber * 11 + l_partkey % 10 - 1) // 8 AS INTEGER) ELSE -1 END AS grp, CASE WHEN l_linenumber * 11 + l_partkey % 10 <= 64 THEN CAST((l_linenumber * 11 + l_partkey % 10 - 1) % 8 AS INTEGER) ELSE -1 END AS place, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def detector_addressing(spark, sf_dir):
    num = (F.col("l_linenumber") * 11 + F.col("l_partkey") % 10).cast("int")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(num.alias("num"))
    return rows.groupBy("num").count().select("num", F.coalesce(signals.detector_group(F.col("num")), F.lit(-1)).alias("grp"), F.coalesce(signals.detector_bit(F.col("num")), F.lit(-1)).alias("place"), F.col("count").alias("n"))


@query(f"WITH {v.STATES} SELECT intersection_id, num, us, state FROM st WHERE kind = 'detector' AND num >= 17 AND num < 30")
def range_filter(spark, sf_dir):
    rows = decode.usable(decode.resolve(samples.samples(spark, sf_dir), decode.of_kinds(oids.oid_dim(spark), ("detector",))))
    return decode.in_range(decode.detectors(decode.groups_in_range(rows, 17, 30)), "detector", 17, 30).select("intersection_id", "num", "us", "state")


@query(f"WITH {v.EV}, {v._DIM}, raw AS ({v._READ}) SELECT intersection_id, kind, grp, COUNT(*) AS n FROM raw JOIN dim USING (oid) WHERE (kind IN ('phase', 'output') AND grp % 2 = 1 AND intersection_id IN ('I0', 'I2')) OR kind = 'detector' GROUP BY ALL")
def enabled_kinds(spark, sf_dir):
    dim = oids.oid_dim(spark)
    ids = samples.events(spark, sf_dir).select("intersection_id").distinct()
    on = F.col("kind").isin("phase", "output") & (F.col("grp") % 2 == 1) & F.col("intersection_id").isin("I0", "I2") | (F.col("kind") == "detector")
    settings = ids.join(F.broadcast(dim.select("kind", "grp").distinct()), F.lit(True)).filter(on)  # four ids by some thirty kinds
    return decode.enabled(decode.resolve(samples.samples(spark, sf_dir), dim), settings).groupBy("intersection_id", "kind", "grp").agg(F.count("*").alias("n"))


# --- changes and current state -----------------------------------------------------------------


@query(f"WITH {v.CHANGES} SELECT intersection_id, kind, num, us, old_state, new_state, initial FROM ch")
def state_changes(spark, sf_dir):
    return changes.mask_changes(v.masks(spark, sf_dir)).select("intersection_id", "kind", "num", "us", "old_state", "new_state", "initial")


_NAMES = " UNION ALL ".join([f"SELECT '{k}' AS kind, NULL AS s, '{n}' AS event_name" for k, n in changes.GENERAL.items()] + [f"SELECT '{k}', '{s}', '{n}'" for (k, s), n in changes.SPECIFIC.items()])


@query(f"WITH {v.CHANGES}, names AS ({_NAMES}) SELECT intersection_id, event_name, num, us FROM ch JOIN names ON ch.kind = names.kind AND (s IS NULL OR s = new_state)")
def typed_events(spark, sf_dir):
    return changes.expand_events(changes.mask_changes(v.masks(spark, sf_dir))).select("intersection_id", "event_name", "num", "us")


@query(f"WITH {v.CHANGES} SELECT intersection_id, num, us, old_state, new_state FROM ch WHERE kind = 'phase' AND (num, old_state, new_state) IN ((2, 'RED', 'GREEN'), (4, 'GREEN', 'YELLOW'), (6, 'YELLOW', 'RED'))")
def transition_matches(spark, sf_dir):
    wanted = spark.createDataFrame([(2, "RED", "GREEN"), (4, "GREEN", "YELLOW"), (6, "YELLOW", "RED")], "num int, old_state string, new_state string")
    found = changes.mask_changes(v.masks(spark, sf_dir, "phase"))
    return changes.match_transitions(found, wanted).select("intersection_id", "num", "us", "old_state", "new_state")


@query(f"WITH {v.STATES} SELECT intersection_id, kind, num, ARG_MAX(state, us) AS state, MAX(us) AS us FROM st GROUP BY 1, 2, 3")
def current_state(spark, sf_dir):
    return changes.mask_state(v.masks(spark, sf_dir))


@query(f"WITH {v.STATES}, cur AS (SELECT intersection_id, kind, num, ARG_MAX(state, us) AS state FROM st GROUP BY 1, 2, 3) SELECT intersection_id, COALESCE(STRING_AGG(CAST(num AS VARCHAR), ',' ORDER BY num) FILTER (state = 'ACTIVE'), '') AS nums FROM cur WHERE kind = 'detector' GROUP BY 1")
def active_detectors(spark, sf_dir):
    found = changes.active(changes.mask_state(v.masks(spark, sf_dir, "detector")), "detector", "ACTIVE")
    return found.select("intersection_id", F.array_join(F.col("nums").cast("array<string>"), ",").alias("nums"))


@query(f"WITH {v.STATES}, cur AS (SELECT intersection_id, kind, num, ARG_MAX(state, us) AS state FROM st GROUP BY 1, 2, 3) SELECT intersection_id, COALESCE(STRING_AGG(CAST(num AS VARCHAR), ',' ORDER BY num) FILTER (state = 'GREEN'), '') AS nums FROM cur WHERE kind = 'phase' GROUP BY 1")
def green_phases(spark, sf_dir):
    found = changes.active(changes.mask_state(v.masks(spark, sf_dir, "phase")), "phase", "GREEN")
    return found.select("intersection_id", F.array_join(F.col("nums").cast("array<string>"), ",").alias("nums"))


@query(f"WITH {v.STATES}, cur AS (SELECT intersection_id, kind, num, ARG_MAX(state, us) AS state FROM st GROUP BY 1, 2, 3) SELECT intersection_id, " + ", ".join(f"COALESCE(STRING_AGG(num || '=' || state, ',' ORDER BY num) FILTER (kind = '{k}'), '') AS {k}s" for k in changes.GENERAL) + ", TRUE AS connected FROM cur GROUP BY 1")
def status_document(spark, sf_dir):
    doc = changes.status_document(changes.mask_state(v.masks(spark, sf_dir)))

    def text(kind: str):
        return F.array_join(F.transform(F.map_entries(f"{kind}s"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(f"{kind}s")

    return doc.select("intersection_id", *[text(k) for k in changes.GENERAL], "connected")


@query(f"WITH {v.RAW}, p AS (SELECT intersection_id, 1 AS reads, 0 AS writes, MAX(CASE WHEN status <> 'OK' THEN 1 ELSE 0 END) AS failed FROM raw GROUP BY intersection_id, poll_us UNION ALL SELECT intersection_id, 0, 1, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END FROM ev WHERE event_type = 'purchase') SELECT intersection_id, CAST(SUM(reads) AS BIGINT) AS reads, CAST(SUM(writes) AS BIGINT) AS writes, CAST(SUM(failed) AS BIGINT) AS errors FROM p GROUP BY 1")
def poll_stats(spark, sf_dir):
    return changes.poll_stats(samples.samples(spark, sf_dir), samples.commands(spark, sf_dir))


@query(f"WITH {v.STATES}, one AS (SELECT intersection_id, num, us, ARG_MAX(state, seq) AS state FROM st WHERE kind = 'detector' GROUP BY 1, 2, 3), asked AS (SELECT event_id, us, intersection_id, CAST(1 + event_id % 64 AS INTEGER) AS num FROM ev) SELECT event_id, state AS state_then FROM asked ASOF LEFT JOIN one ON one.intersection_id = asked.intersection_id AND one.num = asked.num AND asked.us >= one.us")
def state_asof_event(spark, sf_dir):
    asked = samples.events(spark, sf_dir).select("event_id", "us", "intersection_id", (F.col("event_id") % 64 + 1).cast("int").alias("num"), F.col("event_id").alias("seq"))
    return changes.state_as_of(asked, v.states(spark, sf_dir, "detector"), ("intersection_id", "num")).select("event_id", "state_then")


# --- pairs and rules ------------------------------------------------------------------------------


@query(f"WITH {v.EV}, i AS (SELECT DISTINCT intersection_id FROM ev) SELECT intersection_id, (2 * p - 1) || ':' || (2 * p) AS pair_key, CAST(2 * p - 1 AS VARCHAR) AS det_a, CAST(2 * p AS VARCHAR) AS det_b, 'radar' AS det_a_type, 'loop' AS det_b_type, CASE p WHEN 2 THEN 'C0' ELSE 'C1,C0' END AS cameras, CAST({v.THRESHOLD} AS BIGINT) * 1000000 AS threshold_us FROM i, (SELECT CAST(range + 1 AS INTEGER) AS p FROM range(3))")
def detector_pairs(spark, sf_dir):
    found = pairs.detector_pairs(v.detectors(spark, sf_dir))
    return found.select("intersection_id", "pair_key", "det_a", "det_b", "det_a_type", "det_b_type", F.array_join("cameras", ",").alias("cameras"), "threshold_us")


@query("SELECT s_suppkey AS id, s_suppkey + 7 AS partner FROM supplier WHERE s_suppkey + 7 NOT IN (SELECT s_suppkey FROM supplier)")
def dangling_partners(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("I").alias("intersection_id"), F.col("s_suppkey").alias("detector_id"), (F.col("s_suppkey") + 7).alias("paired_detector_id"))
    return pairs.dangling_partners(s).select(F.col("detector_id").alias("id"), F.col("paired_detector_id").alias("partner"))


@query(f"WITH {v.PULSES} SELECT intersection_id, detector_id, on_us, off_us FROM pulses")
def pulses(spark, sf_dir):
    return pairs.pulses(v.pair_inputs(spark, sf_dir)[0]).select("intersection_id", "detector_id", "on_us", "off_us")


@query(f"WITH {v.TIMELINE} SELECT intersection_id, {v.PAIR_KEY} AS pair_key, us, a_on, b_on FROM tl")
def pair_timeline(spark, sf_dir):
    return pairs.pair_timeline(*v.pair_inputs(spark, sf_dir)).select("intersection_id", "pair_key", "us", "a_on", "b_on")


@query(f"WITH {v.ISLANDS} SELECT intersection_id, {v.PAIR_KEY} AS pair_key, start_us, COALESCE(end_us, -1) AS end_us, a_leads FROM islands")
def disagreement_islands(spark, sf_dir):
    return pairs.disagreements(pairs.pair_timeline(*v.pair_inputs(spark, sf_dir))).select("intersection_id", "pair_key", "start_us", F.coalesce("end_us", F.lit(-1)).alias("end_us"), "a_leads")


@query(f"WITH {v.ISLANDS} SELECT intersection_id, {v.PAIR_KEY} AS pair_key, start_us, start_us + {v.THRESHOLD}000000 AS fire_us, ROUND((end_us - start_us) / 1e6, 3) AS disagreement_sec, CAST(CASE WHEN a_leads THEN 2 * p - 1 ELSE 2 * p END AS VARCHAR) AS leader, CASE WHEN a_leads THEN 'radar' ELSE 'loop' END AS leader_type FROM islands WHERE end_us - start_us > {v.THRESHOLD}000000")
def rule1_candidates(spark, sf_dir):
    edge, pair = v.pair_inputs(spark, sf_dir)
    found = rules.rule1_candidates(pairs.disagreements(pairs.pair_timeline(edge, pair))).join(pair.drop("threshold_us"), ["intersection_id", "pair_key"])
    leader = lambda a, b, name: F.when(F.col("a_leads"), F.col(a)).otherwise(F.col(b)).alias(name)
    return found.select("intersection_id", "pair_key", "start_us", "fire_us", signals.seconds(F.col("end_us") - F.col("start_us")).alias("disagreement_sec"), leader("det_a", "det_b", "leader"), leader("det_a_type", "det_b_type", "leader_type"))


@query(f"WITH {v.PULSES} SELECT intersection_id, {v.PAIR_KEY} AS pair_key, side, on_us, off_us FROM pulses WHERE off_us - on_us > 0 AND off_us - on_us < {v.THRESHOLD}000000")
def rule2_candidates(spark, sf_dir):
    edge, pair = v.pair_inputs(spark, sf_dir)
    return rules.rule2_candidates(pairs.pulses(edge), pair).select("intersection_id", "pair_key", "side", "on_us", "off_us")


@query(f"WITH {v.ORPHANS} SELECT intersection_id, {v.PAIR_KEY} AS pair_key, side, on_us, off_us, at_us AS fire_us, ROUND(10.0 + (off_us - on_us) / 1e6 + 20.0 + {v.THRESHOLD}, 3) AS clip_sec FROM orphans")
def rule2_orphans(spark, sf_dir):
    edge, pair = v.pair_inputs(spark, sf_dir)
    found = rules.orphan_pulses(rules.rule2_candidates(pairs.pulses(edge), pair), pairs.on_intervals(edge), pair)
    return found.select("intersection_id", "pair_key", "side", "on_us", "off_us", "fire_us", rules.clip_length(F.col("on_us"), F.col("off_us"), F.col("threshold_us"), 10.0, 20.0).alias("clip_sec"))


@query(
    f"""WITH RECURSIVE {v.EDGES}, ordered AS (SELECT intersection_id, p, us FROM ed GROUP BY ALL), kept AS (SELECT intersection_id, p, MIN(us) AS us FROM ordered GROUP BY 1, 2
UNION ALL SELECT k.intersection_id, k.p, (SELECT MIN(o.us) FROM ordered o WHERE o.intersection_id = k.intersection_id AND o.p = k.p AND o.us >= k.us + {v.COOLDOWN}000000) AS us FROM kept k WHERE k.us IS NOT NULL)
SELECT intersection_id, {v.PAIR_KEY} AS pair_key, us FROM kept WHERE us IS NOT NULL"""
)
def cooldown_thinning(spark, sf_dir):
    edge, pair = v.pair_inputs(spark, sf_dir)
    rows = pairs.of_pairs(edge, pair).select("intersection_id", "pair_key", "us").distinct()
    return resolver.thin(rows, ("intersection_id", "pair_key"), "us", v.COOLDOWN * 1_000_000)


def _fired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edge, pair = v.pair_inputs(spark, sf_dir)
    params = resolver.Params(post_roll_us=v.POST_ROLL * 1_000_000, cooldown_us=v.COOLDOWN * 1_000_000)
    return resolver.resolve_pairs(edge, pair, params), pair


@query(f"WITH {v.FIRED} SELECT intersection_id, pair_key, trigger_id, action, rule, side, fire_us, disagreement_sec, max_duration_sec, COALESCE(pulse_us, -1) AS pulse_us FROM fired")
def pair_triggers(spark, sf_dir):
    return _fired(spark, sf_dir)[0].withColumn("pulse_us", F.coalesce("pulse_us", F.lit(-1)))


# January in Boise is seven hours behind UTC
@query(f"WITH {v.DOCUMENTS} SELECT trigger_id, action, fire_us / 1e6 AS event_timestamp, intersection_id, 'trigger_' || strftime(make_timestamp(fire_us - 25200000000), '%Y%m%dT%H%M%S%f') || '_' || trigger_id[:8] || '.json' AS file_name, cameras, det_a, det_b, 'radar' AS det_a_type, 'loop' AS det_b_type, rule_name AS rule, description, disagreement_sec, max_duration_sec FROM docs")
def trigger_payloads(spark, sf_dir):
    fired, pair = _fired(spark, sf_dir)
    zones = samples.events(spark, sf_dir).select("intersection_id", F.lit("America/Boise").alias("timezone")).distinct()
    docs = trig.pair_payloads(fired, pair, zones)
    name = trig.trigger_file_name(F.round(F.col("event_timestamp") * 1e6).cast("bigint"), F.col("timezone"), F.col("trigger_id"))
    meta = ("det_a", "det_b", "det_a_type", "det_b_type", "rule", "description", "disagreement_sec")
    return docs.select("trigger_id", "action", "event_timestamp", "intersection_id", name.alias("file_name"), F.array_join("cameras", ",").alias("cameras"), *[F.col("metadata")[m].alias(m) for m in meta], "max_duration_sec")


@query(
    """SELECT l_orderkey, l_linenumber, errors FROM (SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_partkey % 7 = 0 THEN 'missing trigger_id' END, CASE WHEN l_suppkey % 5 = 0 THEN 'missing action' END, CASE WHEN l_linenumber = 7 THEN 'missing event_timestamp' END, CASE WHEN l_suppkey % 5 = 4 THEN 'unknown action pause' END) AS errors FROM lineitem) WHERE errors <> ''"""
)
def trigger_quarantine(spark, sf_dir):
    row = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 7 != 0, F.lit("T")).alias("trigger_id"), F.get(F.array(F.lit(None).cast("string"), F.lit("start"), F.lit("stop"), F.lit("extend"), F.lit("pause")), (F.col("l_suppkey") % 5).cast("int")).alias("action"), F.when(F.col("l_linenumber") != 7, F.lit(1.0)).alias("event_timestamp")
    )
    return trig.validated(row)[1].select("l_orderkey", "l_linenumber", F.array_join("errors", ";").alias("errors"))


# --- configuration ---------------------------------------------------------------------------------

_DETS = "dets AS (SELECT CAST(s_nationkey AS INTEGER) AS k, CAST(s_suppkey AS INTEGER) AS d, CASE WHEN s_nationkey % 4 = 1 THEN s_suppkey % 4 ELSE s_suppkey % 3 END AS t, 'C' || (s_suppkey % CASE WHEN s_nationkey % 5 = 2 THEN 3 ELSE 2 END) AS camera_id FROM supplier), nat AS (SELECT DISTINCT k FROM dets)"
_BAD = f"""{_DETS}, bad AS (SELECT k, 'no JSON object' AS e FROM nat WHERE k % 6 = 5 UNION ALL SELECT k, 'missing controller_ip' FROM nat WHERE k % 3 = 0
UNION ALL SELECT k, 'detector ' || d || ' has type laser' FROM dets WHERE t = 3 AND k % 6 <> 5 UNION ALL SELECT k, 'detector ' || d || ' names camera C2' FROM dets WHERE camera_id = 'C2' AND k % 6 <> 5)"""


@query(f"WITH {_BAD} SELECT 'N' || nat.k AS intersection_id, COALESCE(STRING_AGG(e, ';' ORDER BY e), '') AS errors FROM nat LEFT JOIN bad ON bad.k = nat.k AND NOT (nat.k % 6 = 5 AND e <> 'no JSON object') GROUP BY 1")
def config_errors(spark, sf_dir):
    return config.config_errors(v.blobs(spark, sf_dir)).select("intersection_id", F.array_join("errors", ";").alias("errors"))


@query(f"WITH {_BAD} SELECT 'N' || k AS intersection_id, CAST(d AS VARCHAR) AS detector_id, ['radar', 'loop', 'video', 'laser'][CAST(t AS INTEGER) + 1] AS type, CAST(d % 8 + 1 AS INTEGER) AS phase, camera_id, CAST(d + 25 AS VARCHAR) AS paired_detector_id FROM dets WHERE k NOT IN (SELECT k FROM bad)")
def config_flatten(spark, sf_dir):
    return config.load_config(v.blobs(spark, sf_dir)).detectors.select("intersection_id", "detector_id", "type", "phase", "camera_id", "paired_detector_id")


@query(f"WITH {_BAD} SELECT 'N' || k AS intersection_id, 'C0=rtsp://camera.invalid/1,C1=rtsp://camera.invalid/2' AS streams, 10.0::DOUBLE AS pre_roll_sec, 20.0::DOUBLE AS post_roll_sec FROM nat WHERE k NOT IN (SELECT k FROM bad)")
def stream_map(spark, sf_dir):
    cams = config.load_config(v.blobs(spark, sf_dir)).cameras
    text = F.array_join(F.transform(F.map_entries("streams"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("streams")
    return config.stream_map(cams).select("intersection_id", text).join(config.roll_defaults(cams), "intersection_id")


@query("SELECT CAST(o_custkey % 40 AS VARCHAR) AS intersection_id, MAX(CAST(o_orderkey AS DOUBLE)) AS updated_at FROM orders GROUP BY 1")
def config_latest(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 40).cast("string").alias("intersection_id"), F.lit("{}").alias("config_json"), F.col("o_orderkey").cast("double").alias("updated_at"))
    return config.latest_config(o.filter("updated_at % 2 = 0"), o.filter("updated_at % 2 = 1")).select("intersection_id", "updated_at")


@query("SELECT event_id, COALESCE(CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 0 THEN regexp_extract(props, '([0-9]+)', 1) END, '7') AS k, 'none' AS deep FROM events")
def settings_paths(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", signals.setting(F.col("props"), "k", "7").alias("k"), signals.setting(F.col("props"), "a.b.c", "none").alias("deep"))


# --- schedule ---------------------------------------------------------------------------------------

_ROUT = """rt AS (SELECT 'I' || (s_suppkey % 7) AS intersection_id, CAST(s_suppkey AS INTEGER) AS ordinal, CASE WHEN s_suppkey % 5 = 0 THEN 'L' || (s_suppkey % 2) ELSE s_name END AS label, CASE WHEN s_suppkey % 13 <> 0 THEN (s_suppkey % 26) || ':' || (s_suppkey % 61) END AS time, ROUND(s_acctbal, 0) AS duration_sec, s_suppkey AS k FROM supplier),
chk AS (SELECT *, CASE WHEN k % 26 < 24 AND k % 61 < 60 AND time IS NOT NULL THEN k % 26 END AS hour, k % 61 AS minute, COUNT(*) OVER (PARTITION BY intersection_id, label) AS uses FROM rt),
err AS (SELECT *, concat_ws(';', CASE WHEN time IS NULL THEN 'no time' END, CASE WHEN time IS NOT NULL AND hour IS NULL THEN 'bad time' END, CASE WHEN NOT duration_sec > 0 THEN 'duration not positive' END, CASE WHEN k % 9 = 0 THEN 'no cameras' END, CASE WHEN uses > 1 THEN 'label used twice' END) AS errors FROM chk)"""


@query(f"WITH {_ROUT} SELECT intersection_id, ordinal, label, errors FROM err")
def routine_errors(spark, sf_dir):
    return schedule.routine_errors(v.routines(spark, sf_dir)).select("intersection_id", "ordinal", "label", F.array_join("errors", ";").alias("errors"))


@query(f"WITH {_ROUT} SELECT intersection_id, label, COUNT(*) AS n FROM rt GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicate_labels(spark, sf_dir):
    return schedule.duplicate_labels(v.routines(spark, sf_dir))


@query(f"WITH {_ROUT} SELECT intersection_id, label, lpad(CAST(hour AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute AS VARCHAR), 2, '0') AS time, duration_sec FROM err WHERE errors = ''")
def routine_summary(spark, sf_dir):
    return schedule.summary(v.routines(spark, sf_dir))


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return schedule.due_routines(v.routines(spark, sf_dir), schedule.known_zones(spark), "2024-03-08", "2024-03-12")


#: Five days around a clock change in Boise, on 10 March 2024 at 2:00; Paris is an hour ahead throughout, zones that nobody knows read as UTC.
_DUE = f"""{_ROUT}, days AS (SELECT err.*, CAST(d AS DATE) AS local_date, d + to_hours(CAST(hour AS INTEGER)) + to_minutes(CAST(minute AS INTEGER)) AS moment, k % 4 AS z FROM err, range(TIMESTAMP '2024-03-08', TIMESTAMP '2024-03-13', INTERVAL 1 DAY) r(d) WHERE errors = ''),
due AS (SELECT *, ['UTC', 'America/Boise', 'Europe/Paris', 'UTC'][CAST(z AS INTEGER) + 1] AS timezone, epoch_us(moment) + CASE WHEN z = 1 AND moment < TIMESTAMP '2024-03-10 02:00:00' THEN 25200000000 WHEN z = 1 THEN 21600000000 WHEN z = 2 THEN -3600000000 ELSE 0 END AS fire_us FROM days
 WHERE NOT (z = 1 AND moment >= TIMESTAMP '2024-03-10 02:00:00' AND moment < TIMESTAMP '2024-03-10 03:00:00'))"""


@query(f"WITH {_DUE} SELECT intersection_id, label, CAST(local_date AS VARCHAR) AS local_date, fire_us, duration_sec FROM due")
def routine_due(spark, sf_dir):
    return _due(spark, sf_dir).select("intersection_id", "label", F.col("local_date").cast("string").alias("local_date"), "fire_us", "duration_sec")


@query(
    f"""WITH {v.DOCUMENTS}, {_DUE} SELECT trigger_id, action, fire_us / 1e6 AS event_timestamp, 'detector_disagreement' AS reason, intersection_id, 'UTC' AS timezone, cameras, max_duration_sec, rule_name AS rule, NULL AS label, NULL AS time FROM docs
UNION ALL SELECT sha256(intersection_id || '|' || label || '|' || local_date), 'start', fire_us / 1e6, 'routine_baseline', intersection_id, timezone, CASE WHEN k % 9 > 4 THEN 'C1' ELSE 'all' END, duration_sec, NULL, label, lpad(CAST(hour AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute AS VARCHAR), 2, '0') FROM due"""
)
def trigger_queue(spark, sf_dir):
    fired, pair = _fired(spark, sf_dir)
    zones = samples.events(spark, sf_dir).select("intersection_id", F.lit("UTC").alias("timezone")).distinct()
    rows = trig.oldest_first(trig.queue(trig.pair_payloads(fired, pair, zones), trig.routine_payloads(_due(spark, sf_dir))))
    m = F.col("metadata")
    return rows.select("trigger_id", "action", "event_timestamp", "reason", "intersection_id", "timezone", F.array_join("cameras", ",").alias("cameras"), "max_duration_sec", m["rule"].alias("rule"), m["scheduled_label"].alias("label"), m["scheduled_time"].alias("time"))


# --- clips --------------------------------------------------------------------------------------------

_TRIG = """tr AS (SELECT 'I' || ((o_orderkey // 3) % 5) AS intersection_id, 'T' || (o_orderkey // 3) AS trigger_id, CASE WHEN o_orderkey % 5 < 3 THEN 'start' ELSE 'stop' END AS action, epoch_us(o_orderdate) + o_orderkey * 1000003 AS us, CAST(TRUNC(o_totalprice * 10) AS BIGINT) AS max_sec, o_custkey AS c FROM orders),
sts AS (SELECT *, us AS start_us FROM tr WHERE action = 'start'),
lim AS (SELECT *, (SELECT MIN(t.us) FROM tr t WHERE t.intersection_id = s.intersection_id AND t.trigger_id = s.trigger_id AND t.action = 'stop' AND t.us >= s.us) AS stop_us, us + max_sec * 1000000 AS limit_us FROM sts s),
life AS (SELECT *, LEAST(stop_us, limit_us) AS end_us, CASE WHEN stop_us <= limit_us THEN 'stop' ELSE 'max_duration' END AS ended_by FROM lim)"""


@query(
    f"""WITH RECURSIVE {_TRIG}, kept AS (SELECT intersection_id, trigger_id, MIN(start_us) AS start_us FROM life GROUP BY 1, 2
UNION ALL SELECT k.intersection_id, k.trigger_id, (SELECT MIN(n.start_us) FROM life n WHERE n.intersection_id = k.intersection_id AND n.trigger_id = k.trigger_id AND n.start_us >= l.end_us AND n.start_us > k.start_us) FROM kept k JOIN life l USING (intersection_id, trigger_id, start_us) WHERE k.start_us IS NOT NULL)
SELECT intersection_id, trigger_id, start_us - 10000000 AS clip_start_us, start_us, end_us, ended_by FROM kept JOIN life USING (intersection_id, trigger_id, start_us)"""
)
def clip_windows(spark, sf_dir):
    return clips.windows(clips.lifecycle(v.triggers(spark, sf_dir))).select("intersection_id", "trigger_id", "clip_start_us", "start_us", "end_us", "ended_by")


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(F.lit("C1"), F.lit("C2"))
    started = clips.with_ends(v.triggers(spark, sf_dir)).withColumn("camera_id", clips.target_camera(F.col("cameras"), known))
    return clips.admission(started)


#: Starts one by one; ``running`` holds the clips that run, two at most.
_ADM = f"""RECURSIVE {_TRIG}, ord AS (SELECT *, CASE c % 3 WHEN 0 THEN 'C1' WHEN 1 THEN 'C2' END AS camera_id, ROW_NUMBER() OVER (PARTITION BY intersection_id ORDER BY start_us, trigger_id) AS n FROM life),
adm AS (SELECT DISTINCT intersection_id, 0::BIGINT AS n, NULL::VARCHAR AS trigger_id, NULL::BIGINT AS start_us, NULL::VARCHAR AS camera_id, NULL::BIGINT AS end_us, CAST([] AS STRUCT(id VARCHAR, e BIGINT)[]) AS running, NULL::VARCHAR AS drop_reason, NULL::BIGINT AS c FROM ord
UNION ALL SELECT intersection_id, n, trigger_id, start_us, camera_id, end_us, CASE WHEN reason IS NULL THEN list_append(live, {{'id': trigger_id, 'e': end_us}}) ELSE live END, reason, c
FROM (SELECT *, CASE WHEN list_contains(list_transform(live, lambda x: x.id), trigger_id) THEN 'duplicate' WHEN camera_id IS NULL THEN 'camera' WHEN len(live) >= 2 THEN 'cap' END AS reason
FROM (SELECT o.intersection_id, o.n, o.trigger_id, o.start_us, o.camera_id, o.end_us, o.c, list_filter(a.running, lambda x: x.e > o.start_us) AS live FROM adm a JOIN ord o ON o.intersection_id = a.intersection_id AND o.n = a.n + 1)))"""


@query(f"WITH {_ADM} SELECT intersection_id, trigger_id, start_us, end_us, camera_id, drop_reason FROM adm WHERE n > 0")
def clip_admission(spark, sf_dir):
    return _admitted(spark, sf_dir).select("intersection_id", "trigger_id", "start_us", "end_us", "camera_id", "drop_reason")


# zones without clock changes, and one that nobody knows
@query(
    f"""WITH {_ADM} SELECT strftime(make_timestamp(start_us + [0, 19800000000, -25200000000, 0][CAST(c % 4 AS INTEGER) + 1]), '%Y-%m-%d %H:%M:%S ') || ['UTC', 'IST', 'MST', 'UTC'][CAST(c % 4 AS INTEGER) + 1] AS "Local_Timestamp", trigger_id AS "Trigger_ID", trigger_id || '_' || camera_id || '_' || (start_us // 1000000) || '.mp4' AS "Video_Filename", 'rule2_orphan_pulse' AS "Rule_Type", camera_id AS "Det_A", '2' AS "Det_B", '-' AS "Description"
FROM adm WHERE n > 0 AND drop_reason IS NULL AND c % 2 = 0"""
)
def discrepancy_log(spark, sf_dir):
    meta = F.struct(F.lit(rules.RULES[2]).alias("rule"), F.col("camera_id").alias("det_a"), F.lit("2").alias("det_b"), F.lit("-").alias("description"))
    zone = F.get(F.array(*map(F.lit, ("UTC", "Asia/Kolkata", "America/Phoenix", "No/Where"))), (F.col("custkey") % 4).cast("int"))
    return clips.discrepancy_log(_admitted(spark, sf_dir).withColumn("timezone", zone).withColumn("metadata", meta))


_CLIP = f"{v.EV}, cl AS (SELECT intersection_id, 'T' || event_id AS trigger_id, 'C' || ((user_id // 4) % 3) AS camera_id, us AS start_us, us + 18000000000 AS end_us FROM ev), fr AS (SELECT intersection_id, 'C' || ((user_id // 4) % 3) AS camera_id, us AS frame_us, event_id AS seq FROM ev), tk AS (SELECT *, LEAST(end_us, LEAD(start_us) OVER (PARTITION BY intersection_id, camera_id ORDER BY start_us, trigger_id)) AS feed_end_us FROM cl)"


@query(f"WITH {_CLIP} SELECT intersection_id, trigger_id, camera_id, start_us, feed_end_us FROM tk")
def camera_takeover(spark, sf_dir):
    return clips.takeover(v.clip_inputs(spark, sf_dir)).select("intersection_id", "trigger_id", "camera_id", "start_us", "feed_end_us")


@query(f"WITH {_CLIP} SELECT cl.intersection_id, trigger_id, fr.camera_id, frame_us, seq FROM cl JOIN fr ON fr.intersection_id = cl.intersection_id AND fr.camera_id = cl.camera_id AND frame_us >= start_us - 3600000000 AND frame_us < start_us QUALIFY ROW_NUMBER() OVER (PARTITION BY trigger_id ORDER BY frame_us DESC, seq DESC) <= 3")
def preroll_frames(spark, sf_dir):
    return clips.preroll_frames(v.clip_inputs(spark, sf_dir), v.frames(spark, sf_dir), 3 / 3600, 3_600_000_000)


@query(f"WITH {_CLIP}, m AS (SELECT tk.intersection_id, trigger_id, fr.camera_id, frame_us, seq FROM tk JOIN fr ON fr.intersection_id = tk.intersection_id AND fr.camera_id = tk.camera_id AND frame_us >= start_us - 3600000000 AND frame_us < feed_end_us QUALIFY LAG(frame_us) OVER (PARTITION BY trigger_id ORDER BY frame_us, seq) IS DISTINCT FROM frame_us) SELECT *, ROW_NUMBER() OVER (PARTITION BY trigger_id ORDER BY frame_us, seq) AS place FROM m")
def frame_manifest(spark, sf_dir):
    planned = clips.windows(clips.takeover(v.clip_inputs(spark, sf_dir)))
    return clips.frame_manifest(planned, v.frames(spark, sf_dir), 3_600_000_000)
