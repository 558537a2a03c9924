"""Traffic-shaped inputs made of the given tables, in Spark and, as common table expressions, in DuckDB's SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions.signals import micros
from phasegrid.operators import decode, pairs
from phasegrid.sources import oids, samples

#: Spans for events that are minutes apart: threshold, post-roll, cooldown in seconds.
THRESHOLD, POST_ROLL, COOLDOWN = 3600, 1800, 14400


def states(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return decode.states(samples.samples(spark, sf_dir), oids.oid_dim(spark), kinds)


def masks(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    dim = oids.oid_dim(spark)
    found = decode.masks(samples.samples(spark, sf_dir), decode.of_kinds(dim, kinds) if kinds else dim)
    return found.filter(F.col("kind").isin(*kinds)) if kinds else found


def detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six detectors of each intersection that events name, in three pairs; A lists first, its partner names it back."""
    ids = samples.events(spark, sf_dir).select("intersection_id").distinct()
    n = F.col("n")
    listed = ids.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return listed.select(
        "intersection_id", n.cast("string").alias("detector_id"), n.alias("ordinal"), F.when(n % 2 == 1, "radar").otherwise("loop").alias("type"), ((n + 1) / 2).cast("int").alias("phase"),
        F.when(n % 2 == 1, n + 1).otherwise(n - 1).cast("string").alias("paired_detector_id"), F.when(n != 3, F.concat(F.lit("C"), (n % 2).cast("string"))).alias("camera_id"), F.lit(float(THRESHOLD)).alias("lag_threshold_sec"),
    )


def pair_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, pairs)."""
    return pairs.edges(samples.detector_samples(spark, sf_dir)), pairs.detector_pairs(detectors(spark, sf_dir))


def routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as routines, some of them wrong."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    zones = F.array(*map(F.lit, ("UTC", "America/Boise", "Europe/Paris", "No/Where")))
    return s.select(
        F.concat(F.lit("I"), (k % 7).cast("string")).alias("intersection_id"), k.cast("int").alias("ordinal"), F.when(k % 5 == 0, F.concat(F.lit("L"), (k % 2).cast("string"))).otherwise(F.col("s_name")).alias("label"),
        F.when(k % 13 != 0, F.concat_ws(":", (k % 26).cast("string"), (k % 61).cast("string"))).alias("time"), F.round(F.col("s_acctbal"), 0).alias("duration_sec"), F.when(k % 9 == 0, F.array().cast("array<string>")).when(k % 9 > 4, F.array(F.lit("C1"))).alias("cameras"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("pre_roll_sec"), F.get(zones, (k % 4).cast("int")).alias("timezone"),
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as triggers: two or three orders of a customer share an id; the first by time may start it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    action = F.when(k % 5 < 3, "start").when(k % 5 == 3, "stop").otherwise("extend")
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k * 1_000_003
    return o.select(
        F.concat(F.lit("I"), (F.floor(k / 3) % 5).cast("string")).alias("intersection_id"), F.concat(F.lit("T"), F.floor(k / 3).cast("string")).alias("trigger_id"), action.alias("action"), day.alias("us"), (F.col("o_totalprice") * 10).cast("int").cast("double").alias("max_duration_sec"),
        F.when(c % 3 == 0, F.array(F.lit("all"))).when(c % 3 == 1, F.array(F.lit("C9"), F.lit("C2"))).otherwise(F.array(F.lit("C9"))).alias("cameras"), F.lit(10.0).alias("pre_roll_sec"), F.when(c % 2 == 0, "detector_disagreement").otherwise("routine_baseline").alias("reason"), c.alias("custkey"),
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as configurations: suppliers are their detectors, every third nation lacks a key, some documents are broken."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").cast("int").alias("k"), F.col("s_suppkey").cast("int").alias("d"))
    kinds = F.array(*map(F.lit, ("radar", "loop", "video", "laser")))
    one = F.struct(F.get(kinds, F.when(F.col("k") % 4 == 1, F.col("d") % 4).otherwise(F.col("d") % 3)).alias("type"), (F.col("d") % 8 + 1).alias("phase"), F.concat(F.lit("C"), (F.col("d") % F.when(F.col("k") % 5 == 2, 3).otherwise(2)).cast("string")).alias("camera_id"), (F.col("d") + 25).cast("string").alias("paired_detector_id"))
    dets = s.withColumn("det", one).groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("d").cast("string").alias("d"), "det")))).alias("detectors"))
    cams = F.create_map(F.lit("C0"), F.struct(F.lit("rtsp://u:p@camera.invalid/1").alias("url")), F.lit("C1"), F.struct(F.lit("rtsp://camera.invalid/2").alias("url")))
    ident = F.concat(F.lit("N"), F.col("k").cast("string"))
    doc = F.to_json(F.struct(ident.alias("intersection_id"), F.when(F.col("k") % 3 != 0, F.lit("192.0.2.1")).alias("controller_ip"), F.lit(161).alias("snmp_port"), F.lit("UTC").alias("timezone"), cams.alias("cameras"), "detectors", (F.col("k") / 10).alias("poll_interval_sec")))
    return n.join(dets, "k").select(ident.alias("intersection_id"), F.when(F.col("k") % 6 != 5, doc).otherwise(F.lit("{broken")).alias("config_json"), F.col("k").cast("double").alias("updated_at"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.frames(spark, sf_dir)


def clip_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a clip on a camera of frames: five hours each, one hour of pre-roll."""
    e = samples.events(spark, sf_dir)
    return e.select("intersection_id", F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("trigger_id"), F.expr(samples.CAMERA).alias("camera_id"), F.col("us").alias("start_us"), (F.col("us") + 18_000_000_000).alias("end_us"), F.lit(3600.0).alias("pre_roll_sec"))



EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, 'I' || CAST(user_id % 4 AS VARCHAR) AS intersection_id FROM events)"""

_DIM = "dim(oid, kind, grp, channel, base_num) AS (VALUES " + ", ".join(f"('{o}', '{k}', {g}, '{c}', {b})" for o, k, g, c, b in oids.oid_rows()) + ")"
_READ = " UNION ALL ".join(
    f"SELECT intersection_id, us AS poll_us, event_id * 16 + {j} AS seq, {oid} AS oid, CAST({value} AS INTEGER) AS value, CASE WHEN event_type = 'error' AND {j} >= event_id % 11 THEN 'ERR' ELSE 'OK' END AS status FROM ev" + (" WHERE event_id % 11 <> 0" if j == 1 else "")
    for j, (oid, value) in enumerate(samples.READINGS)
)
RAW = f"{EV}, {_DIM}, raw AS ({_READ}), res AS (SELECT raw.*, kind, grp, channel, base_num FROM raw JOIN dim USING (oid))"
USED = f"""{RAW}, fam AS (SELECT *, MIN(CASE WHEN status <> 'OK' THEN seq END) OVER (PARTITION BY intersection_id, poll_us, CASE WHEN kind IN ('phase', 'overlap') THEN 'signal' ELSE kind END) AS failed FROM res),
used AS (SELECT * FROM fam WHERE failed IS NULL OR (kind <> 'detector' AND seq < failed)),
polls AS (SELECT intersection_id, kind, grp, base_num, poll_us, MIN(seq) AS seq, MAX(value) FILTER (channel = 'red') AS red, MAX(value) FILTER (channel = 'yellow') AS yellow, MAX(value) FILTER (channel = 'green') AS green
 FROM used WHERE kind IN ('phase', 'overlap', 'ped') GROUP BY ALL HAVING COUNT(DISTINCT channel) = 3)"""
STATES = f"""{USED}, st AS (
 SELECT intersection_id, kind, CAST(base_num + i AS INTEGER) AS num, poll_us AS us, seq, CASE WHEN (green >> i) & 1 = 1 THEN 'GREEN' WHEN (yellow >> i) & 1 = 1 THEN 'YELLOW' WHEN (red >> i) & 1 = 1 THEN 'RED' ELSE 'DARK' END AS state FROM polls, (SELECT CAST(range AS INTEGER) AS i FROM range(8))
 UNION ALL SELECT intersection_id, kind, CAST(base_num + i AS INTEGER), poll_us, seq, CASE WHEN (value >> i) & 1 = 1 THEN 'ACTIVE' ELSE 'INACTIVE' END FROM used, (SELECT CAST(range AS INTEGER) AS i FROM range(8)) WHERE kind = 'detector'
 UNION ALL SELECT intersection_id, kind, base_num, poll_us, seq, CASE WHEN value = 1 THEN 'ON' ELSE 'OFF' END FROM used WHERE kind = 'output')"""
CHANGES = f"""{STATES}, lagged AS (SELECT *, LAG(state) OVER w AS old_state, ROW_NUMBER() OVER w AS n FROM st WINDOW w AS (PARTITION BY intersection_id, kind, num ORDER BY us, seq)),
ch AS (SELECT intersection_id, kind, num, us, seq, old_state, state AS new_state, n = 1 AS initial FROM lagged WHERE n = 1 OR state <> old_state)"""
EDGES = f"""{EV}, ds AS (SELECT intersection_id, CAST((user_id // 4) % 3 * 2 + CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 2 END AS VARCHAR) AS detector_id, us, event_id AS seq, k % 2 = 1 AS is_on FROM ev),
dl AS (SELECT *, LAG(is_on) OVER (PARTITION BY intersection_id, detector_id ORDER BY us, seq) AS was FROM ds),
ed AS (SELECT intersection_id, detector_id, us, seq, is_on, CAST((CAST(detector_id AS INTEGER) + 1) // 2 AS INTEGER) AS p, CASE WHEN CAST(detector_id AS INTEGER) % 2 = 1 THEN 'a' ELSE 'b' END AS side, was FROM dl WHERE was IS NULL OR was <> is_on)"""
PAIR_KEY = "CAST(2 * p - 1 AS VARCHAR) || ':' || CAST(2 * p AS VARCHAR)"
TIMELINE = f"""{EDGES}, seen AS (SELECT intersection_id, p, us, seq, COALESCE(LAST_VALUE(CASE WHEN side = 'a' THEN is_on END IGNORE NULLS) OVER w, FALSE) AS a_on, COALESCE(LAST_VALUE(CASE WHEN side = 'b' THEN is_on END IGNORE NULLS) OVER w, FALSE) AS b_on
 FROM ed WINDOW w AS (PARTITION BY intersection_id, p ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tl AS (SELECT intersection_id, p, us, a_on, b_on FROM seen QUALIFY ROW_NUMBER() OVER (PARTITION BY intersection_id, p, us ORDER BY seq DESC) = 1)"""
ISLANDS = f"""{TIMELINE}, tw AS (SELECT *, a_on <> b_on AS differ, LEAD(us) OVER w AS next_us, LAG(a_on <> b_on) OVER w AS before FROM tl WINDOW w AS (PARTITION BY intersection_id, p ORDER BY us)),
tg AS (SELECT *, SUM(CASE WHEN before IS NULL OR before <> differ THEN 1 ELSE 0 END) OVER (PARTITION BY intersection_id, p ORDER BY us) AS span FROM tw),
isl AS (SELECT intersection_id, p, span, MIN(us) AS start_us, ARG_MAX(COALESCE(next_us, -1), us) AS end_raw, ARG_MAX(a_on, us) AS a_leads FROM tg WHERE differ GROUP BY 1, 2, 3),
islands AS (SELECT intersection_id, p, start_us, NULLIF(end_raw, -1) AS end_us, a_leads FROM isl)"""
PULSES = f"""{EDGES}, pw AS (SELECT *, LAST_VALUE(CASE WHEN is_on THEN us END IGNORE NULLS) OVER (PARTITION BY intersection_id, detector_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS on_us FROM ed),
pulses AS (SELECT intersection_id, detector_id, p, side, on_us, us AS off_us, seq FROM pw WHERE NOT is_on AND on_us IS NOT NULL)"""
ORPHANS = f"""{PULSES}, nx AS (SELECT *, LEAD(us) OVER (PARTITION BY intersection_id, detector_id ORDER BY us, seq) AS off_us FROM ed), iv AS (SELECT intersection_id, p, side, us AS on_us, COALESCE(off_us, 9000000000000000000) AS off_us FROM nx WHERE is_on),
orphans AS (SELECT c.*, off_us + {THRESHOLD}000000 AS at_us FROM pulses c WHERE off_us - on_us > 0 AND off_us - on_us < {THRESHOLD}000000
 AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.intersection_id = c.intersection_id AND iv.p = c.p AND iv.side <> c.side AND iv.on_us <= c.off_us + {THRESHOLD}000000 AND iv.off_us > c.on_us - {THRESHOLD}000000))"""
#: The pair evaluator, an edge's instant or a deadline a step: n edges and o orphans are done; d is since when the sides differ, act when the
#: active disagreement fired, ag since when the sides agree again, c until when the pair cools down.
FIRED = f"""RECURSIVE {ORPHANS},
es AS (SELECT *, COALESCE(LAST_VALUE(CASE WHEN side = 'a' THEN is_on END IGNORE NULLS) OVER w, FALSE) AS a_on, COALESCE(LAST_VALUE(CASE WHEN side = 'b' THEN is_on END IGNORE NULLS) OVER w, FALSE) AS b_on
 FROM ed WINDOW w AS (PARTITION BY intersection_id, p ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
eg AS (SELECT intersection_id, p, us, ARG_MAX(a_on, seq) AS a_on, ARG_MAX(b_on, seq) AS b_on, BOOL_OR(was IS NOT NULL AND NOT is_on AND NOT a_on AND NOT b_on) AS reset, ROW_NUMBER() OVER (PARTITION BY intersection_id, p ORDER BY us) AS n FROM es GROUP BY 1, 2, 3),
og AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY intersection_id, p ORDER BY at_us, side, on_us) AS n FROM orphans),
ends AS (SELECT intersection_id, p, MAX(us) AS last_us FROM eg GROUP BY 1, 2),
mach AS (
 SELECT intersection_id, p, 0::BIGINT AS n, 0::BIGINT AS o, FALSE AS a, FALSE AS b, NULL::BIGINT AS d, NULL::BIGINT AS act, NULL::BIGINT AS ag, NULL::BIGINT AS c, NULL::VARCHAR AS action, NULL::INTEGER AS rule, NULL::VARCHAR AS side, NULL::BIGINT AS fire_us, NULL::BIGINT AS named_us, NULL::BIGINT AS pulse_us, NULL::BIGINT AS length_us FROM ends
 UNION ALL
 SELECT intersection_id, p, CASE WHEN k = -1 THEN n + 1 ELSE n END, CASE WHEN k = 3 THEN o + 1 ELSE o END, CASE WHEN k = -1 THEN a_on ELSE a END, CASE WHEN k = -1 THEN b_on ELSE b END,
  CASE WHEN k = -1 AND act IS NULL AND (c IS NULL OR reset) THEN CASE WHEN a_on <> b_on THEN COALESCE(d, t) END WHEN k = 0 THEN CASE WHEN a <> b THEN t END WHEN k IN (1, 2) OR fires THEN NULL ELSE d END,
  CASE k WHEN 1 THEN t WHEN 2 THEN NULL ELSE act END,
  CASE WHEN k = -1 AND act IS NOT NULL THEN CASE WHEN a_on = b_on THEN COALESCE(ag, t) END WHEN k IN (1, 2) THEN NULL ELSE ag END,
  CASE WHEN k = -1 AND reset THEN NULL WHEN k = 0 THEN NULL WHEN k = 2 OR fires THEN t + {COOLDOWN}000000 ELSE c END,
  CASE WHEN k = 1 OR fires THEN 'start' WHEN k = 2 THEN 'stop' END, CASE WHEN k IN (1, 2) THEN 1 WHEN fires THEN 2 END, CASE WHEN k = 1 THEN CASE WHEN a THEN 'a' ELSE 'b' END WHEN fires THEN oside END, t, CASE WHEN k = 2 THEN act ELSE t END, CASE WHEN fires THEN on_us END, CASE WHEN fires THEN off_us - on_us END
 FROM (SELECT *, k = 3 AND act IS NULL AND c IS NULL AS fires FROM (
  SELECT *, CASE t WHEN eu THEN -1 WHEN c THEN 0 WHEN t1 THEN 1 WHEN t2 THEN 2 ELSE 3 END AS k FROM (
   SELECT *, LEAST(eu, c, t1, t2, at_us) AS t FROM (
    SELECT m.intersection_id, m.p, m.n, m.o, m.a, m.b, m.d, m.act, m.ag, m.c, eg.us AS eu, eg.a_on, eg.b_on, eg.reset, og.at_us, og.side AS oside, og.on_us, og.off_us, ends.last_us, CASE WHEN m.act IS NULL AND m.c IS NULL THEN m.d + {THRESHOLD}000000 END AS t1, CASE WHEN m.act IS NOT NULL THEN m.ag + {POST_ROLL}000000 END AS t2
    FROM mach m JOIN ends USING (intersection_id, p) LEFT JOIN eg ON eg.intersection_id = m.intersection_id AND eg.p = m.p AND eg.n = m.n + 1 LEFT JOIN og ON og.intersection_id = m.intersection_id AND og.p = m.p AND og.n = m.o + 1)))
  WHERE t IS NOT NULL AND (eu IS NOT NULL OR t <= last_us))),
fired AS (SELECT intersection_id, {PAIR_KEY} AS pair_key, p, sha256(intersection_id || '|' || {PAIR_KEY} || '|' || named_us || '|' || rule) AS trigger_id, action, rule, side, fire_us, CASE WHEN action = 'stop' THEN 0.0 WHEN rule = 1 THEN {THRESHOLD}.0 ELSE ROUND(length_us / 1e6, 3) END::DOUBLE AS disagreement_sec, CASE WHEN rule = 1 THEN 300.0 ELSE ROUND((10000000 + length_us + {POST_ROLL}000000 + {THRESHOLD}000000) / 1e6, 3) END::DOUBLE AS max_duration_sec, pulse_us FROM mach WHERE action IS NOT NULL)"""
#: Their documents; seconds to the thousandth by whole numbers.
_MS = "printf('%d.%03d', ({0} + 500) // 1000 // 1000, ({0} + 500) // 1000 % 1000)"
_LED, _OTHER = "CAST(CASE side WHEN 'b' THEN 2 * p ELSE 2 * p - 1 END AS VARCHAR)", "CAST(CASE side WHEN 'b' THEN 2 * p - 1 ELSE 2 * p END AS VARCHAR)"
DOCUMENTS = f"""{FIRED}, docs AS (SELECT *, CAST(2 * p - 1 AS VARCHAR) AS det_a, CAST(2 * p AS VARCHAR) AS det_b, CASE p WHEN 2 THEN 'C0' ELSE 'C1,C0' END AS cameras, CASE rule WHEN 1 THEN 'rule1_continuous_disagreement' ELSE 'rule2_orphan_pulse' END AS rule_name,
 CASE WHEN action = 'stop' THEN 'Rule 1 recording stopped after 20.0s post-roll' WHEN rule = 1 THEN 'detector ''' || {_LED} || ''' ON, detector ''' || {_OTHER} || ''' OFF for {THRESHOLD}.0s (threshold={THRESHOLD}.0s)' ELSE 'orphan on detector ''' || {_LED} || ''': orphan pulse duration=' || disagreement_sec || 's window=[' || {_MS.format(f"(pulse_us - {THRESHOLD}000000)")} || ', ' || {_MS.format("fire_us")} || ']' END AS description FROM fired)"""
