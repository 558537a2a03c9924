"""Intersection configurations: JSON documents, a table of blobs, their validation and flattening."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Required keys and allowed values, fixed by the configuration format.
REQUIRED_TOP = ("intersection_id", "controller_ip", "snmp_port", "cameras", "detectors", "timezone")
REQUIRED_CAMERA = ("url",)
REQUIRED_DETECTOR = ("type", "phase", "camera_id")
DETECTOR_TYPES = ("radar", "loop", "video")
#: Polling faster than this is only warned about.
MIN_POLL_SEC = 0.5

CAMERA = "struct<url:string,description:string,pre_roll_sec:double,post_roll_sec:double>"
DETECTOR = "struct<type:string,phase:int,description:string,paired_detector_id:string,camera_id:string,lag_threshold_sec:double>"
ROUTINE = "struct<label:string,time:string,duration_sec:double,cameras:array<string>,reason:string,pre_roll_sec:double>"
CONFIG = f"struct<intersection_id:string,description:string,controller_ip:string,snmp_port:int,poll_interval_sec:double,timezone:string,cameras:map<string,{CAMERA}>,detectors:map<string,{DETECTOR}>,routine_recordings:array<{ROUTINE}>>"


@dataclass
class Config:
    """The tables of a set of configurations."""

    intersections: DataFrame
    cameras: DataFrame
    detectors: DataFrame
    routines: DataFrame
    errors: DataFrame


def read_config_file(spark: SparkSession, path: str) -> DataFrame:
    """(intersection_id, config_json) of a JSON file, or files, whose object maps ids to configurations.

    A file that isn't such an object gives no rows here and one in ``broken_files``.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(F.explode("m").alias("intersection_id", "config_json"))


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose content isn't a JSON object."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return text.filter(F.from_json("value", "map<string,string>").isNull() | (F.size(F.coalesce(F.from_json("value", "map<string,string>"), F.create_map())) == 0)).select("file")


def latest_config(blobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Blobs (intersection_id, config_json, updated_at) after an upsert: the newest of an id wins."""
    newest = Window.partitionBy("intersection_id").orderBy(F.desc("updated_at"), F.desc("config_json"))
    return blobs.unionByName(updates).withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")


def _missing(present: Column, required: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def config_errors(blobs: DataFrame) -> DataFrame:
    """(intersection_id, errors): all that is wrong with each configuration, sorted; sound ones have an empty list."""
    keys = F.coalesce(F.json_object_keys("config_json"), F.array().cast("array<string>"))
    entries = lambda name: F.map_entries(F.coalesce(F.from_json(F.get_json_object("config_json", f"$.{name}"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    cameras = F.map_keys(F.coalesce(F.from_json(F.get_json_object("config_json", "$.cameras"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    top = F.transform(_missing(keys, REQUIRED_TOP), lambda k: F.concat(F.lit("missing "), k))
    cam = F.flatten(F.transform(entries("cameras"), lambda e: F.transform(_missing(F.json_object_keys(e["value"]), REQUIRED_CAMERA), lambda k: F.concat(F.lit("camera "), e["key"], F.lit(" missing "), k))))

    def detector(e: Column) -> Column:
        kind, ref = F.get_json_object(e["value"], "$.type"), F.get_json_object(e["value"], "$.camera_id")
        bad_type = F.when(~kind.isin(*DETECTOR_TYPES), F.concat(F.lit("detector "), e["key"], F.lit(" has type "), kind))
        bad_camera = F.when((ref != "") & ~F.array_contains(F.col("__cameras"), ref), F.concat(F.lit("detector "), e["key"], F.lit(" names camera "), ref))
        lacks = F.transform(_missing(F.json_object_keys(e["value"]), REQUIRED_DETECTOR), lambda k: F.concat(F.lit("detector "), e["key"], F.lit(" missing "), k))
        return F.concat(lacks, F.array_compact(F.array(bad_type, bad_camera)))

    broken = F.when(F.json_object_keys("config_json").isNull(), F.array(F.lit("no JSON object")))
    found = F.coalesce(broken, F.array_sort(F.concat(top, cam, F.flatten(F.transform(entries("detectors"), detector)))))
    return blobs.withColumn("__cameras", cameras).select("intersection_id", found.alias("errors"))


def load_config(blobs: DataFrame) -> Config:
    """Flattened configurations; those with errors are in ``errors`` only."""
    errors = config_errors(blobs)
    sound = blobs.join(errors.filter(F.size("errors") == 0).select("intersection_id"), "intersection_id", "left_semi")
    c = sound.select("intersection_id", F.from_json("config_json", CONFIG).alias("c"))

    def entries(name: str, key: str) -> DataFrame:
        rows = c.select("intersection_id", F.posexplode(F.map_entries(f"c.{name}")).alias("ordinal", "e"))
        return rows.select("intersection_id", F.col("e.key").alias(key), "ordinal", "e.value.*")

    return Config(
        c.select("intersection_id", *[f"c.{n}" for n in ("description", "controller_ip", "snmp_port", "poll_interval_sec", "timezone")], (F.col("c.poll_interval_sec") < MIN_POLL_SEC).alias("polls_fast")),
        entries("cameras", "camera_id"),
        entries("detectors", "detector_id"),
        c.select("intersection_id", F.posexplode("c.routine_recordings").alias("ordinal", "r")).select("intersection_id", "ordinal", "r.*"),
        errors.filter(F.size("errors") > 0),
    )


def listed_ids(blobs: DataFrame) -> DataFrame:
    """The ids, sorted."""
    return blobs.select("intersection_id").distinct().orderBy("intersection_id")


def looked_up(wanted: DataFrame, dimension: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``wanted`` keys with their row of the dimension, and ``missing`` where there is none."""
    return wanted.join(dimension.withColumn("__found", F.lit(True)), list(key), "left").withColumn("missing", F.col("__found").isNull()).drop("__found")


def stream_map(cameras: DataFrame) -> DataFrame:
    """For each intersection its cameras' addresses, user names and passwords cut out."""
    safe = F.regexp_replace("url", "//[^/@]*@", "//")
    return cameras.groupBy("intersection_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("camera_id", safe.alias("url"))))).alias("streams"))


def roll_defaults(cameras: DataFrame) -> DataFrame:
    """Pre- and post-roll of an intersection: the first listed camera's, else 10 and 20 seconds."""
    first = lambda name, default: F.coalesce(F.min_by(name, "ordinal"), F.lit(default)).alias(name)
    return cameras.groupBy("intersection_id").agg(first("pre_roll_sec", 10.0), first("post_roll_sec", 20.0))


def dangling_cameras(detectors: DataFrame, cameras: DataFrame) -> DataFrame:
    """Detectors whose camera isn't listed."""
    return detectors.filter(F.coalesce(F.col("camera_id"), F.lit("")) != "").join(cameras.select("intersection_id", "camera_id"), ["intersection_id", "camera_id"], "left_anti")


def settings_with_default(raw: DataFrame, default_json: str) -> DataFrame:
    """Settings documents; one that is absent or can't be read is replaced whole by the default."""
    usable = F.when(F.json_object_keys("raw").isNotNull(), F.col("raw"))
    return raw.withColumn("raw", F.coalesce(usable, F.lit(default_json)))
