"""Trigger documents: building, naming, writing and reading them, and what becomes of broken ones."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phasegrid.functions.signals import known_zone, local_text
from phasegrid.operators.rules import describe_rule1, describe_rule2, describe_stop, rule_name

#: Fixed field names of trigger documents.
METADATA = "struct<det_a:string,det_b:string,det_a_type:string,det_b_type:string,det_a_phase:int,det_b_phase:int,rule:string,description:string,disagreement_sec:double,scheduled_label:string,scheduled_time:string,trigger_source:string>"
TRIGGER = f"trigger_id string, action string, event_timestamp double, reason string, intersection_id string, timezone string, cameras array<string>, pre_roll_sec double, post_roll_sec double, max_duration_sec double, metadata {METADATA}"
#: Keys without which a document is no trigger, and actions that are known.
REQUIRED = ("trigger_id", "action", "event_timestamp")
ACTIONS = ("start", "stop", "extend")


def deterministic_id(*parts: Column) -> Column:
    """An id that a replay gives again."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def pair_payloads(fired: DataFrame, pairs: DataFrame, intersections: DataFrame, pre_roll_sec: float = 10.0, post_roll_sec: float = 20.0) -> DataFrame:
    """Trigger documents of the pair evaluator's rows, with both detectors' metadata."""
    rows = fired.join(pairs, ["intersection_id", "pair_key"]).join(intersections.select("intersection_id", "timezone"), "intersection_id", "left")
    pulsing, silent = F.when(F.col("side") == "b", F.col("det_b")).otherwise(F.col("det_a")), F.when(F.col("side") == "b", F.col("det_a")).otherwise(F.col("det_b"))
    spent, threshold = F.col("disagreement_sec"), F.col("threshold_us")
    text = F.when(F.col("action") == "stop", describe_stop(post_roll_sec)).when(F.col("rule") == 1, describe_rule1(pulsing, silent, spent, threshold / 1e6)).otherwise(describe_rule2(pulsing, spent, F.col("pulse_us"), F.col("fire_us"), threshold))
    none = F.lit(None).cast("string")
    meta = F.struct("det_a", "det_b", "det_a_type", "det_b_type", "det_a_phase", "det_b_phase", rule_name(F.col("rule")).alias("rule"), text.alias("description"), "disagreement_sec", none.alias("scheduled_label"), none.alias("scheduled_time"), F.lit("pair_evaluator").alias("trigger_source"))
    return rows.select("trigger_id", "action", (F.col("fire_us") / 1e6).alias("event_timestamp"), F.lit("detector_disagreement").alias("reason"), "intersection_id", known_zone(F.col("timezone")).alias("timezone"), "cameras", F.lit(pre_roll_sec).alias("pre_roll_sec"), F.lit(post_roll_sec).alias("post_roll_sec"), "max_duration_sec", meta.alias("metadata"))


def routine_payloads(due: DataFrame) -> DataFrame:
    """Trigger documents of due routines; always starts, with the intersection's zone."""
    none = F.lit(None).cast("string")
    meta = F.struct(
        *[none.alias(n) for n in ("det_a", "det_b", "det_a_type", "det_b_type")], F.lit(None).cast("int").alias("det_a_phase"), F.lit(None).cast("int").alias("det_b_phase"), none.alias("rule"), none.alias("description"), F.lit(None).cast("double").alias("disagreement_sec"),
        F.col("label").alias("scheduled_label"), F.format_string("%02d:%02d", "hour", "minute").alias("scheduled_time"), F.lit("schedule").alias("trigger_source"),
    )
    ident = deterministic_id(F.col("intersection_id"), F.col("label"), F.col("local_date").cast("string"))
    return due.select(ident.alias("trigger_id"), F.lit("start").alias("action"), (F.col("fire_us") / 1e6).alias("event_timestamp"), "reason", "intersection_id", "timezone", "cameras", "pre_roll_sec", F.lit(0.0).alias("post_roll_sec"), F.col("duration_sec").alias("max_duration_sec"), meta.alias("metadata"))


def queue(*producers: DataFrame) -> DataFrame:
    """All producers' triggers as one table."""
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def oldest_first(triggers: DataFrame) -> DataFrame:
    """Triggers in the order in which they are to be handled."""
    return triggers.orderBy("event_timestamp", "trigger_id")


def trigger_file_name(us: Column, zone: Column, trigger_id: Column) -> Column:
    """The name of a trigger's document: local time and the first eight characters of its id."""
    return F.concat(F.lit("trigger_"), local_text(us, zone, "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("_"), F.substring(trigger_id, 1, 8), F.lit(".json"))


def write_triggers(df: DataFrame, path: str) -> None:
    """Appends documents, one a line; Spark's committer shows whole files only.  For a file each, see ``documents.write_documents``."""
    df.write.mode("append").json(path)


def trigger_reader(spark: SparkSession, stream: bool = False, glob: str = "*.json", multi_line: bool = True, clean: str = "off", files: int | None = None):
    """A reader of trigger documents; a stream takes the oldest files first, ``files`` of them at a time."""
    reader = spark.read
    if stream:
        reader = spark.readStream.option("cleanSource", clean).option("latestFirst", False)
        reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.schema(f"{TRIGGER}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", multi_line).option("pathGlobFilter", glob).option("ignoreMissingFiles", True)


def read_triggers(spark: SparkSession, path: str, stream: bool = False, glob: str = "*.json", multi_line: bool = True, clean: str = "off", files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of a folder of documents.

    ``clean``: what a stream does with files it has read: off, delete or archive.
    """
    return validated(trigger_reader(spark, stream, glob, multi_line, clean, files).json(path))


def handle_triggers(spark: SparkSession, path: str, checkpoint: str, handler: Callable[[DataFrame, DataFrame, int], None], files: int = 1000, clean: str = "delete", glob: str = "trigger_*.json", **trigger) -> StreamingQuery:
    """Hands a folder's documents to ``handler(valid, quarantine, batch)``, oldest files first, and does away with files it has handled.

    Rows come by the time of their file (``file_us``), then by its name, and a batch
    holds the oldest ``files`` that weren't handled yet.  A file goes once the batch
    after its own has begun, as then its own is committed; one that a batch is begun
    with again is handed over again, with the batch's number, and no other is.
    """
    origin = (F.unix_micros("_metadata.file_modification_time").alias("file_us"), F.col("_metadata.file_name").alias("file_name"))
    rows = trigger_reader(spark, True, glob, True, clean, files).json(path).select("*", *origin)

    def handle(batch: DataFrame, number: int) -> None:
        valid, quarantine = validated(batch)
        handler(valid.orderBy("file_us", "file_name"), quarantine.orderBy("file_us", "file_name"), number)

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()


def trigger_errors(df: DataFrame) -> Column:
    """What is wrong with each row: missing keys, an unknown action, or text that is no JSON."""
    wrong = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in REQUIRED] + [F.when(~F.col("action").isin(*ACTIONS), F.concat(F.lit("unknown action "), F.col("action")))]
    if "_corrupt_record" in df.columns:
        wrong.append(F.when(F.col("_corrupt_record").isNotNull(), F.lit("no JSON")))
    return F.array_compact(F.array(*wrong))


def validated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of trigger rows."""
    marked = df.withColumn("errors", trigger_errors(df))
    return marked.filter(F.size("errors") == 0).drop("errors", "_corrupt_record"), marked.filter(F.size("errors") > 0)


def append_log(log: DataFrame, path: str) -> None:
    """Appends the discrepancy log as CSV; every file has the header.  For one file, see ``documents.write_log``."""
    log.write.mode("append").option("header", True).csv(path)
