"""Daily routines: validation, due times in local zones, and their triggers."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions.signals import micros

HHMM = r"^\s*(\d+):(\d+)\s*$"


def hour_minute(time: Column) -> tuple[Column, Column]:
    """Hour and minute of ``HH:MM`` (``8:5`` will do); null where it isn't a time of day."""
    hour, minute = (F.expr(f"try_cast(nullif(regexp_extract(`__time`, '{HHMM.replace(chr(92), chr(92) * 2)}', {k}), '') AS INT)") for k in (1, 2))
    sound = hour.between(0, 23) & minute.between(0, 59)
    return F.when(sound, hour), F.when(sound, minute)


def with_defaults(routines: DataFrame) -> DataFrame:
    """Routines with label, cameras, reason and pre-roll filled in, and hour and minute."""
    label = F.coalesce(F.nullif("label", F.lit("")), F.col("time"))
    hour, minute = hour_minute(F.col("time"))
    return routines.withColumn("__time", F.col("time")).select(
        "intersection_id", "ordinal", label.alias("label"), "time", "duration_sec", F.coalesce("cameras", F.array(F.lit("all"))).alias("cameras"), F.coalesce("reason", F.lit("routine_baseline")).alias("reason"), F.coalesce("pre_roll_sec", F.lit(0.0)).alias("pre_roll_sec"), hour.alias("hour"), minute.alias("minute")
    )


def routine_errors(routines: DataFrame) -> DataFrame:
    """``with_defaults`` and ``errors``: all that is wrong with each routine; labels used twice are errors of each use."""
    filled = with_defaults(routines)
    twice = filled.groupBy("intersection_id", "label").agg((F.count("*") > 1).alias("twice"))
    wrong = F.array_compact(
        F.array(
            F.when(F.col("time").isNull(), "no time"),
            F.when(F.col("time").isNotNull() & F.col("hour").isNull(), "bad time"),
            F.when(~F.coalesce(F.col("duration_sec") > 0, F.lit(False)), "duration not positive"),
            F.when(F.size("cameras") == 0, "no cameras"),
            F.when(F.coalesce("twice", F.lit(False)), "label used twice"),
        )
    )
    return filled.join(twice, ["intersection_id", "label"], "left").withColumn("errors", wrong).drop("twice")


def duplicate_labels(routines: DataFrame) -> DataFrame:
    """(intersection_id, label, n) of labels used more than once."""
    return with_defaults(routines).groupBy("intersection_id", "label").agg(F.count("*").alias("n")).filter("n > 1")


def known_zones(spark: SparkSession) -> DataFrame:
    """The zones that this engine knows."""
    return spark.createDataFrame([(z,) for z in sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())], "timezone string")


def with_zone(df: DataFrame, zones: DataFrame, timezone: str = "timezone") -> DataFrame:
    """Zones that aren't known read as UTC."""
    known = zones.select(F.col("timezone").alias("__zone"))
    return df.join(F.broadcast(known), F.col(timezone) == F.col("__zone"), "left").withColumn(timezone, F.coalesce("__zone", F.lit("UTC"))).drop("__zone")


def due_routines(routines: DataFrame, zones: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """One firing of each sound routine for each local date from start to end, at HH:MM:00 exactly.

    ``routines`` needs a ``timezone``.  A local time that a clock change leaves out
    doesn't fire; one that comes twice fires the first time.
    """
    sound = with_zone(routine_errors(routines).filter(F.size("errors") == 0).join(routines.select("intersection_id", "ordinal", "timezone"), ["intersection_id", "ordinal"]), zones)
    days = sound.withColumn("local_date", F.explode(F.sequence(F.to_date(F.lit(start_date)), F.to_date(F.lit(end_date)))))
    local = F.to_timestamp(F.format_string("%s %02d:%02d:00", F.col("local_date").cast("string"), "hour", "minute"))
    due = days.withColumn("local", local).withColumn("utc", F.to_utc_timestamp("local", F.col("timezone")))
    fires = due.filter(F.from_utc_timestamp("utc", F.col("timezone")) == F.col("local"))
    return fires.dropDuplicates(["intersection_id", "label", "local_date"]).select("intersection_id", "label", "timezone", "local_date", micros(F.col("utc")).alias("fire_us"), "duration_sec", "cameras", "reason", "pre_roll_sec", "hour", "minute")


def surviving_labels(fired: DataFrame, routines: DataFrame) -> DataFrame:
    """Fired marks (intersection_id, label, ...) whose label is still in the schedule after a reload."""
    return fired.join(with_defaults(routines).select("intersection_id", "label"), ["intersection_id", "label"], "left_semi")


@dataclass
class Marks:
    """What an intersection has fired: the last local date of each label; ``labels`` are those of its schedule, None for any."""

    fired: dict[str, str] = field(default_factory=dict)
    labels: list[str] | None = None

    def due(self, label: str, date: str) -> bool:
        """Whether a label that is due fires: it is in the schedule and hasn't fired on that date.  Rows come in time order."""
        if (self.labels is not None and label not in self.labels) or self.fired.get(label) == date:
            return False
        self.fired[label] = date
        return True

    def reload(self, labels: list[str]) -> None:
        """A new schedule: marks of labels that it keeps stay."""
        self.labels = labels
        self.fired = {k: d for k, d in self.fired.items() if k in labels}

    def expire(self, before: str) -> None:
        """Lets marks of dates before one go."""
        self.fired = {k: d for k, d in self.fired.items() if d >= before}


def with_reloads(due: DataFrame, reloads: DataFrame | None) -> DataFrame:
    """Due routines (intersection_id, label, local_date, fire_us) and new schedules (intersection_id, us, labels) as one table by ``us``."""
    none = F.lit(None)
    rows = due.select("intersection_id", F.col("fire_us").alias("us"), F.lit(1).alias("turn"), "label", F.col("local_date").cast("string").alias("local_date"), none.cast("array<string>").alias("labels"))
    if reloads is None:
        return rows
    return rows.unionByName(reloads.select("intersection_id", "us", F.lit(0).alias("turn"), none.cast("string").alias("label"), none.cast("string").alias("local_date"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels")))


FIRINGS = "intersection_id string, label string, local_date string, fire_us bigint"


def firings(due: DataFrame, reloads: DataFrame | None = None) -> DataFrame:
    """(intersection_id, label, local_date, fire_us): each label fires once a local date, while the schedule has it.

    A label that a new schedule leaves out loses its mark; one that stays keeps it.
    Rows of an intersection are looked at in time order; memory holds its marks.
    """
    rows = with_reloads(due, reloads).repartition("intersection_id").sortWithinPartitions("intersection_id", "us", "turn", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, marks = None, Marks()
        for batch in batches:
            out = []
            for i, us, turn, label, date, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != where:
                    where, marks = i, Marks()
                if turn == 0:
                    marks.reload(labels)
                elif marks.due(label, date):
                    out.append({"intersection_id": i, "label": label, "local_date": date, "fire_us": us})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("intersection_id", pa.string()), ("label", pa.string()), ("local_date", pa.string()), ("fire_us", pa.int64())]))

    return rows.mapInArrow(run, FIRINGS)


def summary(routines: DataFrame) -> DataFrame:
    """Label, time and duration of each sound routine."""
    sound = routine_errors(routines).filter(F.size("errors") == 0)
    return sound.select("intersection_id", "label", F.format_string("%02d:%02d", "hour", "minute").alias("time"), "duration_sec")
