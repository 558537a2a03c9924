"""Clip planning from triggers: lifecycle, admission, camera takeover, frames and the log.

Pixels are none of it: a clip is a span on a camera, a frame is a row.
"""

import heapq
import zoneinfo
from collections.abc import Iterator
from datetime import datetime
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from phasegrid.functions.signals import frames_kept, known_zone


CLIP = ("intersection_id", "trigger_id")
STARTED = (*CLIP, "start_us")
#: How long a clip may run whose start doesn't say.
MAX_DURATION_SEC = 300.0


def with_ends(triggers: DataFrame) -> DataFrame:
    """Each start with end_us and how a clip that it begins ends: at the id's first stop from then on, or after max_duration_sec.

    ``triggers``: intersection_id, trigger_id, action, us, max_duration_sec, cameras,
    pre_roll_sec and whatever else a start carries; rows of one id and instant count once.
    """
    later = Window.partitionBy(*CLIP).orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, 0)  # from the last one back, in linear time
    stop = F.min(F.when(F.col("action").isin("stop", "extend"), F.col("us"))).over(later)
    limit = F.col("start_us") + (F.coalesce("max_duration_sec", F.lit(MAX_DURATION_SEC)) * 1_000_000).cast("bigint")
    starts = triggers.withColumn("stop_us", stop).filter("action = 'start'").withColumnRenamed("us", "start_us").drop("action").dropDuplicates(STARTED)
    return starts.withColumn("end_us", F.least("stop_us", limit)).withColumn("ended_by", F.when(F.col("stop_us") <= limit, "stop").otherwise("max_duration")).drop("stop_us")


def lifecycle(triggers: DataFrame) -> DataFrame:
    """One row for each clip, as if any number could run: start_us, end_us and how it ended.

    A start of an id whose clip still runs is ignored, stops without a running clip too.
    An id's starts are looked at in order; memory holds one end, whatever an id has.
    """
    # dealt once: ends, repeated starts and the pass below all go by these keys
    found = with_ends(triggers.repartition(*CLIP)).sortWithinPartitions(*STARTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, end = None, None
        for batch in batches:
            keep = []
            for *ident, start, ends in zip(*(batch.column(c).to_pylist() for c in (*STARTED, "end_us")), strict=True):
                fresh = ident != key or end is None or end <= start
                keep.append(fresh)
                if fresh:
                    key, end = ident, ends
            yield batch.filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(run, found.schema)


def target_camera(cameras: Column, known: Column) -> Column:
    """The camera that records: the first of the named ones that exists; of all of them for ["all"]; null for none."""
    chosen = F.when(cameras == F.array(F.lit("all")), known).otherwise(F.array_intersect(cameras, known))
    return F.get(chosen, F.lit(0))


class Running:
    """The clips of one intersection that run, ``cap`` at most if there is one; the earliest end is let go first."""

    def __init__(self, cap: int | None):
        self.cap, self.ends, self.queue = cap, {}, []

    def reason(self, ident: str, start: int, end: int | None, camera: str | None) -> str | None:
        """Why a start is dropped; None for one that is recorded, which then runs until ``end``.  Starts come in order."""
        while self.queue and self.queue[0][0] <= start:
            at, name = heapq.heappop(self.queue)
            if self.ends.get(name) == at:
                del self.ends[name]
        if ident in self.ends:
            return "duplicate"
        if camera is None:
            return "camera"
        if self.cap is not None and len(self.ends) >= self.cap:
            return "cap"
        if end is not None and end > start:
            self.ends[ident] = end
            heapq.heappush(self.queue, (end, ident))
        return None


def admission(clips: DataFrame, cap: int | None = 2) -> DataFrame:
    """Adds ``drop_reason`` to starts with their ends and camera_id (see ``with_ends``), checked in this order.

    "duplicate" while a clip of the id runs, "camera" without a target camera, "cap"
    when ``cap`` clips of the intersection already run; null for those that are
    recorded.  An intersection's starts are looked at in order, each once; memory holds
    its running clips.
    """
    columns = [c for c in clips.columns if c != "drop_reason"]
    rows = clips.select(*columns).repartition("intersection_id").sortWithinPartitions(*(STARTED[i] for i in (0, 2, 1)))
    schema = StructType([*rows.schema.fields, StructField("drop_reason", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, running = None, Running(cap)
        for batch in batches:
            reasons = []
            for i, ident, start, end, camera in zip(*(batch.column(c).to_pylist() for c in ("intersection_id", "trigger_id", "start_us", "end_us", "camera_id")), strict=True):
                if i != where:
                    where, running = i, Running(cap)
                reasons.append(running.reason(ident, start, end, camera))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reasons, pa.string())], names=[*columns, "drop_reason"])

    return rows.mapInArrow(run, schema)


def takeover(clips: DataFrame) -> DataFrame:
    """Adds ``feed_end_us``: a clip gets frames until it ends or a newer one starts on its camera."""
    later = F.lead("start_us").over(Window.partitionBy("intersection_id", "camera_id").orderBy("start_us", "trigger_id"))
    return clips.withColumn("feed_end_us", F.least("end_us", later))


def windows(clips: DataFrame) -> DataFrame:
    """Adds clip_start_us: the start less the pre-roll."""
    return clips.withColumn("clip_start_us", F.col("start_us") - (F.coalesce("pre_roll_sec", F.lit(0.0)) * 1_000_000).cast("bigint"))


def file_name(trigger_id: Column, camera: Column, start_us: Column) -> Column:
    """The name of a clip's file."""
    return F.format_string("%s_%s_%d.mp4", trigger_id, camera, F.floor(start_us / 1_000_000))


def preroll_frames(clips: DataFrame, frames: DataFrame, fps: float, bucket_us: int) -> DataFrame:
    """The newest frames before each clip's start, as many as the buffer keeps, and no older than the pre-roll.

    A pre-roll of zero keeps none; rows of one clip share what its buffer keeps.
    """
    spans = clips.filter("pre_roll_sec > 0").withColumn("from_us", F.col("start_us") - (F.col("pre_roll_sec") * 1_000_000).cast("bigint")).withColumn("keep", frames_kept(F.lit(fps), F.col("pre_roll_sec")))
    found = met(frames, spans, "from_us", "start_us", bucket_us)
    # of n rows of a clip each has every n-th of the frames kept, where a frame counts n times
    same = Window.partitionBy(*AT, "trigger_id", "until_us")
    shared = found.withColumn("of", F.count("*").over(same)).withColumn("nth", F.row_number().over(same.orderBy("seq")))
    return expanded(shared.withColumn("keep", F.floor((F.col("keep") + F.col("of") - F.col("nth")) / F.col("of"))), F.asc_nulls_first("seq")).drop("place")


def frame_manifest(clips: DataFrame, frames: DataFrame, bucket_us: int) -> DataFrame:
    """(intersection_id, trigger_id, camera_id, place, frame_us, seq): each clip's frames in order, repeats of an instant left out."""
    found = met(frames, clips.withColumn("keep", F.lit(None).cast("int")), "clip_start_us", "feed_end_us", bucket_us)
    first = Window.partitionBy(*AT, "trigger_id").orderBy(F.desc("until_us"), F.asc_nulls_last("seq"))
    return expanded(found.withColumn("nth", F.row_number().over(first)).filter("nth = 1"), F.asc_nulls_last("seq"))


#: Frames and spans of a camera that one task meets, and what tells its rows apart first.
MET = ("intersection_id", "camera_id", "chunk")
AT = (*MET, "is_span", "at_us")
#: Buckets of time in a chunk.
CHUNK_BUCKETS = 16
#: Rows of an Arrow batch that goes out.
ROWS = 50_000


def met(frames: DataFrame, spans: DataFrame, start: str, end: str, bucket_us: int) -> DataFrame:
    """Frames (at_us, seq) and the ``spans`` (at_us, until_us, trigger_id, keep) that have some, in one table dealt by camera and chunk of time.

    A span goes where its ``start`` lies, with all frames up to before its ``end``, so
    that it is expanded there and nothing is dealt again: frames are copied for chunks
    of earlier spans that reach their bucket, spans never.
    """
    bucket = lambda us: F.floor(F.col(us) / bucket_us)
    known = spans.filter(F.col(start) < F.col(end)).filter("intersection_id IS NOT NULL AND camera_id IS NOT NULL").withColumn("chunk", F.floor(bucket(start) / CHUNK_BUCKETS))
    reach = known.groupBy(*MET).agg(F.min(bucket(start)).alias("first"), F.max(bucket(end)).alias("last"))
    reached = reach.select(*MET, F.explode(F.sequence("first", "last")).alias("bucket"))
    theirs = frames.withColumn("bucket", bucket("frame_us")).join(reached, ["intersection_id", "camera_id", "bucket"])
    rows = theirs.select(*MET, F.lit(False).alias("is_span"), F.col("frame_us").alias("at_us"), "seq")
    asked = known.select(*MET, F.lit(True).alias("is_span"), F.col(start).alias("at_us"), F.col(end).alias("until_us"), "trigger_id", "keep")
    return rows.unionByName(asked, allowMissingColumns=True).repartition(*MET)


def expanded(found: DataFrame, by_seq: Column) -> DataFrame:
    """(intersection_id, trigger_id, camera_id, place, frame_us, seq) of the frames in the spans of ``met``, the last ``keep`` of them if that isn't null.

    Frames are ordered by instant and ``by_seq``.  Memory holds one chunk's frames, 16
    bytes each, and a batch of what goes out.
    """
    rows = found.select(*AT, "until_us", "seq", "trigger_id", "keep").sortWithinPartitions(*AT, by_seq)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField("place", IntegerType()) if c == "place" else StructField(c, kinds[{"frame_us": "at_us"}.get(c, c)]) for c in ("intersection_id", "trigger_id", "camera_id", "place", "frame_us", "seq")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, us, seqs = None, [], []
        for batch in filter(len, batches):
            moved = np.zeros(len(batch) - 1, bool)
            for c in (*MET, "is_span"):
                moved |= pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
            for i, j in pairwise((0, *(np.flatnonzero(moved) + 1), len(batch))):
                part = batch.slice(i, j - i)
                key, at = [part.column(c)[0].as_py() for c in MET], part.column("at_us").to_numpy()
                if not part.column("is_span")[0].as_py():
                    if key != where:
                        where, us, seqs = key, [], []
                    us.append(at)
                    seqs.append(part.column("seq"))
                elif key == where:
                    us, seqs = [np.concatenate(us)], [pa.concat_arrays(seqs)]
                    yield from _rows(part, us[0], seqs[0])

    return rows.mapInArrow(run, schema)


def _rows(spans: pa.RecordBatch, us: np.ndarray, seqs: pa.Array) -> Iterator[pa.RecordBatch]:
    """Each span's frames out of those of its chunk, in batches."""
    high = np.searchsorted(us, spans.column("until_us").to_numpy())
    kept = pc.fill_null(spans.column("keep").cast(pa.int64()), len(us)).to_numpy(zero_copy_only=False)
    low = np.maximum(np.searchsorted(us, spans.column("at_us").to_numpy()), high - kept)
    upto = np.cumsum(high - low)
    for n in range(0, int(upto[-1]), ROWS):
        place = np.arange(n, min(n + ROWS, upto[-1]))
        row = np.searchsorted(upto, place, "right")
        place -= upto[row] - (high - low)[row]
        frame = low[row] + place
        own = spans.take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [own.column("intersection_id"), own.column("trigger_id"), own.column("camera_id"), pa.array((place + 1).astype(np.int32)), pa.array(us[frame]), seqs.take(pa.array(frame))],
            names=["intersection_id", "trigger_id", "camera_id", "place", "frame_us", "seq"],
        )


@cache
def abbreviations() -> tuple[tuple[str, int, str], ...]:
    """(zone, seconds ahead of UTC, what clocks of the zone show for that), by the time of year from 2000 on; some 1,000 rows.

    Where a zone has had two names for one offset, the later one is given for all instants.
    """
    found = {}
    for name in sorted(zoneinfo.available_timezones()):
        zone = zoneinfo.ZoneInfo(name)
        for year in range(2000, 2038):
            for month in (1, 4, 7, 10):
                at = datetime(year, month, 15, tzinfo=zone)
                found[name, int(at.utcoffset().total_seconds())] = at.tzname()
    return tuple((z, s, a) for (z, s), a in found.items())


def zone_text(us: Column, zone: Column) -> Column:
    """Local date and time of an instant with the zone's abbreviation; missing and unknown zones read as UTC."""
    zone = known_zone(zone)
    local = F.from_utc_timestamp(F.timestamp_micros(us), zone)
    ahead = F.floor((F.unix_micros(local) - us) / 1_000_000)
    names = F.create_map(*[F.lit(x) for z, s, a in abbreviations() for x in (f"{z} {s}", a)])
    sign = F.when(ahead < 0, "-").otherwise("+")
    digits = F.concat(sign, F.format_string("%02d%02d", F.floor(F.abs(ahead) / 3600), F.floor(F.abs(ahead) % 3600 / 60)))
    return F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.coalesce(names[F.concat_ws(" ", zone, ahead.cast("string"))], digits))


def with_zone_text(df: DataFrame, us: str, zone: str, name: str) -> DataFrame:
    """``df`` with ``zone_text`` of two of its columns, for whole tables: abbreviations are joined, not looked up row by row."""
    known = df.withColumn("__zone", known_zone(F.col(zone)))
    local = F.from_utc_timestamp(F.timestamp_micros(us), F.col("__zone"))
    rows = known.withColumn("__local", local).withColumn("__ahead", F.floor((F.unix_micros("__local") - F.col(us)) / 1_000_000).cast("int"))
    names = df.sparkSession.createDataFrame(list(abbreviations()), "__zone string, __ahead int, __letters string")
    ahead = F.col("__ahead")
    digits = F.concat(F.when(ahead < 0, "-").otherwise("+"), F.format_string("%02d%02d", F.floor(F.abs(ahead) / 3600), F.floor(F.abs(ahead) % 3600 / 60)))
    text = F.concat_ws(" ", F.date_format("__local", "yyyy-MM-dd HH:mm:ss"), F.coalesce("__letters", digits))
    found = rows.join(F.broadcast(names), ["__zone", "__ahead"], "left").withColumn(name, text)  # some 1,000 rows, whatever the table
    return found.drop("__zone", "__local", "__ahead", "__letters")


def discrepancy_log(clips: DataFrame) -> DataFrame:
    """The log's seven text columns, of recorded starts that are detector disagreements."""
    m = F.col("metadata")
    rows = with_zone_text(clips.filter((F.col("reason") == "detector_disagreement") & F.col("drop_reason").isNull()), "start_us", "timezone", "__text")
    return rows.select(
        F.when(F.col("start_us").isNull(), "UNKNOWN_TIME").otherwise(F.col("__text")).alias("Local_Timestamp"),
        F.col("trigger_id").alias("Trigger_ID"),
        file_name(F.col("trigger_id"), F.col("camera_id"), F.col("start_us")).alias("Video_Filename"),
        m["rule"].alias("Rule_Type"),
        m["det_a"].alias("Det_A"),
        m["det_b"].alias("Det_B"),
        m["description"].alias("Description"),
    )
