"""From samples to clips, continuously: four queries, each with its table.

Spark runs one stateful operator of this kind a query, so each stage appends to a table
of the folder that the next one reads as a stream; a table holds committed rows only,
each once, whatever stage is started anew.

    masks      polls put together (``polls.stream_masks``)
    changes    bits that changed (``stateful.stream_mask_changes``)
    triggers   documents of the pair evaluator (``stateful.stream_pairs``)
    clips      recorded and dropped starts (``clips.stream_clips``)
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phasegrid.operators.clips import target_camera
from phasegrid.operators.resolver import Params
from phasegrid.sources.triggers import pair_payloads
from phasegrid.streaming.clips import stream_clips
from phasegrid.streaming.polls import stream_masks, stream_polls
from phasegrid.streaming.stateful import stream_mask_changes, stream_pairs

STAGES = ("masks", "changes", "triggers", "clips")


@dataclass
class Site:
    """What the stages need to know: tables of configuration, and parameters."""

    dim: DataFrame
    pairs: DataFrame
    intersections: DataFrame
    cameras: DataFrame
    params: Params = field(default_factory=Params)
    cap: int | None = 2
    delay: str = "10 seconds"
    reloads: DataFrame | None = None


def edges_of(changes: DataFrame) -> DataFrame:
    """Changes of detectors as edges (intersection_id, detector_id, us, seq, is_on)."""
    rows = changes.filter("kind = 'detector'")
    return rows.select("intersection_id", F.col("num").cast("string").alias("detector_id"), "us", "seq", (F.col("new_state") == "ACTIVE").alias("is_on"))


def clip_triggers(documents: DataFrame, cameras: DataFrame) -> DataFrame:
    """Trigger documents as triggers of clips: ``us`` and the camera that records, of the intersection's listed ones."""
    known = cameras.groupBy("intersection_id").agg(F.array_sort(F.collect_list("camera_id")).alias("known"))
    rows = documents.join(known, "intersection_id", "left").withColumn("us", F.round(F.col("event_timestamp") * 1e6).cast("bigint"))
    return rows.withColumn("camera_id", target_camera(F.col("cameras"), F.coalesce("known", F.array().cast("array<string>")))).drop("known")


class Running:
    """The stages over one folder; ``start`` them all, or each as a job of its own."""

    def __init__(self, spark: SparkSession, folder: str, site: Site):
        self.spark, self.folder, self.site = spark, folder.rstrip("/"), site
        self.schemas: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        """What a stage has put out so far."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def _stream(self, name: str) -> DataFrame:
        return self.spark.readStream.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def _clock(self) -> DataFrame:
        """One row for each poll of detectors: time goes on while nothing changes."""
        return self._stream("masks").filter("kind = 'detector' AND base_num = 1").select("intersection_id", "us")

    def _made(self, name: str, samples: DataFrame) -> DataFrame:
        site = self.site
        if name == "masks":
            return stream_masks(stream_polls(samples, site.dim, site.delay)).drop("ts")
        if name == "changes":
            return stream_mask_changes(self._stream("masks"))
        if name == "triggers":
            fired = stream_pairs(edges_of(self._stream("changes")), site.pairs, site.params, site.delay, site.reloads, self._clock())
            return pair_payloads(fired, site.pairs, site.intersections)
        return stream_clips(clip_triggers(self._stream("triggers"), site.cameras), site.cap, site.delay, self._clock())

    def start(self, samples: DataFrame, once: bool = False) -> list[StreamingQuery]:
        """Starts the stages; with ``once`` each takes what there is and ends before the next one begins."""
        queries = []
        for name in STAGES:
            made = self._made(name, samples)
            self.schemas[name] = made.schema
            writer = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{self.folder}/_state/{name}").queryName(name)
            # a table that nothing was committed to has to be there for its readers
            self.spark.createDataFrame([], made.schema).write.mode("append").parquet(f"{self.folder}/{name}")
            query = (writer.trigger(availableNow=True) if once else writer).start(f"{self.folder}/{name}")
            if once:
                query.awaitTermination()
            queries.append(query)
        return queries
