"""Pairs of detectors that watch one zone: edges, pulses, timelines and disagreements.

Edges are few next to samples, since unchanged states are gone before anything is
keyed by pair.  All spans are half-open and in microseconds.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIR = ("intersection_id", "pair_key")


def detector_pairs(detectors: DataFrame) -> DataFrame:
    """One row for each pair: pair_key, det_a, det_b with types, phases and cameras, threshold of A.

    ``detectors``: intersection_id, detector_id, ordinal, type, phase,
    paired_detector_id, camera_id, lag_threshold_sec.  The first listed detector of
    a pair is A; the key joins the ids in text order.  Partners that don't exist
    make no pair (see ``dangling_partners``).
    """
    d = detectors
    other = d.select("intersection_id", F.col("detector_id").alias("det_b"), F.col("type").alias("b_type"), F.col("phase").alias("det_b_phase"), F.col("camera_id").alias("b_camera"))
    a = d.filter(F.col("paired_detector_id").isNotNull()).select(
        "intersection_id", F.col("detector_id").alias("det_a"), "ordinal", F.col("type").alias("a_type"), F.col("phase").alias("det_a_phase"), F.col("camera_id").alias("a_camera"), "lag_threshold_sec", F.col("paired_detector_id").alias("det_b")
    )
    key = F.array_join(F.array_sort(F.array("det_a", "det_b")), ":")
    first = Window.partitionBy(*PAIR).orderBy("ordinal")
    pairs = a.join(other, ["intersection_id", "det_b"]).withColumn("pair_key", key).withColumn("n", F.row_number().over(first)).filter("n = 1")
    return pairs.select(
        *PAIR,
        "det_a",
        "det_b",
        F.coalesce("a_type", F.lit("unknown")).alias("det_a_type"),
        F.coalesce("b_type", F.lit("unknown")).alias("det_b_type"),
        "det_a_phase",
        "det_b_phase",
        pair_cameras(F.col("a_camera"), F.col("b_camera")).alias("cameras"),
        (F.coalesce("lag_threshold_sec", F.lit(2.0)) * 1_000_000).cast("bigint").alias("threshold_us"),
    )


def pair_cameras(a: Column, b: Column) -> Column:
    """The cameras of a pair: A's, then B's, distinct and non-empty; ["all"] if there are none."""
    named = F.array_distinct(F.filter(F.array(a, b), lambda c: c.isNotNull() & (c != "")))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("all")))


def dangling_partners(detectors: DataFrame) -> DataFrame:
    """Detectors whose partner isn't listed."""
    listed = detectors.select("intersection_id", F.col("detector_id").alias("paired_detector_id"))
    return detectors.filter(F.col("paired_detector_id").isNotNull()).join(listed, ["intersection_id", "paired_detector_id"], "left_anti")


def edges(samples: DataFrame) -> DataFrame:
    """Samples (intersection_id, detector_id, us, seq, is_on) at which a detector's state changes; the first counts."""
    order = Window.partitionBy("intersection_id", "detector_id").orderBy("us", "seq")
    before = F.lag("is_on").over(order)
    return samples.withColumn("before", before).filter(~F.col("is_on").eqNullSafe(F.col("before"))).drop("before")


def pulses(edge: DataFrame) -> DataFrame:
    """(intersection_id, detector_id, on_us, off_us) of ended pulses: the latest ON edge before each OFF edge."""
    earlier = Window.partitionBy("intersection_id", "detector_id").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    on = F.last(F.when(F.col("is_on"), F.col("us")), ignorenulls=True).over(earlier)
    return edge.withColumn("on_us", on).filter(~F.col("is_on") & F.col("on_us").isNotNull()).select("intersection_id", "detector_id", "on_us", F.col("us").alias("off_us"), "seq")


def on_intervals(edge: DataFrame) -> DataFrame:
    """(intersection_id, detector_id, on_us, off_us) with off_us null while a detector is still on."""
    order = Window.partitionBy("intersection_id", "detector_id").orderBy("us", "seq")
    return edge.withColumn("off_us", F.lead("us").over(order)).filter("is_on").select("intersection_id", "detector_id", F.col("us").alias("on_us"), "off_us")


def of_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """``df`` by detector, with its pair and side: rows of unpaired or unknown detectors go."""
    sides = pairs.select(*PAIR, "threshold_us", F.explode(F.array(F.struct(F.col("det_a").alias("detector_id"), F.lit("a").alias("side")), F.struct(F.col("det_b").alias("detector_id"), F.lit("b").alias("side")))).alias("d"))
    return df.join(sides.select(*PAIR, "threshold_us", "d.detector_id", "d.side"), ["intersection_id", "detector_id"])


def pair_timeline(edge: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, us, a_on, b_on, threshold_us): both sides' states from each instant of an edge on; off before the first."""
    rows = of_pairs(edge, pairs)
    order = Window.partitionBy(*PAIR).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)

    def side(name: str) -> Column:
        return F.coalesce(F.last(F.when(F.col("side") == name, F.col("is_on")), ignorenulls=True).over(order), F.lit(False)).alias(f"{name}_on")

    seen = rows.select(*PAIR, "threshold_us", "us", "seq", side("a"), side("b"))
    last = Window.partitionBy(*PAIR, "us").orderBy(F.desc("seq"))  # edges of one instant: what they leave behind counts
    return seen.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "seq")


def disagreements(timeline: DataFrame) -> DataFrame:
    """(pair, start_us, end_us, leader): maximal spans in which the sides differ; end_us null while open.

    The direction isn't tracked: a swap of sides within one instant goes on with the span.
    """
    order = Window.partitionBy(*PAIR).orderBy("us")
    differ = F.col("a_on") != F.col("b_on")
    marked = timeline.withColumn("differ", differ).withColumn("fresh", (~F.col("differ").eqNullSafe(F.lag("differ").over(order))).cast("int"))
    spans = marked.withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_us", F.lead("us").over(order))
    found = spans.filter("differ").groupBy(*PAIR, "threshold_us", "span").agg(F.min("us").alias("start_us"), F.max_by("next_us", "us").alias("end_us"), F.max_by("a_on", "us").alias("a_leads"))
    return found.drop("span")
