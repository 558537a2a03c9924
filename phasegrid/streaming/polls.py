"""Polls on a stream: samples are put together by poll, and a poll goes on once the watermark has passed it.

What comes out is what the operators of ``decode`` make of a table with the same
samples: readings that count when a poll fails part-way, and masks.  Samples of polls
that have gone on are late; Spark drops them and counts them in the query's progress.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.signals import MASKED_KINDS
from phasegrid.operators.decode import FAMILIES, limits, resolve

LAST = (1 << 63) - 1


def stream_polls(samples: DataFrame, dim: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(intersection_id, poll_us, ts, readings): a row for each poll with the readings that count (see ``decode.usable``), by seq.

    The state holds polls up to ``delay`` old, each with its readings: some forty, one
    for each identifier that is read.
    """
    rows = resolve(samples, dim).withColumn("ts", F.timestamp_micros("poll_us")).withWatermark("ts", delay)
    family = F.coalesce(*[F.when(F.col("kind").isin(*members), k) for k, members in enumerate(FAMILIES.values())])
    reading = F.struct("seq", family.alias("family"), "oid", "kind", "grp", "channel", "base_num", "value", "status")
    bounds = F.array(*[F.coalesce(limit, F.lit(LAST)) for limit in limits()])
    found = rows.groupBy("intersection_id", "poll_us", "ts").agg(F.array_sort(F.collect_list(reading)).alias("readings"), bounds.alias("bounds"))
    return found.withColumn("readings", F.filter("readings", lambda r: r["seq"] < F.get("bounds", r["family"]))).drop("bounds")


def stream_usable(polls: DataFrame) -> DataFrame:
    """The readings of polls as rows, in the columns of ``decode.usable``."""
    rows = polls.select("intersection_id", "poll_us", F.explode("readings").alias("r"))
    return rows.select("r.oid", "intersection_id", "poll_us", "r.seq", "r.value", "r.status", "r.kind", "r.grp", "r.channel", "r.base_num")


def stream_masks(polls: DataFrame) -> DataFrame:
    """The masks of ``decode.masks``, and the poll's ``ts``; a poll's masks follow from its readings alone."""
    colours = ("red", "yellow", "green")
    zero = F.lit(0)

    def mask(r: Column, width: int, one: Column, two: Column = zero, three: Column = zero) -> Column:
        return F.struct(r["kind"].alias("kind"), r["base_num"].alias("base_num"), F.lit(width).alias("width"), r["seq"].alias("seq"), one.cast("int").alias("one"), two.cast("int").alias("two"), three.cast("int").alias("three"))

    def group(g: Column) -> Column:
        mine = F.filter("readings", lambda r: (r["kind"] == g["kind"]) & (r["grp"] == g["grp"]) & r["base_num"].eqNullSafe(g["base_num"]))
        most = [F.array_max(F.transform(F.filter(mine, lambda r: r["channel"] == c), lambda r: r["value"])).alias(c) for c in colours]  # noqa: B023
        return F.struct(g["kind"].alias("kind"), g["base_num"].alias("base_num"), F.array_min(F.transform(mine, lambda r: r["seq"])).alias("seq"), *most)

    def lit(g: Column) -> Column:
        yellow = g["yellow"].bitwiseAND(F.bitwise_not(g["green"]))
        return mask(g, 8, g["red"].bitwiseAND(F.bitwise_not(g["green"])).bitwiseAND(F.bitwise_not(g["yellow"])), yellow, g["green"])

    names = F.transform(F.filter("readings", lambda r: r["kind"].isin(*MASKED_KINDS)), lambda r: F.struct(r["kind"].alias("kind"), r["grp"].alias("grp"), r["base_num"].alias("base_num")))
    groups = F.filter(F.transform(F.array_distinct(names), group), lambda g: g["red"].isNotNull() & g["yellow"].isNotNull() & g["green"].isNotNull())
    read = F.transform(F.filter("readings", lambda r: r["kind"] == "detector"), lambda r: mask(r, 8, r["value"]))
    on = F.transform(F.filter("readings", lambda r: r["kind"] == "output"), lambda r: mask(r, 1, r["value"] == 1))
    rows = polls.select("intersection_id", "poll_us", "ts", F.explode(F.concat(F.transform(groups, lit), read, on)).alias("m"))
    return rows.select("intersection_id", "m.kind", "m.base_num", "m.width", F.col("poll_us").alias("us"), "m.seq", "m.one", "m.two", "m.three", "ts")
