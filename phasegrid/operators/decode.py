"""From samples to states: resolving identifiers, assembling polls, decoding masks."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phasegrid.functions.signals import MASKED_KINDS, bit, detector_group, signal_state, state_name

STATE_COLUMNS = ("intersection_id", "kind", "num", "us", "seq", "code", "state")


def resolve(samples: DataFrame, dim: DataFrame) -> DataFrame:
    """Samples with kind, group, channel and first number; the dimension has 40 rows and is broadcast.

    Samples of unknown identifiers are left out here and kept by ``unresolved``.
    """
    return samples.join(F.broadcast(dim), "oid")


def unresolved(samples: DataFrame, dim: DataFrame) -> DataFrame:
    """Samples whose identifier isn't in the dimension."""
    return samples.join(F.broadcast(dim.select("oid")), "oid", "left_anti")


#: What fails by itself in a poll; phases and overlaps fail together.
FAMILIES = {"signal": ("phase", "overlap"), "ped": ("ped",), "detector": ("detector",), "output": ("output",), "ring": ("ring",)}


def of_kinds(dim: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The identifiers that decide about ``kinds``: theirs, and those of kinds that fail with them."""
    wanted = {k for members in FAMILIES.values() if set(members) & set(kinds) for k in members}
    return dim.filter(F.col("kind").isin(*wanted))


def limits() -> list[Column]:
    """For each family the order from which on its readings of a poll don't count, as aggregates; a failed detector poll is lost as a whole."""
    bad = F.coalesce(F.col("status") != "OK", F.lit(False))
    return [F.min(F.when(bad & F.col("kind").isin(*members), F.lit(-(1 << 63)) if name == "detector" else F.col("seq"))) for name, members in FAMILIES.items()]


def usable(resolved: DataFrame) -> DataFrame:
    """Samples that count when a poll fails part-way.

    Phases and overlaps, and outputs, keep what was read before the failure;
    pedestrians fail by themselves; detectors lose the whole poll.
    """
    poll = Window.partitionBy("intersection_id", "poll_us")  # one shuffle, which serves whatever is grouped by poll after it
    columns = resolved.columns
    names = [f"__limit_{name}" for name in FAMILIES]
    marked = resolved.select("*", *[limit.over(poll).alias(n) for n, limit in zip(names, limits(), strict=True)])
    limit = F.coalesce(*[F.when(F.col("kind").isin(*members), F.col(n)) for n, members in zip(names, FAMILIES.values(), strict=True)], F.lit((1 << 63) - 1))
    return marked.filter(F.col("seq") < limit).select(*columns)


def assemble(resolved: DataFrame) -> DataFrame:
    """One row for each group of lamps in a poll with its three masks; groups that lack a colour give none."""

    def lamp(name: str):
        return F.max(F.when(F.col("channel") == name, F.col("value"))).alias(name)

    rows = resolved.filter(F.col("kind").isin(*MASKED_KINDS))
    return rows.groupBy("intersection_id", "kind", "grp", "base_num", "poll_us").agg(lamp("red"), lamp("yellow"), lamp("green"), F.min("seq").alias("seq")).dropna(subset=["red", "yellow", "green"])


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("state", state_name(F.col("kind"), F.col("code"))).select(*STATE_COLUMNS)


def lamps(polls: DataFrame) -> DataFrame:
    """Eight states for each assembled poll; the lowest bit is the first number."""
    place = polls.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    code = signal_state(*[bit(F.col(c), F.col("i")) for c in ("red", "yellow", "green")])
    return _named(place.select("intersection_id", "kind", (F.col("base_num") + F.col("i")).alias("num"), F.col("poll_us").alias("us"), "seq", code.alias("code")))


def detectors(resolved: DataFrame) -> DataFrame:
    """Eight states for each detector mask."""
    rows = resolved.filter("kind = 'detector'").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return _named(rows.select("intersection_id", "kind", (F.col("base_num") + F.col("i")).alias("num"), F.col("poll_us").alias("us"), "seq", bit(F.col("value"), F.col("i")).alias("code")))


def outputs(resolved: DataFrame) -> DataFrame:
    """A state for each output value: ON only if it is 1."""
    rows = resolved.filter("kind = 'output'")
    return _named(rows.select("intersection_id", "kind", F.col("base_num").alias("num"), F.col("poll_us").alias("us"), "seq", (F.col("value") == 1).cast("int").alias("code")))


def masks(samples: DataFrame, dim: DataFrame) -> DataFrame:
    """(intersection_id, kind, base_num, width, us, seq, one, two, three): a row for each mask of a poll, not for each of its bits.

    A bit is in the mask of its state code, or in none for code 0; groups that lack a
    colour give none.  All kinds go through one aggregation of what counts.
    """
    rows = usable(resolve(samples, dim)).filter("kind <> 'ring'")
    lamp = F.col("kind").isin(*MASKED_KINDS)
    by = [F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in ("red", "yellow", "green")]
    # lamps of a group are put together, any other reading is a mask of its own
    own = F.when(~lamp, F.col("seq"))
    found = rows.groupBy("intersection_id", "poll_us", "kind", "grp", "base_num", own.alias("own")).agg(*by, F.max("value").alias("value"), F.min("seq").alias("seq"))
    found = found.filter(~lamp | (F.col("red").isNotNull() & F.col("yellow").isNotNull() & F.col("green").isNotNull()))
    yellow = F.col("yellow").bitwiseAND(F.bitwise_not("green"))
    red = F.col("red").bitwiseAND(F.bitwise_not("green")).bitwiseAND(F.bitwise_not("yellow"))
    output = F.col("kind") == "output"
    one = F.when(lamp, red).when(output, (F.col("value") == 1).cast("int")).otherwise(F.col("value"))
    return found.select("intersection_id", "kind", "base_num", F.when(output, 1).otherwise(8).alias("width"), F.col("poll_us").alias("us"), "seq", one.alias("one"), F.when(lamp, yellow).otherwise(0).alias("two"), F.when(lamp, F.col("green")).otherwise(0).alias("three"))


def rings(resolved: DataFrame) -> DataFrame:
    """Ring status bytes, passed through."""
    return resolved.filter("kind = 'ring'").select("intersection_id", F.col("grp").alias("ring"), F.col("poll_us").alias("us"), "value")


DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {"lamps": lambda r: lamps(assemble(r)), "detectors": detectors, "outputs": outputs}


def register_decoder(name: str, decoder: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a decoder of resolved samples; it returns the columns of STATE_COLUMNS."""
    DECODERS[name] = decoder


def states(samples: DataFrame, dim: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """All states that the registered decoders find in samples; of ``kinds`` if given, for which no other samples are moved."""
    rows = usable(resolve(samples, of_kinds(dim, kinds) if kinds else dim))
    out = None
    for decoder in DECODERS.values():
        found = decoder(rows)
        out = found if out is None else out.unionByName(found)
    return out.filter(F.col("kind").isin(*kinds)) if kinds else out


def enabled(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Rows whose (kind, grp) is switched on for their intersection."""
    return df.join(settings, ["intersection_id", "kind", "grp"], "left_semi")


def in_range(df: DataFrame, kind: str, start: int, end: int) -> DataFrame:
    """States of a kind with start <= num < end."""
    return df.filter((F.col("kind") == kind) & (F.col("num") >= start) & (F.col("num") < end))


def groups_in_range(resolved: DataFrame, start: int, end: int) -> DataFrame:
    """Detector samples whose group meets start <= num < end: the rest need not be read or exploded."""
    first, last = detector_group(F.lit(max(1, start))), detector_group(F.lit(min(64, end - 1)))
    return resolved.filter((F.col("kind") == "detector") & F.col("grp").between(first, last))
