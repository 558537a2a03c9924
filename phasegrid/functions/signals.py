"""Column functions of the signal domain; all run inside generated code."""

from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed names of the state codes.
SIGNAL_STATES = ("DARK", "RED", "YELLOW", "GREEN")
DETECTOR_STATES = ("INACTIVE", "ACTIVE")
OUTPUT_STATES = ("OFF", "ON")
MASKED_KINDS = ("phase", "overlap", "ped")


def signal_state(red: Column, yellow: Column, green: Column) -> Column:
    """The state code of three lamp bits: green before yellow before red, else dark."""
    return F.when(green == 1, 3).when(yellow == 1, 2).when(red == 1, 1).otherwise(0)


def state_name(kind: Column, code: Column) -> Column:
    """The name of a state code; null for codes that a kind doesn't have."""

    def pick(names: tuple[str, ...]) -> Column:
        return F.get(F.array(*map(F.lit, names)), code)

    return F.when(kind.isin(*MASKED_KINDS), pick(SIGNAL_STATES)).when(kind == "detector", pick(DETECTOR_STATES)).when(kind == "output", pick(OUTPUT_STATES))


def bit(mask: Column, place: Column) -> Column:
    """The bit of a mask, the lowest at place 0."""
    return F.call_function("getbit", mask, place).cast("int")


def detector_group(num: Column) -> Column:
    """The group (0-7) that holds a detector; null outside 1-64."""
    return F.when(num.between(1, 64), F.floor((num - 1) / 8).cast("int"))


def detector_bit(num: Column) -> Column:
    """The place of a detector in its group's mask; null outside 1-64."""
    return F.when(num.between(1, 64), F.pmod(num - 1, F.lit(8)).cast("int"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp that is in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(span: Column) -> Column:
    """A span of microseconds in seconds, to the thousandth."""
    return F.round(span / F.lit(1e6), 3)


def status_text(kind: Column, num: Column, state: Column) -> Column:
    """A readable line such as ``Phase 2: GREEN``."""
    return F.format_string("%s %d: %s", F.initcap(kind), num, state)


def frames_kept(fps: Column, pre_roll_sec: Column) -> Column:
    """How many frames a pre-roll buffer keeps; a missing or non-positive rate counts as 15."""
    rate = F.when(fps > 0, fps).otherwise(F.lit(15.0))
    return F.greatest(F.lit(1), F.floor(rate * pre_roll_sec).cast("int"))


def setting(raw: Column, path: str, default: str) -> Column:
    """The value at a dotted path of a JSON document, as text, or the default."""
    return F.coalesce(F.get_json_object(raw, f"$.{path}"), F.lit(default))


@cache
def zone_names() -> tuple[str, ...]:
    """The zones that this engine knows, some 600."""
    joined = SparkSession.active()._jvm.java.lang.String.join(",", SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds())
    return tuple(sorted(joined.split(",")))


def known_zone(zone: Column) -> Column:
    """The zone, or UTC where it is missing or the engine doesn't know it."""
    return F.when(zone.isin(*zone_names()), zone).otherwise(F.lit("UTC"))


def local_text(ts_micros: Column, zone: Column, pattern: str) -> Column:
    """A UTC instant as local text; zones that the engine doesn't know read as UTC."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(ts_micros), known_zone(zone)), pattern)
