"""The dictionary of object identifiers as a dimension table."""

from pyspark.sql import DataFrame, SparkSession

#: Fixed identifiers of the protocol.
BASE = "1.3.6.1.4.1.1206"
PHASE = f"{BASE}.4.2.1.1.4.1"
OVERLAP = f"{BASE}.4.2.1.9.4.1"
DETECTOR = f"{BASE}.4.2.1.2.4.1.2"
OUTPUT = f"{BASE}.4.2.1.3.14.1.2"
RING = f"{BASE}.4.2.1.7.6.1.1"
#: Column numbers of the lamp masks.
LAMPS = {2: "red", 3: "yellow", 4: "green"}
WALKS = {5: "red", 6: "yellow", 7: "green"}

SCHEMA = "oid string, kind string, grp int, channel string, base_num int"


def oid_rows() -> list[tuple[str, str, int, str, int]]:
    """(oid, kind, group, channel, number of the first thing in it)."""
    rows = [(f"{PHASE}.{c}.{g}", "phase", g, name, 8 * g - 7) for g in (1, 2) for c, name in LAMPS.items()]
    rows += [(f"{OVERLAP}.{c}.1", "overlap", 3, name, 1) for c, name in LAMPS.items()]
    rows += [(f"{PHASE}.{c}.1", "ped", 1, name, 1) for c, name in WALKS.items()]
    rows += [(f"{DETECTOR}.{g + 1}", "detector", g, "active", 8 * g + 1) for g in range(8)]
    rows += [(f"{OUTPUT}.{n}", "output", n, "state", n) for n in range(1, 17)]
    return rows + [(f"{RING}.{n}", "ring", n, "state", n) for n in range(1, 5)]


def lamp_oids(group: int = 1) -> tuple[str, ...]:
    """The red, yellow and green identifiers of phases 1-8 (group 1), phases 9-16 (2) or overlaps (3); any other group reads as 1."""
    rows = oid_rows()
    found = {(g, channel): oid for oid, kind, g, channel, _ in rows if kind in ("phase", "overlap")}
    return tuple(found[group if (group, c) in found else 1, c] for c in LAMPS.values())


def oid_dim(spark: SparkSession) -> DataFrame:
    """The dimension, 40 rows."""
    return spark.createDataFrame(oid_rows(), SCHEMA)
