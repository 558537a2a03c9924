"""Change detection and what follows from it: typed events, current state, status documents."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phasegrid.functions.signals import bit, state_name

KEY = ("intersection_id", "kind", "num")

#: Fixed names of events: the general one of a kind, and that of each new state.
GENERAL = {"phase": "phase_change", "overlap": "overlap_change", "ped": "pedestrian_change", "detector": "detector_change", "output": "output_change"}
SPECIFIC = {
    ("phase", "GREEN"): "phase_green_start",
    ("phase", "RED"): "phase_red_start",
    ("phase", "YELLOW"): "phase_yellow_start",
    ("ped", "GREEN"): "pedestrian_walk_start",
    ("ped", "YELLOW"): "pedestrian_clearance_start",
    ("ped", "RED"): "pedestrian_dont_walk_start",
    ("detector", "ACTIVE"): "detector_on",
    ("detector", "INACTIVE"): "detector_off",
    ("output", "ON"): "output_on",
    ("output", "OFF"): "output_off",
}


def changes(states: DataFrame) -> DataFrame:
    """States that differ from the one before, by (us, seq); the first of a key counts, with old_state null."""
    order = Window.partitionBy(*KEY).orderBy("us", "seq")
    found = states.withColumn("old_state", F.lag("state").over(order)).withColumn("initial", F.row_number().over(order) == 1)
    return found.filter(F.col("initial") | ~F.col("state").eqNullSafe(F.col("old_state"))).withColumnRenamed("state", "new_state").drop("code")


MASK = ("intersection_id", "kind", "base_num")


def _code(masks: Column, place: Column) -> Column:
    """The state code of a bit in a struct of masks."""
    return F.when(bit(masks["three"], place) == 1, 3).when(bit(masks["two"], place) == 1, 2).when(bit(masks["one"], place) == 1, 1).otherwise(0)


def mask_changes(masks: DataFrame) -> DataFrame:
    """The changes of ``changes``, from masks (see ``decode.masks``): masks are compared, and only bits that differ become rows."""
    order = Window.partitionBy(*MASK).orderBy("us", "seq")
    now = masks.withColumn("now", F.struct("one", "two", "three")).drop("one", "two", "three").withColumn("then", F.lag("now").over(order))
    return changed_bits(now)


def changed_bits(rows: DataFrame) -> DataFrame:
    """A change for each bit in which ``now`` differs from ``then``, both structs of masks; for all bits where ``then`` is null."""
    apart = F.lit(0)
    for name in ("one", "two", "three"):
        apart = apart.bitwiseOR(F.col("now")[name].bitwiseXOR(F.col("then")[name]))
    apart = F.when(F.col("then").isNull(), F.call_function("shiftleft", F.lit(1), F.col("width")) - 1).otherwise(apart)
    places = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: bit(F.col("apart"), i) == 1)
    rows = rows.withColumn("apart", apart).filter("apart <> 0").withColumn("i", F.explode(places))
    initial = F.col("then").isNull()
    old, new = (state_name(F.col("kind"), _code(F.col(c), F.col("i"))) for c in ("then", "now"))
    return rows.select("intersection_id", "kind", (F.col("base_num") + F.col("i")).alias("num"), "us", "seq", F.when(~initial, old).alias("old_state"), new.alias("new_state"), initial.alias("initial"))


def mask_state(masks: DataFrame, as_of: int | None = None) -> DataFrame:
    """The rows of ``current_state``, from masks: the last of each group becomes rows."""
    rows = masks if as_of is None else masks.filter(F.col("us") <= as_of)
    last = rows.groupBy(*MASK, "width").agg(F.max_by(F.struct("one", "two", "three"), F.struct("us", "seq")).alias("now"), F.max("us").alias("us"))
    rows = last.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return rows.select("intersection_id", "kind", (F.col("base_num") + F.col("i")).alias("num"), state_name(F.col("kind"), _code(F.col("now"), F.col("i"))).alias("state"), "us")


def expand_events(changed: DataFrame) -> DataFrame:
    """Each change as its general event, and as the event of its new state where there is one."""
    general = F.create_map(*[F.lit(x) for kv in GENERAL.items() for x in kv])[F.col("kind")]
    key = F.concat_ws("/", "kind", "new_state")
    specific = F.create_map(*[F.lit(x) for (k, s), v in SPECIFIC.items() for x in (f"{k}/{s}", v)])[key]
    return changed.withColumn("event_name", F.explode(F.array_compact(F.array(general, specific))))


def subscribe(events: DataFrame, event_name: str, num: int | None = None) -> DataFrame:
    """Events of one name, of one number if given."""
    found = events.filter(F.col("event_name") == event_name)
    return found if num is None else found.filter(F.col("num") == num)


def route(batch: DataFrame, handlers: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Hands each handler the events of its name; one that fails doesn't stop the others, its error is returned."""
    errors = {}
    for name, handler in handlers.items():
        try:
            handler(subscribe(batch, name))
        except Exception as e:  # a handler is foreign code
            errors[name] = repr(e)
    return errors


def match_transitions(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes that a rule (num, old_state, new_state) names; rules are joined as they are, Spark picks how."""
    return changed.join(rules, ["num", "old_state", "new_state"], "left_semi")


def watched(df: DataFrame, nums: list[int]) -> DataFrame:
    """Rows of the watched numbers."""
    return df.filter(F.col("num").isin(*nums))


def current_state(states: DataFrame, as_of: int | None = None) -> DataFrame:
    """The last state of each key, as of an instant if given."""
    rows = states if as_of is None else states.filter(F.col("us") <= as_of)
    return rows.groupBy(*KEY).agg(F.max_by("state", F.struct("us", "seq")).alias("state"), F.max("us").alias("us"))


def active(current: DataFrame, kind: str, state: str) -> DataFrame:
    """For each intersection the sorted numbers of a kind that are in a state."""
    rows = current.filter(F.col("kind") == kind)
    return rows.groupBy("intersection_id").agg(F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("num")))).alias("nums"))


def status_document(current: DataFrame) -> DataFrame:
    """For each intersection a map num -> state for each kind, and ``connected``."""

    def of(kind: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("num", "state"))))).alias(f"{kind}s")

    return current.groupBy("intersection_id").agg(*[of(k) for k in GENERAL], F.lit(True).alias("connected"))


def snapshots(states: DataFrame) -> DataFrame:
    """For each poll and kind the list of (num, state)."""
    return states.groupBy("intersection_id", "us", "kind").agg(F.array_sort(F.collect_list(F.struct("num", "state"))).alias("members"))


def member(members: Column, num: Column) -> Column:
    """The state of a number in a snapshot list, null if it isn't there."""
    return F.get(F.filter(members, lambda m: m["num"] == num), F.lit(0))["state"]


def poll_stats(samples: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Reads (polls), writes (``commands``: intersection_id, status, one row each) and failures of either, by intersection."""
    failed = (F.col("status") != "OK").cast("int").alias("failed")
    polls = samples.groupBy("intersection_id", "poll_us").agg(F.max(failed).alias("failed")).select("intersection_id", "failed", F.lit(1).alias("reads"), F.lit(0).alias("writes"))
    if commands is not None:
        polls = polls.unionByName(commands.select("intersection_id", failed, F.lit(0).alias("reads"), F.lit(1).alias("writes")))
    return polls.groupBy("intersection_id").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"), F.sum("failed").alias("errors"))


def state_as_of(events: DataFrame, states: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``events`` with the last state of their key at or before their instant.

    Both sides meet in one ordered window, so the plan has one shuffle and no range join.
    """
    both = events.withColumn("__side", F.lit(1)).unionByName(states.select(*key, "us", "seq", F.col("state").alias("__state")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*key).orderBy("us", "__side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("state_then", F.last("__state", ignorenulls=True).over(before)).filter("__side = 1").drop("__side", "__state")
