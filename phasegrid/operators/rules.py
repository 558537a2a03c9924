"""The discrepancy rules as candidates: continuous disagreement, orphan pulses; and what they read like."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phasegrid.functions.signals import seconds
from phasegrid.operators.pairs import PAIR, of_pairs


def rule1_candidates(spans: DataFrame, horizon_us: Column | None = None) -> DataFrame:
    """Disagreements that last longer than the threshold: fire_us is the instant the threshold ends.

    Open spans count up to ``horizon_us``; without one they are left out.
    """
    end = F.coalesce(F.col("end_us"), horizon_us) if horizon_us is not None else F.col("end_us")
    return spans.withColumn("fire_us", F.col("start_us") + F.col("threshold_us")).filter(end > F.col("fire_us"))


def rule2_candidates(pulse: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ended pulses of paired detectors that are shorter than the threshold and longer than nothing."""
    length = F.col("off_us") - F.col("on_us")
    return of_pairs(pulse, pairs).filter((length > 0) & (length < F.col("threshold_us")))


def orphan_pulses(candidates: DataFrame, intervals: DataFrame, pairs: DataFrame, compat: bool = False) -> DataFrame:
    """Candidates whose partner was off from threshold before to threshold after, both ends included.

    A partner's intervals don't overlap, so the latest one that begins by the
    window's end decides; it is found in one ordered window, without a range join.
    ``compat`` looks at the partner's last edges only: off at the verdict, and no ON
    edge inside the window.
    """
    mine = candidates.select(*PAIR, "side", "detector_id", "on_us", "off_us", "threshold_us", (F.col("off_us") + F.col("threshold_us")).alias("at_us"), F.lit(1).alias("turn"))
    partner = F.when(F.col("side") == "a", "b").otherwise("a")
    theirs = of_pairs(intervals, pairs).select(*PAIR, partner.alias("side"), F.col("on_us").alias("at_us"), F.lit(0).alias("turn"), F.struct("on_us", F.coalesce("off_us", F.lit((1 << 63) - 1)).alias("off_us")).alias("last"))
    upto = Window.partitionBy(*PAIR, "side").orderBy("at_us", "turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = mine.unionByName(theirs, allowMissingColumns=True).withColumn("last", F.last("last", ignorenulls=True).over(upto)).filter("turn = 1")
    active = F.col("last.off_us") > F.col("on_us") - F.col("threshold_us")
    if compat:
        active = (F.col("last.on_us") >= F.col("on_us") - F.col("threshold_us")) | (F.col("last.off_us") > F.col("at_us"))
    return seen.filter(~F.coalesce(active, F.lit(False))).select(*PAIR, "side", "detector_id", "on_us", "off_us", "threshold_us", F.col("at_us").alias("fire_us"))


def clip_length(on_us: Column, off_us: Column, threshold_us: Column, pre_roll_sec: float, post_roll_sec: float) -> Column:
    """Seconds of a clip that shows an orphan: pre-roll, pulse, post-roll and threshold."""
    return F.round(F.lit(pre_roll_sec) + seconds(off_us - on_us) + F.lit(post_roll_sec) + threshold_us / 1e6, 3)


#: Fixed names of the rules, and the fixed texts of a disagreement, an orphan and a stop.
RULES = {1: "rule1_continuous_disagreement", 2: "rule2_orphan_pulse"}
DISAGREEMENT = "detector '%s' ON, detector '%s' OFF for %ss (threshold=%ss)"
ORPHAN = "orphan on detector '%s': orphan pulse duration=%ss window=[%s, %s]"
STOPPED = "Rule 1 recording stopped after %.1fs post-roll"


def rule_name(rule: Column) -> Column:
    """The name of a rule's number."""
    return F.when(rule == 1, RULES[1]).when(rule == 2, RULES[2])


def describe_rule1(leader: Column, other: Column, spent_sec: Column, threshold_sec: Column) -> Column:
    """The text of a continuous disagreement."""
    return F.format_string(DISAGREEMENT, leader, other, spent_sec.cast("string"), threshold_sec.cast("string"))


def describe_rule2(det: Column, pulse_sec: Column, pulse_us: Column, fire_us: Column, threshold_us: Column) -> Column:
    """The text of an orphan pulse, with the window in which its partner stayed off."""
    return F.format_string(ORPHAN, det, pulse_sec.cast("string"), thousandths(pulse_us - threshold_us), thousandths(fire_us))


def thousandths(us: Column) -> Column:
    """An instant in seconds to the thousandth, as text; half a thousandth goes up."""
    ms = F.floor((us + 500) / 1000)
    return F.format_string("%d.%03d", F.floor(ms / 1000), F.pmod(ms, F.lit(1000)))


def describe_stop(post_roll_sec: float) -> Column:
    """The text of a stop."""
    return F.lit(STOPPED % post_roll_sec)
