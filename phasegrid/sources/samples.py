"""Samples of controllers, from files or a stream, and views that shape generic events like them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions.signals import micros
from phasegrid.sources import oids

SAMPLES = "intersection_id string, poll_us bigint, seq bigint, oid string, value int, status string"


def read_samples(spark: SparkSession, path: str, stream: bool = False, form: str = "parquet") -> DataFrame:
    """Logged samples as a table or a stream, always with an explicit schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SAMPLES).format(form).load(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic events with their instant in microseconds and the number k of their properties."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("event_id", micros(F.col("ts")).alias("us"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat(F.lit("I"), (F.col("user_id") % 4).cast("string")).alias("intersection_id"))


#: What an event is sampled as: (oid, value), in the order of reading; plain arithmetic on event_id, user_id and k.
READINGS = (
    [(f"concat('{oids.PHASE}.{c}.', 1 + event_id % 2)", v) for c, v in ((2, "(event_id * 7 + k) % 256"), (3, "(event_id * 13 + user_id) % 256"), (4, "(event_id * 31 + 5 * k) % 256"))]
    + [(f"'{oids.OVERLAP}.{c}.1'", v) for c, v in ((2, "(event_id * 11 + k) % 256"), (3, "(event_id * 3 + user_id) % 256"), (4, "(event_id * 29 + k) % 256"))]
    + [(f"'{oids.PHASE}.{c}.1'", v) for c, v in ((5, "(event_id * 5 + 3 * k) % 256"), (6, "(event_id * 17 + user_id) % 256"), (7, "(event_id * 19 + k) % 256"))]
    + [(f"concat('{oids.DETECTOR}.', 1 + user_id % 8)", "(event_id * 17 + k) % 256"), (f"concat('{oids.OUTPUT}.', 1 + user_id % 16)", "k % 3")]
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: eleven readings each; some lack a colour, and polls of error events fail part-way.

    Events are dealt by poll before they become samples, so that polls can be put
    together where they are made.
    """
    read = F.array(*[F.struct(F.lit(j).alias("j"), F.expr(oid).alias("oid"), F.expr(f"CAST({value} AS INT)").alias("value")) for j, (oid, value) in enumerate(READINGS)])
    rows = events(spark, sf_dir).withColumnRenamed("us", "poll_us").repartition("intersection_id", "poll_us").select("*", F.explode(read).alias("r")).filter("NOT (r.j = 1 AND event_id % 11 = 0)")
    failed = (F.col("event_type") == "error") & (F.col("r.j") >= F.col("event_id") % 11)
    return rows.select("intersection_id", "poll_us", (F.col("event_id") * 16 + F.col("r.j")).alias("seq"), "r.oid", "r.value", F.when(failed, "ERR").otherwise("OK").alias("status"))


def detector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of single detectors: (intersection_id, detector_id, us, seq, is_on)."""
    e = events(spark, sf_dir)
    side = F.when(F.col("event_type").isin("view", "click"), 1).otherwise(2)
    return e.select("intersection_id", (F.expr("(user_id div 4) % 3") * 2 + side).cast("string").alias("detector_id"), "us", F.col("event_id").alias("seq"), (F.col("k") % 2 == 1).alias("is_on"))


#: The camera that an event stands for.
CAMERA = "concat('C', (user_id div 4) % 3)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of cameras: (intersection_id, camera_id, frame_us, seq)."""
    return events(spark, sf_dir).select("intersection_id", F.expr(CAMERA).alias("camera_id"), F.col("us").alias("frame_us"), F.col("event_id").alias("seq"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as writes to controllers: (intersection_id, status), some of them failed."""
    return events(spark, sf_dir).filter("event_type = 'purchase'").select("intersection_id", F.when(F.col("k") % 7 == 0, "ERR").otherwise("OK").alias("status"))
