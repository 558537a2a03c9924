"""Filter interaction audit: what each filter removes in every order of a set of filters.

Each filter has a table of the ids that fail it, and nothing else of the documents is
needed: documents that fail no filter survive every prefix.  A prefix removes from a
filter's table what left-anti joins with the tables of the prefix's filters leave of
it; left-semi joins with the ids of labelled documents give what a removal costs.
Survivors, redundancies and Shapley values are sums of these counts, which depend on
the set of filters before, not on its order: 80 numbers a part for five filters.
Tables of ids are merged, never broadcast: the driver holds none of them.

Ids: a row's key is its doc_id and a digest of its text, on which failing depends, so
repeated rows share a key and are counted.  Null texts are empty; null doc_ids are
told apart by their texts, never have labels and never are copies of a smaller id;
a doc_id with several labels has each of them.  Empty tables give no rows.
"""

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phasegrid.llm.common import cut, shared_dir, written

#: Parts that the rows of one text or of one doc_id are dealt to where they meet their group.
SALTS = 32
#: Rows of failing ids in a file.
IDS_A_FILE = 50_000
#: The filters: four of a text, and E for copies.
FILTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails: too short, repetitive, loud, with signs of code or prices.

    Words are maximal runs of bytes other than space and the control characters 9 to 13.
    """
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.char_length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, part, digest, failed, n): each key once, with the letters of the text filters that it fails and its rows."""
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), part.alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    failed = F.concat(*[F.when(c, name).otherwise("") for name, c in text_filters(F.col("text")).items()])
    found = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed"))
    keys = found.select(F.coalesce("doc_id", F.xxhash64(F.lit(1), "digest")).alias("k1"), F.xxhash64("digest").alias("k2"), "*")
    return keys.groupBy("k1", "k2", "doc_id", "part", "digest", "failed").agg(F.count("*").alias("n"))


def salted(df: DataFrame) -> DataFrame:
    """``df`` once for each salt, to be met by rows that were dealt one.

    Spark takes its size for that before the salts, and would send SALTS times a
    broadcast's limit through the driver; so it is to be merged.
    """
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def copies(keys: DataFrame) -> DataFrame:
    """The keys whose text a smaller doc_id has too; groups of copies are dealt to SALTS parts."""
    groups = keys.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").drop("last_id")
    dealt = keys.withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted(groups), ["digest", "salt"]).filter("doc_id > first_id")


def failing_ids(keys: DataFrame, rows: int) -> DataFrame:
    """Stored tables (k1, k2, doc_id, part, n) of the keys that fail a filter, one for each value of ``filter``; ``rows`` is about how many keys there are."""
    letter = F.explode(F.split(F.col("failed"), "")).alias("filter")
    texts = keys.filter("failed <> ''").select("k1", "k2", "doc_id", "part", "n", letter)
    both = texts.unionByName(copies(keys).select("k1", "k2", "doc_id", "part", "n", F.lit("E").alias("filter")))
    path = shared_dir(keys.sparkSession)
    both.repartition(1 + rows // IDS_A_FILE).write.partitionBy("filter").option("compression", "zstd").parquet(path)
    return keys.sparkSession.read.schema("k1 bigint, k2 bigint, doc_id bigint, part string, n bigint, filter string").parquet(path)


def removals(failing: DataFrame, names: str, labelled: dict[str, DataFrame]) -> DataFrame:
    """(part, bit, prefix, removed, and a column for each label): rows that fail a filter and none of a prefix's filters.

    ``bit`` and ``prefix`` are a filter and a set of others as bits in the order of
    ``names``.  ``labelled``: tables (doc_id) of documents with a label.
    """
    # one anti join with the tables of all filters and one semi join with those of all labels: a row's prefix and label say which of them count
    everything = failing.withColumn("bit", F.element_at(F.array(*[F.lit(1 << k) for k in range(len(names))]), F.instr(F.lit(names), F.col("filter"))))
    dealt = everything.select("k1", "k2", "doc_id", "part", "bit", "n", F.pmod("k2", F.lit(SALTS)).cast("int").alias("salt"))
    rows = dealt.withColumn("label", F.lit(""))
    if labelled:
        theirs = reduce(DataFrame.unionByName, [ids.select("doc_id", F.lit(name).alias("label")) for name, ids in labelled.items()])
        either = dealt.withColumn("label", F.explode(F.array(*map(F.lit, labelled))))
        rows = rows.unionByName(either.join(salted(theirs.filter("doc_id IS NOT NULL").distinct()), ["doc_id", "label", "salt"], "left_semi"))
    # one shuffle by key before rows are made of the prefixes; the join after it keeps that partitioning
    rows = rows.select("k1", "k2", "part", "bit", "label", "n").repartition("k1", "k2")
    others = F.filter(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)), lambda p: p.bitwiseAND(F.col("bit")) == 0)
    theirs = everything.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("bit").alias("before")).hint("merge")
    same = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("prefix").bitwiseAND(F.col("before")) != 0)
    left = rows.withColumn("prefix", F.explode(others)).join(theirs, same, "left_anti")
    counts = [F.sum(F.when(F.col("label") == name, F.col("n")).otherwise(0)).alias(name or "removed") for name in ("", *labelled)]
    return left.groupBy("part", "bit", "prefix").agg(*counts)


def audit(docs: DataFrame, labelled: dict[str, DataFrame]) -> DataFrame:
    """One row for each part, order of the five filters and step: see ``op11`` for the counts; a column for each label's losses."""
    keys = written(keyed(docs))
    names = FILTERS
    removed = cut(removals(failing_ids(keys, keys.count()), names, labelled).coalesce(8))
    full, n = (1 << len(names)) - 1, len(names)
    before = F.bit_count("prefix")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), before + 1)
    alone = F.col("prefix") == F.lit(full) - F.col("bit")
    by_filter = removed.groupBy("part", "bit").agg(F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("failing"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    steps = _steps(keys.groupBy("part").agg(F.sum("n").alias("total")), names)
    found = steps.join(removed, ["part", "bit", "prefix"], "left").join(by_filter, ["part", "bit"], "left")
    counts = ("removed", "failing", "unique_fails", "shapley", *labelled)
    found = found.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *labelled, "shapley")


def _steps(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``parts`` once for each order and step, with the step's filter and those before it as bits."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))

    def bits(letters: Column) -> Column:
        total = F.lit(0)
        for k, name in enumerate(names):
            total = total + F.when(F.contains(letters, F.lit(name)), 1 << k).otherwise(0)
        return total

    return rows.withColumn("bit", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("prefix", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's counts: each part (a lang value; null: empty), order of A to E and step, zeros included.

    kept, removed, redundant (fails the step's filter, removed earlier), unique_fails
    (fails no other), good_lost and toxic_lost (removed, labelled quality=1 and
    toxic=1), shapley (removed by the filter, summed over all orders).
    """
    return audit(docs, {"good_lost": labels.filter("quality = 1").select("doc_id"), "toxic_lost": labels.filter("toxic = 1").select("doc_id")})
