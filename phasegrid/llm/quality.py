"""Quality classifier: a sparse ensemble of rules.

Trees are grown on statistics of a bounded sample of labelled rows; every path
from a root is a rule, a conjunction of thresholds.  A lasso logistic regression
weighs the rules and drops most; what stays is compiled into one Spark column
expression over the statistics, so scoring runs inside generated code.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import cut, fresh, slices, string_bytes, without
from phasegrid.llm.toxicity import held_out, training_rows

#: Statistics of a text, all bounded or logarithmic.
FEATURES = ("log_bytes", "word_bytes", "upper", "digit", "symbol", "exclaim", "pipe", "stop", "newline", "distinct_words", "adjacent_repeats", "distinct_lines")
STATISTICS = "struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"

#: Byte classes: 1 upper case, 2 digits, 3 symbols, 4 exclamation marks, 5 bars, 6 sentence marks, 7 line ends.
CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+<=>@\\^_`{}~/[]", b"!", b"|", b".,;:?", b"\n"), 1):
    CLASSES[list(_chars)] = _k


def statistics_of(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; texts without bytes have zeros, and ones for the distinct shares."""
    data, offsets = string_bytes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j in slices(offsets, 4 << 20):
        part = CLASSES[data[offsets[i] : offsets[j]]]
        at = offsets[i : j + 1] - offsets[i]
        size = np.maximum(np.diff(at), 1)
        out[i:j, 0] = np.log1p(np.diff(at))
        for k in range(1, 8):
            out[i:j, 1 + k] = np.diff(np.concatenate(([0], np.cumsum(part == k, dtype=np.int64)))[at]) / size
        for row, text in enumerate(texts[i:j].to_pylist(), i):
            words, lines = (text or "").split(), (text or "").split("\n")
            n = max(1, len(words))
            out[row, 1] = min(100.0, (offsets[row + 1] - offsets[row]) / n)
            out[row, 9] = len(set(words)) / n if words else 1.0
            out[row, 10] = sum(map(eq, words, words[1:])) / n
            out[row, 11] = len(set(lines)) / len(lines)
    return out


def statistics(text: Column) -> Column:
    """The statistics of a text column as a struct; null counts as empty."""

    @F.arrow_udf(STATISTICS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = statistics_of(batch)
            yield pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(FEATURES))], list(FEATURES))

    return run(text)


#: One rule: (feature, "<=" or ">", threshold), all of which must hold.
Rule = tuple[tuple[str, str, float], ...]


@dataclass
class RuleModel:
    """Weighted rules and a bias."""

    rules: list[tuple[Rule, float]]
    bias: float

    def column(self, stats: Column) -> Column:
        """The score, 0 to 1, as an expression over a statistics struct."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule: Rule, stats: Column) -> Column:
    """Whether all conditions of a rule hold."""
    return reduce(and_, [stats[f] <= t if op == "<=" else stats[f] > t for f, op, t in rule])


def tree_rules(described: str) -> list[Rule]:
    """The paths of a tree, as Spark ML describes it, one rule for each node below the root."""
    out, path = [], []
    for line in described.splitlines():
        found = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = (len(line) - len(line.lstrip())) // 1
            path = [p for p in path if p[0] < depth] + [(depth, (FEATURES[int(found[1])], found[2], float(found[3])))]
            out.append(tuple(p[1] for p in path))
    return out


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 12_000, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fits on at most ``max_rows`` labelled rows (a documented bound) that aren't held out.

    Labels other than 0 and 1 are left out; without labels of both kinds the score is
    that of the only label, or one half without any.  Texts are taken whole at any
    length, null ones count as empty; of repeated labels the larger counts, repeated
    documents count each; ties between splits go by Spark ML's order; an empty table
    gives a model too.
    """
    rows = training_rows(documents, labels, "quality", max_rows)
    rows = cut(rows.select("label", statistics(F.col("text")).alias("s")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleModel([], 4.0 if 1 in counts else -4.0 if 0 in counts else 0.0)
    data = rows.select(F.col("label").cast("double").alias("label"), "s", array_to_vector(F.array(*[F.col("s")[f] for f in FEATURES])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(data)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t.toDebugString)))
    if not rules:
        share = counts[1] / sum(counts.values())
        return RuleModel([], float(np.log(share / (1 - share))))
    held = data.select("label", array_to_vector(F.array(*[holds(r, F.col("s")).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(held)
    return RuleModel([(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w], float(lasso.intercept))


def scored(df: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """Adds ``quality_score``; a column of that name is replaced, all rows and other columns stay."""
    own = fresh(df, "__stats")
    with_stats = without(df.withColumn(own, statistics(F.col(text))), "quality_score")
    return with_stats.withColumn("quality_score", model.column(F.col(own))).drop(own)


def op5(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted (score >= 0.3)."""
    model = fit(documents, labels, **options)
    return scored(documents.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
