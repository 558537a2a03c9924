"""Toxicity by weak supervision.

Voters for toxic are lexicon entries (whole words) and patterns (word prefixes that
so many different words of a text start with), collected from a bounded sample of
labelled training rows as a dictionary would be; voters for clean are texts without
any lexicon entry, and without any pattern.  A generative label model then sees
their votes only, and of the labels no more than the share of toxic rows: EM
estimates how often each voter fires on toxic and on clean texts, and how each
depends on the voter that it is most correlated with (a tree of pairs).  Its
posterior labels train a linear classifier, which scores whole texts.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import cut, fresh, released, without

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the prefixes that patterns are made of; a lexicon entry ends with END.
PREFIXES, END = (3, 4, 5, 6, 7, 8), "\x00"
#: A pattern votes when this many different words match; each number is a voter of its own.
LEVELS = (1, 2, 3)


@dataclass
class Model:
    """A linear classifier over the voters for toxic that fire on a text."""

    voters: dict[str, int]
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.heads = heads_of(self.voters)

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[v] for v in fired(text, self.voters, self.heads))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def heads_of(voters: dict[str, int]) -> set[str]:
    """The first letters of all voters: most words begin with none of them."""
    return {v.rstrip(END + "".join(map(str, LEVELS)))[: PREFIXES[0]] for v in voters}


def all_votes(text: str) -> set[str]:
    """Every vote that a text could cast: lexicon entries, and patterns with their levels."""
    words = set(WORD.findall(text.lower()))
    found = Counter(w[:k] for w in words for k in PREFIXES if len(w) >= k)
    return {w + END for w in words} | {f"{p}{k}" for p, n in found.items() for k in LEVELS if n >= k}


def fired(text: str, voters: dict[str, int], heads: set[str]) -> list[int]:
    """The voters that fire on a text; ``heads`` as ``heads_of`` gives them."""
    stems: Counter = Counter()
    out = []
    for word in set(WORD.findall(text.lower())):
        if word[: PREFIXES[0]] not in heads:
            continue
        v = voters.get(word + END)
        if v is not None:
            out.append(v)
        for k in PREFIXES:
            stem = word[:k]
            if len(stem) < k:
                break
            if stem + "1" in voters or stem + "2" in voters or stem + "3" in voters:
                stems[stem] += 1
    return out + [voters[t] for stem, n in stems.items() for k in LEVELS if n >= k and (t := f"{stem}{k}") in voters]


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from; rows without a doc_id are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled rows that aren't held out, chosen by a hash of doc_id.

    The sample's ids are few by that bound and are broadcast, so no text is shuffled.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def find_voters(rows: DataFrame, most: int, least: int, odds: float) -> list[str]:
    """Terms that mark toxic rows: in ``least`` of them at least, ``odds`` times as frequent as in clean rows.

    Candidates come from the toxic rows of the sample, then only those are counted
    in the clean ones; both are bounded by the sample.
    """

    def counts(part: DataFrame, among: frozenset[str] | None) -> dict[str, int]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for text in batch["text"].to_pylist():
                    votes = all_votes(text)
                    found.update(votes if among is None else votes & among)
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        totals = part.select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in (totals.filter(F.col("n") >= least) if among is None else totals).collect()}

    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return []
    toxic = counts(rows.filter("label = 1"), None)
    clean = counts(rows.filter("label = 0"), frozenset(toxic))

    def ratio(term: str) -> float:
        return ((toxic[term] + 0.5) / (sizes[1] + 1)) / ((clean.get(term, 0) + 0.5) / (sizes[0] + 1))

    return sorted((t for t in toxic if ratio(t) >= odds), key=lambda t: (-ratio(t), -toxic[t], t))[:most]


def dependences(votes: np.ndarray, toxic: np.ndarray, posterior: np.ndarray, correlated: float) -> np.ndarray:
    """For each voter the one that its residuals are most correlated with given the label, -1 for none.

    The pairs are a maximum spanning forest over correlations of ``correlated`` at
    least.  Voters for clean hang on the others by their making and stay apart.
    """
    n, k = votes.shape
    mean = [(m @ votes) / max(m.sum(), 1e-9) for m in (posterior, 1 - posterior)]
    rest = votes - (posterior[:, None] * mean[0] + (1 - posterior[:, None]) * mean[1])
    sd = rest.std(axis=0) + 1e-9
    strength = np.abs(rest.T @ rest / n / np.outer(sd, sd)) * np.outer(toxic, toxic)
    parent, left = np.full(k, -1), np.arange(k) > 0
    best, nearest = strength[0].copy(), np.zeros(k, np.int64)
    while left.any():
        j = int(np.argmax(np.where(left, best, -1)))
        left[j] = False
        parent[j] = nearest[j] if best[j] >= correlated else -1
        nearer = strength[j] > best
        best, nearest = np.where(nearer, strength[j], best), np.where(nearer, j, nearest)
    return parent


def label_model(votes: np.ndarray, toxic: np.ndarray, balance: float, rounds: int = 40, correlated: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, P(fires | toxic), P(fires | clean), parent) from a 0/1 matrix of rows by voters.

    ``toxic``: which voters vote for toxic, the others vote for clean; ``balance``:
    the share of toxic rows.  No label of any row is seen.  EM starts from rows on
    which a voter for toxic fires, and holds voters to be better than chance.  A
    voter that doesn't fire says nothing.  A voter's rates are estimated apart for
    rows on which its parent (see ``dependences``) fires and doesn't, so that no
    evidence counts twice; parents are found again once the posterior has settled.
    """
    k = votes.shape[1]
    posterior = np.where(votes[:, toxic].any(axis=1), 0.9, 0.02)
    prior = np.log(balance / (1 - balance))

    def rate(fires: np.ndarray, rows: np.ndarray, before: np.ndarray, weight: float) -> np.ndarray:
        return np.clip((fires + weight * before) / (rows + weight), 1e-5, 0.9999)

    for _ in range(2):
        parent = dependences(votes, toxic, posterior, correlated)
        up = votes[:, np.maximum(parent, 0)] * (parent >= 0)
        both, alone = votes * up, votes * (1 - up)
        for _ in range(rounds):
            mass = posterior, 1 - posterior
            on, off = (rate(m @ votes, m.sum(), np.full(k, b), 1.0) for m, b in zip(mass, (0.05, 0.001), strict=True))
            on = np.where(toxic, np.maximum(on, 1.5 * off), np.minimum(on, off / 1.1)).clip(1e-5, 0.9999)
            given = [[rate(m @ part, m @ seen, r, 2.0) for m, r in zip(mass, (on, off), strict=True)] for part, seen in ((both, up), (alone, 1 - up))]
            weight = [np.where(parent >= 0, np.log(a / b), np.log(on / off)) for a, b in given]
            z = prior + both @ weight[0] + alone @ weight[1]
            last, posterior = posterior, 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if np.abs(posterior - last).max() < 1e-4:
                break
    return posterior, on, off, parent


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        h = (xb * (p * (1 - p) + 1e-6)[:, None]).T @ xb + np.diag(penalty)
        step = np.linalg.solve(h, xb.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 12_000, most: int = 400, least: int = 5, odds: float = 100.0) -> Model:
    """Fits on at most ``max_rows`` labelled rows (a documented bound); held-out rows are never read for labels.

    ``most``: voters kept; ``least``: toxic rows a voter needs; ``odds``: how much
    more frequent it is in toxic rows.  Labels other than 0 and 1 are left out;
    without labels of both kinds the model has no voters and scores every text by
    the share of toxic rows.  Texts are taken whole at any length, null ones count
    as empty; of repeated labels the larger counts, repeated documents count each;
    an empty table gives a model too.
    """
    rows = cut(training_rows(documents, labels, "toxic", max_rows))
    terms_found = find_voters(rows, most, least, odds)
    voters = {t: i for i, t in enumerate(terms_found)}
    heads = heads_of(voters)

    @F.arrow_udf("array<int>")
    def vote(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(fired(t, voters, heads)) for t in texts.to_pylist()], pa.list_(pa.int32()))

    sample = sorted((r["doc_id"], r["label"], r["v"]) for r in rows.select("doc_id", "label", vote("text").alias("v")).collect())  # max_rows at most
    balance = float(np.clip(np.mean([r[1] for r in sample]) if sample else 0.1, 0.01, 0.5))
    if not voters:
        return Model({}, np.zeros(0), float(np.log(balance / (1 - balance))))
    votes = np.zeros((len(sample), len(voters)))
    for i, r in enumerate(sample):
        votes[i, r[2]] = 1
    first = np.sort(np.unique(votes, axis=1, return_index=True)[1])  # voters that always agree count once
    found, lexicon = votes[:, first], np.array([terms_found[j].endswith(END) for j in first])
    silent = [1.0 - found[:, kind].any(axis=1) for kind in (lexicon, ~lexicon)]  # the voters for clean
    posterior, *_ = label_model(np.column_stack([found, *silent]), np.arange(len(first) + 2) < len(first), balance)
    weights, bias = logistic(found, posterior)
    return Model({terms_found[j]: i for i, j in enumerate(first)}, weights, bias)


def score(text: Column, model: Model) -> Column:
    """The toxicity (0 to 1) of a text column; null and empty texts score by the bias alone."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(t.as_py() or "") for t in batch], pa.float64())
        released()

    return run(text)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``toxicity``; a column of that name is replaced, all rows and other columns stay."""
    own = fresh(df, "__score")
    return without(df.withColumn(own, score(F.col(text), model)), "toxicity").withColumnRenamed(own, "toxicity")


def op7(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted (score >= 0.5)."""
    model = fit(documents, labels, **options)
    return scored(documents.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
