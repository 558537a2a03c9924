"""Rows that near-duplicate removal keeps: row by row, and against brute-force similarity."""

import itertools
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from phasegrid.llm import shingles, simhash

WORDS = [f"w{k}" for k in range(400)]


def text(k, n=40):
    return " ".join(f"t{k}x{i}" for i in range(n))


def kept(df):
    return sorted((str(r["doc_id"]), r["text"]) for r in df.collect())


def test_rows_without_an_id_or_with_the_same_id_are_told_apart(spark):
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (5, text(3)), (5, text(4)), (1, text(5)), (7, text(5)), (7, text(6)), (None, text(6))]
    want = sorted((str(d), t) for d, t in [(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (1, text(5)), (7, text(6))])
    assert kept(simhash.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))) == want


def shingle_set(t):
    w = (t or "").split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def similar(a, b):
    return a == b or bool(a | b) and len(a & b) >= 0.8 * len(a | b)


def survivors(rows):
    """The smallest doc_id of each component, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    label = [d for d, _ in rows]
    near = [[j for j in range(len(rows)) if similar(sets[i], sets[j])] for i in range(len(rows))]
    while True:
        new = [min(label[j] for j in n) for n in near]
        if new == label:
            return set(label)
        label = new


def planted(seed=3):
    """Texts with copies from equal to far, chains of them, templates with other words, and short ones."""
    rnd, rows = random.Random(seed), []
    line = " ".join(rnd.choice(WORDS) for _ in range(25))
    for base in range(60):
        words = [rnd.choice(WORDS) for _ in range(rnd.choice((3, 6, 12, 40, 150, 600)))]
        for _ in range(rnd.randint(1, 5)):
            rows.append((rnd.randrange(1_000_000) * 100 + len(rows), " ".join(words) + (" " + line if base % 3 == 0 else "")))
            for _ in range(rnd.randint(0, 1 + len(words) // 30)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return [*rows, (7, ""), (8, None), (9, " \n"), (10, "a b c d e"), (11, "a b c d e f"), (12, "a b c d")]


def band(rows):
    """How many pairs lie between 0.8 and 0.95."""
    sets = [shingle_set(t) for _, t in rows]
    return sum(0.8 <= len(a & b) / len(a | b) < 0.95 for a, b in itertools.combinations(sets, 2) if a | b)


def test_near_copies_are_those_of_brute_force(spark):
    rows = planted()
    assert band(rows) >= 10
    for options in ({}, {"chunk": 3, "waves": 0}):  # buckets met whole, and chunk against chunk
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()
        assert {r["doc_id"] for r in got} == survivors(rows)
        assert len(got) == len(survivors(rows))


def test_near_copies_without_fingerprints(spark, monkeypatch):
    """Fingerprints that link nothing, or everything, change nothing: sets decide."""
    rows = planted(4)
    for links in (lambda fps, *_: fps.selectExpr("fp AS a", "fp AS b").limit(0), lambda fps, *_: fps.selectExpr("fp AS a", "min(fp) OVER (ORDER BY fp) AS b").filter("a <> b")):
        monkeypatch.setattr(simhash, "links", links)
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r["doc_id"] for r in got} == survivors(rows)


def test_near_copies_on_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(None, None), (None, ""), (3, " "), (4, text(1)), (4, text(1)), (4, text(2)), (None, text(2)), (None, text(3)), (None, text(4))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("'x' AS node", "'y' AS digest", "doc_id", "text", "1 AS root")
    got = simhash.near_duplicates(df)
    assert got.columns == df.columns
    assert kept(got) == sorted([("3", " "), ("4", text(1)), ("4", text(2)), ("None", text(3)), ("None", text(4))])


def test_a_filter_passes_all_that_it_was_made_of(spark):
    df = spark.range(2000).selectExpr("unhex(sha2(CAST(id AS STRING), 256)) AS node", "id")
    asked, sure = shingles.split_by(df, "node", shingles.filter_words(df.filter("id % 10 = 0"), "node"))
    assert asked.filter("id % 10 = 0").count() == 200 and asked.count() < 210 and asked.count() + sure.count() == 2000


def test_the_stage_of_the_pipeline_drops_them(spark):
    words = [f"t{k}" for k in range(100)]
    other = [*words[:30], "x", *words[31:60], "y", *words[61:]]
    assert similar(shingle_set(" ".join(words)), shingle_set(" ".join(other)))
    df = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(other)), (3, text(9))], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]


def test_unlike_texts_of_one_key_make_no_pairs(spark):
    """A passage that many texts share is a key of all of them; their sketches tell them apart within the bucket."""
    rows = [(k, text(1, 9) + " " + text(k, 30)) for k in range(100, 300)] + [(300, text(1, 9) + " " + text(299, 30) + " more")]
    found = shingles.profiles(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "X'00' AS digest", "text"), 5).filter("node IS NOT NULL")
    keyed = found.selectExpr("1L AS key", "node", "size", "0 AS pos", "node AS label").join(shingles.folded(found), "node")
    want = {r["node"] for r in found.filter("doc_id >= 299").collect()}
    for chunk in (1000, 7):
        got = shingles.bucket_pairs(keyed, 0.8, chunk).collect()
        assert len(got) == 1 and {got[0]["a"], got[0]["b"]} == want


def test_members_travel_packed_by_bucket(spark):
    """A row a slice and bucket, not one a member; what meets is what several texts have, once a text."""
    rows = [(k, text(k % 40) + " " + text(k, 30)) for k in range(300)] + [(300, text(7) + " " + text(7, 30))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    common = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    packed = shingles.prefixes(docs, 5, 0.8, common, 4)
    assert packed.count() <= 3 * 4
    met = shingles.meeting(packed).collect()
    assert len({(r["key"], r["node"]) for r in met}) == len(met) > 0
    found = {}
    for r in shingles.meeting(shingles.prefixes(docs, 5, 0.8, common, 1)).collect():
        found.setdefault(r["key"], set()).add((bytes(r["node"]), r["size"], r["pos"]))
    assert min(map(len, found.values())) > 1
    want = {}
    for _, sets, nodes, _ in shingles.of_batches(iter([pa.RecordBatch.from_pydict({"text": [t for _, t in rows[:300]]})]), 5):
        for k, node in enumerate(nodes):
            h = np.sort(sets.hashes[sets.bounds[k] : sets.bounds[k + 1]])
            for pos in range(len(h) - int(np.ceil(0.8 * len(h) - 1e-9)) + 1):
                want.setdefault(int(h[pos].view(np.int64)), set()).add((node, len(h), pos))
    assert found == {key: v for key, v in want.items() if len(v) > 1}
