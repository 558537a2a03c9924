"""Near-duplicates and repeated substrings against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import xxhash

from phasegrid.llm import block_dedup, hashing, simhash, suffix_dedup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, sf_dir):
    """The generated documents and planted ones: copies, near copies, passages at odd offsets, periodic texts."""
    rnd = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = [w for _, t in rows[:50] for w in (t or "").split()]
    passage = [rnd.choice(words) for _ in range(90)]
    for k in range(8):
        own = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        rows.append((10_000 - k, "  ".join([*own, *passage[k : 90 - 2 * k], *own[: k + 3]])))
    rows += [(20_000, "ab" * 500), (20_001, "x" * 900), (20_002, "x" * 399), (20_003, "x" * 400), (20_004, rows[3][1]), (20_004, rows[3][1]), (20_005, rows[4][1] + " more"), (20_006, None), (20_007, None)]
    return rows


def test_simhash(spark, sf_dir):
    rows = texts(spark, sf_dir)
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    fps = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(low))
        shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    a = np.array(fps, np.uint64)
    label = list(range(len(rows)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= 4) for x in a]
    label = [rows[i][0] for i in range(len(rows))]
    while changed:
        new = [min(label[j] for j in n) for n in near]
        changed, label = new != label, new
    want = sorted((rows[i][0], f"{fps[i]:016x}", label[i]) for i in range(len(rows)))
    got = sorted(tuple(r) for r in simhash.op1(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == want


def test_simhash_hot_buckets_are_split(spark):
    rnd = random.Random(1)
    base = rnd.getrandbits(63)
    fps = {base ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60)) for _ in range(300)} | {rnd.getrandbits(63) for _ in range(50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    split = {r["node"]: r["root"] for r in simhash.roots(simhash.links(df, chunk=40)).collect()}
    whole = {r["node"]: r["root"] for r in simhash.roots(simhash.links(df)).collect()}
    assert split == whole
    assert len(split) >= 250


def test_suffix_dedup(spark, sf_dir):
    rows = texts(spark, sf_dir)
    data = [(t or "").encode() for _, t in rows]
    for length in (400, 60):
        counts = collections.Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
        want = []
        for (d, _), b in zip(rows, data, strict=True):
            gone = bytearray(len(b))
            for k in range(len(b) - length + 1):
                if counts[b[k : k + length]] > 1:
                    gone[k : k + length] = b"\1" * length
            want.append((d, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
        got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=length).collect()
        assert sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got) == sorted(want)


def test_block_dedup(spark, sf_dir):
    rows = texts(spark, sf_dir)
    words = [SPACED.findall(t or "") for _, t in rows]
    first: dict = {}
    for (d, _), w in sorted(zip(rows, words, strict=True), key=lambda x: x[0][0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    want = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for i in range(k, k + 13)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = block_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept"]) for r in got) == sorted(want)


def test_block_dedup_tells_thue_morse_words_apart(spark):
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(d, " ".join(["w1 w2 w3 w4 w5 w6", w, "w8 w9 w10 w11 w12 w13"])) for d, w in ((1, x), (2, y), (3, y + " "))]
    got = {r["doc_id"]: r["n_removed"] for r in block_dedup.op9(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_rows_without_an_id_are_larger_than_any_and_spare_each_other(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(None, f"n{k} {passage} m{k}") for k in range(50)] + [(None, f"n{k} q{k} " + " ".join(f"z{i}" for i in range(15))) for k in range(9)] + [(7, passage), (8, f"x {passage}")]
    got = block_dedup.op9(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["n_removed"] for r in got if r["doc_id"] is None) == [0] * 9 + [20] * 50
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"]} == {7: 0, 8: 20}
    kept = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=30).collect()
    assert len(kept) == len(rows) and sum(len(r["kept"]) == len(r["removed"]) == 0 for r in kept) == 0


def test_many_rows_without_an_id_cost_no_more_each(spark):
    """Each row looks up its own answers only: no list of what all such rows were told."""
    df = spark.createDataFrame([(None, f"{k} " + " ".join(f"{k % 7}w{i}" for i in range(16))) for k in range(3000)], "doc_id bigint, text string")
    found = block_dedup.originals(df, "doc_id", "text")
    assert found.select("owner").distinct().count() == 3000 and found.filter("copies > 1").count() == 0


def test_texts_made_to_collide_stay_whole(spark):
    """Blocks in Thue-Morse order, which sums of powers modulo 2^64 can't tell apart: no 400 bytes occur twice."""
    rnd = random.Random(7)
    order = [bin(k).count("1") % 2 for k in range(64)]
    rows = []
    for pair in (("Mo7r", "Wh=C"), ("6-k1", 'wj>"')):
        for k in range(24):
            word = "".join(pair[bit ^ (k % 2)] for bit in order)
            rows.append((len(rows), "".join(rnd.choice("abcdefghij") for _ in range(72)) + word + "".join(rnd.choice("klmnopqrst") for _ in range(72))))
    got = suffix_dedup.op2(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 48 and {(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {(400, 0, 0)}


def test_stretches_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    start, end = np.array([0, 3, 6, 9, 0]), np.array([3, 6, 9, 12, 0])
    a, b, c, d, nothing = hashing.stretch_digests(data, start, end, b"k" * 32).tolist()
    assert a == b == d and a != c and nothing not in (a, c)
    assert hashing.stretch_digests(data, start, end, b"l" * 32).tolist()[0] != a
    assert hashing.stretch_digests(data, start[:0], end[:0], b"k").shape == (0, 2)
