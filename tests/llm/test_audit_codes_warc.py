"""Filter audit, vector codes and archives against plain loops, on odd rows, empty tables and damaged files."""

import gzip
import hashlib
import itertools
import random

import numpy as np
import pytest

from phasegrid.llm import filter_audit, vector_codes, warc
from phasegrid.llm.common import shared_dir

DOCS = "doc_id bigint, text string, lang string, k1 string, salt int, filter string, digest string, n string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "w") for r in rows], DOCS)


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def failing(rows):
    """The letters that each row fails, looked at one by one."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = t.translate(dict.fromkeys(range(9, 14), " ")).split(" ")
        words = [w for w in words if w]
        found = set()
        found |= {"A"} if len(words) < 200 else set()
        found |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        found |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        found |= {"D"} if any(c in t for c in "#$%&*|") else set()
        found |= {"E"} if i is not None and smallest[t] < i else set()
        out.append(found)
    return out


def test_audit_replays_every_order(spark):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice(("alpha", "Beta", "gamma#", "été", "x|y", "w%d" % k)) for k in range(n)) for n in (0, 1, 50, 199, 200, 260)]
    pool += [" ".join(f"u{k}" for k in range(n)) for n in (199, 200, 5_000)] + [None, "", " \t\n", "A" * 40, "same words " * 150]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(pool), rnd.choice([None, "", "en", "de"])) for _ in range(400)]
    marks = [(k, rnd.choice((0, 1, None)), rnd.choice((0, 1, None))) for k in range(0, 60, 2)] + [(4, 1, 0), (4, 1, 0), (None, 1, 1)]
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    fails = failing(rows)
    want = {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                all_failing = sum(letter in f for _, f in mine)
                left = [r for r in left if letter not in r[1]]
                shapley[letter] += len(gone)
                found.append(("".join(order), step, letter, len(left), len(gone), all_failing - len(gone), sum(f == {letter} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        for order, step, letter, *counts in found:
            want[part, order, step] = (*counts, shapley[letter])
    got = filter_audit.op11(documents(spark, rows), label_rows(spark, marks)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want
    assert len(got) == len(want)


def test_audit_of_nothing_and_without_labels(spark):
    assert filter_audit.op11(documents(spark, []), label_rows(spark, [])).count() == 0
    got = filter_audit.op11(documents(spark, [(1, "short", "en"), (2, "short", "en")]), label_rows(spark, [])).collect()
    assert {r["good_lost"] + r["toxic_lost"] for r in got} == {0} and len(got) == 600
    assert {(r["filter_order"], r["step"]): r["kept"] for r in got}["EABCD", 1] == 1


def test_audit_sends_no_ids_through_the_driver(spark, monkeypatch):
    docs = documents(spark, [(k, f"text {k % 40}", "en") for k in range(80)])
    plans = []

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(filter_audit, "cut", ran)
    filter_audit.op11(docs, label_rows(spark, [(k, 1, 1) for k in range(80)]))
    ran(filter_audit.copies(filter_audit.keyed(docs)))
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def full_rescan(rows, rounds=6):
    """(vec_id: (code, error)), codebooks: every part against every entry in every round, in Python's whole numbers."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * 4096)) for x in v]) for i, v in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    size = len(kept[0][1]) // 8
    parts = [[v[p * size : (p + 1) * size] for p in range(8)] for _, v in kept]
    books = [[list(v[p]) for v in parts[:16]] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(8)] for v in parts]

    for _ in range(rounds):
        found = assign()
        for p in range(8):
            for k in range(len(books[p])):
                mine = [v[p] for v, f in zip(parts, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found, strict=True)}, books


@pytest.mark.parametrize(("n", "dim", "values"), [(300, 16, 6), (5, 8, 50), (120, 64, 3), (80, 8, 1000)])
def test_codes_are_those_of_full_rescans(spark, n, dim, values):
    rnd = random.Random(n)
    scale = 4000.0 if values == 1000 else 1.0  # four bytes a component, or two
    rows = [(k * 7, [scale * rnd.randint(-values, values) / values for _ in range(dim)]) for k in range(n)]  # few values: many ties
    want, books = full_rescan(rows)
    df = spark.createDataFrame([(i, v, k % 3 if k % 5 else None, "x") for k, (i, v) in enumerate(rows)], "vec_id bigint, embedding array<float>, label int, codes string").repartition(3)
    got = vector_codes.op12(df).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    said = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {said}
    sums = {}
    for k, (i, _) in enumerate(rows):
        sums[k % 3 if k % 5 else None] = sums.get(k % 3 if k % 5 else None, 0) + want[i][1]
    assert {r["vec_id"]: r["label_error"] for r in got} == {i: sums[k % 3 if k % 5 else None] for k, (i, _) in enumerate(rows)}


def test_held_parts_look_at_moved_entries_only(monkeypatch):
    seen = []
    whole = vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda x, e: seen.append((len(x), len(e))) or whole(x, e))
    entries = np.array([[0], [10], [20], [30]])
    x = np.array([[0], [5], [10], [20], [25], [30]])
    codes, dists = vector_codes.nearest(x, entries)
    entries[2] = 15  # ties between 1 and 2 at 12.5 can't be; 20 to 2 at 25, 25 to 3 at 25
    seen.clear()
    got = vector_codes.reassigned(x, codes, dists, entries, np.array([False, False, True, False]))
    assert seen == [(4, 1), (2, 4)]
    assert [list(a) for a in got] == [list(a) for a in vector_codes.nearest(x, entries)]


def test_codes_of_odd_rows(spark):
    inf = float("inf")
    rows = [(1, None, 1), (2, [0.0] * 8, 1), (2, [0.0] * 8, 1), (None, [1.0] * 8, None), (3, [None] + [0.0] * 7, 1), (4, [inf] * 8, 1), (5, [float("nan")] * 8, 2), (6, [], 2), (7, [0.5] * 16, 2), (8, [9e9] * 8, 2), (9, [1.0] * 7, 1)]
    schema = "vec_id bigint, embedding array<double>, label int"
    got = vector_codes.op12(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == [("2", "00" * 8, 0, 0)] * 2 + [("None", "02" * 8, 0, 0)]
    assert vector_codes.op12(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.op12(spark.createDataFrame(rows[:1], schema)).count() == 0


LONG = "ä" * 40_000
PAGES = [(1, "http://a/", "x" * 99), (2, "http://a/", "x" * 99), (5, "http://b/ é\r\nWARC/1.1", "y" * 100), (3, None, "y" * 100), (None, None, "y" * 100), (4, "u", None), (6, "u", ""), (7, "u", LONG), (8, "u", LONG), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 3_000), (3, "v", "y" * 100), (None, "n", "z" * 200), (None, "m", "z" * 200)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "page_id bigint, url string, html string, digest string, payload string, salt int")


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw, f = (h or "").encode(), first.get(h)
        again = f is not None and (i is None or i > f)
        out.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", str(f) if again else "None"))
    return sorted(out)


def test_pages_survive_archives(spark):
    got = warc.op13(pages(spark)).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == expected(PAGES)
    assert {r["error"] for r in got} == {None}
    assert warc.op13(pages(spark, [])).count() == 0


def archive(path, *records, packed=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    body = b"".join(gzip.compress(r + b"\r\n\r\n") if packed else r + b"\r\n\r\n" for r in records)
    path.write_bytes(body)


def read(spark, folder):
    return warc.decoded(warc.assembled(warc.read_records(spark, str(folder)))).collect()


def test_segments_in_any_archive_and_order(spark, tmp_path):
    payload = LONG.encode()
    pieces = list(warc.page_records(7, "u", payload, hashlib.sha256(payload).hexdigest(), None, "2020-01-01T00:00:00Z", 1_000))
    assert len(pieces) > 50
    random.Random(1).shuffle(pieces)
    for k in range(5):
        archive(tmp_path / "all" / f"{k}.warc", *pieces[k::5], packed=k % 2 == 0)
    archive(tmp_path / "all" / "again.warc", *pieces[:3])  # the same segments twice
    [r] = read(spark, tmp_path / "all")
    assert (r["page_id"], r["payload"], r["error"]) == (7, payload, None)
    for k in range(5):
        archive(tmp_path / "less" / f"{k}.warc", *[p for p in pieces[k::5] if b"Segment-Number: 9\r\n" not in p])
    [r] = read(spark, tmp_path / "less")
    assert (r["page_id"], r["payload"], r["error"]) == (7, None, "segments are missing")
    archive(tmp_path / "headless" / "0.warc", *[p for p in pieces if b"Segment-Number: 1\r\n" not in p])
    assert [(r["type"], r["error"]) for r in warc.assembled(warc.read_records(spark, str(tmp_path / "headless"))).collect()] == [(None, "segments without a beginning")]


def test_damaged_archives_keep_what_is_whole(spark, tmp_path):
    def one(i, text):
        [r] = warc.page_records(i, None, text, hashlib.sha256(text).hexdigest(), None, "2020-01-01T00:00:00Z", 9_999)
        return r

    bad_digest = one(3, b"three").replace(b"three", b"seven")
    archive(tmp_path / "a.warc", one(1, b"one"), b"WARC/1.1\r\nContent-Length: many\r\n\r\nrubbish", one(2, b"two"), bad_digest, one(4, b"four")[:-3])
    (tmp_path / "a.warc").write_bytes((tmp_path / "a.warc").read_bytes()[:-4])
    found = {r["page_id"]: (r["payload"], r["error"]) for r in read(spark, tmp_path)}
    assert found[1] == (b"one", None) and found[2] == (b"two", None)
    assert found[3] == (None, "another block digest") and found[4] == (None, "the file ends inside the record")
    assert [r["error"] for r in warc.read_records(spark, str(tmp_path)).filter("type IS NULL").collect()] == ["45 bytes are no record"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.warc.gz").write_bytes(gzip.compress(one(1, b"one") + b"\r\n\r\n" + one(2, bytes(range(256)) * 10) + b"\r\n\r\n")[:-60])
    assert [r["payload"] for r in read(spark, tmp_path / "b") if r["error"] is None] == [b"one"]


def test_chunks():
    for n in (0, 1, 4_095, 4_096, 4_097, 20_000):
        assert warc.dechunked(warc.chunked(b"k" * n)) == b"k" * n
    assert warc.dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b"5\r\nab"):
        with pytest.raises(ValueError, match="chunk"):
            warc.dechunked(broken)


def test_a_revisit_of_nothing_says_so(spark):
    rows = spark.createDataFrame([(1, "u", "revisit", 9, "d", None, None)], "page_id bigint, target_uri string, record_type string, revisited_id bigint, payload_digest string, payload_bytes bigint, error string")
    [r] = warc.resolved(rows, ("payload_bytes",)).collect()
    assert (r["payload_bytes"], r["error"]) == (None, "no response with this payload")


def test_archives_hold_real_records(spark):
    path = f"{shared_dir(spark)}/x"
    warc.write_archives(pages(spark, PAGES[:3]), path, compression="none")
    text = b"".join(r["content"] for r in spark.read.format("binaryFile").load(path).collect())
    assert text.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == 3 and text.endswith(b"0\r\n\r\n\r\n\r\n")
