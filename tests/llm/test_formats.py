"""Secrets and media through their queries, against code that shares nothing with the operators."""

import hashlib
import random
import re
import string
import zlib

from pyspark.sql import functions as F

from phasegrid.llm import media_audio, queries, secret_scan

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")


def base(text):
    """The three fixed patterns as the contract words them."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text.translate(LOW)) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets_of_the_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op10_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r["doc_id"]])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, n, _ in want) for k in range(3)]
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("random:")] == [s for s in said.split(",") if s]


def test_random_keys_are_found_and_words_are_left(spark):
    """Recall on planted keys, and false alarms on long runs of words and known identifiers."""
    rnd = random.Random(9)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-")
    keys = ["".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(24, 64))) for _ in range(300)]
    words = "customer order payment service network controller signal memory recursive distributed environment language".split()
    runs = [rnd.choice("-_/").join(rnd.sample(words, rnd.randint(3, 6))) for _ in range(300)]
    known = [hashlib.sha256(str(k).encode()).hexdigest().upper() for k in range(40)] + ["123E4567-e89b-12d3-a456-4266141740%02d" % k for k in range(40)]
    rows = [(k, f"see {w} there") for k, w in enumerate(keys + runs + known)]
    got = {r["doc_id"]: any(s["kind"] == "random" for s in r["secret_spans"]) for r in secret_scan.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[k] for k in range(300)) >= 0.99 * 300
    assert sum(got[k] for k in range(300, len(rows))) <= 0.01 * (len(rows) - 300)


#: Fixed bit rates of Layer III, MPEG-1, by index, in kbit/s.
RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)


def frames_of(stream):
    """(offset, size) of the frames of a stream, header after header."""
    at = 0
    if stream[:3] == b"ID3":
        at = 10 + sum((b & 127) << 7 * (3 - k) for k, b in enumerate(stream[6:10]))
    out = []
    while at < len(stream):
        assert stream[at] == 0xFF and stream[at + 1] >> 4 == 0xF and stream[at + 1] >> 1 & 3 == 1, "no Layer III header"
        rate, sampling, padding = RATES[stream[at + 2] >> 4], (44_100, 48_000, 32_000)[stream[at + 2] >> 2 & 3], stream[at + 2] >> 1 & 1
        out.append((at, 144_000 * rate // sampling + padding))
        at += out[-1][1]
    assert at == len(stream)
    return out


def test_media_of_the_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    streams = {r["doc_id"]: bytes(r["media"]) for r in media_audio.media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "media").collect()}
    got = queries.op3_media_audio(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        raw, stream = texts[r["doc_id"]], streams[r["doc_id"]]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        found = frames_of(stream)
        audio = dict(x.split("=", 1) for x in r["feature"].split(";"))
        assert int(audio["frames"]) in (len(found), len(found) - 1)  # the frame with the variable-bitrate table holds no sound
        assert audio["checksum_failures"] == audio["resyncs"] == "0"


def test_equal_texts_give_equal_media(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: (bytes(r["media"]), r["audio"]) for r in media_audio.media_columns(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3]
    assert df.select(F.col("doc_id")).count() == 4
