"""Tokenizers, token files and media: exact round trips and the tokenizers library as the brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from phasegrid.llm import bpe_codec, media_audio, token_files

ALPHABET = "abAB  \n\t\r'sdre12٣²½éßſİΣςΣ한中😀‍\x1c\x1f\x85\xa0 _-!<|>́ªº\x00ÀÿŒœ\x0b\x0cŀŉ"


def texts(spark, sf_dir):
    rnd = random.Random(2)
    found = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    found += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(600)]
    return [*found, "", "aaaaaaaaaaaaaaaaaaaaa", "!" * 23, "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "<|startoftext|>", "hello'll  don't"]


def test_bpe_equals_the_library(spark, sf_dir):
    found, library = texts(spark, sf_dir), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = bpe_codec.encode_decode(spark.createDataFrame(list(enumerate(found)), "doc_id bigint, text string")).collect()
    for r in out:
        ids = library.encode(found[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids
        assert r["decoded_text"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_and_goes_on():
    bpe = bpe_codec.PairIndexBpe(public_tokenizers.path("byte_bpe_50k.json"))
    before = bpe.encode_batch(["the cat"])[0].tolist()
    bpe.forget()
    assert bpe.encode_batch(["the cat"])[0].tolist() == before


def test_token_files(spark, sf_dir, tmp_path):
    found, library = texts(spark, sf_dir), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = list(enumerate(found))
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r for r in token_files.op8(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "tokens")).collect()}
    start = 0
    for d, t in enumerate(found):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards_are_read_at_random():
    rnd = np.random.default_rng(3)
    docs = [np.concatenate([np.tile(rnd.integers(0, 9, 5), 40), rnd.integers(0, 49_408, n), [1]]).astype(np.uint32) for n in (0, 1, 300, 2000)]
    docs.insert(2, np.zeros(0, np.uint32))
    ends = np.cumsum([len(d) for d in docs])
    shard = token_files.Shard(token_files.pack(np.arange(len(docs)), np.concatenate(docs), ends))
    flat = np.concatenate(docs)
    assert len(shard.seq) < len(flat)
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    for a, b in ((0, 1), (3, 250), (100, len(flat)), (len(flat) - 1, len(flat)), (77, 77)):
        assert (shard.id_range(a, b) == flat[a:b]).all()


def test_grammars_leave_no_pair_that_repeats():
    rnd = np.random.default_rng(5)
    phrase = rnd.integers(0, 50, 120)
    docs = [np.concatenate([rnd.integers(0, 50, rnd.integers(0, 200)), phrase[: rnd.integers(1, 120)], np.full(rnd.integers(0, 9), 7), [1]]).astype(np.uint32) for _ in range(60)] + [np.zeros(0, np.uint32), np.zeros(17, np.uint32)]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    seq, cuts, rules, rounds, base = token_files.compress(ids, ends)
    assert len(rules) == rounds.sum() and len(seq) + 2 * len(rules) < len(ids)
    places: dict = {}
    for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        for k in range(a, b - 1):
            places.setdefault((seq[k], seq[k + 1]), []).append(k)
    for found in places.values():  # occurrences that don't overlap
        n, last = 0, -2
        for k in found:
            if k >= last + 2:
                n, last = n + 1, k
        assert n == 1
    shard = token_files.Shard(token_files.pack(np.arange(len(docs)), ids, ends))
    assert (shard.expand(shard.seq) == ids).all()


def test_grammars_of_many_symbols():
    """Pairs and places that don't fit one number together, as in the shard of a very long text."""
    rnd = np.random.default_rng(8)
    ids = np.tile(rnd.integers(1 << 27, 1 << 28, 300), 7).astype(np.uint32)
    seq, cuts, rules, rounds, base = token_files.compress(ids, np.array([1000, len(ids)]))
    assert 2 * base.bit_length() + len(ids).bit_length() > 64 and cuts[-1] == len(seq) < 400

    def plain(symbol):
        return [symbol] if symbol < base else [x for s in rules[symbol - base].tolist() for x in plain(s)]

    out = [plain(s) for s in seq.tolist()]
    assert sum(out, []) == ids.tolist() and sum(len(x) for x in out[: cuts[0]]) == 1000


def test_rows_of_one_doc_id_are_dealt_to_all_tasks(spark, tmp_path):
    """Rows without a doc_id, and equal rows, lie in several parts; every row gets its ids back once."""
    texts_of = [f"word{k} is in this text {k * k}" for k in range(400)]
    rows = [(None, t) for t in texts_of] + [(3, "the same text")] * 400 + [(5, "the last")]
    path = str(tmp_path / "hot")
    got = token_files.op8(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), path).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    crc = {t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows}
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(d), crc[t]) for d, t in rows)
    ordered, start = sorted(got, key=lambda r: r["start"]), 0
    for r in ordered:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in ordered] == [None] * 400 + [3] * 400 + [5]
    parts = token_files.read_token_files(spark, path).groupBy("doc_id").agg({"part": "approx_count_distinct"}).collect()
    assert all(r[1] > 1 for r in parts if r["doc_id"] != 5)


def test_media_round_trip(spark):
    rnd = random.Random(4)
    for n in (0, 1, 191, 192, 193, 1344, 1345, 6 * 192, 50_000):
        raw = bytes(rnd.randrange(256) for _ in range(n))
        payload = media_audio.padded(raw)
        got = media_audio.parse(media_audio.stream(payload, {"text_bytes": str(n)}))
        assert got["payload"] == payload and dict(got["tags"])["text_bytes"] == str(n)
        assert got["checksum_failures"] == got["resyncs"] == 0 and got["vbr_frames"] == got["frames"]
        assert got["duration_numerator"] * 32_000 == got["frames"] * 1152 * got["duration_denominator"]


def test_media_is_resynchronised_and_verified():
    payload = b"z" * (192 * 21)
    whole = media_audio.stream(payload, {"text_bytes": "1"})
    frames = media_audio.parse(whole)["seek_offsets"]
    broken = whole[: frames[1]] + b"junk \xff\xfa junk" + whole[frames[1] :]
    got = media_audio.parse(broken)
    assert got["resyncs"] == 1 and got["payload"] == payload and got["seek_offsets"][1] == frames[1] + 12
    flipped = bytearray(whole)
    flipped[frames[2] + 8] ^= 1  # inside the protected side information
    assert media_audio.parse(bytes(flipped))["checksum_failures"] == 1
    assert media_audio.parse(b"")["frames"] == 0 and media_audio.parse(b"ID3\xff")["frames"] == 0


def test_texts_that_look_like_tables_and_tags():
    """Payloads that begin like a table of a variable bitrate, or hold a tag's mark where one may stand, are payloads."""
    for text in (b"Info desk, third floor", b"Xing of the line", b"VBRI" * 90, b"x" * 13 + b"VBRI", b"ID3\x04", b"TAG" * 70, *(b"y" * n + b"TAG" for n in range(60, 70))):
        payload = media_audio.padded(text)
        got = media_audio.parse(media_audio.stream(payload, {"text_bytes": str(len(text))}))
        assert got["payload"] == payload and got["resyncs"] == got["checksum_failures"] == 0 and got["frames"] == got["vbr_frames"]


def tag(version, frames, flags=0, extended=b""):
    """An ID3v2 tag with frames of (name, content), written by its rules."""
    wide = 3 if version == 2 else 4
    size = (lambda n: bytes((n >> s) & 127 for s in (21, 14, 7, 0))) if version == 4 else (lambda n: n.to_bytes(wide, "big"))
    body = extended + b"".join(name + size(len(content)) + bytes(2 * (version > 2)) + content for name, content in frames)
    return b"ID3" + bytes((version, 0, flags)) + bytes((len(body) >> s) & 127 for s in (21, 14, 7, 0)) + body


def test_media_of_other_writers():
    payload = b"z" * (192 * 21)
    whole = media_audio.stream(payload, {"text_bytes": "1"})
    frames = whole[len(tag(4, [(b"TXXX", b"\x03text_bytes\x001")])) :]
    assert media_audio.parse(frames)["payload"] == payload
    long = "é" * 200
    for version, head, data in (
        (2, (b"TT2", b"TXX"), b""),
        (3, (b"TIT2", b"TXXX"), b""),
        (4, (b"TIT2", b"TXXX"), b""),
    ):
        said = [(head[0], b"\x00" + long.encode("latin-1")), (b"PIC" if version == 2 else b"APIC", bytes(range(256))), (head[1], b"\x01" + "mood".encode("utf-16") + bytes(2) + "großé".encode("utf-16")), (head[0][:2] + b"9" * (len(head[0]) - 2), b"\x02" + "ж".encode("utf-16-be"))]
        got = media_audio.parse(tag(version, said) + data + frames)
        assert got["payload"] == payload and got["resyncs"] == 0
        assert dict(got["tags"]) == {head[0].decode(): long, "mood": "großé", (head[0][:2] + b"9" * (len(head[0]) - 2)).decode(): "ж"}
    assert dict(media_audio.parse(tag(3, [(b"TALB", b"\x00a")], 0x40, (6).to_bytes(4, "big") + bytes(6)) + frames)["tags"]) == {"TALB": "a"}
    assert dict(media_audio.parse(tag(4, [(b"TALB", b"\x03a")], 0x40, bytes((0, 0, 0, 6, 1, 0))) + frames)["tags"]) == {"TALB": "a"}
    last = b"TAG" + b"Title".ljust(30, b"\0") + b"Some One".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07" + b"\xff"
    got = media_audio.parse(tag(3, [(b"TIT2", b"\x00Longer title")]) + frames + last)
    assert got["payload"] == payload and got["resyncs"] == 0
    assert dict(got["tags"]) == {"TIT2": "Longer title", "TPE1": "Some One", "TYER": "1999", "COMM": "note", "TRCK": "7"}
    got = media_audio.parse(frames + b"junk" * 9 + last)
    assert got["payload"] == payload and got["resyncs"] == 1 and dict(got["tags"])["TPE1"] == "Some One"


def test_media_tables_and_false_starts():
    payload = b"z" * (192 * 21)
    whole = media_audio.stream(payload, {})
    got = media_audio.parse(whole)
    at, size = whole.index(b"Xing") - 21, media_audio.frame_size(1)
    assert got["vbr_offsets"][0] == size * 256 // got["vbr_bytes"] * got["vbr_bytes"] // 256 and len(got["vbr_offsets"]) == 100
    steps = [size, *np.diff([*got["seek_offsets"], len(whole)]).tolist()]
    table = b"VBRI" + bytes(6) + got["vbr_bytes"].to_bytes(4, "big") + got["frames"].to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (len(steps), 1, 2, 1)) + b"".join(n.to_bytes(2, "big") for n in steps)
    other = media_audio.parse(whole[:at] + whole[at : at + 4].ljust(36, b"\0") + table.ljust(size - 36, b"\0") + whole[at + size :])
    assert (other["payload"], other["vbr_frames"], other["vbr_bytes"]) == (payload, got["frames"], got["vbr_bytes"])
    assert [at + n for n in other["vbr_offsets"][1:]] == got["seek_offsets"]
    stray = whole[got["seek_offsets"][0] :][:4] + b"no frame behind this header " * 40
    found = media_audio.parse(stray + whole[at:])
    assert found["payload"] == payload and found["resyncs"] == 1


def test_workers_keep_no_pre_tokens(spark):
    """What a task has learnt goes with it: workers stay, and hold the memory of every stage before."""
    df = spark.createDataFrame([(f"word{k} of text {k}",) for k in range(200)], "text string").repartition(2)
    assert bpe_codec.encode_decode(df).filter("text = decoded_text").count() == 200

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(c.number) - len(c.special) for c in bpe_codec._LOADED.values()] * min(batch.num_rows, 1)}, pa.schema([("n", pa.int64())]))

    assert {r["n"] for r in df.mapInArrow(held, "n bigint").collect()} <= {0}
