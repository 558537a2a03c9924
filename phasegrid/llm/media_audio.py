"""Media columns: MPEG audio.

``stored`` writes a payload as a valid, silent MPEG-1 Layer III stream: an ID3v2
tag, a frame with the table of a variable bitrate, then checksummed frames whose
ancillary data carry the payload.  ``parsed`` reads any column of such streams, of
other writers too: it reads tags at the start (ID3v2.2 to 2.4) and at the end
(ID3v1), the tables of a variable bitrate (Xing, Info, VBRI), resynchronises on frame
headers, verifies checksums, and returns exact durations, frame seek offsets and the
carried bytes.  Only MPEG-1 Layer III frames with a stated bitrate count as frames.
"""

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import fresh, without

#: Fixed values of the format, MPEG-1 Layer III: bitrates in kbit/s by index, sample rates by index.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152

#: Payload bytes of a unit; a text is padded to a positive multiple of it.
UNIT = 192
#: Units a frame carries, and the bitrate index that leaves room for them at 32 kHz mono.
FRAME_UNITS = {7: 14, 5: 12, 4: 11, 3: 10, 2: 7, 1: 3}
HEAD = 4 + 2 + 17

PARSED = (
    "struct<payload:binary,frames:int,samples:bigint,sample_rate:int,duration_numerator:bigint,duration_denominator:bigint,"
    "checksum_failures:int,resyncs:int,vbr_frames:int,vbr_bytes:bigint,vbr_offsets:array<bigint>,tags:map<string,string>,seek_offsets:array<int>>"
)


def crc16_steps() -> list[int]:
    """Table of the checksum polynomial x^16 + x^15 + x^2 + 1."""
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


CRC = crc16_steps()


@lru_cache(4096)
def checksum(protected: bytes) -> int:
    """The frame checksum of the header's last two bytes and the side information."""
    c = 0xFFFF
    for b in protected:
        c = ((c << 8) ^ CRC[(c >> 8) ^ b]) & 0xFFFF
    return c


def header(bitrate: int, rate: int = 2, protected: bool = True, padding: int = 0) -> bytes:
    """A Layer III header, single channel."""
    return bytes((0xFF, 0xFA if protected else 0xFB, bitrate << 4 | rate << 2 | padding << 1, 0xC0))


def frame_size(bitrate: int, rate: int = 2, padding: int = 0) -> int:
    return 144_000 * BITRATES[bitrate] // RATES[rate] + padding


@lru_cache(64)
def frame_start(bitrate: int) -> bytes:
    """Header, checksum and empty side information: what follows is ancillary data."""
    head, side = header(bitrate), bytes(17)
    return head + checksum(head[2:] + side).to_bytes(2, "big") + side


def syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def stream(payload: bytes, tags: dict[str, str]) -> bytes:
    """The stream that carries a payload of whole units."""
    units = len(payload) // UNIT
    sizes = [7] * (units // 7) + {0: [], 6: [5, 1]}.get(units % 7, [units % 7])
    parts, at, offsets = [], 0, [0]
    for n in sizes:
        bitrate = FRAME_UNITS[n]
        room = frame_size(bitrate) - HEAD - n * UNIT
        parts += [frame_start(bitrate), payload[at : at + n * UNIT], bytes(room)]
        at += n * UNIT
        offsets.append(offsets[-1] + frame_size(bitrate))
    total = offsets[-1] + frame_size(1)
    table = bytes(min(255, (frame_size(1) + offsets[k * len(sizes) // 100]) * 256 // total) for k in range(100))
    info = header(1, protected=False) + bytes(17) + b"Xing" + (15).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + total.to_bytes(4, "big") + table + bytes(4)
    body = b"".join(b"TXXX" + syncsafe(len(t)) + bytes(2) + t for t in (b"\x03" + k.encode() + b"\0" + v.encode() for k, v in tags.items()))
    return b"".join((b"ID3\x04\x00\x00", syncsafe(len(body)), body, info.ljust(frame_size(1), b"\0"), *parts))


def syncsafe_value(raw: bytes) -> int:
    n = 0
    for b in raw:
        n = n << 7 | b & 0x7F
    return n


#: Fixed values of the tag formats: text encodings by their number, and the fields of a tag at the end (start, end, name of the same field at the start).
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
FIELDS = ((3, 33, "TIT2"), (33, 63, "TPE1"), (63, 93, "TALB"), (93, 97, "TYER"), (97, 127, "COMM"))
TAG_BYTES = 128


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """(tags, length) of an ID3v2 tag (2.2 to 2.4) at the start; ({}, 0) if there is none.

    Text frames only; a user's own go by their description.  Texts in any of the four encodings are read.
    """
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return {}, 0
    version, flags, size = data[3], data[5], syncsafe_value(data[6:10])
    body, tags, at = data[10 : 10 + size], {}, 0
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2:  # an extended header; 2.4 counts its size field in
        at = syncsafe_value(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    wide, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and (name := body[at : at + wide]).isalnum():
        raw = body[at + wide : at + 2 * wide]
        n = syncsafe_value(raw) if version == 4 else int.from_bytes(raw, "big")
        content = body[at + head : at + head + n]
        if version == 4 and body[at + 9] & 2:
            content = content.replace(b"\xff\0", b"\xff")
        if version == 4 and body[at + 9] & 1:  # its length comes first
            content = content[4:]
        at += head + n
        if name[:1] == b"T" and content and content[0] < len(ENCODINGS):
            text = content[1:].decode(ENCODINGS[content[0]], "replace").lstrip("\ufeff")
            if name in (b"TXX", b"TXXX"):
                key, _, text = text.partition("\0")
            else:
                key = name.decode()
            tags[key] = text.lstrip("\ufeff").rstrip("\0")
    return tags, 10 + size + 10 * (version == 4 and flags & 0x10 > 0)


def end_tag(data: bytes, at: int) -> dict[str, str] | None:
    """The fields of an ID3v1 tag that begins at ``at`` and ends the stream, None if there is none."""
    if at != len(data) - TAG_BYTES or data[at : at + 3] != b"TAG":
        return None
    raw = data[at:]
    found = {name: raw[i:j].partition(b"\0")[0].decode("latin-1").rstrip() for i, j, name in FIELDS}
    if raw[125] == 0 and raw[126]:
        found["TRCK"] = str(raw[126])
    return {k: v for k, v in found.items() if v}


def bitrate_table(data: bytes, at: int, start: int) -> dict | None:
    """Frames, bytes and seek offsets (from the first frame, in equal steps of time) that a table of a variable bitrate states; None if the frame has none.

    ``at``: where the frame begins; ``start``: where its side information ends.
    """

    def number(p: int, n: int) -> int:
        return int.from_bytes(data[p : p + n], "big")

    for p in (start, start - 2):  # some writers don't count the checksum in
        if data[p : p + 4] in (b"Xing", b"Info"):
            flags, p, out = number(p + 4, 4), p + 8, {}
            for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):
                if flags & bit:
                    out[name], p = number(p, 4), p + 4
            if flags & 4 and "vbr_bytes" in out:
                out["vbr_offsets"] = [b * out["vbr_bytes"] // 256 for b in data[p : p + 100]]
            return out
    p = at + 36
    if data[p : p + 4] != b"VBRI":
        return None
    entries, scale, wide = (number(p + k, 2) for k in (18, 20, 22))
    steps = [number(p + 26 + k * wide, wide) * scale for k in range(entries) if p + 26 + (k + 1) * wide <= len(data)]
    return {"vbr_bytes": number(p + 10, 4), "vbr_frames": number(p + 14, 4), "vbr_offsets": list(accumulate(steps, initial=0))[: len(steps)]}


def frame_at(data: bytes, at: int) -> tuple[int, int, bool, int] | None:
    """(size, sample rate, protected, side information bytes) of a frame header, None where there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    b = data[at + 2]
    if b >> 4 in (0, 15) or (b >> 2) & 3 == 3:
        return None
    size = frame_size(b >> 4, (b >> 2) & 3, (b >> 1) & 1)
    return (size, RATES[(b >> 2) & 3], data[at + 1] & 1 == 0, 17 if data[at + 3] >> 6 == 3 else 32) if at + size <= len(data) else None


def parse(data: bytes) -> dict:
    """What a stream holds; damaged stretches are skipped until a header is followed by another, by a tag or by the end, as the first one has to be."""
    tags, at = read_tags(data)
    out = {"checksum_failures": 0, "resyncs": 0, "vbr_frames": None, "vbr_bytes": None, "vbr_offsets": None}
    tail = len(data) - TAG_BYTES if end_tag(data, len(data) - TAG_BYTES) is not None else -1
    offsets, carried, rate, lost, first = [], [], 0, False, True
    while at < len(data):
        found = frame_at(data, at)
        if found and (lost or first):
            after = at + found[0]
            if after < len(data) and not frame_at(data, after) and end_tag(data, after) is None:
                found = None
        if not found:
            if (last := end_tag(data, at)) is not None:
                tags = last | tags
                break
            out["resyncs"] += not lost
            lost, nxt = True, data.find(b"\xff", at + 1)
            at = min(x for x in (nxt, tail, len(data)) if x > at)
            continue
        size, rate, protected, side = found
        start = at + 4 + 2 * protected + side
        table = bitrate_table(data, at, start) if first else None
        lost = first = False
        if table is not None:
            out |= table
        else:
            if protected and checksum(data[at + 2 : at + 4] + data[at + 6 : start]) != int.from_bytes(data[at + 4 : at + 6], "big"):
                out["checksum_failures"] += 1
            offsets.append(at)
            carried.append(data[start : start + (at + size - start) // UNIT * UNIT])
        at += size
    exact = Fraction(len(offsets) * SAMPLES, rate or 1)
    return out | {
        "tags": list(tags.items()),
        "payload": b"".join(carried),
        "frames": len(offsets),
        "samples": len(offsets) * SAMPLES,
        "sample_rate": rate,
        "duration_numerator": exact.numerator,
        "duration_denominator": exact.denominator,
        "seek_offsets": offsets,
    }


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of the unit."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def stored(text: Column) -> Column:
    """The MPEG audio stream of each text's UTF-8 bytes; null counts as empty."""

    @F.arrow_udf("binary")
    def store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.to_pylist()]
            yield pa.array([stream(padded(r), {"text_bytes": str(len(r))}) for r in raw], pa.binary())

    return store(text)


def parsed(media: Column) -> Column:
    """What each stream of a binary column holds; null and streams without a frame give no frames and an empty payload."""

    @F.arrow_udf(PARSED)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct(
            [("payload", pa.binary()), ("frames", pa.int32()), ("samples", pa.int64()), ("sample_rate", pa.int32()), ("duration_numerator", pa.int64()), ("duration_denominator", pa.int64()), ("checksum_failures", pa.int32())]
            + [("resyncs", pa.int32()), ("vbr_frames", pa.int32()), ("vbr_bytes", pa.int64()), ("vbr_offsets", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())), ("seek_offsets", pa.list_(pa.int32()))]
        )
        for batch in batches:
            yield pa.array([parse(m or b"") for m in batch.to_pylist()], kind)

    return read(media)


def media_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media`` (the stored stream) and ``audio`` (what is read back from it).

    Columns of those names are replaced; null and empty texts store one unit of
    spaces; long texts become long streams; an empty table stays empty.  Rows are
    stored each by itself: equal texts give equal streams, repeated rows stay rows,
    ties and order mean nothing.
    """
    own = fresh(df, "__media")
    return without(df.withColumn(own, stored(F.col(text))), "media", "audio").withColumnRenamed(own, "media").withColumn("audio", parsed(F.col("media")))


def op3(documents: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_bytes, payload_*, tail_crc32, media_*, feature."""
    a = F.col("audio")
    return media_columns(documents.select("doc_id", "text")).select(
        "doc_id",
        F.try_element_at(a["tags"], F.lit("text_bytes")).cast("long").alias("n_bytes"),
        F.octet_length(a["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(a["payload"], 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(audio.payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            *[F.concat(F.lit(f"{n}="), a[n].cast("string")) for n in ("frames", "samples", "sample_rate", "vbr_frames", "vbr_bytes", "checksum_failures", "resyncs")],
            F.concat(F.lit("seconds="), a["duration_numerator"].cast("string"), F.lit("/"), a["duration_denominator"].cast("string")),
            F.concat(F.lit("seek="), F.sha2(F.array_join(a["seek_offsets"].cast("array<string>"), ","), 256)),
        ).alias("feature"),
    )
