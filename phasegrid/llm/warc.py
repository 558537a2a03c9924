"""WARC archives: writing pages as records, and reading records back whole.

Writing: a page becomes a response record that holds an HTTP message in chunked
framing, or a revisit record where an equal payload is stored already.  Messages
longer than a segment go on in continuation records.  Spark's text writer puts
records into files, one after the other with the separator that the format asks for,
so files are committed like any other table, compressed or not.

Reading: files are taken apart by Content-Length, unpacked as they are read; where a
header is damaged, reading goes on at the next one.  Segments are grouped by the
record they began in, wherever they lie, ordered by number, checked to be complete and
of the stated total length, joined, and only then is the chunked framing undone.
Records that fail a check keep their row, with the reason in ``error`` and no payload.
A file is one task's work and a payload one value; no group holds more than a record.

Null payloads are empty; null ids have records that name none, and revisit a record
with an id where there is one; rows with the same smallest id are all responses; other
columns are left out.
"""

import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import shared_dir, written

#: Bytes of a message in a record, before it goes on in the next, and of a chunk inside the message.
SEGMENT, CHUNK = 16_384, 4_096
#: Shorter payloads are stored each time.
LEAST_SHARED = 100
#: Parts that rows of one payload are dealt to where they meet their group.
SALTS = 32
#: Fixed names and texts of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "\r\n\r\n"
#: Fields of this library's own.
PAGE_ID, REVISITED = "X-Page-ID", "X-Refers-To-Page-ID"
#: What a URI keeps as it is.
PLAIN = "!#$%&'()*+,/:;=?@[]~-._"

RECORD = "file string, at bigint, type string, record_id string, target_uri string, date string, payload_digest string, block_digest string, page_id bigint, revisited_id bigint, origin_id string, segment int, total_length bigint, block binary, error string"
_FIELDS = [f.split()[0] for f in RECORD.split(", ")]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in RECORD.split(", "))])


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A payload in chunks, each after its length in hexadecimal; an empty one ends them."""
    pieces = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        pieces += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*pieces, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over.  Raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : max(end, at)].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk without a length")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk of another length")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}" for k, v in fields], f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None, date: str, segment: int) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response and what continues it."""
    own = _id()
    uri = [("WARC-Target-URI", urllib.parse.quote(url, safe=PLAIN))] if url else []
    mine = [(PAGE_ID, str(page_id))] if page_id is not None else []
    common = [("WARC-Record-ID", own), ("WARC-Date", date), *uri, *mine, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisits is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", SAME_PAYLOAD), (REVISITED, str(revisits))], head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment >= len(block) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _id()), ("WARC-Date", date), *uri, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *last], block[at : at + segment])


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, revisits): which pages revisit another; groups of equal payloads are dealt to SALTS parts."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= LEAST_SHARED)
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    return dealt.join(groups, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", F.when(later, F.col("first_id")).alias("revisits"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", segment: int = SEGMENT, compression: str = "gzip") -> None:
    """Writes (page_id, url, html) as archives into a new folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "revisits")), strict=True):
                for record in page_records(*row, date, segment):
                    out.append(record)
                    size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = with_revisits(pages).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", SEPARATOR).option("compression", compression).text(path)


class _Bytes:
    """The bytes of a file, unpacked piece by piece where they are gzip members, read in order."""

    def __init__(self, data: bytes):
        self.source, self.packed = memoryview(data), data[:2] == b"\x1f\x8b"
        self.at = self.done = 0  # in the file; unpacked bytes before the buffer
        self.buffer, self.inflate, self.error = bytearray(), zlib.decompressobj(31), None

    def more(self) -> bool:
        """Takes another piece; whether there was one."""
        if self.at >= len(self.source) or self.error:
            return False
        piece = bytes(self.source[self.at : self.at + (1 << 20)])
        if not self.packed:
            self.buffer += piece
            self.at += len(piece)
            return True
        try:
            self.buffer += self.inflate.decompress(piece)
        except zlib.error as e:
            self.error = f"cannot be unpacked: {e}"
            return False
        self.at += len(piece) - len(self.inflate.unused_data)
        if self.inflate.eof:  # the next member
            self.inflate = zlib.decompressobj(31)
        return True

    def have(self, n: int) -> bool:
        while len(self.buffer) < n and self.more():
            pass
        return len(self.buffer) >= n

    def find(self, what: bytes, start: int, within: int | None = None) -> int:
        """The place of ``what`` from ``start`` on, -1 if it doesn't come, or not ``within`` so many bytes."""
        while True:
            at = self.buffer.find(what, start)
            if at >= 0 or (within is not None and len(self.buffer) >= within):
                return at
            start = max(start, len(self.buffer) - len(what) + 1)
            if not self.more():
                return self.buffer.find(what, start)

    def take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.done += n
        return out


#: No header of a record is longer.
LONGEST_HEADER = 1 << 20
_NAMES = {
    "warc-type": "type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date", "warc-payload-digest": "payload_digest", "warc-block-digest": "block_digest",
    "warc-segment-origin-id": "origin_id", PAGE_ID.lower(): "page_id", REVISITED.lower(): "revisited_id", "warc-segment-number": "segment", "warc-segment-total-length": "total_length",
}
_NUMBERS = ("page_id", "revisited_id", "segment", "total_length")


def _header(text: bytes) -> dict | None:
    """The known fields of a header and its ``length``; None if it is none."""
    first, _, rest = text.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", first):
        return None
    found: dict = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", rest).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            continue
        name, value = name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace")
        if name == "content-length":
            found["length"] = value
        elif name in _NAMES:
            found[_NAMES[name]] = value
    if not re.fullmatch(r"\d{1,18}", found.get("length", "")):
        return None
    for name in _NUMBERS:
        if name in found:
            found[name] = int(found[name]) if re.fullmatch(r"-?\d{1,18}", found[name]) and (name != "segment" or len(found[name]) < 10) else None
    return found | {"length": int(found["length"])}


def records_of(data: bytes) -> Iterator[dict]:
    """The records of a file: the fields of RECORD less ``file``."""
    stream = _Bytes(data)
    damaged = None
    while stream.have(1):
        if stream.have(2) and stream.buffer[:2] == b"\r\n" and damaged is None:
            stream.take(2)
            continue
        at = stream.done
        end = stream.find(b"\r\n\r\n", 0, LONGEST_HEADER) if stream.have(5) and stream.buffer[:5] == b"WARC/" else -1
        header = _header(bytes(stream.buffer[:end])) if end >= 0 else None
        if header is None:  # on to whatever looks like the next header
            damaged = at if damaged is None else damaged
            skip = stream.find(b"WARC/", 1)
            stream.take(skip if skip > 0 else len(stream.buffer))
            continue
        if damaged is not None:
            yield {"at": damaged, "error": f"{at - damaged} bytes are no record"}
            damaged = None
        stream.take(end + 4)
        length = header.pop("length")
        whole = stream.have(length)
        block = stream.take(min(length, len(stream.buffer)))
        error = None if whole else stream.error or "the file ends inside the record"
        said = header.get("block_digest") or ""
        if whole and said.startswith("sha256:") and hashlib.sha256(block).hexdigest() != said[7:]:
            error = "another block digest"
        yield header | {"at": at, "block": block if error is None else None, "error": error}
    if damaged is not None or stream.error:
        yield {"at": damaged if damaged is not None else stream.done, "error": stream.error or f"{stream.done - damaged} bytes are no record"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives of a folder, in the columns of RECORD."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows, size = batch.column("path")[k].as_py(), [], 0
                for record in records_of(batch.column("content")[k].as_py()):
                    rows.append(record | {"file": name})
                    size += len(record.get("block") or b"")
                    if size > 4 << 20 or len(rows) >= 5_000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.mapInArrow(run, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """``records`` with segmented ones joined, in the columns of RECORD less ``segment``, ``origin_id`` and ``total_length``.

    A segment that comes twice with the same content counts once.
    """
    columns = [c for c in _FIELDS if c not in ("segment", "origin_id", "total_length")]
    whole = records.filter("segment IS NULL AND (type IS NULL OR type <> 'continuation')").select(*columns)
    pieces = records.filter("segment IS NOT NULL OR type = 'continuation'")
    first = F.col("origin_id").isNull()
    fields = [c for c in columns if c not in ("block", "error")]
    groups = pieces.withColumn("group", F.coalesce("origin_id", "record_id")).groupBy("group").agg(
        F.min(F.when(first, F.struct(*fields))).alias("head"),
        F.max("total_length").alias("total"),
        F.max("error").alias("broken"),
        F.array_sort(F.collect_set(F.struct(F.coalesce("segment", F.lit(-1)).alias("n"), F.col("block").cast("string").alias("block")))).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["block"]), "").cast("binary")
    numbers = F.transform("parts", lambda p: p["n"])
    error = (
        F.when(F.col("broken").isNotNull(), F.col("broken"))
        .when(F.col("head").isNull(), "segments without a beginning")
        .when(F.col("total").isNull() | (numbers != F.sequence(F.lit(1), F.size("parts"))), "segments are missing")
        .when(F.octet_length("block") != F.col("total"), "segments have another total length")
    )
    found = groups.withColumn("block", joined).withColumn("error", error)
    kept = [F.when(F.col("error").isNull(), F.col("block")).alias("block") if c == "block" else F.col("error") if c == "error" else F.col(f"head.{c}").alias(c) for c in columns]
    return whole.unionByName(found.select(*kept))


def message(block: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, decoded body) of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    return fields, dechunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


def decoded(records: DataFrame) -> DataFrame:
    """Assembled responses and revisits as pages: page_id, target_uri, record_type, revisited_id, payload (null in revisits), payload_digest, error."""
    wanted = records.filter("type IN ('response', 'revisit')").select("page_id", "target_uri", F.col("type").alias("record_type"), "revisited_id", "payload_digest", "block", "error")
    names = ["page_id", "target_uri", "record_type", "revisited_id", "payload", "payload_digest", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, digests, errors = [], [], []
            for kind, said, block, error in zip(*(batch.column(c).to_pylist() for c in ("record_type", "payload_digest", "block", "error")), strict=True):
                payload, digest = None, (said or "").removeprefix("sha256:") or None
                if error is None and kind == "response":
                    try:
                        payload = message(block)[1]
                    except ValueError as e:
                        error = str(e)
                    else:
                        found = hashlib.sha256(payload).hexdigest()
                        error = None if digest in (None, found) or not (said or "").startswith("sha256:") else "another payload digest"
                        payload, digest = (payload, found) if error is None else (None, digest)
                payloads.append(payload)
                digests.append(digest)
                errors.append(error)
            arrays = [batch.column(c) for c in names[:4]] + [pa.array(payloads, pa.binary()), pa.array(digests, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return wanted.mapInArrow(run, "page_id bigint, target_uri string, record_type string, revisited_id bigint, payload binary, payload_digest string, error string")


def resolved(pages: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """Decoded pages in which revisits have the ``carried`` columns of the response whose payload digest they name.

    A revisit of a payload that no archive holds has an error.  Revisits of one payload
    are dealt to SALTS parts.
    """
    asked = pages.filter("record_type = 'revisit'").select("payload_digest").distinct()
    held = pages.filter("record_type = 'response' AND error IS NULL").join(asked, "payload_digest", "left_semi").groupBy("payload_digest").agg(*[F.first(c).alias(f"held_{c}") for c in carried])
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("held", F.lit(True)).withColumn("of", F.lit("revisit"))
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "target_uri"), F.lit(SALTS)).cast("int"))
    rows = dealt.join(held.withColumnRenamed("of", "record_type"), ["record_type", "payload_digest", "salt"], "left")
    lost = F.when((F.col("record_type") == "revisit") & F.col("held").isNull(), "no response with this payload")
    filled: dict[str, Column] = {c: F.when(F.col("record_type") == "revisit", F.col(f"held_{c}")).otherwise(F.col(c)) for c in carried}
    return rows.withColumns(filled | {"error": F.coalesce("error", lost)}).select(*pages.columns)


def op13(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from archives written and read back; ``error`` is null."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archives"
    write_archives(pages, path)
    read = decoded(assembled(read_records(spark, path)))
    slim = read.select("page_id", "target_uri", "record_type", "revisited_id", "payload_digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("found_digest"), "error")
    rows = resolved(written(slim), ("payload_bytes", "found_digest"))
    return rows.select("page_id", "payload_bytes", F.col("found_digest").alias("payload_digest"), "record_type", F.col("revisited_id").alias("refers_to"), "error")
