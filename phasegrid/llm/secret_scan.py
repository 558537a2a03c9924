"""Secret scan: three fixed patterns, and a token-efficiency test for random strings.

A long run of key characters that a byte-pair vocabulary can only write with few
characters a token is no language: its characters look random.  Runs that are
known digests or identifiers (hexadecimal digests of usual lengths, UUIDs, plain
numbers) are left out.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import fresh, released, without

#: Fixed patterns of the three base kinds; letters of the first keyword in either case, ASCII only.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in code points, end exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def known(run: str) -> bool:
    """Whether a run is a digest, a UUID or made of one class of characters after its first."""
    if UUID.fullmatch(run) or DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS:
        return True
    rest = run[1:]
    return any(c.islower() for c in rest) + any(c.isupper() for c in rest) + any(c.isdigit() for c in rest) < 2


_RANKS: dict = {}


def vocabulary(path: str | None):
    """The tiktoken vocabulary of a ranks file, loaded once in each Python worker."""
    if path not in _RANKS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _RANKS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _RANKS[path]


def found_spans(text: Column, path: str | None = None, min_chars: int = 20, max_ratio: float = 2.0) -> Column:
    """All spans of a text column, sorted by start, then kind.

    ``min_chars``: shortest run tested; ``max_ratio``: characters a token up to
    which a run counts as random.  Null counts as the empty text.
    """
    run = RUN % min_chars

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab, runs = vocabulary(path), re.compile(run)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                spans = base_spans(text or "")
                for m in runs.finditer(text or ""):
                    word = m[0]
                    if not known(word) and len(word) <= max_ratio * len(vocab.encode_ordinary(word)):
                        spans.append((m.start(), 3, m.end()))
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.array(out, pa.list_(kind))
        released()

    return scan(text)


def scanned(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Adds ``secret_spans``; an existing column of that name is replaced.

    Null and empty texts have no spans; texts are taken whole at any length;
    repeated rows are scanned each; an empty table stays empty.  Spans that start
    together come in the order of KINDS; null doc_ids and other columns are untouched.
    """
    own = fresh(df, "__spans")
    return without(df.withColumn(own, found_spans(F.col(text), **options)), "secret_spans").withColumnRenamed(own, "secret_spans")


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``df`` with every found span of its text replaced by ``mark``; overlapping spans become one mark."""

    @F.arrow_udf("string")
    def replace(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text and found:
                parts, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    return df.withColumn(text, replace(F.col(text), found_spans(F.col(text), **options)))


def op10(documents: DataFrame, **options) -> DataFrame:
    """Contract columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    done = scanned(documents.select("doc_id", "text"), "text", **options)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select(
        "doc_id",
        *[counted(k) for k in KINDS[:3]],
        F.sha2(joined(F.filter("secret_spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
