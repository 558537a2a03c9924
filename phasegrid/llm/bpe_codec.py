"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts of a batch are cut into pre-tokens.  All pre-tokens that were not met
before are laid out as one array of symbols with next/previous links; an index
maps each merge rank to every position where its pair stands.  Active ranks are
applied in ascending order, at all positions at once, and the lists of the pairs
that arise are extended.  A document is then the concatenation of its
pre-tokens' ids; decoding maps ids to bytes and reads them as UTF-8.
"""

import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import fresh, released, slices, string_bytes, without

#: Pre-tokenizer of byte-level BPE, fixed by the vocabulary's format.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of PLAIN characters only, for which ``re`` agrees with the classes above.
SPLIT_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\t\n\v\f\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ſ]")

#: Pre-tokens a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class PairIndexBpe:
    """A byte-level BPE vocabulary (``tokenizers`` JSON) with its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.size = max([*vocab.values(), *special.values()]) + 1
        token_bytes = [b""] * self.size
        for token, i in vocab.items():
            token_bytes[i] = bytes(value[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        self.bytes_flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.bytes_length = np.fromiter(map(len, token_bytes), np.int64, self.size)
        self.bytes_start = np.cumsum(self.bytes_length) - self.bytes_length
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        codes = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        for token in self.special:
            self.number[token] = len(self.number)
        self.flat = np.array([*self.special.values()], np.int32)
        self.lengths = np.ones(len(self.special), np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 for none."""
        code = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(joined ids, number of ids) of the words, all words together."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        follow, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        full = ends[lengths > 0]
        follow[full - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enters the pairs that start at these positions."""
            rank = self.rank_of(symbol[at], symbol[follow[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        note(np.flatnonzero(follow >= 0).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists) if len(lists) > 1 else lists[0])
            a, b = self.left[r], self.right[r]
            at = at[live[at] & (symbol[at] == a) & (follow[at] >= 0)]
            at = at[symbol[follow[at]] == b]
            if a == b and len(at) > 1:  # of a run of overlapping pairs every second one, from the left
                fresh = np.concatenate(([True], follow[at[:-1]] != at[1:]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = follow[at]
            after = follow[gone]
            symbol[at] = self.made[r]
            live[gone] = False
            follow[at] = after
            inner = after >= 0
            before[after[inner]] = at[inner]
            prior = before[at]
            note(np.concatenate((prior[prior >= 0], at[inner])))
        counts = np.concatenate(([0], np.cumsum(live)))[ends]
        return symbol[live].astype(np.int32), np.diff(counts, prepend=0)

    def pieces(self, text: str) -> np.ndarray:
        """The numbers of a text's pre-tokens."""
        split = SPLIT if NOT_PLAIN.search(text) else SPLIT_PLAIN
        if self.special_split and self.special_split.search(text):
            words: list[str] = []
            for k, part in enumerate(self.special_split.split(text)):
                words += [part] if k % 2 else split.findall(part)
        else:
            words = split.findall(text)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode_new(self) -> None:
        """Encodes the pre-tokens that got a number since the last call."""
        flat, lengths = self.encode_words([w.encode() for w in itertools.islice(self.number, len(self.lengths), None)])
        self.flat = np.concatenate((self.flat, flat))
        self.lengths = np.concatenate((self.lengths, lengths))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(joined ids, offsets) of the texts."""
        if len(self.number) > REMEMBERED:
            self.forget()
        docs = [self.pieces(t) for t in texts]
        self.encode_new()
        out, counts = [np.zeros(0, np.int32)], [0]
        starts = np.cumsum(self.lengths) - self.lengths
        for words in docs:
            out.append(spread(self.flat, self.lengths, starts, words))
            counts.append(len(out[-1]))
        return np.concatenate(out), np.cumsum(counts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return spread(self.bytes_flat, self.bytes_length, self.bytes_start, ids).tobytes().decode("utf-8", "replace")


def spread(flat: np.ndarray, lengths: np.ndarray, starts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that belong to ``items``, joined."""
    n = lengths[items]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[items] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


_LOADED: dict[str, PairIndexBpe] = {}


def codec(path: str | None = None) -> PairIndexBpe:
    """The codec of a vocabulary file, loaded once in each Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


def encoded(text: Column, path: str | None = None) -> Column:
    """The ids (array of int) of a text column; null counts as the empty text."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(path)
        for batch in batches:
            _, offsets = string_bytes(batch)
            parts = []
            for i, j in slices(offsets, TOGETHER):
                ids, ends = bpe.encode_batch([t or "" for t in batch[i:j].to_pylist()])
                parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.concat_arrays(parts or [pa.array([], pa.list_(pa.int32()))])
        bpe.forget()
        released()

    return encode(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an ids column; null ids give the empty text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(path)
        for batch in batches:
            ids, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            yield pa.array([bpe.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        released()

    return decode(ids)


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``token_ids`` (array<int>) and ``decoded_text``, read back from those ids.

    Null texts count as empty and give no ids and the empty text.  Texts of any
    length are taken whole, repeated rows stay rows, an empty table stays empty; ties
    and order mean nothing.  Columns of ``df`` that have the added names are replaced.
    """
    own = fresh(df, "__text")
    return without(df.withColumn(own, F.col(text)), "token_ids", "decoded_text").withColumn("token_ids", encoded(F.col(own), path)).withColumn("decoded_text", decoded(F.col("token_ids"), path)).drop(own)


def op6(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Contract columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = encode_decode(documents.select("doc_id", "text"), "text", path)
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )
