"""Repeated long substrings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases, each reaching over the next
trigger, so that no phrase ending is a prefix of another.  Equal phrases get equal
names (the dictionary), a text becomes a sequence of names (the parse), and a
suffix is the end of a phrase followed by a suffix of the parse.  Two suffixes
share their first ``length`` bytes if the ends of their phrases, the whole phrases
that follow, and the start of the last phrase agree.

The orders that decide this are sorted in buckets, none of which holds the corpus:

1. names of phrases: one that occurs once ends all windows over it;
2. windows that hold the same whole phrases form a stretch; stretches are sorted by
   those phrases (the parse's order), then by what surrounds them (the dictionary's
   order).  Equal stretches are repeats as a whole, whatever their number;
3. only where equal phrases stand in different surroundings, at the ends of repeats,
   windows are compared one by one, as are windows without a whole phrase.

Names of phrases only propose; stretches and windows are equal by 128 bits of a hash
under a key that is drawn for the run.  Hashes order suffixes, not letters; which suffixes share a prefix of
the given length, all that is asked here, is the same in either order.
"""

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.block_dedup import covered, mine, originals
from phasegrid.llm.common import binary_array, slices, string_bytes
from phasegrid.llm.hashing import eights, fresh_seeds, mix, stretch_digests, word_hashes
from phasegrid.llm.routed import PACKED, bucket_count, combined, grouped, once, resolved, unpacked

LENGTH = 400
#: Bytes of a trigger, which are read as one number; one window of so many is a trigger; bytes of text handled at once.
TRIGGER, RARITY, SLICE = 8, 40, 1 << 20


@dataclass
class Keys:
    """What a run draws, so that no text can have been made for its hashes."""

    trigger: int = field(default_factory=lambda: fresh_seeds(1)[0])
    phrase: int = field(default_factory=lambda: fresh_seeds(1)[0])
    stretch: bytes = field(default_factory=lambda: os.urandom(32))


class Parse:
    """The phrases and windows of a slice of texts; ``keys`` are those of the run."""

    def __init__(self, texts: pa.Array, length: int, keys: Keys):
        self.length, self.keys = length, keys
        self.data, self.offsets = string_bytes(texts)
        n = len(self.data)
        sizes = np.diff(self.offsets)
        self.row_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        room = np.repeat(self.offsets[1:], sizes) - np.arange(n)  # bytes from here to the text's end
        near = mix(eights(self.data)[:n] ^ np.uint64(keys.trigger))
        trigger = (near >> np.uint64(32)) * np.uint64(RARITY) >> np.uint64(32) == 0
        trigger &= room >= TRIGGER
        trigger &= sizes[self.row_of] >= length
        self.trigger = np.flatnonzero(trigger)
        before = np.concatenate(([0], np.cumsum(trigger)))
        self.window = np.flatnonzero(room >= length)
        self.low = before[self.window]  # the first trigger from a window's start on
        self.high = before[self.window + length - TRIGGER + 1] - 1  # the last one that lies inside
        self.row = self.row_of[self.trigger[:-1]] if len(self.trigger) else np.zeros(0, np.int32)
        self.inner = self.row == self.row_of[self.trigger[1:]] if len(self.trigger) else np.zeros(0, bool)

    def phrases(self) -> np.ndarray:
        """The name of the phrase that each trigger but the last begins."""
        return word_hashes(self.data, self.trigger[:-1], self.trigger[1:] + TRIGGER, self.keys.phrase)

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two numbers for each stretch, which are equal where the bytes are."""
        return stretch_digests(self.data, start, end, self.keys.stretch)

    def stretches(self, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, last window, first trigger, last trigger) of the runs of windows that hold the same, repeated phrases."""
        alone = np.concatenate(([0], np.cumsum(~repeated)))
        at = np.flatnonzero((self.high > self.low) & (alone[np.maximum(self.high, 0)] == alone[np.minimum(self.low, len(alone) - 1)]))
        w, low, high = self.window[at], self.low[at], self.high[at]
        fresh = np.concatenate(([True], (np.diff(w) != 1) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(at) else np.zeros(0, bool)
        head = np.flatnonzero(fresh)
        tail = np.concatenate((head[1:] - 1, [len(at) - 1])) if len(head) else head
        return w[head], w[tail], low[head], high[head]

    def bare(self) -> np.ndarray:
        """The windows without a whole phrase."""
        return self.window[self.high <= self.low]


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, removed, kept), a row for each row of ``df``.

    ``removed``: merged byte spans (start, end exclusive) covered by strings of
    ``length`` bytes that also start anywhere else; ``kept``: the other bytes.
    Null texts count as empty, texts shorter than ``length`` are kept whole, texts
    of any length are taken whole; a row that repeats another's text is a repeat of
    it whatever its doc_id; null doc_ids are kept as null; other columns of ``df``,
    whatever their names, are left out; an empty table stays empty.
    """
    docs = originals(df, doc_id, text)
    first = docs.filter(F.col("owner") == F.col("first")).select("doc_id", "owner", "text")
    buckets, keys = bucket_count(df), Keys()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Parse]]:
        for batch in batches:
            _, offsets = string_bytes(batch["text"])
            for i, j in slices(offsets, SLICE):
                part = batch.slice(i, j - i)
                yield part, part["owner"].to_numpy(), Parse(part["text"], length, keys)

    def repeated(part: pa.RecordBatch, parse: Parse) -> np.ndarray:
        return mine(parse.row, part.num_rows, parse.phrases(), part["phrases"]) & parse.inner

    def send_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, owner, parse in parsed(batches):
            at = np.flatnonzero(parse.inner)
            name = parse.phrases()[at]
            yield from combined(owner[parse.row[at]], [name], name, buckets)

    def meet_phrases(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        owner, (name,) = unpacked(table, 0)
        order, _, n = grouped(owner, [name])
        again = order[np.repeat(n > 1, n)]
        again = again[once(owner[again], name[again])]  # a text needs to hear of a name once
        return [(owner[again], name[again])]

    def send_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, owner, parse in parsed(batches):
            a, b, low, high = parse.stretches(repeated(part, parse))
            core = np.ascontiguousarray(parse.digests(parse.trigger[low], parse.trigger[high] + TRIGGER)[:, 0])
            full, second = (np.ascontiguousarray(lane) for lane in parse.digests(a, b + length).T)
            yield from combined(owner[parse.row_of[a]], [core, full, second], full, buckets)

    def meet_stretches(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        owner, (core, full, second) = unpacked(table, 0, lanes=3)
        order, head, n = grouped(owner, [core, full, second])
        again = order[np.repeat(n > 1, n)]
        cores = core[order[head]]
        here, kinds = np.unique(cores, return_counts=True)
        several = kinds[np.searchsorted(here, cores)] > 1
        shown = order[head[several]]  # of equal stretches one shows its windows
        return [(owner[again], full[again]), (owner[shown], full[shown])]

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, owner, parse in parsed(batches):
            a, b, _, _ = parse.stretches(repeated(part, parse))
            shown = mine(parse.row_of[a], part.num_rows, parse.digests(a, b + length)[:, 0], part["shown"])
            a, n = a[shown], (b - a + 1)[shown]
            at = np.sort(np.concatenate((np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum()), parse.bare())))
            if len(at):
                lanes = [np.ascontiguousarray(lane) for lane in parse.digests(at, at + length).T]
                yield from combined(owner[parse.row_of[at]], lanes, lanes[0], buckets)

    def meet_windows(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        owner, (a, b) = unpacked(table, 0, lanes=2)
        order, _, n = grouped(owner, [a, b])
        again = order[np.repeat(n > 1, n)]
        return [(owner[again], a[again])]

    def cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for part, owner, parse in parsed(batches):
            starts = np.zeros(len(parse.data), bool)
            a, b, _, _ = parse.stretches(repeated(part, parse))
            rows = parse.row_of[a]
            full = parse.digests(a, b + length)[:, 0]
            whole = mine(rows, part.num_rows, full, part["equal"])
            single = ~whole & mine(rows, part.num_rows, full, part["shown"])
            for flags, test in ((whole, False), (single, True)):
                n = (b - a + 1)[flags]
                at = np.repeat(a[flags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = np.sort(np.concatenate((at, parse.bare()))) if test else at
                if test:
                    at = at[mine(parse.row_of[at], part.num_rows, parse.digests(at, at + length)[:, 0], part["windows"])]
                starts[at] = True
            copied = np.zeros(part.num_rows, bool) | (part["copies"].to_numpy() > 1)
            starts[parse.window[copied[parse.row_of[parse.window]]]] = True
            gone = covered(starts, length)
            stay = np.concatenate(([0], np.cumsum(~gone)))[parse.offsets]
            spans = []
            for d in range(part.num_rows):
                edges = np.flatnonzero(np.diff(gone[parse.offsets[d] : parse.offsets[d + 1]].astype(np.int8), prepend=0, append=0))
                spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "n_bytes": pa.array(np.diff(parse.offsets)), "removed": pa.array(spans, pa.list_(span)), "kept": binary_array(parse.data[~gone], stay).cast(pa.binary())})

    none = F.array().cast("array<bigint>")

    def with_answers(left: DataFrame, answers: DataFrame, how: str) -> DataFrame:
        answers = answers.withColumnRenamed("owner", "__owner")
        return left.join(answers, left["owner"] == answers["__owner"], how).drop("__owner")

    def filled(left: DataFrame, *names: str) -> DataFrame:
        return left.withColumns({n: F.coalesce(n, none) for n in names})

    named = resolved(first.mapInArrow(send_phrases, PACKED), meet_phrases, ["phrases"], buckets)
    told = with_answers(first, named, "inner")
    met = resolved(told.mapInArrow(send_stretches, PACKED), meet_stretches, ["equal", "shown"], buckets)
    answers = named.join(met, "owner", "left")
    windows = resolved(filled(with_answers(first, answers, "left"), "phrases", "equal", "shown").mapInArrow(send_windows, PACKED), meet_windows, ["windows"], buckets)
    answers = answers.join(windows, "owner", "full")
    final = filled(with_answers(docs.drop("first"), answers, "left"), "phrases", "equal", "shown", "windows")
    return final.mapInArrow(cut_bytes, "doc_id bigint, n_bytes bigint, removed array<struct<start:int,end:int>>, kept binary")


def op2(documents: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return repeats(documents.select("doc_id", "text")).select("doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
