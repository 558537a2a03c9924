"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words;
every rolling window of as many words is a probe.  A repeated window of ``window``
words holds a whole block of the smaller document if ``2 * block - 1 <= window``,
so each repeat has a probe that meets a block.  Hits are extended to windows of
full length, which meet again under 128-bit hashes with seeds drawn for the run: a
window whose smallest document is another one is removed; runs of such windows are
maximal repeats.  An answer names a window of its document by 64 of those bits.

Copies of a whole text take a short way: all but the smallest are repeats as they are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import slices, string_bytes
from phasegrid.llm.hashing import fresh_seeds, window_hashes, word_hashes, words_in
from phasegrid.llm.routed import PACKED, bucket_count, bucket_of, grouped, known, once, packed, resolved, unpacked

WINDOW, BLOCK = 13, 7
#: Bytes of text handled at once; bytes kept of a block's hash, besides its bucket: it only proposes candidates.
SLICE, KEPT = 2 << 20, 5
#: Rows without a doc_id are known by numbers from here on, by their texts; all count as one id that is larger than any other.
NO_ID = 1 << 62
#: Parts that the rows of one text are dealt to when they look up their copies.
SALTS = 32

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a slice of texts with their hashes, a lane for each seed."""

    def __init__(self, texts: pa.Array, seeds: tuple[int, ...]):
        self.seeds, self.hashed = seeds, {}
        self.data, offsets = string_bytes(texts)
        self.start, self.end, row = words_in(~SPACE, self.data, offsets)
        self.bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        self.row = row
        self.left = self.bounds[1:][row] - np.arange(len(row)) if len(row) else row  # words from here to the document's end
        self.place = np.arange(len(row)) - self.bounds[row] if len(row) else row

    def windows(self, size: int, lane: int = 0) -> np.ndarray:
        """The hash of the window that starts at each word; windows that cross documents mean nothing."""
        found = window_hashes(self.words(lane), size)
        return np.concatenate((found, np.zeros(len(self.row) - len(found), np.uint64)))

    def words(self, lane: int) -> np.ndarray:
        if lane not in self.hashed:
            self.hashed[lane] = word_hashes(self.data, self.start, self.end, self.seeds[lane])
        return self.hashed[lane]


def rank(owner: np.ndarray) -> np.ndarray:
    """Owners in the order of their doc_ids; rows without one are equal."""
    return np.minimum(owner, NO_ID)


def key_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """What is left of a block's hash after its way through a bucket."""
    return bucket_of(h, buckets).astype(np.uint64) << np.uint64(8 * KEPT) | (h & np.uint64((1 << 8 * KEPT) - 1))


def mine(row: np.ndarray, n: int, keys: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each key (of row ``row``) is in its row's list."""
    out = np.zeros(len(keys), bool)
    bounds = np.searchsorted(row, np.arange(n + 1))
    values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    for k in np.flatnonzero(np.diff(ends)).tolist():
        out[bounds[k] : bounds[k + 1]] = np.isin(keys[bounds[k] : bounds[k + 1]], values[ends[k] : ends[k + 1]])
    return out


def spread_back(flags: np.ndarray, reach: int) -> np.ndarray:
    """Marks each place from which a marked place is at most ``reach`` ahead."""
    ahead = np.concatenate((flags, np.zeros(reach, bool)))
    counts = np.concatenate(([0], np.cumsum(ahead)))
    return counts[reach + 1 :] > counts[: -reach - 1]


def covered(starts: np.ndarray, window: int) -> np.ndarray:
    """Marks the places that a window from a marked place covers."""
    steps = np.zeros(len(starts) + window + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps)[: len(starts)] > 0


def combined_blocks(owner: np.ndarray, h: np.ndarray, is_block: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of probes (kind 0) and blocks (kind 1) of a slice, less what the slice itself can answer.

    A probe that meets a smaller document's block here is a hit, a block that meets
    a larger document's probe here is asked for; of those only the largest probe and
    the smallest block of a hash are sent, for the other slices' sake.
    """
    order, head, n = grouped(owner, [h])
    distinct, largest = h[order[head]], owner[order[head + n - 1]]
    own, reference = owner[is_block], h[is_block]
    b_order, b_head, b_n = grouped(own, [reference])
    b_distinct, smallest = reference[b_order[b_head]], own[b_order[b_head]]
    if len(b_distinct):
        at = np.minimum(np.searchsorted(b_distinct, h), len(b_distinct) - 1)
        hit = (b_distinct[at] == h) & (rank(smallest[at]) < rank(owner))
    else:
        hit = np.zeros(len(h), bool)
    probe_max = largest[np.searchsorted(distinct, h)]
    sent = np.flatnonzero(~hit | (owner == probe_max))
    sent = np.sort(sent[once(owner[sent], h[sent])])
    yield from packed(bucket_of(h[sent], buckets), owner[sent], [h[sent]], 0, KEPT)
    yield from known(owner[hit], key_of(h[hit], buckets), 0, buckets)
    asked = rank(largest[np.searchsorted(distinct, reference)]) > rank(own)
    first = smallest[np.searchsorted(b_distinct, reference)] == own if len(reference) else asked
    sent = np.flatnonzero(~asked | first)
    sent = np.sort(sent[once(own[sent], reference[sent])])
    yield from packed(bucket_of(reference[sent], buckets), own[sent], [reference[sent]], 1, KEPT)
    yield from known(own[asked], key_of(reference[asked], buckets), 1, buckets)


def originals(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, owner, text, first, copies) by owner: the row's number, the smallest number with the same text, how many rows have it.

    The number is the doc_id, or for a row without one NO_ID and more, by its text.
    Only numbers and digests are grouped; a text moves once, by its number.
    """
    digest = F.md5("text")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("owner", F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)))
    keys = docs.select("owner", digest.alias("digest"))
    copied = keys.groupBy("digest").agg(F.min("owner").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(SALTS)).cast("int"))
    found = keys.join(copied, ["digest", "salt"]).groupBy("owner").agg(F.collect_set(F.struct("digest", "first", "copies")).alias("texts"))
    same = F.filter("texts", lambda o: o["digest"] == digest)[0]
    docs = docs.join(found, "owner", "left").withColumn("same", same)
    return docs.select("doc_id", "owner", "text", F.coalesce("same.first", "owner").alias("first"), F.coalesce("same.copies", F.lit(1)).alias("copies"))


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, removed, kept), a row for each row of ``df``.

    ``removed``: merged spans of words (start, end exclusive) covered by a window
    of ``window`` words that also starts in a document with a smaller id;
    ``kept``: the other words, joined by one space.  Null texts have no words;
    texts of fewer words than a window keep them all; rows of one doc_id don't
    remove each other's words; a null doc_id counts as larger than any other.
    Texts are taken whole at any length; an empty table stays empty.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block wherever it starts")
    docs = originals(df, doc_id, text)
    first = docs.filter(F.col("owner") == F.col("first")).select("doc_id", "owner", "text")  # the same columns everywhere: texts are shuffled once
    buckets, seeds = bucket_count(df), fresh_seeds(2)

    def send_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = string_bytes(batch["text"])
            owner = batch["owner"].to_numpy()
            for i, j in slices(offsets, SLICE):
                words = Words(batch["text"][i:j], seeds)
                if not len(words.row):
                    continue
                h = words.windows(block)
                long = (words.left + words.place) >= window
                at = np.flatnonzero(long & (words.left >= block))
                yield from combined_blocks(owner[i:j][words.row[at]], h[at], words.place[at] % block == 0, buckets)

    def meet_blocks(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        bucket = np.uint64(table["bucket"][0].as_py()) << np.uint64(8 * KEPT)
        probe_owner, (probe,) = unpacked(table, 0, width=KEPT)
        block_owner, (reference,) = unpacked(table, 1, width=KEPT)
        order = np.lexsort((block_owner, reference))
        block_owner, reference = block_owner[order], reference[order]
        head = np.flatnonzero(np.concatenate(([True], reference[1:] != reference[:-1]))) if len(reference) else np.zeros(0, np.int64)
        if not len(head):
            return [(probe_owner[:0], probe[:0])] * 2
        distinct, smallest = reference[head], block_owner[head]
        at = np.minimum(np.searchsorted(distinct, probe), len(distinct) - 1)
        met = distinct[at] == probe
        hit = met & (rank(smallest[at]) < rank(probe_owner))
        largest = np.full(len(distinct), np.iinfo(np.int64).min)
        np.maximum.at(largest, at[met], probe_owner[met])
        asked = rank(np.repeat(largest, np.diff(head, append=len(reference)))) > rank(block_owner)
        return [(probe_owner[hit], probe[hit] | bucket), (block_owner[asked], reference[asked] | bucket)]

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = string_bytes(batch["text"])
            owner = batch["owner"].to_numpy()
            for i, j in slices(offsets, SLICE):
                words = Words(batch["text"][i:j], seeds)
                keys = key_of(words.windows(block), buckets)
                here = words.left >= block
                probed = mine(words.row, j - i, keys, batch["probes"][i:j]) & here
                asked = mine(words.row, j - i, keys, batch["blocks"][i:j]) & here & (words.place % block == 0)
                at = np.flatnonzero(spread_back(probed | asked, window - block) & (words.left >= window))
                lanes = [words.windows(window, lane)[at] for lane in (0, 1)]
                mine_owner = owner[i:j][words.row[at]]
                order, head, n = grouped(mine_owner, lanes)
                later = rank(mine_owner[order]) > np.repeat(rank(mine_owner[order[head]]), n)
                known_already, sent = order[later], order[~later]  # the smallest documents of a window ask for others
                sent = np.sort(sent[once(mine_owner[sent], lanes[0][sent])])
                yield from packed(bucket_of(lanes[0][sent], buckets), mine_owner[sent], [x[sent] for x in lanes], 0)
                yield from known(mine_owner[known_already], lanes[0][known_already], 0, buckets)

    def meet_windows(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        owner, (a, b) = unpacked(table, 0, lanes=2)
        order, head, n = grouped(owner, [a, b])
        later = order[rank(owner[order]) > np.repeat(rank(owner[order[head]]), n)]
        return [(owner[later], a[later])]

    def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            _, offsets = string_bytes(batch["text"])
            copy = rank(batch["owner"].to_numpy()) != rank(batch["first"].to_numpy())
            for i, j in slices(offsets, SLICE):
                words = Words(batch["text"][i:j], seeds)
                n = np.diff(words.bounds)
                starts = mine(words.row, j - i, words.windows(window), batch["windows"][i:j]) | copy[i:j][words.row]
                gone = covered(starts & (words.left >= window), window)
                raw = words.data.tobytes()
                spans, kept = [], []
                for d in range(j - i):
                    a, b = int(words.bounds[d]), int(words.bounds[d + 1])
                    flags = gone[a:b]
                    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                    stay = np.flatnonzero(~flags) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"][i:j], "n_words": pa.array(n, pa.int64()), "removed": pa.array(spans, pa.list_(span)), "kept": pa.array(kept, pa.string())})

    def with_answers(left: DataFrame, answers: DataFrame, how: str) -> DataFrame:
        answers = answers.withColumnRenamed("owner", "__owner")
        return left.join(answers, left["owner"] == answers["__owner"], how).drop("__owner")

    sent = first.mapInArrow(send_blocks, PACKED)
    hits = resolved(sent, meet_blocks, ["probes", "blocks"], buckets)
    candidates = with_answers(first, hits, "inner")
    windows = resolved(candidates.mapInArrow(send_windows, PACKED), meet_windows, ["windows"], buckets)
    final = with_answers(docs.drop("copies"), windows, "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<bigint>")))
    return final.mapInArrow(cut_words, "doc_id bigint, n_words bigint, removed array<struct<start:int,end:int>>, kept string")


def op9(documents: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_words, n_removed, kept_sha256."""
    n = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return repeats(documents.select("doc_id", "text")).select("doc_id", "n_words", n.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
