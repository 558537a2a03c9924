"""Benchmark decontamination with an FM-index for each training shard.

A shard is a few megabytes of documents.  Its words become symbols; words that no
benchmark phrase has end a run, and runs shorter than the shortest phrase can't
hold one, so the index covers all that can match.  The suffix array of the
symbols gives the Burrows-Wheeler transform, a wavelet matrix gives its ranks,
backward search finds all phrases at once, sampled suffix positions locate their
occurrences, and the spans of a document are merged.

Benchmarks are taken in blocks of bounded size, one block at a time: each is searched
in all documents, and what earlier blocks hit is written before the next is read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import fresh, released, slices, string_bytes, without, written
from phasegrid.llm.hashing import fresh_seeds, word_hashes, words_in

#: Bytes of words: digits, letters and everything beyond ASCII; A-Z count as a-z.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Words of a window; bytes of text in a shard; bytes of benchmark in a block; distance of sampled suffix positions.
WINDOW, SHARD_BYTES, BLOCK_BYTES, SAMPLE = 10, 4 << 20, 4 << 20, 8

SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
HITS = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,bytes:array<struct<start:int,end:int>>,items:array<string>>"


@dataclass
class Phrases:
    """The windows of a block of benchmark items."""

    words: list[bytes]  # the word of each symbol from 2 on; 0 ends the text, 1 ends a run
    hashes: np.ndarray  # of the words, sorted
    symbols: np.ndarray  # of the sorted hashes
    by_length: dict[int, np.ndarray]  # length -> a row of symbols for each phrase
    items: dict[int, list[list[str]]]  # length -> the item ids of each phrase
    shortest: int
    seed: int  # of the hashes; no two words of the block share one


def words_of(text: str) -> list[bytes]:
    """The words of a text, lower-cased."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = words_in(WORD_BYTE, data, np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start, end, strict=True)]


def phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases | None:
    """The distinct windows of (item id, text) pairs; None if no item has a word."""
    symbol: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        seq = [symbol.setdefault(w, len(symbol) + 2) for w in words_of(text)]
        size = min(window, len(seq))
        if size:
            for i in range(len(seq) - size + 1):
                found.setdefault(tuple(seq[i : i + size]), set()).add(item)
    if not found:
        return None
    joined = np.frombuffer(b" ".join(symbol), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in symbol]) - 1
    while True:
        (seed,) = fresh_seeds(1)
        hashes = word_hashes(joined, np.concatenate(([0], ends[:-1] + 1)), ends, seed)
        order = np.argsort(hashes)
        if (np.diff(hashes[order]) != 0).all():
            break
    rows: dict[int, list] = {}
    for p in found:
        rows.setdefault(len(p), []).append(p)
    return Phrases([*symbol], hashes[order], order + 2, {n: np.array(r, np.int64) for n, r in rows.items()}, {n: [sorted(found[p]) for p in r] for n, r in rows.items()}, min(rows), seed)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by doubling the compared length until no two tie."""
    n = len(text)
    rank = text.astype(np.int64)
    size = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        if size > 1:
            behind = np.zeros(n, np.int64)
            behind[: n - size // 2] = rank[size // 2 :] + 1
            key = rank * (int(rank.max()) + 2) + behind
            order = np.argsort(key, kind="stable")
            key = key[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        size = 2 * size


class FmIndex:
    """Counts and locates symbol sequences in a text that ends with its only 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        self.last = text[order - 1]  # order 0 wraps to the final 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.sampled = order % sample == 0
        self.position = order[self.sampled]
        self.samples_before = np.concatenate(([0], np.cumsum(self.sampled)))
        self.bits = max(1, int(text.max()).bit_length())
        self.ones, self.zeros = [], []
        level = self.last
        for b in range(self.bits - 1, -1, -1):  # wavelet matrix: zeros of a level go before its ones
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones = self.ones[k]
            at = np.where(one, self.zeros[k] + ones[at], at - ones[at])
            low = np.where(one, self.zeros[k] + ones[low], low - ones[low])
        return at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, last row + 1) of the patterns that occur."""
        live = np.flatnonzero((patterns < len(self.first) - 1).all(axis=1))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.last))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows: steps back until a sampled row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            c = self.last[rows[going]]
            rows[going] = self.first[c] + self.rank(c, rows[going])
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        return self.position[self.samples_before[rows]] + steps


def shard_hits(texts: pa.Array, block: Phrases) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, list[str]]], np.ndarray, np.ndarray]:
    """(word starts, word ends, [(document, first word, end word, items)], first word of each document, data) of a shard."""
    raw, offsets = string_bytes(texts)
    data = LOWER[raw]
    start, end, row = words_in(WORD_BYTE, data, offsets) if len(data) else (np.zeros(0, np.int64),) * 3
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    found: list[tuple[int, int, int, list[str]]] = []
    if not len(start):
        return start, end, found, bounds, data
    h = word_hashes(data, start, end, block.seed)
    at = np.minimum(np.searchsorted(block.hashes, h), len(block.hashes) - 1)
    known = block.hashes[at] == h
    fresh = np.concatenate(([True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])))
    run_start = np.flatnonzero(fresh)
    run_length = np.diff(run_start, append=len(known))
    keep = known[run_start] & (run_length >= block.shortest)
    run_start, run_length = run_start[keep], run_length[keep]
    if not len(run_start):
        return start, end, found, bounds, data
    ends = np.cumsum(run_length + 1)
    text = np.ones(ends[-1] + 1, np.int64)  # 1 after each run, 0 at the end
    text[-1] = 0
    origin = np.full(len(text), -1, np.int64)
    place = np.arange(run_length.sum()) + np.repeat(np.arange(len(run_length)), run_length)
    word = np.arange(run_length.sum()) + np.repeat(run_start - (np.cumsum(run_length) - run_length), run_length)
    text[place], origin[place] = block.symbols[at[word]], word
    index = FmIndex(text)
    for length, patterns in block.by_length.items():
        which, low, high = index.search(patterns)
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which = np.repeat(which, n)
        words = origin[index.locate(rows)]
        for p, w in zip(which.tolist(), words.tolist(), strict=True):
            # a word that is none of the block's may share a hash with one: the bytes decide
            if all(data[start[w + k] : end[w + k]].tobytes() == block.words[s - 2] for k, s in enumerate(patterns[p].tolist())):
                found.append((int(row[w]), w, w + length, block.items[length][p]))
    return start, end, found, bounds, data


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as maximal spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's (item id, text) pairs in blocks of about ``block_bytes``, one block at a time on the driver."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["id"], r["text"]))
        size += len(r["text"].encode())
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def merged_column(found: list[list[tuple[int, int]]], before: pa.Array | None) -> pa.Array:
    """A column of merged spans, those of earlier blocks included."""
    if before is not None:
        found = [f + [(s["start"], s["end"]) for s in b] for f, b in zip(found, before.to_pylist(), strict=True)]
    return pa.array([[{"start": a, "end": b} for a, b in merged(f)] for f in found], pa.list_(SPAN))


def hits(text: Column, block: Phrases, earlier: Column | None = None) -> Column:
    """The words, merged hit spans (in words, and in bytes of UTF-8) and hit items of each text, with those of an earlier block."""

    def found(texts: pa.Array, before: pa.StructArray | None) -> pa.Array:
        _, offsets = string_bytes(texts)
        spans, places = [[[] for _ in range(len(texts))] for _ in range(2)]
        items: list[set] = [set(x) for x in before.field("items").to_pylist()] if before is not None else [set() for _ in range(len(texts))]
        counts = np.zeros(len(texts), np.int64)
        for i, j in slices(offsets, SHARD_BYTES):
            start, end, hit, bounds, _ = shard_hits(texts[i:j], block)
            counts[i:j] = np.diff(bounds)
            for d, a, b, ids in hit:
                at = int(offsets[i + d] - offsets[i])
                spans[i + d].append((a - int(bounds[d]), b - int(bounds[d])))
                places[i + d].append((int(start[a]) - at, int(end[b - 1]) - at))
                items[i + d].update(ids)
        columns = {"n_words": pa.array(counts), "spans": merged_column(spans, before and before.field("spans")), "bytes": merged_column(places, before and before.field("bytes")), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    @F.arrow_udf(HITS)
    def alone(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield found(batch, None)
        released()

    @F.arrow_udf(HITS)
    def added(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before in batches:
            yield found(texts, before)
        released()

    return alone(text) if earlier is None else added(text, earlier)


#: A block without phrases: documents are still counted.
EMPTY = Phrases([], np.zeros(1, np.uint64), np.zeros(1, np.int64), {}, {}, 1 << 60, 0)


def with_hits(df: DataFrame, benchmark: DataFrame, text: str, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """(``df`` with its hits, the name of their column, which is none of its own); the driver and each worker hold one block of the benchmark at a time."""
    name, out = fresh(df, "__hits"), None
    for items in blocks_of(benchmark, item_id, item_text, block_bytes):
        block = phrases(items, window)
        if block is not None:
            out = df.withColumn(name, hits(F.col(text), block)) if out is None else written(out).withColumn(name, hits(F.col(text), block, F.col(name)))
    return (df.withColumn(name, hits(F.col(text), EMPTY)) if out is None else out), name


def marked(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Adds ``contamination``: n_words, merged hit spans in words and in bytes, and the ids of items with an occurring window.

    Null texts have no words; items without words match nothing; repeated items
    count once; null item ids read "null".  Texts of any length are taken whole;
    repeated rows stay rows and are judged each; the order of rows or items means
    nothing.  A column of the added name is replaced, others stay.  An empty table
    stays empty; an empty benchmark hits nothing.
    """
    found, name = with_hits(df, benchmark, text, **options)
    return without(found, "contamination").withColumnRenamed(name, "contamination")


def cleaned(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with every merged hit span cut from its texts; null texts stay null, clean texts stay as they are."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if found:
                raw, parts, at = t.encode(), [], 0
                for s in found:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                t = b"".join([*parts, raw[at:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    found, name = with_hits(df, benchmark, text, **options)
    return found.withColumn(text, cut(F.col(text), F.col(f"{name}.bytes"))).drop(name)


def op4(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = F.col("contamination")
    n_hit = F.aggregate(c["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return marked(documents.select("doc_id", "text"), benchmark).select(
        "doc_id", c["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
