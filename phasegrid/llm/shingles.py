"""Sets of word shingles: their hashes, SimHash fingerprints and exact similarity, for whole slices of texts at once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.block_dedup import SPACE
from phasegrid.llm.common import cut, fresh, released, slices, string_bytes, written
from phasegrid.llm.hashing import window_hashes, word_hashes, words_in
from phasegrid.llm.routed import bucket_of

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text handled at once; bits of the filter of asked sets; shingles known as frequent; times a batch must have one to report it.
SLICE, FILTER_BITS, FREQUENT, REPORTED = 2 << 20, 1 << 24, 1 << 16, 4
#: Bits of the smallest sketch.
SKETCH = 256
#: Bytes of a sketch that goes into a bucket at most; longer ones are folded.
FOLDED = 256
#: Files of sets for each file of ids.
SET_FILES = 8
#: Guards comparisons of counts with multiples of the similarity against rounding.
TINY = 1e-9


class ShingleSets:
    """The distinct shingles of each text of a slice, sorted by hash; a text of fewer words is one shingle, none without words."""

    def __init__(self, texts: pa.Array, words: int):
        raw, offsets = string_bytes(texts)
        data = LOWER[raw]
        start, end, row = words_in(~SPACE, data, offsets)
        h, bounds = word_hashes(data, start, end), np.searchsorted(row, np.arange(len(texts) + 1))
        count = np.diff(bounds)
        found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size in range(1, words + 1):
            if size == words:
                at = np.flatnonzero(bounds[1:][row] - np.arange(len(row)) >= size)
            else:
                at = bounds[:-1][count == size]
            if len(at):
                found.append(window_hashes(h, size)[at])
                rows.append(row[at])
        h, row = np.concatenate(found), np.concatenate(rows)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hashes, self.row = h[fresh], row[fresh]
        self.bounds = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.sizes = np.diff(self.bounds)

    def nodes(self) -> list[bytes]:
        """A 128-bit digest of each set."""
        raw, b = self.hashes.tobytes(), (8 * self.bounds).tolist()
        return [xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(b[:-1], b[1:], strict=True)]

    def sketches(self) -> list[bytes]:
        """For each set, whether an odd number of members falls on each of a power of two of places, 2 to 4 for each member."""
        places = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(2 * self.sizes, 1))).astype(np.int64))
        ends = np.cumsum(places)
        at = (self.hashes >> np.uint64(20)).astype(np.int64) % places[self.row] + (ends - places)[self.row]
        odd = np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1
        raw = np.packbits(odd.astype(np.uint8)).tobytes()
        return [raw[a:b] for a, b in zip(((ends - places) // 8).tolist(), (ends // 8).tolist(), strict=True)]

    def fingerprints(self) -> np.ndarray:
        """The SimHash of each set: a bit is 1 if set in over half the hashes."""
        out = np.zeros(len(self.sizes), np.int64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            bits = np.unpackbits(self.hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, self.bounds[some], axis=0, dtype=np.int32)
            out[some] = np.packbits(sums * 2 > self.sizes[some, None], axis=1, bitorder="little").view("<i8").ravel()
        return out


def of_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, ShingleSets, list[bytes], np.ndarray]]:
    """(slice, sets, nodes, the first row of each node in the slice)."""
    for batch in batches:
        _, offsets = string_bytes(batch["text"])
        for i, j in slices(offsets, SLICE):
            part = batch.slice(i, j - i)
            sets = ShingleSets(part["text"], words)
            nodes = sets.nodes()
            yield part, sets, nodes, np.unique(np.array([int.from_bytes(n[:8], "little") for n in nodes], np.uint64), return_index=True)[1]
    released()


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """For each row of ``docs`` (doc_id, digest, text) its node, size, fingerprint and sketch; rows without a node are shingles (with a count) that a batch has often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, nodes, first in of_batches(batches, words):
            none = np.zeros(part.num_rows, bool)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part["doc_id"], "digest": part["digest"], "node": pa.array(nodes, pa.binary()), "size": pa.array(sets.sizes, pa.int32()), "fp": pa.array(sets.fingerprints()), "sketch": pa.array(sets.sketches(), pa.binary())}
                | {"shingle": pa.nulls(len(none), pa.int64()), "n": pa.nulls(len(none), pa.int64())}
            )
            once = np.zeros(part.num_rows, bool)
            once[first] = True
            found, n = np.unique(sets.hashes[once[sets.row]], return_counts=True)
            found, n = found[n >= REPORTED], n[n >= REPORTED]
            empty = {k: pa.nulls(len(found), t) for k, t in (("doc_id", pa.int64()), ("digest", pa.binary()), ("node", pa.binary()), ("size", pa.int32()), ("fp", pa.int64()), ("sketch", pa.binary()))}
            yield pa.RecordBatch.from_pydict(empty | {"shingle": pa.array(found.view(np.int64)), "n": pa.array(n, pa.int64())})

    return docs.mapInArrow(run, "doc_id bigint, digest binary, node binary, size int, fp bigint, sketch binary, shingle bigint, n bigint")


def frequent(found: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of the ``most`` most reported shingles, sorted by shingle."""
    top = found.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(most).collect()
    rows = sorted((r["shingle"] & (1 << 64) - 1, r["n"]) for r in top)
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def prefixes(docs: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """The first members of each set, rare ones first, of which sets as similar share one, packed by bucket of the member.

    A row has what a slice of texts sends to one bucket: nodes with their sizes and how many members each has here; members and their places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, nodes, first in of_batches(batches, words):
            h, n = sets.hashes, np.zeros(len(sets.hashes), np.int64)
            if len(common[0]):
                at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
                n = np.where(common[0][at] == h, common[1][at], 0)
            order = np.lexsort((h, n, sets.row))
            pos = np.arange(len(h)) - sets.bounds[:-1][sets.row]
            kept = sets.sizes - np.ceil(similarity * sets.sizes - TINY).astype(np.int64) + 1
            once = np.zeros(len(sets.sizes), bool)
            once[first] = True
            at = np.flatnonzero((pos < kept[sets.row]) & once[sets.row])
            key, row, pos = h[order][at], sets.row[at], pos[at].astype("<i4")
            bucket = bucket_of(key, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, key, row, pos = bucket[order], key[order], row[order], pos[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            names = np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, 16)
            out: dict[str, list] = {"bucket": [], "nodes": [], "sizes": [], "counts": [], "keys": [], "places": []}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                head = np.flatnonzero(np.diff(row[a:b], prepend=-1))
                mine = row[a:b][head]
                out["bucket"].append(int(bucket[a]))
                parts = {"nodes": names[mine], "sizes": sets.sizes[mine].astype("<i4"), "counts": np.diff(head, append=b - a).astype("<i4"), "keys": key[a:b], "places": pos[a:b]}
                for name, part in parts.items():
                    out[name].append(part.tobytes())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out.pop("bucket"), pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    return docs.select("text").mapInArrow(run, "bucket int, nodes binary, sizes binary, counts binary, keys binary, places binary")


def meeting(packed: DataFrame) -> DataFrame:
    """(key, node, size, pos), each (key, node) once: the members of ``prefixes`` that several nodes have, after one shuffle by bucket."""

    def meet(table: pa.Table) -> pa.Table:
        nodes, sizes, counts, key, pos = (np.frombuffer(b"".join(table[k].to_pylist()), kind) for k, kind in (("nodes", "<u8"), ("sizes", "<i4"), ("counts", "<i4"), ("keys", "<u8"), ("places", "<i4")))
        nodes = nodes.reshape(-1, 2)
        order = np.lexsort(nodes.T)
        fresh = np.any(np.diff(nodes[order], axis=0, prepend=~nodes[order[:1]]) != 0, axis=1)
        number = np.zeros(len(nodes), np.int64)
        number[order] = np.cumsum(fresh) - 1
        owner = np.repeat(np.arange(len(nodes)), counts)
        order = np.lexsort((number[owner], key))
        k, v = key[order], number[owner[order]]
        order = order[np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))]  # a node that several slices have counts once
        k = key[order]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        n = np.diff(head, append=len(k))
        order = order[np.repeat(n > 1, n)]
        names = pa.array([x.tobytes() for x in nodes[owner[order]]], pa.binary())
        found = pa.table({"key": pa.array(key[order].view(np.int64)), "node": names, "size": pa.array(sizes[owner[order]], pa.int32()), "pos": pa.array(pos[order], pa.int32())})
        released()
        return found

    return packed.groupBy("bucket").applyInArrow(meet, "key bigint, node binary, size int, pos int")


def filter_words(ids: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """(word, bit): a filter that passes every value of the binary column ``name`` and few others; ``bits`` / 64 rows at most."""
    h = F.xxhash64(name)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))
    return ids.select(F.shiftright(F.pmod(h, F.lit(bits)), 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))


def split_by(df: DataFrame, name: str, words: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` that the filter passes, all others); the filter is broadcast, its size is fixed."""
    h = F.xxhash64(name)
    word, bit, passes = (fresh(df, n) for n in ("__word", "__bit", "__pass"))
    looked = df.withColumn(word, F.shiftright(F.pmod(h, F.lit(bits)), 6)).join(F.broadcast(words.select(F.col("word").alias(word), F.col("bit").alias(bit))), word, "left")
    looked = looked.withColumn(passes, F.coalesce(F.call_function("getbit", F.col(bit), F.pmod(h, F.lit(64)).cast("int")) == 1, F.lit(False)))
    return tuple(looked.filter(F.col(passes) == side).drop(word, bit, passes) for side in (True, False))


def sets_of(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, members) of the asked nodes; texts are read where they lie, only sets that pass a filter move."""
    words_of = filter_words(asked, "node").collect()  # FILTER_BITS / 64 at most
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[[r["word"] for r in words_of]] = [r["bit"] for r in words_of]
    passed = filled.view(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, nodes, first in of_batches(batches, words):
            place = np.array([xxhash.xxh64_intdigest(n, 42) for n in nodes], np.uint64) % np.uint64(8 * len(passed))
            wanted = first[(passed[place[first] >> np.uint64(3)] >> (place[first] & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
            members = [sets.hashes[sets.bounds[k] : sets.bounds[k + 1]].tobytes() for k in wanted.tolist()]
            yield pa.RecordBatch.from_pydict({"node": pa.array([nodes[k] for k in wanted.tolist()], pa.binary()), "members": pa.array(members, pa.binary())})

    return docs.select("text").mapInArrow(run, "node binary, members binary").join(asked, "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that ``sketches`` (node, size, sketch) don't tell apart: sets differ in as many members as their sketches in bits, at least."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    mine = split_by(sketches, "node", filter_words(asked, "node"))[0]

    @F.arrow_udf("boolean")
    def near(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for m, x, n, y in batches:
            out = []
            for size_a, a, size_b, b in zip(m.to_pylist(), x.to_pylist(), n.to_pylist(), y.to_pylist(), strict=True):
                if min(size_a, size_b) < similarity * max(size_a, size_b) - TINY:
                    out.append(False)
                    continue
                short, long = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
                while len(long) > len(short):  # what falls on either of two places counts for one
                    long = long[: len(long) // 2] ^ long[len(long) // 2 :]
                differ = int(np.bitwise_count(short ^ long).sum())
                out.append(differ * (1 + similarity) <= (1 - similarity) * (size_a + size_b) + TINY)
            yield pa.array(out, pa.bool_())

    a, b = (mine.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").filter(near("size_a", "sketch_a", "size_b", "sketch_b")).select("a", "b")


def similar(pairs: DataFrame, docs: DataFrame, words: int, similarity: float, files: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard of ``similarity`` or more; ``docs`` has the texts."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(sets_of(docs, asked, words), SET_FILES * files)

    @F.arrow_udf("boolean")
    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both >= similarity * (len(x) + len(y) - both) - TINY)
            yield pa.array(out, pa.bool_())

    a, b = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return cut(pairs.join(a, "a").join(b, "b").filter(near("x", "y")).select("a", "b"), files)


def ordered(pairs: DataFrame, one: Column, other: Column) -> DataFrame:
    """The distinct pairs (a, b) of two columns, a < b."""
    return pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (key, node, size, pos) with their label (of ``labels``, else the node), of keys that nodes of several labels have."""
    named = rows.join(labels, "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return named.join(several, "key", "left_semi")


def hub_pairs(rows: DataFrame, similarity: float, seed: int) -> DataFrame:
    """(a, b), a < b: of each key one node, by ``seed``, with all nodes of other labels that may be as similar."""
    mine = F.struct(*[F.col(c) for c in ("node", "size", "pos", "label")])
    hubs = rows.groupBy("key").agg(F.min_by(mine, F.xxhash64("node", F.lit(seed))).alias("hub"))
    rest = F.least(F.col("size") - F.col("pos"), F.col("hub.size") - F.col("hub.pos"))  # members from this one on
    fits = (F.col("label") != F.col("hub.label")) & (rest * (1 + similarity) >= similarity * (F.col("size") + F.col("hub.size")) - TINY)
    return ordered(rows.join(hubs, "key").filter(fits), F.col("node"), F.col("hub.node"))


def folded(sketches: DataFrame) -> DataFrame:
    """(node, sketch) with sketches of FOLDED bytes at most: what falls on either of two places counts for one."""

    @F.arrow_udf("binary")
    def fold(batch: pa.Array) -> pa.Array:
        out = []
        for sketch in batch.to_pylist():
            if len(sketch) > FOLDED:
                sketch = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, FOLDED // 8), axis=0).tobytes()
            out.append(sketch)
        return pa.array(out, pa.binary())

    return sketches.select("node", fold("sketch").alias("sketch"))


class Bucket:
    """The nodes that share a key, by size: their sketches, folded to each width that one of them has."""

    def __init__(self, members: pa.StructArray):
        size = members.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        self.rest = self.size - members.field("pos").to_numpy(zero_copy_only=False)[self.order]  # members from the key on
        self.label = members.field("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)[self.order]
        sketches = members.field("sketch").take(pa.array(self.order)).to_pylist()
        self.width = np.array([len(x) for x in sketches])  # grows with the size
        widths, starts = np.unique(self.width, return_index=True)
        groups = [np.frombuffer(b"".join(sketches[i:j]), np.uint64).reshape(j - i, -1) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(sketches)], strict=True)]
        self.sketch = {
            w: (i, np.concatenate([np.bitwise_xor.reduce(g.reshape(len(g), -1, w // 8), axis=1) for g in groups[k:]])) for k, (w, i) in enumerate(zip(widths.tolist(), starts.tolist(), strict=True))
        }

    def pairs(self, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Members of different labels that neither sizes, nor places of the key, nor sketches tell apart."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.searchsorted(self.size, self.size / similarity + TINY, "right")
        for i, end in enumerate(ends.tolist()):
            j = np.arange(i + 1, end)
            both = self.size[i] + self.size[j]
            j = j[(self.label[j] != self.label[i]) & (np.minimum(self.rest[i], self.rest[j]) * (1 + similarity) >= similarity * both - TINY)]
            if not len(j):
                continue
            first, sketch = self.sketch[int(self.width[i])]
            differ = np.bitwise_count(sketch[j - first] ^ sketch[i - first]).sum(axis=1, dtype=np.int64)
            j = j[differ * (1 + similarity) <= (1 - similarity) * (self.size[i] + self.size[j]) + TINY]
            left.append(np.full(len(j), i))
            right.append(j)
        return self.order[np.concatenate(left)], self.order[np.concatenate(right)]


def bucket_pairs(rows: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """(a, b), a < b: nodes of different labels that share a key and, by size, place of the key and sketch, may be as similar.

    ``rows``: key, node, size, pos, label, sketch (see ``folded``).  Keys of more than ``chunk`` nodes are met chunk against chunk.
    """
    hot = cut(rows.groupBy("key").count().filter(F.col("count") > chunk))  # a row for every ``chunk`` rows at most
    group = ["key"]
    if not hot.isEmpty():
        rows = in_chunks(rows, hot, "node", chunk)
        group = ["key", "pair"]
    members = rows.groupBy(*group).agg(F.collect_list(F.struct("node", "size", "pos", "label", "sketch")).alias("members")).filter(F.size("members") > 1)

    @F.arrow_udf("array<struct<one:binary,other:binary>>")
    def met(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends, found = [0], [pa.StructArray.from_arrays([pa.array([], pa.binary())] * 2, ["one", "other"])]
            for bucket in batch:
                one, other = Bucket(bucket.values).pairs(similarity)
                nodes = bucket.values.field("node")
                found.append(pa.StructArray.from_arrays([nodes.take(pa.array(k)).cast(pa.binary()) for k in (one, other)], ["one", "other"]))
                ends.append(ends[-1] + len(one))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(found))

    pairs = members.select(F.explode(met("members")).alias("pair"))
    return ordered(pairs, F.col("pair.one"), F.col("pair.other"))


def in_chunks(rows: DataFrame, hot: DataFrame, member: str, chunk: int) -> DataFrame:
    """``rows`` with ``pair``: those of a key in ``hot`` (key, count) once for each pair of chunks that has theirs."""
    n = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64(member), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.least(k, F.col("mine")) * F.col("n") + F.greatest(k, F.col("mine")))
    return rows.join(hot, "key", "left").withColumn("n", n).withColumn("mine", mine).select(*rows.columns, F.explode(pairs).alias("pair")).repartition("key", "pair")
