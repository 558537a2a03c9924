"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into blocks.  Two fingerprints that differ in at
most ``bits`` bits agree in at least ``blocks - bits`` blocks, so they share the
key of some choice of that many blocks.  Fingerprints meet on those keys only,
distances are verified, and a bucket hands on a spanning forest of its links
rather than all pairs.  Components come from star contractions of the forests.

``near_duplicates`` judges by exact similarity of shingle sets instead.  At a Jaccard
of 0.8 some ten of 64 bits differ, where blocks that close pairs share are too short
to select anything, so fingerprints alone would miss most such pairs.  They join the
closest texts there, and what they leave apart meets on the rarest shingles of each
set (a prefix filter, which misses no pair); every link is verified on whole sets.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm import shingles
from phasegrid.llm.common import cut, files_for, fresh, written
from phasegrid.llm.routed import bucket_count

SEED = 42
#: Parts that the members of one component are dealt to.
SALTS = 32
#: Members of a bucket that one group takes; larger buckets are met chunk against chunk.
CHUNK = 50_000


def fingerprint_of(text: str, words: int = 4) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    found = text.encode().lower().split()  # bytes: A-Z only, and the white space 09-0D and 20
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    size = min(words, len(found))
    spans = zip(starts[: len(found) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """The fingerprints (bigint) of a text column; null counts as the empty text, whose fingerprint is zero."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t.as_py() or "", words) for t in batch], pa.int64())

    return simhash(text)


def block_keys(fp: Column, bits: int, blocks: int) -> Column:
    """The keys of every choice of ``blocks - bits`` blocks of a fingerprint."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, choice in enumerate(combinations(range(blocks), blocks - bits)):
        key = F.lit(n).cast("bigint")
        for b in choice:
            width = edges[b + 1] - edges[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning links of the fingerprints that are joined by steps of at most ``bits`` differing bits."""
    links: list[tuple[int, int]] = []
    waiting = np.unique(fps)
    while len(waiting) > 1:
        root, waiting = int(waiting[0]), waiting[1:]
        queue = [root]
        while queue and len(waiting):
            near = np.bitwise_count((waiting ^ np.int64(queue.pop())).view(np.uint64)) <= bits
            if near.any():
                met = waiting[near].tolist()
                links += [(root, m) for m in met]
                queue += met
                waiting = waiting[~near]
    return links


def links(fps: DataFrame, bits: int = 4, blocks: int = 7, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that join the distinct fingerprints ``fp`` of ``fps`` as all pairs within ``bits`` bits would."""
    keyed = fps.repartition(bucket_count(fps), "fp").select("fp", F.explode(block_keys(F.col("fp"), bits, blocks)).alias("key"))
    group = ["key"]
    hot = cut(keyed.groupBy("key").count().filter(F.col("count") > chunk))  # a row for every ``chunk`` rows at most
    if not hot.isEmpty():  # each pair of chunks of a large bucket is a group of its own
        keyed = shingles.in_chunks(keyed, hot, "fp", chunk)
        group = ["key", "pair"]
    buckets = keyed.groupBy(*group).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            values, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            yield pa.array([[{"a": a, "b": b} for a, b in forest(values[i:j], bits)] for i, j in zip(ends[:-1], ends[1:], strict=True)], kind)

    return buckets.select(F.explode(near("fps")).alias("link")).select("link.a", "link.b").distinct()


def roots(edges: DataFrame, files: int = 1) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches, by large and small stars.

    ``files``: how many files the links are cut into; later rounds follow their number.
    """
    state = None
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), files)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, files)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, files = now, files_for(now[0])


def rooted(docs: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, first, root): for each fingerprint of ``docs`` (doc_id, fp; cut) its smallest doc_id, and the root of its component."""
    firsts = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return firsts.join(roots(links(firsts.select("fp"), bits), files_for(docs.count())), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``df``.

    component_id is the smallest doc_id that the row's fingerprint reaches over
    links of at most ``bits`` differing bits.  Null texts count as empty; texts
    without words have fingerprint zero and link like others; rows that share a
    doc_id stay rows, and link by their own texts; null doc_ids are never the
    smallest unless a component has no other (then component_id is null).  Texts
    of any length are taken whole; other columns of ``df`` are left out.  An empty
    table gives an empty result.
    """
    docs = cut(df.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint(F.col(text), words).alias("fp")))
    firsts = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = roots(links(firsts.select("fp"), bits), files_for(docs.count()))
    members = found.union(found.select("root", "root").distinct()).toDF("fp", "root")  # only those that have links
    mine = members.join(firsts, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    least = mine.groupBy("root", "salt").agg(F.min("first").alias("first")).groupBy("root").agg(F.min("first").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a component may hold a third of all
    by_fp = firsts.join(mine.join(least, ["root", "salt"]).select("fp", "component_id"), "fp", "left")
    return docs.join(by_fp.select("fp", F.coalesce("component_id", "first").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns: rows that share it are equal throughout."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256))


def first_rows(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each component of ``docs`` (doc_id, digest, root) the row of ``df`` with the smallest doc_id; nulls come last, ties go by digest.

    Rows whose digest is neither dropped nor repeated stay where they are: a filter
    of fixed size tells them, so that only the others move.
    """
    rows = docs.groupBy("digest", "doc_id", "root").agg(F.count("*").alias("n"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(64)))  # a third of all rows may share a root
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("one")
    mine, stays, goes = (fresh(df, n) for n in ("__digest", "__kept", "__gone"))
    kept = salted.groupBy("root", "salt").agg(best).groupBy("root").agg(F.min("one").alias("one")).select(F.col("one.digest").alias(stays))
    gone = cut(rows.select("digest", "n").join(kept, F.col("digest") == F.col(stays), "left").filter(F.col(stays).isNull() | (F.col("n") > 1)).select("digest", stays), files_for(docs.count()))
    asked, sure = shingles.split_by(df.withColumn(mine, row_digest(df)), mine, shingles.filter_words(gone, "digest"))
    dropped = gone.filter(F.col(stays).isNull()).select(F.col("digest").alias(goes))
    # rows of one digest lie together after the join, so that dropping repeats moves no text again
    stay = asked.join(dropped, F.col(mine) == F.col(goes), "left_anti").dropDuplicates([mine])
    return sure.unionByName(stay).drop(mine)


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``df`` that stay: of each component of op1 the one with the smallest doc_id (one row of it, if it repeats).

    A component without any doc_id keeps one row too; rows are told apart by all their columns, not by doc_id.
    """
    docs = cut(df.select(F.col(doc_id).cast("long").alias("doc_id"), row_digest(df).alias("digest"), fingerprint(F.col(text), words).alias("fp")))
    return first_rows(df, docs.join(rooted(docs, bits).select("fp", "root"), "fp").select("doc_id", "digest", "root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, waves: int = 2, chunk: int = 2_000) -> DataFrame:
    """The rows of ``df`` that stay: of each component of texts linked by shingle similarity the one with the smallest doc_id.

    Links join texts whose sets of ``words``-word shingles (A-Z lower-cased) have a
    Jaccard of ``similarity`` or more; all of them count, but for collisions of
    64-bit hashes of shingles.  Null texts count as empty; texts without words are
    copies of each other; texts of fewer words are one shingle.  Rows are told apart
    by all their columns: repeated rows leave one, ties on doc_id go by digest, null
    doc_ids come last.  Texts are taken whole; an empty table stays empty; all
    columns stay as they are.
    ``waves``: how often one node of each key is compared with the others before those
    of a key that are still apart are compared with each other, chunk by chunk.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), row_digest(df).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = written(shingles.profiles(rows, words))
    docs = found.filter("node IS NOT NULL")
    files = files_for(docs.count())
    # texts that fingerprints find close
    by_fp = cut(docs.groupBy("fp").agg(F.min("node").alias("one")), files)
    same = docs.select("fp", "node").distinct().join(by_fp, "fp").filter("node <> one").select("one", "node")
    ends = [by_fp.select(F.col("fp").alias(k), F.col("one").alias(f"node_{k}")) for k in ("a", "b")]
    close = links(by_fp.select("fp")).join(ends[0], "a").join(ends[1], "b").select("node_a", "node_b").union(same)
    tried = cut(shingles.ordered(close, F.col("node_a"), F.col("node_b")), files)
    linked = shingles.similar(tried, rows, words, similarity, files)
    labels = roots(linked, files)
    # all others meet on the rarest members of their sets
    met = written(shingles.meeting(shingles.prefixes(rows, words, similarity, shingles.frequent(found), bucket_count(df))))  # read twice
    met = written(shingles.apart(met, labels).drop("label"), shingles.SET_FILES * files)
    sketches = docs.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    for wave in range(waves + 1):  # a node of each key links most of a large group; then whatever is still apart is paired
        left = shingles.apart(met, labels)
        if wave < waves:
            pairs = shingles.hub_pairs(left, similarity, wave)
        else:
            pairs = shingles.bucket_pairs(left.join(shingles.folded(sketches), "node"), similarity, chunk)
        pairs = cut(shingles.likely(cut(pairs.join(tried, ["a", "b"], "left_anti"), files), sketches, similarity), files)
        if not pairs.isEmpty():
            tried = tried.unionByName(pairs)
            linked = linked.unionByName(shingles.similar(pairs, rows, words, similarity, files))
            labels = roots(linked, files)
    return first_rows(df, docs.join(labels, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root")))


def op1(documents: DataFrame) -> DataFrame:
    """Contract columns: doc_id, fingerprint, component_id."""
    return components(documents.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
