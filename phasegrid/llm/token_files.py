"""Token-id files compressed by Re-Pair grammars.

Documents are put in ascending doc_id order, encoded, and cut into shards of
whole documents.  Each shard repeatedly replaces frequent pairs of ids by
nonterminals until no pair occurs twice, and stores its rules, the lengths the
nonterminals expand to, the compressed sequence and where each document starts
in it, so that a document or any id range is decoded without the rest.

A shard is one binary value, a row of a Parquet table: Spark's committer makes
the files whole, and any store that Spark reads can hold them.
"""

import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from phasegrid.llm.bpe_codec import Numbers, byte_letters, spread
from phasegrid.llm.common import shared_dir, slices, string_bytes
from phasegrid.llm.hashing import HEAD, SEEDS, eights, mix

#: Texts of these characters only are cut into words here; for them lower-casing and white space agree with the library.
NOT_PLAIN = re.compile("[^\t\n\v\f\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ž]")
#: Pieces of a word, fixed by the vocabulary's pre-tokenizer.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Words a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000

#: Ids of a shard, about; times a pair must occur to be replaced; bytes of text encoded together.
SHARD_IDS, LEAST, SLICE = 1 << 20, 2, 2 << 20
#: Magic, first nonterminal, then how many documents, ids, symbols of the sequence, rules and rounds.
MAGIC, HEADER = b"RPG2", "<4sIQQQQQ"

#: Symbols beyond ASCII that plain texts may have; without them their bytes beyond ASCII are letters.
SYMBOL = re.compile("[\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7]")
#: Kinds of bytes in lower-cased plain text: letters, apostrophes (no cut beside them), white space, all others.
LETTER, QUOTE, BLANK, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(0x61, 0x7B), *range(0x80, 256)]] = LETTER
KIND[0x27] = QUOTE
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK

SHARDS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])
TOKENS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("start_in_shard", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def parts_of(data: np.ndarray, offsets: np.ndarray, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of words, cut where a letter meets another character that is no apostrophe: no piece crosses that.

    ``lettered``: rows whose characters beyond ASCII are all letters; others are cut at white space only.
    """
    kind = KIND[data]
    kind[(kind == LETTER) & ~np.repeat(lettered, np.diff(offsets))] = QUOTE
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] != QUOTE) & (kind[:-1] != QUOTE) | (kind[1:] == BLANK) | (kind[:-1] == BLANK)
    fresh[offsets] = True
    cuts = np.flatnonzero(fresh)
    start, end = cuts[:-1], cuts[1:]
    word = kind[start] != BLANK
    start, end = start[word], end[word]
    return start, end, np.searchsorted(offsets, start, "right") - 1


class WordIds:
    """Ids of texts by the tokenizers library; words of plain texts are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode_new(self) -> None:
        """Encodes the words that got a number since the last call."""
        ids: list[int] = []
        ends = []
        tokenize = self.model.tokenize
        for word in itertools.islice(self.number, len(self.lengths), None):
            if word.isalpha():  # bytes: a-z only
                ids += [t.id for t in tokenize(word.decode())]
            else:
                for piece in PIECE.findall(word.decode()):
                    ids += [t.id for t in tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]
            ends.append(len(ids))
        self.flat = np.concatenate((self.flat, np.array(ids, np.uint32)))
        self.lengths = np.concatenate((self.lengths, np.diff(np.array(ends, np.int64), prepend=0)))

    def numbers_of(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word; of equal words of up to 16 bytes one is looked up."""
        out, size = np.empty(len(start), np.int64), end - start
        short = np.flatnonzero(size <= 16)
        slow = np.flatnonzero(size > 16)
        if len(short):
            wide = eights(np.frombuffer(raw, np.uint8))
            low = wide[start[short]] & HEAD[np.minimum(size[short], 8)]
            high = wide[np.minimum(start[short] + 8, len(raw))] & HEAD[np.maximum(size[short] - 8, 0)]
            index = np.uint64((1 << (len(short) - 1).bit_length()) - 1)
            key = mix(low ^ mix(high + np.uint64(SEEDS[0]))) & ~index | np.arange(len(short), dtype=np.uint64)
            key.sort()
            at, key = (key & index).astype(np.int64), key & ~index
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            group = np.repeat(np.arange(len(head)), np.diff(head, append=len(key)))
            first = at[head]
            same = (low[at] == low[first][group]) & (high[at] == high[first][group])  # the bytes decide
            found = [self.number[raw[a:b]] for a, b in zip(start[short[first]].tolist(), end[short[first]].tolist(), strict=True)]
            out[short[at]] = np.array(found, np.int64)[group]
            slow = np.concatenate((slow, short[at[~same]]))
        out[slow] = [self.number[raw[a:b]] for a, b in zip(start[slow].tolist(), end[slow].tolist(), strict=True)]
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens added."""
        if len(self.number) > REMEMBERED:
            self.forget()
        plain = [not ("<|" in t or NOT_PLAIN.search(t)) for t in texts]
        parts = [t.lower().replace("\xa0", " ").encode() for t, p in zip(texts, plain, strict=True) if p]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
        raw = b"".join(parts)
        start, end, row = parts_of(np.frombuffer(raw, np.uint8), offsets, np.array([SYMBOL.search(t) is None for t, p in zip(texts, plain, strict=True) if p], bool))
        words = self.numbers_of(raw, start, end)
        if len(self.number) > len(self.lengths):
            self.encode_new()
        ids = spread(self.flat, self.lengths, np.cumsum(self.lengths) - self.lengths, words)
        ends = np.concatenate(([0], np.cumsum(self.lengths[words])))[np.searchsorted(row, np.arange(len(parts) + 1))]
        mine = iter(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return [ids[slice(*next(mine))] if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t, p in zip(texts, plain, strict=True)]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str | None = None) -> WordIds:
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(sequence, ends of documents in it, rules, rules of each round, first nonterminal); no pair spans two documents.

    A round counts all pairs (every second one of a run of equal symbols) and ranks
    them by frequency; an occurrence is replaced where its pair outranks both pairs
    that overlap it, so the most frequent pair goes everywhere.  Rounds go on until
    no pair occurs ``least`` times.  Places whose pair is rare are left alone from
    then on, unless a neighbour changes: pairs of old symbols never become more.
    """
    n, base = len(ids), int(ids.max()) + 1 if len(ids) else 0
    symbol, full = ids.astype(np.uint32), np.diff(ends, prepend=0) > 0
    follow, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    follow[ends[full] - 1] = -1
    before[(ends - np.diff(ends, prepend=0))[full]] = -1
    live, rank_at = np.ones(n, bool), np.zeros(n + 1, np.int32)  # the last place of rank_at stands for "none"
    rules, rounds, made = [np.zeros((0, 2), np.uint32)], [], base
    active = np.flatnonzero(follow >= 0)
    while len(active) > 1:
        after = follow[active]
        place_bits, bits = np.uint64((len(active) - 1).bit_length()), np.uint64(made.bit_length())
        code = symbol[active].astype(np.uint64) << bits | symbol[after]
        if 2 * int(bits) + int(place_bits) <= 64:
            # pair and place in one number: sorting plain numbers is several times faster than sorting places
            code = code << place_bits | np.arange(len(active), dtype=np.uint64)
            code.sort()
            place = code & np.uint64((1 << int(place_bits)) - 1)
            code >>= place_bits
        else:  # the shard of a very long text
            place = np.argsort(code, kind="stable").astype(np.uint64)
            code = code[place]
        head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        count = np.diff(head, append=len(code))
        often = count >= least
        count, pair = count[often], code[head[often]]
        if not len(pair):
            break
        places = place[np.repeat(often, np.diff(head, append=len(code)))]
        back = places << np.uint64(32) | np.repeat(np.arange(len(pair), dtype=np.uint64), count)
        back.sort()
        which, at = (back & np.uint64(0xFFFFFFFF)).astype(np.int64), (back >> np.uint64(32)).astype(np.int64)
        active, after = active[at], after[at]
        left, right = pair >> bits, pair & np.uint64((1 << int(bits)) - 1)
        twin = np.flatnonzero((left == right)[which])
        fresh = np.concatenate(([True], after[twin[:-1]] != active[twin[1:]])) if len(twin) else np.zeros(0, bool)
        run = np.arange(len(twin))
        second = twin[(run - np.maximum.accumulate(np.where(fresh, run, 0))) % 2 == 1]
        count = count - np.bincount(which[second], minlength=len(pair))
        rank = np.empty(len(pair), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(pair) + 1)
        rank[count < least] = 0
        mine = rank[which]
        mine[second] = 0
        rank_at[active] = mine
        chosen = np.flatnonzero((mine > rank_at[before[active]]) & (mine > rank_at[after]))
        rank_at[active] = 0
        used = np.bincount(which[chosen], minlength=len(pair)) >= least
        chosen = chosen[used[which[chosen]]]
        rules.append(np.stack((left[used], right[used]), 1).astype(np.uint32))
        rounds.append(int(used.sum()))
        at, gone = active[chosen], after[chosen]
        symbol[at] = (made - 1 + np.cumsum(used))[which[chosen]]
        made += rounds[-1]
        live[gone], follow[at] = False, follow[gone]
        inner = follow[at] >= 0
        before[follow[at][inner]] = at[inner]
        again = np.zeros(n + 1, bool)
        again[active[rank[which] > 0]] = True
        again[at] = again[before[at]] = True
        again[gone] = again[-1] = False
        active = np.flatnonzero(again)
        active = active[follow[active] >= 0]
    return symbol[live], np.concatenate(([0], np.cumsum(live)))[ends], np.concatenate(rules), np.array(rounds, np.int64), base


def planes(values: np.ndarray) -> bytes:
    """32-bit values, a plane for each of their bytes: that packs well."""
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def pack(doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of a shard."""
    seq, cuts, rules, rounds, base = compress(ids, ends)
    lengths = expansion_lengths(rules, rounds, base)[base:]
    head = struct.pack(HEADER, MAGIC, base, len(doc_ids), len(ids), len(seq), len(rules), len(rounds))
    return b"".join((head, doc_ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), cuts.astype("<i8").tobytes(), rounds.astype("<i8").tobytes(), planes(rules), planes(lengths), planes(seq)))


def expansion_lengths(rules: np.ndarray, rounds: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol stands for, plain ids first; rules of a round are made of older symbols."""
    sizes = np.ones(base + len(rules), np.int64)
    ends = np.cumsum(rounds)
    for a, b in zip((ends - rounds).tolist(), ends.tolist(), strict=True):
        sizes[base + a : base + b] = sizes[rules[a:b]].sum(axis=1)
    return sizes


class Shard:
    """A shard's bytes, opened for random access."""

    def __init__(self, data: bytes):
        magic, self.base, docs, self.n_ids, n_seq, n_rules, n_rounds = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("no token-id shard")
        at = struct.calcsize(HEADER)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def take_planes(n: int) -> np.ndarray:
            return np.ascontiguousarray(take("u1", 4 * n).reshape(4, -1).T).view("<u4").ravel()

        self.doc_ids, self.ends, self.cuts, rounds = take("<i8", docs), take("<i8", docs), take("<i8", docs), take("<i8", n_rounds)
        self.rules, self.lengths = take_planes(2 * n_rules).reshape(-1, 2), take_planes(n_rules).astype(np.int64)
        self.seq = take_planes(n_seq).astype(np.int64)
        # every symbol's ids in one array, round by round: plain ids stand for themselves
        self.sizes = np.concatenate((np.ones(self.base, np.int64), self.lengths))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.expanded = np.empty(int(self.sizes.sum()), np.uint32)
        self.expanded[: self.base] = np.arange(self.base)
        done, filled = 0, self.base
        for n in rounds.tolist():
            part = spread(self.expanded, self.sizes, self.starts, self.rules[done : done + n].ravel())
            self.expanded[filled : filled + len(part)] = part
            done, filled = done + n, filled + len(part)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids of symbols of the sequence."""
        return spread(self.expanded, self.sizes, self.starts, seq)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.expand(self.seq[self.cuts[k - 1] if k else 0 : self.cuts[k]])

    def id_range(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: whole symbols are skipped by their expansion lengths."""
        ends = np.cumsum(self.sizes[self.seq])
        i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
        skipped = int(ends[i - 1]) if i else 0
        return self.expand(self.seq[i:j])[start - skipped : end - skipped]


def write_token_files(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None, end_id: int = 1) -> None:
    """Writes the ids of all texts, in ascending doc_id order, as shards below ``path``.

    Null texts count as empty; each document gets ``end_id`` at its end.  Null
    doc_ids come first; rows that share a doc_id are ordered by a hash of their
    texts, so that they are dealt to as many tasks as others; equal rows are dealt
    by the partition they come from.  Texts of any length stay in one shard; an
    empty table gives no shard.  Other columns of ``df``, whatever their names,
    are left out.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "hash", "origin"]
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("origin", F.spark_partition_id())
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, encoder = TaskContext.get().partitionId(), 0, word_ids(vocab)
        docs: list[int] = []
        ids: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, ids, total, made
            ends = np.cumsum([len(x) for x in ids])
            data = pack(np.array(docs, np.int64), np.concatenate(ids), ends)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([made], pa.int32()), "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([total], pa.int64()), "data": pa.array([data], pa.binary())})
            docs, ids, total, made = [], [], 0, made + 1
            return out

        for batch in batches:
            _, offsets = string_bytes(batch["text"])
            for i, j in slices(offsets, SLICE):
                for d, found in zip(batch["doc_id"][i:j].to_pylist(), encoder.encode_batch(batch["text"][i:j].to_pylist()), strict=True):
                    docs.append(NULL_ID if d is None else d)
                    ids.append(np.append(found, np.uint32(end_id)))
                    total += len(found) + 1
                    if total >= SHARD_IDS:
                        yield flush()
        if docs:
            yield flush()

    ordered.select("doc_id", "text").mapInArrow(shards, SHARDS).write.option("compression", "zstd").parquet(path)


#: Stands for a null doc_id inside a shard.
NULL_ID = -(2**63)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the shards: part, shard, doc_id, start_in_shard, n_tokens, ids (little-endian unsigned 32-bit)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch["data"][row].as_py())
                ids, n = shard.expand(shard.seq), len(shard.doc_ids)
                starts = np.concatenate(([0], shard.ends[:-1])).astype(np.int64) if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([batch["part"][row].as_py()] * n, pa.int32()),
                        "shard": pa.array([batch["shard"][row].as_py()] * n, pa.int32()),
                        "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NULL_ID),
                        "start_in_shard": pa.array(starts),
                        "n_tokens": pa.array(shard.ends - starts),
                        "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, shard.ends, strict=True)], pa.binary()),
                    }
                )

    return spark.read.schema(SHARDS).parquet(path).mapInArrow(documents, TOKENS)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """How many ids come before each shard: sums over parts first, so that no task gets every shard."""
    shards = spark.read.schema(SHARDS).parquet(path).select("part", "shard", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return shards.withColumn("inside", inside).join(parts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("before"))


def op8(documents: DataFrame, path: str | None = None, vocab: str | None = None) -> DataFrame:
    """Contract columns, all read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/tokens"
    write_token_files(documents, path, vocab=vocab)
    docs = read_token_files(spark, path).select("part", "shard", "doc_id", "start_in_shard", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(shard_starts(spark, path), ["part", "shard"]).select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
