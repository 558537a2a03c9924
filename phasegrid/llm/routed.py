"""Hashes of documents on their way to buckets and back, packed in binary rows.

A row holds what one slice of documents sends to one bucket: the owners (ids of
documents) with how many entries each has, and the entries as byte planes.  A
billion entries are thus some million rows, and ids that ascend cost little.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from phasegrid.llm.hashing import mix

PACKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("owners", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("entries", T.BinaryType())])

ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("entries", pa.binary())])


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of 64-bit values, byte by byte across all values."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int = 8) -> np.ndarray:
    """The values that ``planes`` wrote, unsigned."""
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


def packed(bucket: np.ndarray, owner: np.ndarray, lanes: list[np.ndarray], kind: int, width: int = 8) -> Iterator[pa.RecordBatch]:
    """Rows of the entries (one or more 64-bit lanes each), by bucket; an owner's entries should lie together."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bucket, owner, lanes = bucket[order], owner[order], [x[order] for x in lanes]
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
    rows: dict[str, list] = {"bucket": [], "kind": [], "owners": [], "counts": [], "entries": []}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = owner[a:b]
        first = np.concatenate(([0], np.flatnonzero(mine[1:] != mine[:-1]) + 1))
        rows["bucket"].append(int(bucket[a]))
        rows["kind"].append(kind)
        rows["owners"].append(planes(np.diff(mine[first], prepend=0)))
        rows["counts"].append(planes(np.diff(first, append=b - a)))
        rows["entries"].append(b"".join(planes(x[a:b], width) for x in lanes))
    if rows["bucket"]:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int32()), "kind": pa.array(rows["kind"], pa.int32())} | {k: pa.array(rows[k], pa.binary()) for k in ("owners", "counts", "entries")})


def unpacked(table: pa.Table, kind: int, lanes: int = 1, width: int = 8) -> tuple[np.ndarray, list[np.ndarray]]:
    """(owner of each entry, lanes) of the rows of a kind."""
    owners, entries = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(lanes)]
    kinds = table["kind"].to_numpy()
    for i in np.flatnonzero(kinds == kind).tolist():
        ids = np.cumsum(from_planes(table["owners"][i].as_py()).view(np.int64))
        owners.append(np.repeat(ids, from_planes(table["counts"][i].as_py()).view(np.int64)))
        data = table["entries"][i].as_py()
        size = len(data) // lanes
        for k in range(lanes):
            entries[k].append(from_planes(data[k * size : (k + 1) * size], width))
    return np.concatenate(owners), [np.concatenate(x) for x in entries]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Kinds from here on are answers that a sender knew by itself, for the name of that number.
KNOWN = 8


def part_of(owner: np.ndarray, buckets: int) -> np.ndarray:
    """The part that an owner's answers go to."""
    return bucket_of(mix(owner.astype(np.uint64)), buckets)


def grouped(owner: np.ndarray, lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by lanes, then owner; start of each group of equal lanes; its size)."""
    order = np.lexsort((owner, *lanes[::-1]))
    fresh = np.zeros(len(order), bool)
    for lane in lanes:
        x = lane[order]
        fresh[1:] |= x[1:] != x[:-1]
    fresh[:1] = True
    head = np.flatnonzero(fresh)
    return order, head, np.diff(head, append=len(order))


def once(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the distinct (owner, value) pairs, in order of owner."""
    order = np.lexsort((value, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (value[order][1:] != value[order][:-1])
    return order[fresh]


def known(owner: np.ndarray, value: np.ndarray, name: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of answers that a sender knows already."""
    at = once(owner, value)
    return packed(part_of(owner[at], buckets), owner[at], [value[at]], KNOWN + name)


def combined(owner: np.ndarray, lanes: list[np.ndarray], answer: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of entries that look for an equal: of equal ones in a slice one is sent, and all get ``answer`` (name 0).

    A passage that a great many documents share so sends one entry a slice.
    """
    order, head, n = grouped(owner, lanes)
    sent = np.sort(order[head])
    yield from packed(bucket_of(lanes[0][sent], buckets), owner[sent], [x[sent] for x in lanes], 0)
    again = order[np.repeat(n > 1, n)]
    yield from known(owner[again], answer[again], 0, buckets)


def resolved(sent: DataFrame, resolve: Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray]]], names: list[str], buckets: int) -> DataFrame:
    """(owner, a list of bigint for each name): what the buckets answer to each owner.

    ``resolve`` gets a bucket's rows and returns (owner, value) arrays for each name.
    Answers travel packed as well, to parts that owners are dealt to by hash, and
    become one row for each owner there.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = []
        for kind, (owner, value) in enumerate(resolve(table)):
            before, (said,) = unpacked(table, KNOWN + kind)
            owner, value = np.concatenate((owner, before)), np.concatenate((value, said))
            order = np.argsort(owner, kind="stable")
            rows += packed(part_of(owner[order], buckets), owner[order], [value[order]], kind)
        return pa.Table.from_batches(rows, ARROW)

    def gathered(table: pa.Table) -> pa.Table:
        answers = [unpacked(table, kind) for kind in range(len(names))]
        owners = np.unique(np.concatenate([a[0] for a in answers]))
        columns = {"owner": pa.array(owners, pa.int64())}
        for name, (owner, (value,)) in zip(names, answers, strict=True):
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], owners, "right")
            columns[name] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(value[order].view(np.int64), pa.int64()))
        return pa.table(columns)

    schema = "owner bigint, " + ", ".join(f"{n} array<bigint>" for n in names)
    return sent.groupBy("bucket").applyInArrow(answer, PACKED).groupBy("bucket").applyInArrow(gathered, schema)


def bucket_count(df: DataFrame) -> int:
    """A bucket for each shuffle partition: answers make a row for each bucket and part, which more buckets would square."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
