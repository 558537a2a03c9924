"""Product codes of vectors by Lloyd's rounds that look at active entries only.

A vector is cut into parts, and each part gets the nearest entry of its position's
codebook.  Between rounds a table holds each vector with its codes and their exact
squared distances.  A part whose entry stayed where it was compares only entries that
moved against its stored distance; the rest rescan the whole codebook.  All is whole
numbers, so the codes are those of full rescans, ties going to the lower index.

A round is one pass over that table: tasks write the new codes and, in a row of their
own, the sums of what they assigned, which the next codebooks are made of.  Codebooks
(parts x entries x numbers, whatever the input) are all the driver sees.  A table is
deleted once the next one is committed; lost tasks read the table before again.

Vectors that are null, or hold a component that is null, not finite, or 8,192 and more
in size (squared distances would leave 64 bits), or whose length is not that of the
kept vector with the smallest vec_id, are dropped; lengths that the parts don't divide
too.  vec_ids may be null (they come last) or repeat (equal ids by their vectors).
Fewer vectors than entries make smaller codebooks; empty tables give no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from phasegrid.llm.common import deleted, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of this size and above are left out.
LIMIT = 8192.0
#: Parts that the vectors of a label are dealt to where they meet its sum.
SALTS = 32


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, embedding) of the vectors that are coded."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.select("vec_id", label, "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & sound)


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) as whole numbers."""
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries."""
    apart = x[:, None, :] - entries[None, :, :]
    return np.einsum("nkd,nkd->nk", apart, apart)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, the lower index of equal ones."""
    found = distances(x, entries)
    best = found.argmin(1)
    return best, found[np.arange(len(x)), best]


def reassigned(x: np.ndarray, codes: np.ndarray, dists: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codes and distances of one part position, from the codes before ``moved`` entries moved."""
    codes, dists = codes.copy(), dists.copy()
    again = moved[codes]
    active = np.flatnonzero(moved)
    if len(active):
        held = np.flatnonzero(~again)
        k, d = nearest(x[held], entries[active])
        k = active[k]
        better = (d < dists[held]) | ((d == dists[held]) & (k < codes[held]))
        codes[held[better]], dists[held[better]] = k[better], d[better]
        codes[again], dists[again] = nearest(x[again], entries)
    return codes, dists


def _bytes(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    """The matrix of a binary column whose values are of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _components(column: pa.Array, dim: int) -> np.ndarray:
    """Whole numbers of vectors, stored in two or four bytes each."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.empty((len(column), dim), np.int64)
    for width, dtype in ((2, "<i2"), (4, "<i4")):
        at = np.flatnonzero(sizes == width * dim)
        if len(at):
            out[at] = _rows(column.take(pa.array(at)), dtype)
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in two bytes where all fit, else in four."""
    return x.astype("<i2" if not x.size or max(x.max(), -x.min() - 1) < 1 << 15 else "<i4")


def _schema(kept: DataFrame) -> StructType:
    binary = [StructField(n, BinaryType()) for n in ("components", "codes", "dists")]
    carried = [StructField(n, kept.schema[n].dataType) for n in ("vec_id", "label")]
    return StructType([*carried, *binary, StructField("error", LongType()), StructField("sums", ArrayType(LongType()))])


def _assigned(df: DataFrame, schema: StructType, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """A pass: ``df`` with codes for these codebooks; each task adds a row of its sums.

    ``df`` is raw (embedding) if ``moved`` is None, else the table of the pass before.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        types = None
        for batch in batches:
            types = batch.schema
            n = batch.num_rows
            if not n:
                continue
            raw = moved is None
            flat = quantised(batch.column("embedding").flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) if raw else _components(batch.column("components"), parts * width)
            x = flat.reshape(n, parts, width)
            codes, dists = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
            if not raw:
                codes[:], dists[:] = _rows(batch.column("codes"), "u1"), _rows(batch.column("dists"), "<i8")
            for p in range(parts):
                mine = np.ascontiguousarray(x[:, p])
                codes[:, p], dists[:, p] = nearest(mine, books[p]) if raw else reassigned(mine, codes[:, p], dists[:, p], books[p], moved[p])
                chosen = np.zeros((entries, n), np.int64)
                chosen[codes[:, p], np.arange(n)] = 1
                sums[p, :, :width] += chosen @ mine
                sums[p, :, width] += chosen.sum(1)
            columns = [batch.column("vec_id"), batch.column("label"), _bytes(_narrow(flat)), _bytes(codes.astype("u1")), _bytes(dists.astype("<i8")), pa.array(dists.sum(1)), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        if types is not None and sums[:, :, width].any():
            empty = [pa.nulls(1, types.field(c).type) for c in ("vec_id", "label")] + [pa.nulls(1, pa.binary())] * 3 + [pa.nulls(1, pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _first_entries(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks at the start (parts, entries, numbers): the parts of the vectors with the smallest ids; none without vectors."""
    order = (F.asc_nulls_last("vec_id"), F.col("embedding"))
    first = kept.orderBy(*order).select("embedding").limit(entries).collect()
    if not first:
        return None
    return np.stack([quantised(np.array(r["embedding"])) for r in first]).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def _updated(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floors of means; entries that nothing was assigned to stay."""
    sums = table.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
    for r in sums:
        flat[r["at"]] = r["s"]
    totals = flat.reshape(books.shape[0], books.shape[1], -1)
    counts = totals[:, :, -1:]
    return np.where(counts > 0, totals[:, :, :-1] // np.maximum(counts, 1), books)


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes, dists, error), codebooks) after ``rounds`` rounds and a last assignment."""
    spark = vectors.sparkSession
    kept = usable(vectors, parts)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).limit(1).collect()
    if first:
        kept = kept.filter(F.size("embedding") == first[0]["n"])
    books = _first_entries(kept, parts, entries)
    schema = _schema(kept)
    if books is None:
        return spark.createDataFrame([], schema).drop("components", "sums"), np.zeros((parts, 0, 0), np.int64)
    path = _stored(spark, _assigned(kept, schema, books, None))
    for _ in range(rounds):
        table = spark.read.schema(schema).parquet(path)
        new = _updated(table, books)
        moved = (new != books).any(2)
        books = new
        if not moved.any():  # every further round would find the same
            break
        path, before = _stored(spark, _assigned(table.filter("sums IS NULL").drop("sums", "error"), schema, books, moved)), path
        deleted(spark, before)
    return spark.read.schema(schema).parquet(path).filter("sums IS NULL").drop("components", "sums"), books


def _stored(spark: SparkSession, df: DataFrame) -> str:
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return path


def op12(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    found, books = coded(vectors)
    said = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of_label"), "label_error", salt.alias("of_salt"))
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    rows = dealt.join(sums, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt")))
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(said).alias("codebooks_sha256"))
