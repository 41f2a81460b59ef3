"""What the corpus operators share: text kernels over Arrow buffers, cut points, skew-safe joins and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Documents are taken in blocks of about this many bytes, so that a task's memory does not follow its batch.
BLOCK_BYTES = 500_000
#: A worker keeps so many powers of either base from one task to the next (8 MB each).
HELD_POWERS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64; up to HELD_POWERS of them are kept for later calls."""
    key, base = ("inverse", _INVERSE) if inverse else ("base", _BASE)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, min(1 << 16 if have is None else 2 * len(have), HELD_POWERS)), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64, out=have)
        if len(have) <= HELD_POWERS:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; ``span_hash`` reads any substring's hash from them."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal substrings wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets from 0) of runs of rows; null is empty. No row is split."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        to = min(to, n)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def lowered_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``text_blocks``, with the text of each block in lower case; no more than a block is copied at a time."""
    for at, to, _, _ in text_blocks(column, size):
        for _, _, data, offs in text_blocks(pc.utf8_lower(column.slice(at, to - at)), 1 << 62):
            yield at, to, data, offs


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and one more) of the maximal runs of non-separators within rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~separator[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.ones(n, dtype=bool)
    before[1:] = ~word[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(data), starts, ends)) if len(starts) else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words within a row; a row of fewer words, but not none, gives its whole sequence."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= size:
        at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
        acc = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + words[at + k]
        out, rows = mix(acc), row[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        acc = counts[short].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        for k in range(size - 1):
            has = counts[short] > k
            acc[has] = acc[has] * np.uint64(0xC2B2AE3D27D4EB4F) + words[first[short[has]] + k]
        out, rows = np.concatenate([out, mix(acc + np.uint64(0x27D4EB2F165667C5))]), np.concatenate([rows, short])
    return out, rows


def released(run):
    """A batch function that gives the memory it no longer needs back to the system at its end; idle workers keep little."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)

    return wrapped


def in_slices(batch: pa.RecordBatch, text: int, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of its text column each, so that what is made of them stays small."""
    for at, to, _, _ in text_blocks(batch.column(text), size):
        yield batch.slice(at, to - at)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name_2`` and so on where ``df`` has a column of that name already."""
    taken, out, n = {c.lower() for c in df.columns}, name, 1
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoints(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set (tests on one machine)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="inkwell-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def cut(df: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; it survives the loss of executors.

    The rows are counted on the way, and go on in about one task for each ``rows_per_task``, so small tables need few tasks.  Spark
    moves filters, semi and anti joins below a coalesce, where a task would run many of them at once and hold the memory of all
    (or begin a Python evaluation for each partition); a condition that it may not move, always true, keeps them above."""
    ensure_checkpoints(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(True)
    return out.coalesce(int(seen.get["rows"]) // rows_per_task + 1).where(F.monotonically_increasing_id() >= 0)


def written(df: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """As ``cut``, by Parquet files below the checkpoint folder: once for each turn of a loop of joins.

    The estimated size of a checkpoint is still that of its plan, a product over all joins before it: from round to round its digits
    multiply until the driver's memory is full.  That of files is their own.  A task may read a part of what one task wrote."""
    place, seen = f"{ensure_checkpoints(df.sparkSession)}/round-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    return out.coalesce(int(seen.get["rows"]) // rows_per_task + 1).where(F.monotonically_increasing_id() >= 0)


def skew_join(big: DataFrame, small: DataFrame, key: str, weight: str, hot_rows: int = 20_000, most_hot: int = 2_000, how: str = "inner") -> DataFrame:
    """Equi join where ``small`` has one row for each key and, in ``weight``, how many rows of ``big`` hold the key.

    Keys of at least ``max(hot_rows, total / most_hot)`` rows number ``most_hot`` at most, whatever the input, so they are
    broadcast and their rows stay where they are; all other keys are shuffled.  ``weight`` is dropped."""
    total, most = small.agg(F.sum(weight), F.max(weight)).first()
    least = max(hot_rows, (total or 0) // most_hot)
    if (most or 0) < least:
        return big.join(small.drop(weight).hint("shuffle_hash"), key, how)
    hot, cold = small.where(F.col(weight) >= least).drop(weight), small.where(F.col(weight) < least).drop(weight)
    mark = F.broadcast(hot.select(key))
    return big.join(F.broadcast(hot), key).unionByName(big.join(mark, key, "left_anti").join(cold.hint("shuffle_hash"), key, how))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(id, component) of every id in an edge; component is the smallest id that can be reached.

    Alternating large-star and small-star steps: each node's neighbours are joined to its smallest one, so that after a
    number of rounds that grows with the logarithm of the size only stars are left.  Minima come from partial aggregates, and
    the sort-merge joins that bring them back are those that adaptive execution splits where one node has most edges.  What is
    joined or aggregated stays in the shuffle's partitions: a task of many would hold the memory of all until its end.  The driver
    sees a count and a sum each round."""
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before, tasks = now, now[0] // 100_000 + 1  # small graphs need few tasks
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        edges = cut(large.join(down.hint("merge"), "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct())
    else:
        raise RuntimeError("connected components did not settle")
    parts = edges.groupBy("u").agg(F.min("v").alias("component"))
    return parts.select(F.col("u").alias("id"), "component").union(parts.select(F.col("component").alias("id"), "component").distinct())


def maybe_in(ids: DataFrame, bits: int = 26) -> np.ndarray:
    """A Bloom filter of the ids in column ``id``: a bitmap of 2**bits bits (8 MB), whatever their number.

    It tells most rows apart before a join; where it is full it lets all pass, and the join decides as ever."""
    h = F.xxhash64("id")
    places = ids.select(F.explode(F.array(*[F.call_function("shiftrightunsigned", h, F.lit(64 - bits if k else 0)).bitwiseAND(F.lit((1 << bits) - 1)) for k in (0, 1)])).alias("p"))
    words = places.groupBy(F.call_function("shiftright", "p", F.lit(6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def passes(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the xxhash64 values may belong to the filter's ids."""
    bits = int(len(bitmap)).bit_length() - 1 + 6
    h, good = hashed.view(np.uint64), np.ones(len(hashed), dtype=bool)
    for shift in (0, 64 - bits):
        p = (h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        good &= (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return good


def likely_in(ids: DataFrame, key: Column) -> Column:
    """Whether a row's key may be among ``ids`` (id): false ones surely aren't, so they needn't be shuffled to a join with them."""
    held = ids.sparkSession.sparkContext.broadcast(maybe_in(ids))

    @F.pandas_udf("boolean")
    def test(hashed: pd.Series) -> pd.Series:
        return pd.Series(passes(held.value, hashed.to_numpy()))

    return test(F.xxhash64(key.cast("long")))


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``docs`` less the rows whose key is in ``gone`` (id); only rows that may be there are shuffled."""
    gone = cut(gone.select(F.col("id").cast("long").alias("id")).distinct())
    maybe, named = likely_in(gone, docs[key]), gone.withColumnRenamed("id", "__gone")
    near = docs.where(maybe)
    return docs.where(~maybe).unionByName(near.join(named.hint("shuffle_hash"), near[key] == F.col("__gone"), "left_anti"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows and more out of a partition sorted by ``key``; no group is parted between two of them."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield table.slice(0, last)
            table = table.slice(last).combine_chunks()
        held, count = table.to_batches(), table.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def fixed_binary(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``width`` bytes, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros((0, width), np.uint8)
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    start = np.frombuffer(off, np.int64)[column.offset]
    return np.frombuffer(data, np.uint8)[start : start + len(column) * width].reshape(len(column), width)


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(matrix)
    width = raw.shape[1] * raw.itemsize
    offs = np.arange(raw.shape[0] + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), raw.shape[0], [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw.tobytes())])


def narrow(values: np.ndarray) -> bytes:
    """Integers as bytes: 8 for the least, then 4 for each difference from it (or 8, where they don't fit)."""
    base = int(values.min()) if len(values) else 0
    fits = len(values) == 0 or int(values.max()) - base < 2**32
    return np.array([base], np.int64).tobytes() + (values - base).astype(np.uint32 if fits else np.int64).tobytes()


def widen(raw: bytes, count: int) -> np.ndarray:
    base, wide = np.frombuffer(raw, np.int64, 1)[0], len(raw) - 8 > 4 * count
    return np.frombuffer(raw, np.int64 if wide else np.uint32, count, 8).astype(np.int64) + base


def pack(keys: np.ndarray, buckets: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, n, one binary for each column): what stands under a key goes, as arrays, to the bucket of its hash.

    A shuffle of these moves a few large rows instead of many small ones.  int64 columns are narrowed."""
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(order))
    out = [pa.array(which.astype(np.int32)), pa.array((ends - first).astype(np.int32))]
    for values in columns.values():
        sorted_values = values[order]
        out.append(pa.array([narrow(sorted_values[a:b]) if values.dtype == np.int64 else np.ascontiguousarray(sorted_values[a:b]).tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", "n", *columns])


def packed_schema(*columns: str) -> str:
    return "bucket int, n int, " + ", ".join(f"{c} binary" for c in columns)


def by_bucket(packed: DataFrame) -> DataFrame:
    """Each bucket whole in one of as many partitions as a shuffle has, by its number; buckets in order."""
    parts = partitions(packed.sparkSession)
    return packed.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")


def unpack(batches: Iterator[pa.RecordBatch], **kinds) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(bucket, its columns as arrays) of a partition sorted by bucket."""

    def joined(rows: list[dict]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([widen(r[c], r["n"]) if kind == np.int64 else np.frombuffer(r[c], kind) for r in rows]) for c, kind in kinds.items()}

    at, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("bucket", "n", *kinds)}
            if held and row["bucket"] != at:
                yield at, joined(held)
                held = []
            at = row["bucket"]
            held.append(row)
    if held:
        yield at, joined(held)
