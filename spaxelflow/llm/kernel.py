"""Numpy kernels over whole Arrow text columns, and small Spark helpers shared by the operators.

Texts are read as UTF-8 bytes without a Python object per text; words are spans of bytes and carry
64-bit hashes. A slice holds whole texts and about SLICE_BYTES, so memory does not follow partition size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte that belongs to a word; `excluded` lists closed ranges of separators."""
    out = np.ones(256, dtype=bool)
    for low, high in excluded:
        out[low : high + 1] = False
    return out


WHITESPACE_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * _M2
    x = x ^ (x >> U64(27))
    x = x * _M3
    return x ^ (x >> U64(31))


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair (a, b)."""
    return mix(a * _M1 + b + U64(0x632BE59BD9B4E019))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Record batches cut at row borders to about `limit` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Words:
    """Word spans of a text column: starts, ends (bytes), first (index of each text's first word, and the total)."""

    def __init__(self, column: pa.Array, member: np.ndarray, lower: bool):
        data, self.offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        inside = member[self.data]
        n = len(inside)
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < n]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def before_text_end(self, width: int) -> np.ndarray:
        """True at each word that starts `width` words of its own text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return left >= width


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a step."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(U64) * _M1 + (lanes[starts] & _LOW_BYTES[np.minimum(length, 8)]))
    live, at = np.flatnonzero(length > 8), 8
    while len(live):
        rest = np.minimum(length[live] - at, 8)
        out[live] = join2(out[live], lanes[starts[live] + at] & _LOW_BYTES[rest])
        at += 8
        live = live[length[live] > at]
    return out


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of `width` consecutive values at each position; the last width - 1 positions hold no meaning."""
    n = len(h)
    out, done, power, size = None, 0, h, 1
    while size <= width:
        if width & size:
            if out is None:
                out = power
            else:
                shifted = np.zeros(n, U64)
                shifted[: max(n - done, 0)] = power[done:]
                out = join2(out, shifted)
            done += size
        shifted = np.zeros(n, U64)
        shifted[: max(n - size, 0)] = power[size:]
        power, size = join2(power, shifted), size * 2
    return out


def least_gram(h: np.ndarray, width: int, gram: int = 5) -> np.ndarray:
    """The least hash of `gram` consecutive values inside each window of `width`: equal windows share it, and windows
    next to each other mostly do."""
    out, size, span = window_hash(h, gram), 1, width - gram + 1
    while 2 * size <= span:
        out[: len(out) - size] = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = span - size
    if rest:
        out = np.concatenate([np.minimum(out[: len(out) - rest], out[rest:]), out[len(out) - rest :]])
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + count)."""
    total = int(counts.sum())
    skip = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - skip + np.repeat(starts, counts)


def by_bucket(key: np.ndarray, buckets: int, *columns: np.ndarray):
    """Yields (bucket, the columns' rows in it); the bucket comes from the key's upper half."""
    which = ((key >> U64(32)) % U64(buckets)).astype(np.int32)
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), [c[bounds[b] : bounds[b + 1]] for c in columns]


def gathered(table, name: str, dtype) -> np.ndarray:
    """The packed arrays of a binary column, one after another."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def kept_columns(df, keep: list[str] | None, own: list[str], text: str = "text") -> list[str]:
    """The input columns that a result keeps beside its `own`: `keep`, or all but `text` and those named like one of `own`.
    Such a name in `keep` is a ValueError. Names compare without case."""
    if keep is None:
        return [c for c in df.columns if c.lower() not in {text, *own}]
    clash = sorted(c for c in keep if c.lower() in own)
    if clash:
        raise ValueError(f"kept columns named like results: {clash}")
    return list(keep)


def partitions_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir. Where it is unset, only a local master (tests) gets a folder
    of its own; on a cluster that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)


def checkpoint(df):
    """Writes df to the shared checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df):
    """Writes df as a table in the shared checkpoint folder and reads it again: lineage is cut, and later reads take only
    the columns that they need."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class KeyFilter:
    """A Bloom filter of 64-bit keys: `has` may say yes wrongly, never no wrongly.

    Its size is bounded by CAP_BITS whatever the number of keys, so it can be broadcast; beyond that size it
    only lets more through, and what follows stays exact.
    """

    CAP_BITS = 1 << 28
    SEEDS = tuple(mix(np.arange(1, 5, dtype=U64)))

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size_for(n: int) -> int:
        size = 1 << 16
        while size < 12 * n and size < KeyFilter.CAP_BITS:
            size *= 2
        return size

    @staticmethod
    def places(keys: np.ndarray, size: int):
        for seed in KeyFilter.SEEDS:
            yield mix(keys ^ seed) & U64(size - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for p in self.places(keys, len(self.bits) * 8):
            out &= ((self.bits[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1).astype(bool)
        return out

    @staticmethod
    def build(df, column: str, n: int) -> "KeyFilter":
        """From a long column of df; each task sends its own bits, one segment a row, and segments meet by `or`."""
        size, segment = KeyFilter.size_for(n), 1 << 15

        def bits_of(batches):
            own = np.zeros(size // 8, np.uint8)
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                for p in KeyFilter.places(keys, size):
                    np.bitwise_or.at(own, (p >> U64(3)).astype(np.int64), (1 << (p & U64(7))).astype(np.uint8))
            parts = own.reshape(-1, min(segment, len(own)))
            used = np.flatnonzero(parts.any(axis=1))
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["segment", "bits"])

        def merge(batches):
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = np.frombuffer(b, np.uint8)
                    seen[k] = seen[k] | part if k in seen else part
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([v.tobytes() for v in seen.values()], pa.binary())], ["segment", "bits"])

        schema = "segment int, bits binary"
        rows = df.select(column).mapInArrow(bits_of, schema).repartition(12, "segment").mapInArrow(merge, schema).collect()
        bits = np.zeros(size // 8, np.uint8)
        step = min(segment, len(bits))
        for k, b in rows:
            bits[k * step : (k + 1) * step] = np.frombuffer(b, np.uint8)
        return KeyFilter(bits)


def key_filter(df, column: str):
    """The broadcast KeyFilter of a column of df (null as 0)."""
    from pyspark.sql import functions as F

    keys = df.select(F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("key"))
    return df.sparkSession.sparkContext.broadcast(KeyFilter.build(keys, "key", keys.count()))


def key_filter_column(df, column: str, shared=None):
    """A boolean column over `column`: True for every value of df (null as 0), and seldom for another one. `shared`: the
    filter, if it is there already."""
    from pyspark.sql import functions as F

    shared = shared or key_filter(df, column)

    @F.pandas_udf("boolean")
    def has(values: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(values.to_numpy(np.int64).view(U64)))

    return has(F.coalesce(F.col(column).cast("long"), F.lit(0)))
