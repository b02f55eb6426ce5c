"""Helpers shared by the corpus operators: size-checked joins and vectorised tokenising."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, scratch  # noqa: F401 (the operators take them from here)

#: Ids that a broadcast semi-join may hold: 8 bytes each, so 4 MB of keys at most.
BROADCAST_IDS = 500_000

SPACE = r"[\x20\x09-\x0D]+"

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits a key of the map that leaves rows out before a shuffle, and the powers of two that it may have: a row of 16 bytes holds 64 bits when it is broadcast, so 16 MB at most.
MAP_SHARE, MAP_BITS = 16, (16, 26)


def _maybe(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """df plus _maybe: whether a bit map of the keys' hashes has the row's bit. False is certain, true is not. The map grows with the keys up to its bound, beyond which it leaves out less."""
    bits_ = 1 << min(max((keys.count() * MAP_SHARE).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    place = F.pmod(F.xxhash64(*names), F.lit(bits_))
    bits = keys.select(place.alias("_h")).groupBy(F.expr("shiftright(_h, 6)").alias("_w")).agg(F.expr("bit_or(shiftleft(1L, CAST(_h % 64 AS INT)))").alias("_b"))
    out = df.withColumn("_h", place).withColumn("_w", F.expr("shiftright(_h, 6)")).join(F.broadcast(bits), "_w", "left")
    return out.withColumn("_maybe", F.expr("coalesce(shiftright(_b, CAST(_h % 64 AS INT)) & 1, 0) = 1")).drop("_w", "_h", "_b")


def _met(df: DataFrame, side: DataFrame, names: list[str], how: str) -> DataFrame:
    """df joined with side (inner, left, left_semi or left_anti), where only rows that a bit map of side's keys can't leave out are shuffled."""
    marked = _maybe(df, side, names)
    met = marked.where("_maybe").drop("_maybe").join(side.hint("merge"), names, how)
    if how in ("inner", "left_semi"):
        return met
    return met.unionByName(marked.where("NOT _maybe").drop("_maybe"), allowMissingColumns=True)


def only(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is in ids (one column of the same name, distinct), or isn't (how: left_anti).

    Ids are broadcast only if they are counted and at most BROADCAST_IDS; beyond that the semi-join
    shuffles the rows that a bit map of the ids does not leave out. ids should be cheap to count (a
    written table).
    """
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), key, how)
    return _met(df, ids, [key], how).select(*df.columns)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of uint64."""
    x = x ^ (x >> _U(30))
    x = x * _MIX[0]
    x ^= x >> _U(27)
    x *= _MIX[1]
    x ^= x >> _U(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        step = _U(pow(base, k, 1 << 64))
        out[k : 2 * k] = out[: min(k, n - k)] * step
        k *= 2
    return out


_POW = powers(4096, _BYTE_BASE)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows that hold about `most` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are no ASCII white space) of rows that lie end to end in buf.

    Returns each word's start and end byte, its 64-bit hash, and for each row the index of its
    first word (n + 1 entries). Works in pieces that end at white space, so memory beyond the
    result stays bounded for very long texts too.
    """
    starts, ends, hashes = [], [], []
    heads = np.zeros(len(buf) + 1, bool)
    heads[offsets[:-1]] = True
    at, n = 0, len(buf)
    while at < n:
        to = min(at + most, n)
        while to < n and not (_IS_SPACE[buf[to]] or heads[to]):  # never inside a word
            gap = np.flatnonzero(_IS_SPACE[buf[to : to + most]] | heads[to : min(to + most, n)])
            to = to + int(gap[0]) if len(gap) else min(to + most, n)
        piece = buf[at:to]
        solid = ~_IS_SPACE[piece]
        first = solid.copy()
        first[1:] &= ~solid[:-1] | heads[at + 1 : to]
        s = np.flatnonzero(first)
        if len(s):
            stop = np.append(s[1:], len(piece))
            filled = np.concatenate(([0], np.cumsum(solid, dtype=np.int64)))
            e = s + filled[stop] - filled[s]
            position = np.arange(len(piece), dtype=np.int64) - np.repeat(np.append(0, s), np.diff(np.append(np.append(0, s), len(piece))))
            value = (piece.astype(np.uint64) + _U(1)) * _POW[position & 4095]
            if len(piece) > 256 and position.max() > 255:  # in long words sums of powers alone would have known collisions
                value = np.where(position > 255, mix(value + (position >> 12).astype(np.uint64) * _U(_WORD_BASE)), value)
            value[~solid] = 0
            h = np.add.reduceat(value, s)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(mix(h ^ ((e - s).astype(np.uint64) * _U(_WORD_BASE))))
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    starts = join(starts, np.int64)
    return starts, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hashes of all runs of k consecutive hashes, by doubling: len(h) - k + 1 of them."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    total = len(h) - k + 1
    out, done, run, size = np.zeros(total, np.uint64), 0, h, 1
    while True:
        if k & size:
            out = out * _U(pow(base, size, 1 << 64)) + run[done : done + total]
            done += size
        if size * 2 > k:
            return mix(out)
        run = run[:-size] * _U(pow(base, size, 1 << 64)) + run[size:]
        size *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries, len(h) - w + 1 of them."""
    run, size = h, 1
    while size * 2 <= w:
        run = np.minimum(run[:-size], run[size:])
        size *= 2
    return np.minimum(run[: len(h) - w + 1], run[w - size :]) if size < w else run[: len(h) - w + 1]


#: Bytes of rows that attach() may broadcast.
BROADCAST_BYTES = 32 << 20


def attach(df: DataFrame, side: DataFrame, keys: list[str], row_bytes, how: str = "left") -> DataFrame:
    """df joined with side (a written table, one row a key), which is broadcast only if its measured size allows it; see only() for what is shuffled else."""
    rows, size = side.agg(F.count("*"), F.sum(row_bytes)).first()
    if rows <= BROADCAST_IDS and (size or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(side), keys, how)
    return _met(df, side, keys, how)
