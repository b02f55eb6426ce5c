"""Operator 1, fuzzy line dedup by MinHash.

A line is lower-cased (ASCII) and stripped of white space at its ends; its set holds its
character shingles of SHINGLE code points. Equal lines are collapsed first (combined before the
shuffle, so a line that every document holds costs one row a task). The others are banded by
their signatures, candidates are verified on their exact sets, and the links' components are
found by distributed star contraction. Of each component, the occurrence with the smallest
(doc_id, line number) stays.

Signatures are one-permutation MinHashes (Li, Owen and Zhang, 2012): a shingle's hash chooses a
bin and competes there, and empty bins borrow from bins chosen by a hash of their own (optimal
densification, Shrivastava, 2017). That reads each shingle once instead of once a hash. Bands:
16 of 5 bins, each cut to 12 bits, so that a band's key is its number and its five bins. They
miss a pair of similarity 0.8 with probability 0.2 % (more for lines of ten shingles or so; the
tests measure it), one of 0.9 with 4e-7. Five bins rather than four cost more keys, but lines of
half that similarity, which texts of one subject have many of, share far fewer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, grams, mix, only, slices, text_buffer
from .linking import binary_matrix, dealt_to, link_groups, pruning_table

SHINGLE = 5
ROWS, BANDS = 5, 16
#: Bits of a bin; a band's bins and its number make one 64-bit key.
BITS = 12
HASHES = ROWS * BANDS
PERCENT = 80
#: Bins that a step of the sequential comparison reads.
BATCH = 20
#: Bytes worked on at once: arrays of 8 bytes a character then stay in a core's cache.
SLICE = 1 << 17
_EMPTY = np.uint32(0xFFFFFFFF)
#: Bins that an empty bin borrows from, in turn; then the next full one.
_DONORS = (mix(np.arange(HASHES * 24, dtype=np.uint64).reshape(24, HASHES) + np.uint64(9001)) % np.uint64(HASHES)).astype(np.int64)
#: Bytes of a line that is worth a record, for the number of tasks: shorter ones on average only make tasks hold more.
LINE_BYTES = 40
_ID = ["h1", "h2", "doc", "th", "ln"]


def _lines(raw: bytes) -> list[tuple[int, bytes]]:
    """Number and text of the lines that aren't blank, lower-cased (A-Z) and stripped."""
    return [(n, x) for n, x in ((n, x.strip(b" \t\n\r\x0b\x0c")) for n, x in enumerate(raw.lower().split(b"\n"))) if x]


def _digests(lines: list[bytes]) -> np.ndarray:
    """(lines, 2) int64: a 128-bit hash of each line."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)


def shingle_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every SHINGLE (4 and one) code points, for signatures.

    Code points are folded to bytes, those under 256 onto themselves, so that four are read at
    once. Shingles that fold alike compete as one; links are verified on the shingles themselves.
    """
    high = points >> np.uint32(8)
    b = (points ^ high * np.uint32(157) if high.any() else points).astype(np.uint8)
    if len(b) < SHINGLE:
        return np.empty(0, np.uint64)
    n = len(b) - SHINGLE + 1
    h = np.ndarray((n,), np.dtype("<u4"), b, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h += b[SHINGLE - 1 :].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _borrowed():
    """For each bin the one to borrow from, as often as it takes: chosen by hash at first, then the next ones in turn."""
    yield from _DONORS
    for step in range(1, HASHES):
        yield (np.arange(HASHES) + step) % HASHES


def signatures_of(points, starts, ends):
    """(lines, HASHES) uint16 of lines that lie end to end with one separator between; those without a shingle get anything."""
    g = shingle_hashes(points)
    cell = g >> np.uint64(32)
    cell *= np.uint64(HASHES)
    cell >>= np.uint64(32)
    cell += np.repeat(np.arange(len(starts), dtype=np.uint64) * np.uint64(HASHES), ends - starts + 1)[: len(g)]
    over = (ends[:, None] - np.arange(SHINGLE)[None, :]).reshape(-1)  # shingles that reach into the next line
    cell[over[(over >= 0) & (over < len(g))]] = len(starts) * HASHES
    out = np.full((len(starts) + 1) * HASHES, _EMPTY, np.uint32)
    np.minimum.at(out, cell.view(np.int64), g.astype(np.uint32) >> np.uint32(1))
    out = out[:-HASHES]
    empty = out == _EMPTY
    empty.reshape(-1, HASHES)[ends - starts < SHINGLE] = False  # they have nothing to borrow
    at = np.flatnonzero(empty)
    col = at % HASHES
    head = at - col
    filled = out.copy()
    for borrowed in _borrowed():
        if not len(at):
            break
        got = out[head + borrowed[col]]
        full = got != _EMPTY
        filled[at[full]] = got[full]
        left = np.flatnonzero(~full)
        at, col, head = at[left], col[left], head[left]
    return ((filled.reshape(-1, HASHES) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16)


_SHIFTS = np.arange(ROWS, dtype=np.uint64) * np.uint64(BITS)
_BAND = np.arange(BANDS, dtype=np.uint64) << np.uint64(BITS * ROWS)


def keys_of(sig: np.ndarray) -> np.ndarray:
    """(lines, BANDS) int64: a band's key is its bins, with the band's number in front."""
    bins = sig.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(_BAND, bins.shape[:2]).copy()
    for r in range(ROWS):
        key |= bins[:, :, r].astype(np.uint64) << _SHIFTS[r]
    return key.view(np.int64)


def _keys_in(col) -> np.ndarray:
    """(rows, BANDS) int64 of an Arrow column of keys as binaries."""
    return binary_matrix(col, np.int64).reshape(len(col), BANDS)


def matrix_of(col) -> np.ndarray:
    """(rows, HASHES) uint16 of an Arrow column of keys: keys_of the other way round."""
    keys = _keys_in(col).view(np.uint64).reshape(-1)
    out = np.empty((len(keys), ROWS), np.uint16)
    for r in range(ROWS):
        out[:, r] = (keys >> _SHIFTS[r]) & np.uint64((1 << BITS) - 1)
    return out.reshape(-1, HASHES)


def _found(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[tuple, tuple, list[bytes]]:
    """Row, number and text of the lines of rows lo to hi that aren't blank."""
    found = [(i, n, line) for i in range(lo, hi) for n, line in _lines(buf[offsets[i] : offsets[i + 1]].tobytes())]
    return tuple(zip(*found)) if found else ((), (), [])


def _occurrences(batches):
    """h1, h2, doc, th, ln of every line."""
    import pyarrow as pa

    for x in batches:
        buf, offsets = text_buffer(x.column(2))
        for lo, hi in slices(offsets, SLICE):
            row, number, lines = _found(buf, offsets, lo, hi)
            if lines:
                h, take = _digests(lines), pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), x.column(0).take(take), x.column(1).take(take), pa.array(number, pa.int32())], names=_ID)


#: A line on its way to the task that knows all its occurrences: hashes, first document and place in it, occurrences, characters, keys.
_RECORD = np.dtype([("h1", np.int64), ("h2", np.int64), ("doc", np.int64), ("at", np.int64), ("c", np.int64), ("size", np.int64), ("keys", np.int64, BANDS)])


def _place(number, th: np.ndarray) -> np.ndarray:
    """A line's number and its text's hash as one integer that sorts as the two do; _PLACE is the same in SQL."""
    return (np.asarray(number, np.int64) << 32) + (th.astype(np.int64) + (1 << 31))


_PLACE = "shiftleft(CAST(ln AS BIGINT), 32) + (CAST(th AS BIGINT) + 2147483648)"


def _combined(rows: np.ndarray) -> np.ndarray:
    """One record a line."""
    rows = rows[np.lexsort((rows["h2"], rows["h1"]))]
    first = np.flatnonzero(np.concatenate(([True], (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1]))))
    out = rows[first]
    if len(first) < len(rows):
        out["doc"], out["c"] = np.minimum.reduceat(rows["doc"], first), np.add.reduceat(rows["c"], first)
        own = rows["doc"] == np.repeat(out["doc"], np.diff(np.append(first, len(rows))))
        out["at"] = np.minimum.reduceat(np.where(own, rows["at"], np.iinfo(np.int64).max), first)
    return out


#: Lines that are combined before they are sent on. More would hold more memory, fewer make more rows to shuffle.
HELD = 1 << 14


def _signed(tasks: int):
    """Records of lines, combined HELD at a time, as one block for each task that they go to."""

    def sent(parts):
        import pyarrow as pa

        rows = _combined(np.concatenate(parts))
        pid = ((mix(rows["h1"].view(np.uint64)) >> np.uint64(32)) % np.uint64(tasks)).astype(np.int32)
        order = np.argsort(pid, kind="stable")
        rows, (to, start) = rows[order], np.unique(pid[order], return_index=True)
        blocks = [rows[a:b].tobytes() for a, b in zip(start, np.append(start[1:], len(rows)))]
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blocks, pa.binary())], names=["pid", "rows"])

    def run(batches):
        parts, held = [], 0
        for x in batches:
            buf, offsets = text_buffer(x.column(2))
            docs, th = np.asarray(x.column(0)), np.asarray(x.column(1))
            for lo, hi in slices(offsets, SLICE):
                row, number, lines = _found(buf, offsets, lo, hi)
                if not lines:
                    continue
                row = np.array(row)
                part = np.zeros(len(lines), _RECORD)
                h = _digests(lines)
                points = np.frombuffer(b"\n".join(lines).decode("utf-8").encode("utf-32-le"), np.uint32)
                ends = np.append(np.flatnonzero(points == 10), len(points))
                starts = np.append(0, ends[:-1] + 1)
                part["h1"], part["h2"], part["doc"], part["c"], part["size"] = h[:, 0], h[:, 1], docs[row], 1, ends - starts
                part["at"] = _place(number, th[row])
                part["keys"] = keys_of(signatures_of(points, starts, ends))
                parts.append(part)
                held += len(part)
                if held >= HELD:
                    yield sent(parts)
                    parts, held = [], 0
        if parts:
            yield sent(parts)

    return run


def _other_name(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(mix(h1.view(np.uint64)) + h2.view(np.uint64)).view(np.int64)


def _distinct(batches):
    """id, h1, h2, c, doc, at, size, keys (null for lines without a shingle) of the lines in a partition's blocks.

    A line's id is h1; of lines that share h1, which meet here, all but the first are named by both hashes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    blocks = [r for x in batches for r in x.column("rows").to_pylist()]
    if not blocks:
        return
    every = _combined(np.frombuffer(b"".join(blocks), _RECORD))
    del blocks
    twin = np.append(False, every["h1"][1:] == every["h1"][:-1])
    for lo in range(0, len(every), 1 << 14):
        rows = every[lo : lo + (1 << 14)]
        keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * BANDS), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows["keys"]).tobytes())]).cast(pa.binary())
        keys = pc.if_else(pa.array(rows["size"] < SHINGLE), pa.scalar(None, pa.binary()), keys)
        cols = [np.ascontiguousarray(rows[c]) for c in ("h1", "h2", "c", "doc", "at", "size")]
        named = cols[0].copy()
        again = twin[lo : lo + (1 << 14)]
        named[again] = _other_name(cols[0][again], cols[1][again])
        yield pa.RecordBatch.from_arrays([pa.array(named), *map(pa.array, cols), keys], names=["id", "h1", "h2", "c", "doc", "at", "size", "keys"])


_LINE = "h1 long, h2 long, doc long, th int, ln int"


def _stripped(text: str) -> list[str]:
    fold = {c: c + 32 for c in range(65, 91)}
    return [x.translate(fold).strip(" \t\n\r\x0b\x0c") for x in (text or "").split("\n")]


def character_shingles(line: str) -> frozenset:
    return frozenset(line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)) if len(line) >= SHINGLE else frozenset([line])


def _sets_in(every: np.ndarray, lines: list[str], short: Callable[[int, int], np.ndarray]) -> list[np.ndarray]:
    """Sorted distinct entries of each line's run in every, which has one for each shingle of the lines end to end with one separator between.

    The runs are sorted in place, and what comes twice is found for all of them at once. short: the set of a line without a run, from its start and end.
    """
    sizes = np.array([len(x) for x in lines], np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    long = sizes >= SHINGLE
    starts, ends = at[long], (at + sizes - SHINGLE + 1)[long]
    for a, b in zip(starts.tolist(), ends.tolist()):
        every[a:b].sort()
    keep = np.zeros(len(every) + 1, np.int8)
    keep[starts] = 1
    keep[ends] = -1
    keep = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
    new = np.append(True, every[1:] != every[:-1])[: len(every)]
    new[starts] = True
    keep &= new
    found, count = every[keep], np.append(0, np.cumsum(keep))
    runs = iter(zip(count[starts].tolist(), count[ends].tolist()))
    return [found[slice(*next(runs))] if n >= SHINGLE else short(a, a + n) for a, n in zip(at.tolist(), sizes.tolist())]


def numbered_sets(lines: list[str]) -> list[np.ndarray] | None:
    """Sorted distinct numbers of the lines' shingles, equal for equal shingles only; None for lines of over 4,096 characters apart.

    The characters of these lines are numbered from 1, so that a shingle's five numbers fit 60 bits
    and nothing rests on a hash. A line shorter than a shingle is one of its own.
    """
    points = np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32)
    at = points
    if len(points) and points.max() >= (1 << BITS) - 1:  # smaller ones are their own numbers
        known, at = np.unique(points, return_inverse=True)
        if len(known) >= 1 << BITS:
            return None
    code = at.astype(np.int64) + 1
    every = code[: max(len(code) - SHINGLE + 1, 0)].copy()
    for i in range(1, SHINGLE):
        every |= code[i : len(every) + i] << (BITS * i)
    return _sets_in(every, lines, lambda a, b: np.array([sum(int(c) << (BITS * i) for i, c in enumerate(code[a:b]))], np.int64))


def hashed_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the lines' shingles; all lines are hashed in one pass."""
    points = np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return _sets_in(grams(points, SHINGLE), lines, lambda a, b: grams(points[a:b], b - a))


def _texts(docs: DataFrame, distinct: DataFrame):
    """From ids to id and text (the line), read again from one of the documents that hold it."""

    def read(ids: DataFrame) -> DataFrame:
        at = cut(only(distinct.select("id", "h2", "doc"), ids, "id").groupBy("doc").agg(F.collect_list("id").alias("ids"), F.collect_list("h2").alias("h2s")))
        holders = attach(docs.select("doc", "text"), at, ["doc"], F.size("ids") * 16 + 40, "inner").select("doc", "text", "ids", "h2s")

        def pick(batches):
            import pyarrow as pa

            for x in batches:
                buf, offsets = text_buffer(x.column(1))
                for lo, hi in slices(offsets, SLICE):  # a document at a time would cost more than its lines
                    _, _, lines = _found(buf, offsets, lo, hi)
                    if not lines:
                        continue
                    h = _digests(lines)
                    ids, h2s = (np.asarray(x.column(c).slice(lo, hi - lo).flatten()) for c in (2, 3))
                    known = set(zip(ids.tolist(), h2s.tolist()))
                    hit = np.flatnonzero(np.isin(h[:, 1], h2s))
                    other = _other_name(np.ascontiguousarray(h[hit, 0]), np.ascontiguousarray(h[hit, 1]))
                    found = {name: n for n, a, b, c in zip(hit.tolist(), h[hit, 0].tolist(), h[hit, 1].tolist(), other.tolist()) for name in (a, c) if (name, b) in known}
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([lines[n].decode("utf-8") for n in found.values()], pa.string())], names=["id", "text"])

        return cut(holders.mapInArrow(pick, "id long, text string").dropDuplicates(["id"]))

    return read


#: Bytes that a line takes beside its characters, and a character with the sets made of it, where lines are compared.
WEIGHT = (1024, 24)


def line_groups(docs: DataFrame, text_bytes: int = 0) -> DataFrame:
    """h1, h2 (a line's hashes), first, place (document of its component's first occurrence, and where there, see _place) for lines that occur twice or are linked.

    docs: doc, th, text. text_bytes: how many their texts have, about.
    """
    tasks = dealt_to(docs.sparkSession, text_bytes * _RECORD.itemsize // LINE_BYTES)
    blocks = docs.select("doc", "th", "text").mapInArrow(_signed(tasks), "pid int, rows binary").repartitionById(tasks, F.col("pid"))
    distinct = cut(blocks.mapInArrow(_distinct, "id long, h1 long, h2 long, c long, doc long, at long, size long, keys binary"), free=True, plain=True)
    known = distinct.select("id", "h1", "h2", "c", "doc", "at")
    signatures = distinct.where("keys IS NOT NULL").select("id", F.col("keys").alias("sig"), (F.lit(WEIGHT[0]) + F.col("size") * WEIGHT[1]).alias("w"))
    found = link_groups(signatures, _keys_in, _texts(docs, known), character_shingles, hashed_sets, PERCENT, pruning_table(HASHES, BATCH, PERCENT / 100, 1e-5), BATCH, distinct.count(), BANDS, matrix_of, screen=numbered_sets)
    lines = cut(attach(known, found, ["id"], F.lit(16)).where("c > 1 OR root IS NOT NULL").select("h1", "h2", "root", "doc", "at"))
    # written first, so that the join has plain exchanges on both sides, and a large component is split
    firsts = cut(lines.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc", "at")).alias("f")).select("root", F.col("f.doc").alias("first"), F.col("f.at").alias("place")))
    linked = lines.where("root IS NOT NULL").join(firsts.hint("merge"), "root").select("h1", "h2", "first", "place")
    return linked.unionByName(lines.where("root IS NULL").select("h1", "h2", F.col("doc").alias("first"), F.col("at").alias("place")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed (line numbers from 0), kept_text.

    Lines end at \\n. Lines of white space only are kept and counted. Null texts have no line,
    empty ones one. Lines shorter than SHINGLE are linked with equal ones only. Rows with a null
    id keep their lines. Rows that repeat an id are judged each by its own text; equal rows are
    one document. An empty table gives no rows; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text_col).alias("th"), F.col(text_col).alias("text"))
    known = base.where("doc IS NOT NULL AND text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0]
    groups = cut(line_groups(known, size or 0))
    occurs = attach(known.mapInArrow(_occurrences, _LINE), groups, ["h1", "h2"], F.lit(32), "inner")
    gone = occurs.where(f"doc <> first OR {_PLACE} <> place")
    gone = cut(gone.groupBy("doc", "th").agg(F.array_sort(F.collect_set("ln")).alias("removed")))
    rows = attach(base, gone, ["doc", "th"], F.size("removed") * 4 + 40)
    removed = F.coalesce("removed", F.array().cast("array<int>"))

    def rest(p):
        """The parts left, by a hashed set of positions: array_contains in a filter would take lines times removed lines."""
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), removed), lambda i: F.get(p, i)), "\n")

    # a lambda's variable is computed once, a column inside a lambda for each element: a text is split once
    split = F.transform(F.array(F.split("text", "\n", -1)), lambda p: F.struct(F.size(p).alias("n"), F.when(F.size(removed) > 0, rest(p)).alias("kept")))[0]
    rows = rows.select("doc", "text", removed.alias("removed"), split.alias("s"))
    return rows.select(
        F.col("doc").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.col("s.n")).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"), "removed", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.col("s.kept")).alias("kept_text"),
    )


def line_digests(docs: DataFrame) -> DataFrame:
    return drop_lines(docs).select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
