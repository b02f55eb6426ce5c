"""Linking machinery of the two near-duplicate operators: banded candidates, links, components.

Nothing here emits all pairs of a group. Each bucket of a band first compares its members with
its smallest id only. What those links connect needs no further comparison; only
buckets whose members are then in more than one component are compared in full: in blocks of
bounded size, across components, and each block passes on no more links than join what is still
apart (a spanning forest), so rows stay in proportion to the members. Before that, buckets are
compared by their signatures alone, and members without a partner leave: their texts are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import cut, mix, only, slices

#: Members of one bucket that one task compares with as many others, and their weight at most (bytes, about).
CHUNK, CHUNK_WEIGHT = 4096, 16 << 20
#: Members of small buckets that one call compares, bucket by bucket.
PACK = 4096
#: Keys that are dealt to several tasks: at most so many, with so many rows at least among every SAMPLE-th id.
HOT_KEYS, HOT_ROWS, SAMPLE = 4096, 64, 64
#: Members of a bucket whose signatures are compared all at once.
SMALL = 32
#: Hashes of sets that a call keeps.
KEPT = 4 << 20
#: Characters whose sets are made at once.
AT_ONCE = 1 << 16
#: Sets that are compared with one at once.
BATCH = 32
#: Pairs whose sets are hashed at once.
SCREEN = 512


def _joined(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (a, b) with m, the aggregate of their a.

    The join's key is a with one bit turned: an aggregate by a would else be taken as dealt out for
    the join already and run in one stage with it, which adaptive execution can't split. Here both
    sides are plain exchanges, so the edges of one hub are dealt to several tasks.
    """
    turned = F.col("a").bitwiseXOR(F.lit(1))
    return rows.select(turned.alias("k"), "a", "b").join(least.select(turned.alias("k"), "m").hint("merge"), "k").drop("k")


def components(edges: DataFrame) -> DataFrame:
    """id, root for every id in edges (u, v): root is the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars:
    every id has one edge down, to an id that has none. Neither step makes more rows than it
    reads. Minima are combined before they are shuffled, and hubs are split (see _joined).
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    while True:
        several = e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        inner = e.select("a").distinct().join(e.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi")
        if several.unionByName(inner).isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(_joined(both, least).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _joined(large, least).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.distinct())
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def pruning_table(rows: int, batch: int, threshold: float, miss: float) -> np.ndarray:
    """Fewest agreeing hashes of the first batch, 2 * batch, ... that keep a pair.

    The similarity has a uniform prior, so after m of n hashes agree it is Beta(m + 1, n - m + 1);
    a pair is pruned when P(similarity >= threshold) < miss.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(batch, rows + 1, batch):
        keep = n + 1
        for m in range(n, -1, -1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() < miss * p.sum():
                break
            keep = m
        out.append(keep)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray, batch: int) -> np.ndarray:
    """Indices of rows of the signature matrices a and b that no batch prunes: sequential, so later batches see few rows."""
    left, agree = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, need in enumerate(least):
        part = slice(i * batch, (i + 1) * batch)
        agree = agree + (a[left, part] == b[left, part]).sum(axis=1)
        stay = agree >= need
        left, agree = left[stay], agree[stay]
    return left


def binary_matrix(col, kind=np.uint32) -> np.ndarray:
    """(rows, entries) of an Arrow column of equally long binaries."""
    import pyarrow as pa

    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col):
        return np.empty((0, 0), kind)
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(kind).reshape(len(col), -1)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted hashes reach the threshold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    shared = np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def exact_links(pairs: DataFrame, texts: DataFrame, shingles: Callable[[str], frozenset], percent: int, screen: Callable[[list[str]], list[np.ndarray] | None] | None = None) -> DataFrame:
    """Pairs (u < v) whose sets, built from the texts (id, text), reach the threshold.

    screen gives the sets of some texts as sorted numbers, equal where shingles are equal and only
    there, or None where it can't; then, and without it, the shingles themselves are compared.
    """
    # u, the end that many pairs share, is joined last: rows come sorted by it, and its set is built once
    both = pairs.join(texts.withColumnsRenamed({"id": "v", "text": "tv"}).hint("merge"), "v").join(texts.withColumnsRenamed({"id": "u", "text": "tu"}).hint("merge"), "u")

    def plain(rows, seen):
        for u, v, a, b in rows:
            if len(seen) > 64:
                seen.clear()
            for t in (a, b):
                if t not in seen:
                    seen[t] = shingles(t)
            small, large = sorted((len(seen[a]), len(seen[b])))
            if small and 100 * small >= percent * large:
                shared = len(seen[a] & seen[b])
                if 100 * shared >= percent * (small + large - shared):
                    yield u, v

    def exact(batches):
        import pyarrow as pa

        for x in batches:
            out, seen = [], {}
            rows = list(zip(x.column("u").to_pylist(), x.column("v").to_pylist(), x.column("tu").fill_null("").to_pylist(), x.column("tv").fill_null("").to_pylist()))
            for lo in range(0, len(rows), SCREEN):
                part = rows[lo : lo + SCREEN]
                texts = list({t: None for r in part for t in r[2:]})
                found = screen(texts) if screen else None
                if found is None:
                    out += plain(part, seen)
                else:
                    found = dict(zip(texts, found))
                    out += [r[:2] for r in part if alike(found[r[2]], found[r[3]], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["u", "v"])

    return both.select("u", "v", "tu", "tv").mapInArrow(exact, "u long, v long").distinct()


def _buckets(key: np.ndarray):
    """Starts and ends of the runs of equal keys."""
    cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    return cuts[:-1], cuts[1:]


def _partners(key, root, keys, sig, least, batch, chunk, cross) -> np.ndarray:
    """Which rows (sorted by key) have a partner in their bucket, in another component, that no batch prunes.

    cross: partners are in another chunk. Small buckets are compared all at once, at growing
    distances; large ones a row at a time, the largest component's rows not among themselves.
    """
    active = np.zeros(len(key), bool)
    starts, ends = _buckets(key)
    sizes = ends - starts
    small, end = np.repeat(sizes <= SMALL, sizes), np.repeat(ends, sizes)
    rows = np.flatnonzero(small)
    for step in range(1, SMALL):
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        u, v = rows, rows + step
        apart = root[u] != root[v]
        if cross:
            apart &= chunk[u] != chunk[v]
        u, v = u[apart], v[apart]
        left = survivors(sig[u], sig[v], least, batch)
        active[u[left]] = active[v[left]] = True
    for a, b in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
        before = _before(key[a], keys[a:b])
        _, group, counts = np.unique(root[a:b], return_inverse=True, return_counts=True)
        main = group == counts.argmax()
        for n in np.flatnonzero(~main):
            to = main | (np.arange(b - a) > n)
            to &= group != group[n]
            if cross:
                to &= chunk[a:b] != chunk[a + n]
            to = np.flatnonzero(to)
            to = to[~(before[to] == before[n]).any(axis=1)]
            to = to[survivors(np.broadcast_to(sig[a + n], (len(to), sig.shape[1])), sig[a + to], least, batch)]
            if len(to):
                active[a + n] = True
                active[a + to] = True
    return active


def _before(key, keys: np.ndarray) -> np.ndarray:
    """The columns of keys before the one that holds key: rows that share one of those too meet in its bucket."""
    at = np.flatnonzero((keys == key).any(axis=0))
    return keys[:, : at[0] if len(at) else 0]


def _dealt(rows: DataFrame, size, texts: bool = False) -> DataFrame:
    """rows (key, id, root, w, sig) in packs of small buckets, and in pairs (i, j) of the chunks of large ones. texts: whether rows bring their texts, of weight w."""
    large = cut(rows.groupBy("key").agg(size.cast("int").alias("chunks")).where("chunks > 1"))
    many, weight = rows.agg(F.count("*"), F.sum("w")).first()
    packs = max(1, -(-many // PACK), -(-(weight or 0) // CHUNK_WEIGHT) if texts else 0)
    placed = rows.join(large.hint("merge"), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pack = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(F.col("key"))
    return placed.select("key", "id", "root", "w", "sig", "mine", pack.alias("pack"), (F.col("chunks") > 1).alias("big"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def _hot(signatures: DataFrame, keys_in: Callable) -> list[tuple[int, int]]:
    """Keys that hold a large share of the rows, and over how many tasks to deal each.

    This only places rows and leaves none out: counts come from every SAMPLE-th id by hash, and at
    most HOT_KEYS keys are named, so that the list has a size bound. A key that isn't among them
    holds less than one row in HOT_KEYS.
    """

    def keys(batches):
        import pyarrow as pa

        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_in(x.column(0)).reshape(-1))], names=["key"])

    some = signatures.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("sig").mapInArrow(keys, "key long")
    some = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS)
    return sorted((r["key"], -(-r["n"] // HOT_ROWS)) for r in some.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect())


#: Bytes of a key, a part and an id, and bytes of blocks that one task holds, about: arrays to sort them take several times as much.
ENTRY, DEALT = 20, 48 << 20


def dealt_to(spark, size: int) -> int:
    """Tasks for blocks of so many bytes: as many as Spark would make, and more where each would hold more than DEALT."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // DEALT))


def _dealer(tasks: int, hot: list[tuple[int, int]], keys_in: Callable):
    """Rows (id, sig) as blocks: pid, and the keys, parts and ids of a batch that go to task pid, end to end.

    A row a key would cost a shuffle far more than the 16 bytes that it carries.
    """
    hot_keys, hot_parts = np.array([k for k, _ in hot], np.int64), np.array([n for _, n in hot], np.uint64)

    def run(batches):
        import pyarrow as pa

        for x in batches:
            keys = keys_in(x.column(1))
            key, ids = keys.reshape(-1), np.repeat(np.asarray(x.column(0)), keys.shape[1])
            part = np.full(len(key), -1, np.int32)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                is_hot = hot_keys[at] == key
                part[is_hot] = (mix(ids[is_hot].view(np.uint64)) % hot_parts[at[is_hot]]).astype(np.int32)
            pid = ((mix(key.view(np.uint64) + part.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(tasks)).astype(np.int32)
            order = np.argsort(pid, kind="stable")
            key, part, ids = key[order], part[order], ids[order]
            to, start = np.unique(pid[order], return_index=True)
            ends = np.append(start[1:], len(key))
            block = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(start, ends)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), block(key), block(part) if len(hot_keys) else pa.array([b""] * len(to), pa.binary()), block(ids)], names=["pid", "keys", "parts", "ids"])

    return run


def _repeated(batches):
    """Of a partition's blocks the rows (key, part, id) whose key and part come twice or more, and all of hot keys (part >= 0)."""
    import pyarrow as pa

    blocks = [(k, p, i) for x in batches for k, p, i in zip(*(x.column(c).to_pylist() for c in ("keys", "parts", "ids")))]
    if not blocks:
        return
    key, ids = np.frombuffer(b"".join([k for k, _, _ in blocks]), np.int64), np.frombuffer(b"".join([i for _, _, i in blocks]), np.int64)
    raw = b"".join([p for _, p, _ in blocks])
    part = np.frombuffer(raw, np.int32) if raw else np.full(len(key), -1, np.int32)
    del blocks
    order = np.lexsort((part, key)) if raw else np.argsort(key)
    key, part = key[order], part[order]
    same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    keep = part >= 0
    keep[1:] |= same
    keep[:-1] |= same
    yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(part[keep]), pa.array(ids[order[keep]])], names=["key", "part", "id"])


def _whole_buckets(batches):
    """Tables of whole buckets from batches of rows that are sorted by key and part."""
    import pyarrow as pa

    held = []
    for x in batches:
        if not x.num_rows:
            continue
        key, part = np.asarray(x.column("key")), np.asarray(x.column("part"))
        last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
        if last:
            yield pa.Table.from_batches([*held, x.slice(0, last)])
            held = [x.slice(last)]
        elif held and (held[-1].column("key")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (key[0], part[0]):
            yield pa.Table.from_batches(held)
            held = [x]
        else:
            held.append(x)
    if held:
        yield pa.Table.from_batches(held)


def _candidates(key, part, ids, sig, keys, least, batch):
    """Pairs of rows (indices) to verify, which rows phase two may need, and of how many such rows in their bucket.

    Rows are sorted by key, part and id. In small buckets all rows are compared by their
    signatures, at growing distances, but for pairs that share an earlier key; each row is paired
    with the smallest partner that no batch prunes. In large ones the first row takes those that
    aren't pruned, the first of the others takes its own, and so on, and all rows count as needed.
    """
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]))
    cuts = np.flatnonzero(new)
    starts, ends = cuts[:-1], cuts[1:]
    sizes = ends - starts
    end, bucket = np.repeat(ends, sizes), np.repeat(np.arange(len(sizes)), sizes)
    first, live = np.full(len(key), -1), part >= 0
    rows = np.flatnonzero((sizes <= SMALL)[bucket])
    band = np.argmax(keys == key[:, None], axis=1)
    for step in range(1, SMALL):
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        u, v = rows, rows + step
        for lo in range(0, len(u), 1 << 16):
            a, b = u[lo : lo + (1 << 16)], v[lo : lo + (1 << 16)]
            left = survivors(sig[a], sig[b], least, batch)
            a, b = a[left], b[left]
            own = np.argmax(keys[a] == keys[b], axis=1) == band[a]
            a, b = a[own], b[own]
            a, b = a[ids[a] != ids[b]], b[ids[a] != ids[b]]
            first[b] = a
            live[a] = live[b] = True
    v = np.flatnonzero(first >= 0)
    us, vs = [first[v]], [v]
    for a, b in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
        live[a:b] = True
        left = np.arange(a, b)
        while len(left) > 1:
            n, left = left[0], left[1:]
            hit = np.zeros(len(left), bool)
            hit[survivors(np.broadcast_to(sig[n], (len(left), sig.shape[1])), sig[left], least, batch)] = True
            us.append(np.full(int(hit.sum()), n))
            vs.append(left[hit])
            left = left[~hit]
    count = np.bincount(bucket[live], minlength=len(sizes))[bucket]
    return np.concatenate(us), np.concatenate(vs), live, np.where(part >= 0, 1 << 30, count)


def link_groups(
    signatures: DataFrame, keys_in: Callable, texts: Callable[[DataFrame], DataFrame], shingles: Callable[[str], frozenset], sets: Callable[[list[str]], list[np.ndarray]],
    percent: int, least: np.ndarray, batch: int, items: int, bands: int, matrix: Callable = binary_matrix, screen: Callable | None = None,
) -> DataFrame:
    """Components (id, root) of the links among items that share a band.

    signatures: id, sig (uint32s as binary, or what matrix reads), w (an item's weight in bytes).
    keys_in: the keys of each of the bands, in order, from an Arrow column of signatures. texts: from a table of ids, id and text. shingles: the exact set of a text.
    sets: sorted hashes of the sets of some texts. least, batch: see pruning_table. items: how many
    signatures there are at most. screen: see exact_links. Items
    without links are absent.
    """
    # one exchange by key finds the keys of several items, in one pass over each partition. Keys that very many items
    # share are dealt by a part of the id too, and their parts meet in their smallest ids and in phase two
    tasks = dealt_to(signatures.sparkSession, items * bands * ENTRY)
    dealt = signatures.select("id", "sig").mapInArrow(_dealer(tasks, _hot(signatures, keys_in), keys_in), "pid int, keys binary, parts binary, ids binary")
    members = cut(dealt.repartitionById(tasks, F.col("pid")).mapInArrow(_repeated, "key long, part int, id long"), free=True)

    # phase one: members meet with their signatures, bucket by bucket
    kind = signatures.schema["sig"].dataType
    sized = members.join(signatures.select("id", "sig", F.col("w").cast("long").alias("w")).hint("merge"), "id").select("key", "part", "id", "w", "sig")
    schema = StructType([StructField("key", LongType()), StructField("part", IntegerType()), StructField("id", LongType()), StructField("other", LongType()), StructField("n", LongType()), StructField("w", LongType()), StructField("sig", kind)])

    def compared(batches):
        import pyarrow as pa

        for t in _whole_buckets(batches):
            key, part, ids = (t.column(c).to_numpy() for c in ("key", "part", "id"))
            sig = matrix(t.column("sig"))
            us, vs, live, count = _candidates(key, part, ids, sig, keys_in(t.column("sig")), least, batch)
            pairs = t.select(["key", "part", "id"]).take(pa.array(us))
            none = pa.nulls(len(us), pa.int64())
            yield from pa.table([*pairs.columns, pa.array(ids[vs]), none, none, pa.nulls(len(us), t.column("sig").type)], names=schema.names).to_batches()
            rows = t.filter(pa.array(live))
            yield from pa.table([*rows.select(["key", "part", "id"]).columns, pa.nulls(rows.num_rows, pa.int64()), pa.array(count[live].astype(np.int64)), rows.column("w"), rows.column("sig")], names=schema.names).to_batches()

    seen = cut(sized.repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(compared, schema), free=True)
    tops = seen.where("part >= 0 AND n IS NOT NULL").groupBy("key", "part").agg(F.min("id").alias("v"))
    heads = cut(tops.groupBy("key").agg(F.min("v").alias("u")))
    tested = seen.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v"))
    tested = cut(tested.unionByName(tops.join(heads.hint("merge"), "key").where("u <> v").select("u", "v")).distinct())

    # phase two: buckets whose members are not all in one component. Where two members only were not pruned, they were tested
    rows = seen.where("n > 2").select("key", "id", "w", "sig")

    # one reading for both phases: nearly all rows of phase two are in a pair of phase one, and a reading scans all documents
    ends = lambda pairs: pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id")))
    read = texts(cut(ends(tested).unionByName(rows.select("id")).distinct()))
    found = cut(components(cut(exact_links(tested, read, shingles, percent, screen))))
    roots = cut(rows.join(found.hint("merge"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"), "w", "sig"))
    split = cut(roots.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key"))
    rest = cut(roots.join(split.hint("merge"), "key", "left_semi"))
    if rest.isEmpty():
        return found

    def marked(t):
        """The rows that have a partner by their signatures in another component."""
        import pyarrow as pa

        t = t.sort_by([("key", "ascending"), ("id", "ascending")])
        sig = matrix(t.column("sig"))
        cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        root, key = t.column("root").to_numpy(), t.column("key").to_numpy()
        return t.select(["key", "id", "root", "w", "sig"]).filter(pa.array(_partners(key, root, keys_in(t.column("sig")), sig, least, batch, t.column("mine").to_numpy(), cross)))

    # only rows that have a partner by their signatures meet with their texts
    placed = _dealt(rest, F.ceil(F.count("*") / CHUNK))
    rest = cut(placed.groupBy("pack", "big", "i", "j").applyInArrow(marked, rest.select("key", "id", "root", "w", "sig").schema).dropDuplicates(["key", "id"]))
    if rest.isEmpty():
        return found
    placed = _dealt(rest, F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("w") / CHUNK_WEIGHT)), texts=True)
    placed = placed.join(only(read, cut(rest.select("id").distinct()), "id").hint("merge"), "id")

    def linked(n, to, ids, text, own):
        """Which of to are similar to n, by their sets: one search of all their hashes in n's."""
        if len(own) % 256 == 255 and sum(map(len, own.values())) > KEPT:
            own.clear()
        new = [x for x in (n, *to) if ids[x] not in own]
        own.update(zip((ids[x] for x in new), sets([text[x] for x in new])) if new else ())
        mine, theirs = own[ids[n]], [own[ids[m]] for m in to]
        sizes = np.array([len(x) for x in theirs])
        every = np.concatenate(theirs)
        at = np.searchsorted(mine, every)
        shared = np.add.reduceat((mine[np.minimum(at, len(mine) - 1)] == every).astype(np.int64), np.cumsum(sizes) - sizes)
        return 100 * shared >= percent * (len(mine) + sizes - shared)

    def bucket(key, ids, root, chunk, sig, keys, text, cross, own, us, vs):
        before = _before(key, keys)
        _, group, counts = np.unique(root, return_inverse=True, return_counts=True)  # the component of each member, merged as links appear
        main = group == counts.argmax()  # pairs across components have an end outside the largest one
        for n in np.flatnonzero(~main).tolist():
            to = main | (np.arange(len(ids)) > n)
            to &= group != group[n]
            if cross:
                to &= chunk != chunk[n]
            to = np.flatnonzero(to)
            to = to[~(before[to] == before[n]).any(axis=1)]
            if len(to) < 64:
                to = to[(sig[to] == sig[n]).sum(axis=1) >= least[-1]]
            else:
                to = to[survivors(np.broadcast_to(sig[n], (len(to), sig.shape[1])), sig[to], least, batch)]
            if len(to) > BATCH:  # likely links first: what they join needs no comparison
                to = to[np.argsort(-(sig[to] == sig[n]).sum(axis=1), kind="stable")]
            while len(to):
                some, to = to[:BATCH], to[BATCH:]
                for m in some[linked(n, some.tolist(), ids, text, own)].tolist():
                    if group[m] != group[n]:
                        us.append(min(ids[n], ids[m]))
                        vs.append(max(ids[n], ids[m]))
                        group[group == group[m]] = group[n]
                to = to[group[to] != group[n]]

    def ahead(ids, text) -> dict:
        """Sets by id, AT_ONCE characters at a time, since a few lines a call cost several times as much; linked() makes those beyond KEPT."""
        every, own = dict(zip(ids.tolist(), text)), {}
        names, parts = list(every), list(every.values())
        sizes = np.cumsum([0, *map(len, parts)])
        for lo, hi in slices(sizes[sizes <= KEPT], AT_ONCE):
            own.update(zip(names[lo:hi], sets(parts[lo:hi])))
        return own

    def across(t):
        import pyarrow as pa

        t = t.sort_by([("key", "ascending"), ("id", "ascending")])
        key, ids, root, chunk, text, sig = *(t.column(c).to_numpy() for c in ("key", "id", "root", "mine")), t.column("text").to_pylist(), matrix(t.column("sig"))
        cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        keys, us, vs, own = keys_in(t.column("sig")), [], [], ahead(ids, text)
        for a, b in zip(*_buckets(key)):
            bucket(key[a], ids[a:b], root[a:b], chunk[a:b], sig[a:b], keys[a:b], text[a:b], cross, own, us, vs)
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    more = placed.groupBy("pack", "big", "i", "j").applyInArrow(across, "u long, v long").where("u <> v").distinct()
    more = cut(more)
    extra = cut(exact_links(more, only(read, cut(ends(more).distinct()), "id"), shingles, percent, screen))
    if extra.isEmpty():
        return found
    return cut(components(found.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(extra)))
