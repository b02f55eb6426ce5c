"""Operator 10, benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space collapsed. An item of n characters
may occur with up to k edits (5 % of n, while pieces keep MIN_PIECE characters). Of its k + 1
pieces one at least is then untouched, so an Aho-Corasick automaton over all pieces finds a hit
at every occurrence. The text around a hit is verified with Myers' bit-parallel distance.

Test items are sent to the tasks in blocks of a checked size (BLOCK_ITEMS, BLOCK_BYTES); a
larger benchmark takes one pass over the documents a block. Documents are never shuffled except
by id to bring the blocks' results together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERRORS = 0.05
MIN_PIECE = 12
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20


def clean(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int) -> int:
    return max(0, min(int(n * ERRORS), n // MIN_PIECE - 1))


def pieces(item: str) -> list[tuple[int, str]]:
    """Offset and text of the budget + 1 pieces of an item."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors (1999) of one item, in Python's long integers."""

    def __init__(self, item: str):
        self.n, self.eq = len(item), {}
        for i, c in enumerate(item):
            self.eq[c] = self.eq.get(c, 0) | 1 << i
        self.mask, self.top = (1 << self.n) - 1, 1 << (self.n - 1)

    def distance(self, text: str) -> int:
        """Fewest edits between the item and any substring of text."""
        up, down, now = self.mask, 0, self.n
        best, eq, mask, top = now, self.eq, self.mask, self.top
        for c in text:
            e = eq.get(c, 0)
            diagonal = (((e & up) + up) ^ up) | e | down
            right = (down | ~(diagonal | up)) & mask
            left = up & diagonal
            if right & top:
                now += 1
            elif left & top:
                now -= 1
                if now < best:
                    best = now
            right, left = (right << 1) & mask, (left << 1) & mask
            e |= down
            up = (left | ~(e | right)) & mask
            down = right & e
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t, budget(len(t)), Pattern(t)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for at, (_, t, _, _) in enumerate(self.items):
            for offset, piece in pieces(t):
                places.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def find(self, text: str) -> dict[int, int]:
        """Item ids found in a clean text, with their least distances."""
        out: dict[int, int] = {}
        if not self.any:
            return out
        done: dict[int, int] = {}
        for end, (size, where) in self.automaton.iter(text):
            for at, offset in where:
                ident, item, k, pattern = self.items[at]
                if out.get(ident) == 0:
                    continue
                begin = end - size + 1 - offset
                # hits of one occurrence lie on diagonals at most k apart; the window below covers them
                if at in done and abs(begin - done[at]) <= k:
                    continue
                window = text[max(0, begin - 2 * k) : max(0, begin + len(item) + 2 * k)]
                if k == 0:
                    best = 0 if item in window else len(item)
                else:
                    best = 0 if item in window else pattern.distance(window)
                done[at] = begin
                if best <= k and best < out.get(ident, k + 1):
                    out[ident] = best
        return out


def _pass(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        matcher = Matcher(items)
        for x in batches:
            found = [matcher.find(clean(t)) for t in x.column(1).to_pylist()]
            ids = pa.array([sorted(f) for f in found], pa.list_(pa.int64()))
            best = pa.array([min(f.values()) if f else None for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), ids, best], names=["doc_id", "th", "items", "least"])

    return docs.mapInArrow(run, "doc_id long, th int, items array<long>, least long")


def _rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")


def _count(benchmark: DataFrame) -> int:
    """Blocks that the benchmark is sent in."""
    n, size = _rows(benchmark).agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return max(-(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES), 1)


def _blocks(benchmark: DataFrame, count: int):
    for b in range(count):
        part = _rows(benchmark) if count == 1 else _rows(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        yield sorted((r["item_id"], clean(r["text"])) for r in part.collect())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, items (ids found, ascending), least_edits (null: none found).

    Null and empty texts and items match nothing; items of white space only neither. Items of
    fewer than 24 characters must occur without edits. Repeated rows get equal results; an empty
    benchmark leaves every row clean; other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("th"))
    count = _count(benchmark)
    if count > 1:
        base = base.withColumn("th", F.hash("text"))
    parts = [_pass(base, items) for items in _blocks(benchmark, count)]
    out = parts[0]
    if count > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        copies = base.groupBy("doc_id", "th").agg(F.count("*").alias("c"))
        out = out.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("least").alias("least"))
        out = out.withColumnsRenamed({"doc_id": "d", "th": "t"}).join(copies, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
        out = out.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).select("doc_id", "items", "least")
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", F.col("least").alias("least_edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no test item occurs, with their columns. One pass a block, no shuffle."""
    place = docs.columns.index("text")
    out = docs
    for items in _blocks(benchmark, _count(benchmark)):

        def run(batches, items=items):
            import pyarrow as pa

            matcher = Matcher(items)
            for x in batches:
                yield x.filter(pa.array([not matcher.find(clean(t)) for t in x.column(place).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
