"""Operator 11, best-fit packing of documents into sequences with several capacities.

Documents become token ids and an end id, and only those longer than a sequence are cut. Every
sequence has a residual of tokens, of documents and of attention cost (the sum of squared
lengths). Pieces are taken by falling weighted demand, and of the open sequences that hold a piece
under every constraint the one is chosen whose residual vector is left with the smallest weighted
norm, or has the largest weighted dot-product with the piece's demand.

Pieces are packed in groups of GROUP rows, dealt out by a hash, so that no task grows with the
input. What lies in sequences that are not nearly full goes on to a round of fewer groups, until
there is one group or merging no longer helps. Only lengths move here, no ids and no texts.

Each task keeps the ids of words that it has seen, up to a bound: the tokenizer drops white space and
no token crosses it, so ids of a text are those of its words, one after the other.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, slices, text_buffer

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY, END = 4096, 1
#: Documents and attention cost of a sequence. These bounds can't bind before the tokens do: as few sequences as possible are wanted.
MAX_DOCS, MAX_COST = CAPACITY, CAPACITY**2
WEIGHTS = (1.0, 1 / 64, 1 / 64)
#: Rows that one task packs at once.
GROUP = 8192
#: Sequences with a residual of a SLACK-th of their tokens or more are packed again with those of other groups.
SLACK = 64
#: Words whose ids a Python worker keeps, and the longest of them in bytes.
KNOWN, LONG = 1_400_000, 128
#: One piece to the tokenizer whatever stands beside it: letters that neither decompose nor change their number in lower case. And marks that are a piece of their own after one.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+").fullmatch
AFTER = b".,;:!?"
#: Bytes of a text that are split into words at once, and new words that are encoded at once.
SLICE, NEW = 1 << 20, 8192

_GAP = re.compile(rb"[\x20\x09-\x0D]")
_loaded: dict = {}


class Known(dict):
    """Ids of words. Words that aren't there are gathered, and stand for no ids meanwhile; very long ones are encoded each time."""

    def __init__(self, encode):
        self.encode, self.new, self.missed = encode, set(), 0

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > LONG:
            return self.encode(word)
        self.new.add(word)
        self.missed += 1
        return b""


class Words:
    """Ids of words by a tokenizers file, as little-endian unsigned 32-bit bytes.

    Words of Latin letters are one piece to the tokenizer and end in an id that ends words, so many are
    encoded in one call and parted at those ids. A mark after such a word is a piece of its own.
    Between all other words stands a character whose id is known.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.known = Tokenizer.from_file(path), Known(self._one)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.mark = self._ids("\0")
        self.after = {c: self._ids(chr(c)).tobytes() for c in AFTER}
        assert len(self.mark) == 1

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _one(self, word: bytes) -> bytes:
        return self._ids(word.decode("utf-8", "replace")).tobytes()

    def _parted(self, words: list[bytes], gap: bytes) -> None:
        for lo in range(0, len(words), NEW):
            part = words[lo : lo + NEW]
            ids = self._ids(gap.join(part).decode("utf-8", "replace"))
            if gap == b" ":
                ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
                starts = np.append(0, ends[:-1])
            else:
                marks = np.flatnonzero(ids == self.mark[0])
                starts, ends = np.append(0, marks + 1) * 4, np.append(marks, len(ids)) * 4
            raw = ids.tobytes()
            for word, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True):
                self.known[word] = raw[a:b]

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > KNOWN:
            self.known.clear()
        plain, ended, other, alone = set(), [], [], []
        for w in words:
            if PLAIN(w):
                plain.add(w)
            elif w[-1] in self.after and PLAIN(w[:-1]):
                ended.append(w)
                if w[:-1] not in self.known:
                    plain.add(w[:-1])
            else:
                (alone if b"\0" in w else other).append(w)
        self._parted(list(plain), b" ")
        self._parted(other, b" \0 ")
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.after[w[-1]]
        for w in alone:
            self.known[w] = self._one(w)

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of some texts' words, end to end."""
        known, out, again = self.known, [], []
        for n, words in enumerate(texts):
            before = known.missed
            out.append(b"".join(map(known.__getitem__, words)))
            if known.missed != before:
                again.append(n)
        if again:
            new, known.new = known.new, set()
            self.learn(new)
            for n in again:
                out[n] = b"".join(map(known.__getitem__, texts[n]))
            if known.new:  # the others went to make room
                new, known.new = known.new, set()
                self.learn(new)
                return self.encode(texts)
        return out


def _worded(path: str) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def _parts(raw: bytes):
    """Bytes of one text in parts that end at white space."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        to = gap.start() if gap else len(raw)
        yield raw[at:to]
        at = to


def _cut_up(path: str, end: int, capacity: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        words, step = _worded(path), 4 * capacity
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

        def made(doc_ids, rows, out):
            which, piece, length, crc = zip(*out)
            piece, length = np.array(piece, np.int64), np.array(length, np.int64)
            cols = [doc_ids.take(pa.array(which, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                flat = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(flat)))
            return pa.RecordBatch.from_arrays(cols, names=names)

        for x in batches:
            buf, offsets = text_buffer(x.column(1))
            out, rows = [], []
            for lo, hi in slices(offsets, SLICE):
                raws = [buf[a:b].tobytes() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1])]
                coded = words.encode([raw.split() for raw in raws]) if hi - lo > 1 else None  # split at ASCII white space
                for i, raw in enumerate(raws):
                    ids, piece = bytearray(), 0
                    for part in [coded[i]] if coded else (words.encode([part.split()])[0] for part in _parts(raw)):
                        ids += part
                        while len(ids) > step:  # one id is left at least, for the end of the document
                            one = bytes(ids[:step])
                            out.append((lo + i, piece, capacity, zlib.crc32(one)))
                            if with_ids:
                                rows.append(one)
                            del ids[:step]
                            piece += 1
                            if len(out) >= 4096:
                                yield made(x.column(0), rows, out)
                                out, rows = [], []
                    ids += tail
                    for at in range(0, len(ids), step):
                        one = bytes(ids[at : at + step])
                        out.append((lo + i, piece, len(one) // 4, zlib.crc32(one)))
                        if with_ids:
                            rows.append(one)
                        piece += 1
                if len(out) >= 4096:
                    yield made(x.column(0), rows, out)
                    out, rows = [], []
            if out:
                yield made(x.column(0), rows, out)

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (if asked for) ids: every document's tokens and the end id, in runs of capacity at most.

    Null texts count as empty and make one piece, of the end id alone. Repeated rows make pieces
    each; an empty table makes none. Columns of docs but those two are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = StructType([base.schema["doc_id"]]).simpleString()[7:-1]
    return base.mapInArrow(_cut_up(tokenizer, end, capacity, ids), f"{kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def best_fit(length: np.ndarray, order: np.ndarray, limits: tuple[int, int, int], weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins and offsets of pieces that are taken in this order, and each bin's residuals (3, bins). A piece that no empty bin holds gets one of its own."""
    top = np.array(limits, float)[:, None]
    w = np.array(weights, float)[:, None]
    least = int(length.min()) if len(length) else 0
    bins, offsets, left = np.empty(len(length), np.int64), np.zeros(len(length), np.int64), np.empty((3, len(length)), np.int64)
    used, open_ = 0, np.empty(0, np.int64)  # of the bins those that may still hold a piece
    residual = np.empty((3, 0), np.int64)
    for n, i in enumerate(order.tolist()):
        need = np.array([[length[i]], [1], [length[i] ** 2]])
        after = residual - need
        fits = np.flatnonzero((after >= 0).all(axis=0))
        if len(fits):
            score = (w * (after[:, fits] / top) ** 2).sum(axis=0) if rule == "norm" else -(w * (need / top) * (residual[:, fits] / top)).sum(axis=0)
            at = fits[np.argmin(score)]
            bins[i], offsets[i] = open_[at], limits[0] - residual[0, at]
            residual[:, at] = left[:, open_[at]] = after[:, at]
        else:
            bins[i], left[:, used] = used, np.array(limits) - need[:, 0]
            open_, residual = np.append(open_, used), np.hstack([residual, left[:, used : used + 1]])
            used += 1
        if n % 128 == 127:
            some = (residual[0] >= least) & (residual[1] >= 1) & (residual[2] >= least**2)
            open_, residual = open_[some], np.ascontiguousarray(residual[:, some])
    return bins, offsets, left[:, :used]


def packed(
    rows: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST, weights: tuple = WEIGHTS, rule: str = "norm", length_col: str = "length", group: int = GROUP,
) -> DataFrame:
    """rows plus sequence_id (any numbers) and offset (from 0, without gaps): no sequence exceeds a capacity.

    length_col holds positive tokens. A piece that exceeds a capacity alone gets a sequence of its
    own. rule: norm or dot. Rows of one length are taken in the order of a hash. Repeated rows are
    placed each; an empty table gives no rows. Columns of rows with the two names are replaced.
    """
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    left = cut(rows.select(*kept).withColumn("_uid", F.monotonically_increasing_id()))
    size = F.col(length_col)
    alone = (size >= capacity) | (size * size >= max_cost) | F.lit(max_docs <= 1)
    done = [left.where(alone).withColumns({"sequence_id": -1 - F.col("_uid"), "offset": F.lit(0).cast("long")})]
    left = left.where(~alone)
    schema = StructType([*left.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("_open", LongType())])

    def filler(turn: int):
        def fill(key, table):
            import pyarrow as pa

            length = table.column(length_col).to_numpy().astype(np.int64)
            demand = weights[0] * length / capacity + weights[1] / max_docs + weights[2] * (length / max_cost) * length
            order = np.lexsort((table.column("_uid").to_numpy(), -demand))
            bins, offsets, residual = best_fit(length, order, (capacity, max_docs, max_cost), weights, rule)
            again = (residual[0] * SLACK >= capacity) & (residual[1] > 0)
            table = table.drop_columns(["_group"])
            for name, col in (("sequence_id", (turn << 56) + (key[0].as_py() << 16) + bins), ("offset", offsets), ("_open", again[bins].astype(np.int64))):
                table = table.append_column(name, pa.array(col))
            return table

        return fill

    n, turn = left.count(), 0
    while n:
        groups = -(-n // group)
        dealt = left.withColumn("_group", F.pmod(F.xxhash64("_uid", F.lit(turn)), F.lit(groups)))
        parts = min(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        out = cut(dealt.repartition(parts, "_group").groupBy("_group").applyInArrow(filler(turn), schema))
        rest = out.where("_open = 1").count() if groups > 1 else 0
        if not rest or 2 * rest > n:  # the last group, or a further round would find the same
            done.append(out.drop("_open"))
            break
        done.append(out.where("_open = 0").drop("_open"))
        left, n, turn = out.where("_open = 1").select(*left.columns), rest, turn + 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select(*kept, "sequence_id", "offset")


def training_sequences(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY, **limits) -> DataFrame:
    """sequence_id, input_ids and lengths (of the pieces in order): what a trainer reads. See pieces() and packed()."""
    cut_up = cut(pieces(docs, tokenizer, end, capacity).select("length", "ids").withColumn("place", F.monotonically_increasing_id()))
    placed = cut(packed(cut_up.select("place", "length"), capacity, **limits))
    one = cut_up.join(placed.select("place", "sequence_id", "offset").hint("merge"), "place").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return one.select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.length").alias("lengths"))


def packing_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return packed(pieces(docs, tokenizer, ids=False))
