"""Operator 5, substring dedup by relative Lempel-Ziv parsing against an index of all documents.

The reference index holds a block of K words at the positions that winnowing selects: of every
W consecutive K-word runs those with the smallest hash, so each window of K + W - 1 = 50 words
holds a selected block, and equal windows hold equal ones. Every block that two documents share
points to its first document. A document is parsed against that index: blocks that continue
each other in the same reference (same document, same distance, no gap) make one factor, the
longest one. Factors of 50 words or more are duplicate spans.

Windows that run over a factor's boundary may still start in some other, earlier document.
They are checked there, in two steps: of the blocks near the ends of factors, every document that
holds such a block gives a hash of it with the words up to one beyond the end; where that goes
on in two documents, the windows around it are grouped by their content. So the result is exact
(up to collisions of 128 bits, or of runs of 64-bit ones), and what is shuffled are some 7 % of
the positions, plus the boundaries. No group is gathered in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, grams, mix, slices, sliding_min, text_buffer, words

WINDOW = 50
W = 25
K = WINDOW - W + 1


def _positions(h: np.ndarray, first: np.ndarray):
    """Of rows that lie end to end: block hashes, each window's smallest one (0: no window), and the selected positions."""
    n = len(h)
    g = grams(h, K)
    if n < WINDOW:
        return g, np.empty(0, np.uint64), np.empty(0, np.int64)
    m = sliding_min(g, W)
    end = np.repeat(first[1:], np.diff(first))
    m = np.where(np.arange(len(m)) + WINDOW <= end[: len(m)], m, np.uint64(0))
    # of equal blocks in a row (repeated words) the first and last of every W positions are enough:
    # every window still holds a selected block with its smallest hash
    padded = np.concatenate((np.zeros(W - 1, np.uint64), m, np.zeros(W - 1, np.uint64)))
    most = ~sliding_min(~padded, W)
    at = np.flatnonzero((most[: len(g)] == g) & (g != 0))
    if len(at) > 1:
        new = np.ones(len(at), bool)
        new[1:] = (g[at[1:]] != g[at[:-1]]) | (np.diff(at) >= W)
        if not new.all():
            chain = np.cumsum(new) - 1
            part = (at - at[new][chain]) // W
            edge = np.ones(len(at) + 1, bool)
            edge[1:-1] = new[1:] | (part[1:] != part[:-1])
            at = at[edge[:-1] | edge[1:]]
    return g, m, at


def _anchors(batches):
    import pyarrow as pa

    for x in batches:
        buf, offsets = text_buffer(x.column(2))
        for lo, hi in slices(offsets):
            _, _, h, first = words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            g, _, at = _positions(h, first)
            row = np.searchsorted(first, at, "right") - 1
            take = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), x.column(0).take(take), x.column(1).take(take), pa.array((at - first[row]).astype(np.int32))], names=["fp", "doc", "th", "pos"])


#: A code asks for a block (position * 64), on a side (left 0, right 32), how many words further a window must reach (1 to 24).
def _decode(codes: np.ndarray):
    return codes >> 6, (codes >> 5) & 1, codes & 31


def _runs(batches):
    """Of each code, the hash of the block with the words up to its reach (64 bits: this only sorts out what can't continue)."""
    import pyarrow as pa

    for x in batches:
        buf, offsets = text_buffer(x.column(2))
        for i in range(x.num_rows):
            _, _, h, _ = words(buf[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            g, codes = grams(h, K), np.asarray(x.column(3)[i].values)
            pos, side, reach = _decode(codes)
            other = np.where(side == 0, pos - reach, pos + reach)
            fits = (other >= 0) & (other < len(g))
            codes, pos, side, other, n = codes[fits], pos[fits], side[fits], other[fits], int(fits.sum())
            run = mix(mix(g[pos] * np.uint64(3) + (codes & 63).astype(np.uint64)) + g[other])
            yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(np.full(n, x.column(0)[i].as_py(), np.int64)), pa.array(np.full(n, x.column(1)[i].as_py(), np.int32)), pa.array(codes)], names=["run", "doc", "th", "code"])


def _boundary_windows(batches):
    """The windows that hold a code's block as their smallest one and reach as far as it says."""
    import pyarrow as pa

    for x in batches:
        buf, offsets = text_buffer(x.column(2))
        for i in range(x.num_rows):
            a, b = offsets[i], offsets[i + 1]
            _, _, h, first = words(buf[a:b], np.array([0, b - a]))
            g, m, _ = _positions(h, first)
            pos, side, reach = _decode(np.asarray(x.column(3)[i].values))
            s = pos[:, None] - np.arange(W)[None, :]
            far = np.where(side[:, None] == 0, s <= (pos - reach)[:, None], s + WINDOW >= (pos + K + reach)[:, None])
            fits = far & (s >= 0) & (s < len(m))
            s, of = s[fits], np.repeat(pos, fits.sum(1))
            s = np.unique(s[(m[s] == g[of]) & (m[s] != 0)])
            n = len(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[s].view(np.int64)), pa.array(g[s + WINDOW - K].view(np.int64)), pa.array(np.full(n, x.column(0)[i].as_py(), np.int64)), pa.array(np.full(n, x.column(1)[i].as_py(), np.int32)), pa.array(s.astype(np.int32))],
                names=["k1", "k2", "doc", "th", "s"],
            )


def _merged(batches):
    """Spans that overlap or touch become one."""
    import pyarrow as pa

    for x in batches:
        out = []
        for spans in x.column(2):
            a, b = np.asarray(spans.values).reshape(-1, 2).T
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.concatenate(([True], a[1:] > b[:-1]))
            out.append(np.stack((a[first], b[np.append(np.flatnonzero(first)[1:] - 1, len(b) - 1)]), 1).reshape(-1))
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc", "th", "spans"])


def _cover(n: int, spans) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        np.add.at(edge, np.minimum(spans[0::2], n), 1)
        np.add.at(edge, np.minimum(spans[1::2], n), -1)
    return np.cumsum(edge[:-1]) > 0


def _read(docs: DataFrame, places: DataFrame, run, schema: str) -> DataFrame:
    """run over the texts of the documents that places (doc, th, code) names, with their codes."""
    places = cut(places.groupBy("doc", "th").agg(F.collect_list("code").alias("codes")))
    texts = attach(docs.select("doc", "th", "text"), places, ["doc", "th"], F.size("codes") * 8 + 40, "inner").select("doc", "th", "text", "codes")
    return cut(texts.mapInArrow(run, schema))


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc, th, spans (start and end words, flat) of documents that have any. docs: doc, th (a hash of the text), text."""
    docs = docs.where("doc IS NOT NULL")
    # what is aggregated by a key is written before it is joined by that key: the join then has plain exchanges
    # on both sides, and a passage that very many documents share is split among tasks
    anchors = cut(docs.select("doc", "th", "text").mapInArrow(_anchors, "fp long, doc long, th int, pos int"))
    shared = cut(anchors.groupBy("fp").agg(F.min("doc").alias("r"), F.max("doc").alias("last")).where("r < last").select("fp", "r"))
    occurs = cut(anchors.join(shared.hint("merge"), "fp"))
    refs = cut(occurs.where("doc = r").groupBy("fp").agg(F.min("pos").alias("q")))
    later = occurs.where("doc > r").join(refs.hint("merge"), "fp").withColumn("d", F.col("q") - F.col("pos"))
    line = Window.partitionBy("doc", "th", "r", "d").orderBy("pos")
    later = later.withColumn("gap", (F.col("pos") - F.lag("pos").over(line) > K).cast("int")).withColumn("run", F.sum(F.coalesce("gap", F.lit(0))).over(line))
    factor = Window.partitionBy("doc", "th", "r", "d", "run")
    later = cut(later.select("fp", "doc", "th", "pos", F.min("pos").over(factor).alias("a"), (F.max("pos").over(factor) + K).alias("b")))
    factors = later.where(F.col("b") - F.col("a") >= WINDOW).select("doc", "th", "a", "b").distinct()
    inner = (F.col("a") <= F.col("pos") - W + 1) & (F.col("pos") + WINDOW <= F.col("b"))
    # a window over a factor's end whose smallest block is `pos` holds that block and the words up to one beyond the end
    left, right = F.col("pos") - F.col("a") + 1, F.col("b") - F.col("pos") - K + 1
    asked = F.array_compact(F.array(F.when(left < W, left), F.when(right < W, right + 32)))
    asked = later.where(~inner).select("fp", F.explode(asked).alias("ask")).distinct()
    places = occurs.join(asked.hint("merge"), "fp").select("doc", "th", (F.col("pos").cast("long") * 64 + F.col("ask")).alias("code"))
    runs = _read(docs, places, _runs, "run long, doc long, th int, code long")
    going = cut(runs.groupBy("run").agg(F.min("doc").alias("r"), F.max("doc").alias("last")).where("r < last").select("run"))
    windows = _read(docs, runs.join(going.hint("merge"), "run", "left_semi").select("doc", "th", "code"), _boundary_windows, "k1 long, k2 long, doc long, th int, s int")
    groups = cut(windows.groupBy("k1", "k2").agg(F.min("doc").alias("r"), F.max("doc").alias("last")).where("r < last"))
    found = windows.join(groups.hint("merge"), ["k1", "k2"]).where("doc > r").select("doc", "th", F.col("s").alias("a"), (F.col("s") + WINDOW).alias("b"))
    spans = factors.unionByName(found).groupBy("doc", "th").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("spans"))
    return cut(spans.mapInArrow(_merged, "doc long, th int, spans array<int>"))


def drop_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (the words left, joined by one space).

    A word goes if a window of 50 consecutive words over it also starts in a document with a
    smaller id; windows are judged on the input. Null and empty texts have no words; texts of
    fewer than 50 words keep them all. Rows with a null id keep their words and are no reference.
    Rows that repeat an id are no reference for each other, and each is judged by its own text.
    An empty table gives no rows; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text_col).alias("th"), F.col(text_col).alias("text"))
    spans = duplicate_spans(base)
    rows = attach(base, spans, ["doc", "th"], F.size("spans") * 4 + 40).select("doc", "text", "spans")

    def keep(batches):
        import pyarrow as pa

        for x in batches:
            buf, offsets = text_buffer(x.column(1))
            n_words, n_gone, kept = [], [], []
            for i in range(x.num_rows):
                own = bytes(buf[offsets[i] : offsets[i + 1]]).split()
                spans_i = x.column(2)[i]
                gone = _cover(len(own), np.asarray(spans_i.values) if spans_i.is_valid else None)
                left = [w for w, g in zip(own, gone.tolist()) if not g] if gone.any() else own
                n_words.append(len(own))
                n_gone.append(len(own) - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")


def substring_digests(docs: DataFrame) -> DataFrame:
    return drop_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The query, from all windows as texts.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS v FROM w WHERE len(w) >= 50),
f AS (SELECT v, min(doc_id) AS first FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT s.doc_id, s.i FROM s JOIN f USING (v) WHERE s.doc_id > f.first),
k AS (SELECT w.doc_id, t.word, t.pos FROM w, LATERAL (SELECT unnest(w.w) AS word, unnest(range(1, len(w.w) + 1)) AS pos) t),
m AS (SELECT k.doc_id, k.word, k.pos, sum(CASE WHEN g.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY k.doc_id ORDER BY k.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.i = k.pos),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)
"""
