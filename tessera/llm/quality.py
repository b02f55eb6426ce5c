"""Operator 4, quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded as shares of
character classes and of repeated, upper-cased and odd words. A hidden layer, a gate (tanh times
sigmoid) and the attention weights it gives (softmax over the document's passages) are learned
together from document labels alone; the score is a logistic function of the attention-weighted
passage representation (Ilse et al., 2018).

Fitting uses a bounded sample: TRAIN_DOCS labelled documents that are not held out, with the
smallest hashes, each with all its passages. Scoring reads every passage of every text.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_buffer, words

PASSAGE = 64
TRAIN_DOCS = 6000
#: Bytes of their passages' features that are fitted on at most, in the order of the ids' hashes: some 900,000 passages of 64 words. The driver holds a few times as much.
TRAIN_BYTES = 64 << 20
THRESHOLD = 0.7
HIDDEN = 16
EPOCHS = 30
BATCH = 256
SEED = 5

_CLASS = np.full(256, 7, np.uint8)  # 7: other punctuation
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[0x20, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_"]] = 4
_CLASS[ord("|")] = 5
_CLASS[ord("!")] = 6
_CLASS[[ord(c) for c in ".,;:?"]] = 8
_CLASS[128:] = 9
_LETTERISH = np.isin(_CLASS, (0, 1, 9))
FEATURES = 10 + 8


def passages(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of the rows end to end in buf, and each row's first passage (n + 1 entries). A row without words has one passage of zeros."""
    starts, ends, h, first = words(buf, offsets)
    n_words, n = np.diff(first), len(first) - 1
    count = np.maximum(1, -(-n_words // PASSAGE))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros((int(at[-1]), FEATURES), np.float32)
    if not len(starts):
        return out, at
    row = np.repeat(np.arange(n), count)
    begin = first[:-1][row] + (np.arange(len(row)) - at[:-1][row]) * PASSAGE
    real = n_words[row] > 0
    begin, of = begin[real], row[real]
    stop = np.minimum(begin + PASSAGE, first[1:][of])
    size = (stop - begin).astype(np.float64)
    lo, hi = starts[begin], ends[stop - 1]
    cuts = np.stack((lo, np.minimum(hi, len(buf) - 1)), 1).reshape(-1)
    tail = hi >= len(buf)
    length = (hi - lo).astype(np.float64)
    kinds = _CLASS[buf]
    f = np.zeros((len(begin), FEATURES))
    for k in range(10):
        mask = kinds == k
        total = np.add.reduceat(mask, cuts, dtype=np.int64)[0::2]
        f[:, k] = (total + tail * mask[-1]) / length
    size_of = (ends - starts).astype(np.float64)
    over = lambda x: np.add.reduceat(x.astype(np.float64), begin)
    # reduceat runs on to the next passage's first word: passages of a row are adjacent, and so are rows
    f[:, 10] = over(size_of) / size / 8
    f[:, 11] = np.sqrt(np.maximum(over(size_of**2) / size - (over(size_of) / size) ** 2, 0)) / 8
    f[:, 12] = over(_LETTERISH[buf[ends - 1]]) / size
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][n_words > 0]] = False
    f[:, 13] = over(same) / size
    place = np.repeat(np.arange(len(begin)), (stop - begin))
    order = np.lexsort((h, place))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (place[order][1:] != place[order][:-1])
    f[:, 14] = np.bincount(place[order][new], minlength=len(begin)) / size
    whole = np.repeat(np.arange(n), n_words)
    pair = h.copy()
    pair[:-1] = h[:-1] * np.uint64(3) + h[1:] * np.uint64(5)
    order = np.lexsort((pair, whole))
    seen = np.zeros(len(h), bool)
    seen[order[1:]] = (pair[order][1:] == pair[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    seen[first[1:][n_words > 0] - 1] = False
    f[:, 15] = over(seen) / size
    upper = (buf[starts] >= 65) & (buf[starts] <= 90)
    f[:, 16] = over(upper) / size
    f[:, 17] = np.log1p(size) / np.log1p(PASSAGE)
    out[real] = f
    return out, at


class Attention:
    """The model: hidden layer, gated attention over the passages of a bag, logistic output."""

    def __init__(self, mean, scale, seed: int = SEED):
        g = np.random.default_rng(seed)
        d, k = len(mean), HIDDEN
        self.mean, self.scale = mean, scale
        self.p = {"w": g.normal(0, 0.3, (d, k)), "b": np.zeros(k), "v": g.normal(0, 0.3, (k, k)), "u": g.normal(0, 0.3, (k, k)), "a": g.normal(0, 0.1, k), "c": g.normal(0, 0.3, k), "d": np.zeros(1)}

    def forward(self, x, at):
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
        e = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
        w = e / np.add.reduceat(e, at[:-1])[bag]
        m = np.add.reduceat(w[:, None] * h, at[:-1], axis=0)
        y = 1 / (1 + np.exp(-(m @ p["c"] + p["d"])))
        return y, (z, h, t, s, w, m, bag)

    def gradients(self, x, at, label):
        p = self.p
        y, (z, h, t, s, w, m, bag) = self.forward(x, at)
        dy = (y - label) / len(label)
        dm = dy[:, None] * p["c"]
        dw = (dm[bag] * h).sum(1)
        de = w * (dw - np.add.reduceat(w * dw, at[:-1])[bag])
        dts = de[:, None] * p["a"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh = w[:, None] * dm[bag] + dt @ p["v"].T + ds @ p["u"].T
        dz = dh * (1 - h**2)
        return {"w": z.T @ dz, "b": dz.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": m.T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4):
        g, step = np.random.default_rng(SEED), 0
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = g.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                part, step = order[lo : lo + BATCH], step + 1
                x = np.concatenate([bags[i] for i in part]).astype(np.float64)
                at = np.concatenate(([0], np.cumsum([len(bags[i]) for i in part])))
                for k, d in self.gradients(x, at, label[part]).items():
                    d = d + decay * self.p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * d
                    m2[k] = 0.999 * m2[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Attention | float:
    """The model, or a constant score where the labelled rows are of one kind (0.5 without any)."""
    rows = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()
    quality = {r["doc_id"]: int(r["quality"]) for r in rows}
    if not quality:
        return 0.5
    chosen = docs.sparkSession.createDataFrame([(i,) for i in quality], "doc_id long")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    some = some.groupBy("doc_id").agg(F.max("text").alias("text"))  # one bag an id, however often it is repeated

    def encode(batches):
        import pyarrow as pa

        for x in batches:
            buf, offsets = text_buffer(x.column(1))
            bags = []
            for i in range(x.num_rows):
                f, _ = passages(buf[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                bags.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(bags, pa.binary())], names=["doc_id", "bag"])

    encoded = cut(some.mapInArrow(encode, "doc_id long, bag binary").withColumn("size", F.octet_length("bag")))
    size = {r["doc_id"]: r["size"] for r in encoded.select("doc_id", "size").collect()}
    left, taken = train_bytes, []
    for i in quality:  # in the order of their hashes; bags that don't fit any more are passed over
        if size.get(i, left + 1) <= left:
            taken.append(i)
            left -= size[i]
    if len(taken) < len(size):
        encoded = encoded.where(F.col("doc_id").isin(taken)) if taken else encoded.limit(0)
    found = sorted((r["doc_id"], bytes(r["bag"])) for r in encoded.select("doc_id", "bag").collect())
    label = np.array([quality[i] for i, _ in found], np.float64)
    if not len(label) or label.min() == label.max():
        return float(label[0]) if len(label) else 0.5
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, b in found]
    every = np.concatenate(bags).astype(np.float64)
    return Attention(every.mean(0), every.std(0) + 1e-3).fit(bags, label)


def score(docs: DataFrame, model: Attention | float) -> DataFrame:
    """docs plus score (0 to 1). Null and empty texts are scored as one empty passage. A column named score is replaced."""
    cols = [c for c in docs.columns if c != "score"]
    place = cols.index("text")

    def run(batches):
        import pyarrow as pa

        for x in batches:
            buf, offsets = text_buffer(x.column(place))
            out = np.empty(x.num_rows)
            for lo, hi in slices(offsets):
                if isinstance(model, float):
                    out[lo:hi] = model
                else:
                    f, at = passages(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    out[lo:hi] = model.forward(f.astype(np.float64), at)[0]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out)], names=[*cols, "score"])

    schema = docs.select(*cols).schema.add("score", "double")
    return docs.select(*cols).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Repeated rows get equal scores; an empty table gives no rows; a null id is not held out."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns."""
    return score(docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD).select(*docs.columns)

