"""Packing, repair of conversations and the manifest against brute force, with odd rows, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import dialogue, manifest, packing
from tests.test_queries import SF, TABLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def in_duckdb(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(f"_{name}", frame.toArrow())
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    return con.sql(sql).to_arrow_table()


def rows(table):
    return sorted((tuple(str(x[k]) for k in sorted(x)) for x in table.to_pylist()))


# ---- 11


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé,.1 ") for _ in range(r.randint(1, 9)))
    made = [None, "", " \n", "A\0B \0", "x<|endoftext|>y z", "don't", "q" * 5000, "é É"] + [" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(80)] + ["\t".join(word() for _ in range(90_000))]
    return [(i if i != 3 else None, t, "en", "s", 0) for i, t in enumerate(made)] + [(5, "don't", "en", "s", 0)] * 2


def test_pieces_are_the_tokenizers_ids(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER)
    want = []
    for i, text, *_ in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, at // 64, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes()), ids[at : at + 64]) for at in range(0, len(ids), 64)]
    docs = spark.createDataFrame(texts, DOCS).withColumns({"piece": F.lit("x"), "ids": F.lit(1)})
    got = [tuple(x) for x in packing.pieces(docs, capacity=64).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_are_cut_between_words():
    raw = b" ".join([b"word"] * 400_000)
    parts = list(packing._parts(raw))
    assert len(parts) > 1 and b"".join(parts) == raw and all(len(p) <= packing.SLICE + 8 for p in parts)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_no_limit_is_exceeded_and_offsets_have_no_gaps(spark, rule):
    r = random.Random(5)
    lengths = [r.choice([1, 1, 5, 30, 60, 99, 100, r.randint(1, 100)]) for _ in range(900)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long").withColumn("offset", F.lit("x")).repartition(5)
    for max_docs, max_cost, group in ((1000, 10_000, 64), (4, 10_000, 300), (1000, 5_000, 10_000), (1, 10_000, 64)):
        got = packing.packed(df, 100, max_docs, max_cost, (1.0, 0.5, 0.5), rule, group=group).toPandas()
        assert sorted(got["id"]) == list(range(900))
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g["length"].sum() <= 100 and len(g) <= max_docs and ((g["length"] ** 2).sum() <= max_cost or len(g) == 1)
            assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]]
    assert packing.packed(df.limit(0), 100).count() == 0


def test_few_sequences(spark):
    r = random.Random(6)
    lengths = [min(4095, int(r.lognormvariate(6.3, 1)) + 1) for _ in range(6000)]
    df = spark.createDataFrame([(n,) for n in lengths], "length long")
    one, many = (packing.packed(df, group=g).select("sequence_id").distinct().count() for g in (10_000, 500))
    least = -(-sum(lengths) // 4096)
    assert one <= least * 1.005 + 1 and many <= one * 1.01 + 1


def test_rules_choose_by_residual_vectors():
    # two open sequences hold the last piece: the first is short of tokens, the second of documents
    length, order = np.array([70, 20, 20, 20, 10]), np.arange(5)
    norm, *_ = packing.best_fit(length, order, (100, 4, 10_000), (1.0, 0.0, 0.0), "norm")
    dot, *_ = packing.best_fit(length, order, (100, 4, 10_000), (1.0, 0.0, 0.0), "dot")
    assert norm.tolist() == [0, 0, 1, 1, 0] and dot.tolist()[:2] == [0, 0] and dot.tolist()[4] == 1


def test_training_sequences(spark, texts):
    docs = spark.createDataFrame(texts, DOCS)
    seqs = packing.training_sequences(docs, capacity=256, max_docs=256, max_cost=256**2).collect()
    pieces = [tuple(x["ids"]) for x in packing.pieces(docs, capacity=256).collect()]
    back = []
    for s in seqs:
        at = np.cumsum([0, *s["lengths"]])
        assert at[-1] == len(s["input_ids"]) <= 256
        back += [tuple(s["input_ids"][a:b]) for a, b in itertools.pairwise(at)]
    assert sorted(back) == sorted(pieces)


# ---- 12

CONV = "conv_id long, turn long, role string, text string"


def least_edits(symbols):
    """By trying all edits, cheapest first and then by their letters."""
    import heapq

    heap = [(0, "", 0, 0)]
    while heap:
        cost, done, i, q = heapq.heappop(heap)
        if i == len(symbols) and q in dialogue.ENDS:
            return cost, done
        for letter, taken, to, more in dialogue._steps(symbols[i] if i < len(symbols) else None, q):
            heapq.heappush(heap, (cost + more, done + letter, i + taken, to))


def test_answers_and_shared_layers():
    r = random.Random(7)
    every = sorted({"".join(r.choice("suaoSUAOXua") for _ in range(r.randint(0, 7))) for _ in range(400)})
    made = []
    got = list(dialogue.answers(every, made))
    assert [g[0] for g in got] == every
    assert all((cost, audit) == least_edits(s) for s, cost, audit in got)
    assert len(made) == len(set(made)) == len({s[:i] for s in every for i in range(1, len(s) + 1)})  # a layer a node of the trie


def talk():
    r = random.Random(8)
    said = ["Yes.", "No", "Well. ", "", " ", "Hm?", None, "Yes."]
    out = []
    for c in range(150):
        for t in range(r.randint(0, 9)):
            role = r.choice(["system", "user", "assistant", "assistant", "user", "tool", None])
            out.append((c if c != 5 else None, r.choice([t, t, t, t * 2, None]), role, r.choice(said) if r.random() < 0.5 else f"word {r.random()}."))
    return out + out[:40] + [(900, 1, "user", "a"), (901, None, None, None)]


def test_repair_against_sql(spark):
    df = spark.createDataFrame(talk(), CONV)
    clash = df.withColumns({"k": F.lit(1), "row": F.lit(2), "said": F.lit("x"), "kind": F.lit(0)}).repartition(4)
    got = dialogue.repair_digests(clash).toArrow()
    assert rows(got) == rows(in_duckdb(dialogue.SQL, conversations=df))
    assert max(got["cost"].to_pylist()) > 0 and max(got["illegal"].to_pylist()) > 0
    assert dialogue.repair_digests(df.limit(0)).count() == 0


def test_conversations_without_rows_and_very_long_ones(spark):
    long_ = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(30_001)]
    df = spark.createDataFrame([*long_, (2, 0, "user", "?"), (2, 1, "tool", "!")], CONV)
    report, turns = dialogue.repairs(df, spark.createDataFrame([(7,), (7,), (1,)], "conv_id long"))
    got = {x["conv_id"]: x for x in report.collect()}
    assert got[7]["audit"] == "" and got[7]["cost"] == got[7]["gaps"] == 0
    assert got[1]["audit"] == "K" * 30_000 + "D"
    assert got[2]["audit"] == "KR"
    said = dialogue.repaired_conversations(df, None).where("conv_id = 2").orderBy("place").collect()
    assert [(x["role"], x["text"]) for x in said] == [("user", "?"), ("assistant", "!")]
    digest = {x["k"]: x["repaired_sha256"] for x in turns.mapInArrow(dialogue._digests, "k string, repaired_sha256 string").collect()}
    assert digest["=7"] == hashlib.sha256(b"").hexdigest() and digest["=2"] == hashlib.sha256(b"user:?\nassistant:!").hexdigest()


# ---- 13


def test_traversal_against_whole_trees():
    for n in (1, 2, 3, 5, 16, 17, 31, 100, 257):
        leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
        height = (n - 1).bit_length()
        for extra, sub in ((0, 1), (0, 3), (2, 4)):
            levels = [leaves]
            for _ in range(height + extra):
                low = levels[-1]
                levels.append([manifest.parent(*low[i : i + 2]) for i in range(0, len(low), 2)])
            steps = manifest.traverse(leaves, height + extra, sub)
            assert next(steps) == levels[-1][0]
            want = [[low[(i >> k) ^ 1] if (i >> k) ^ 1 < len(low) else None for k, low in enumerate(levels[:-1])] for i in range(n)]
            assert list(steps) == want


def test_manifest_against_sql(spark):
    r = random.Random(9)
    base = [(i, r.choice([None, "", "text é " * r.randint(1, 9)]), r.choice(["en", "en", "en", "de", "", None, "é"]), r.choice(["s", None]), r.choice([None, 3])) for i in range(300)]
    base += [(7, "again", "en", "s", 1)] * 3 + [(None, None, None, None, None), (999, "alone", "zz", "s", 5)]
    docs = spark.createDataFrame(base, DOCS)
    clash = docs.withColumns({"root": F.lit(1), "path": F.lit(2), "g": F.lit(3), "pos": F.lit(4), "leaf": F.lit(5)}).repartition(4)
    want = rows(in_duckdb(manifest.SQL, documents=docs))
    assert rows(manifest.manifest_digests(clash).toArrow()) == want
    leaves = docs.select("*", manifest.leaf_hash().alias("leaf"), F.lit("x").alias("root"))
    few = manifest.manifest(leaves, height=2).withColumn("end", manifest.folded(F.col("leaf"), F.col("path")))  # several tiers of blocks
    few = few.withColumn("proof_sha256", manifest.proof_digest(F.col("path")))
    names = ["doc_id", "leaf", "proof_sha256", "root", "subroot"]  # of the query's columns, in order, those but folded_root and verified
    assert few.where("end <> root").isEmpty()
    assert rows(few.select(*names).toArrow()) == sorted((x[0], *x[2:6]) for x in want)
    assert manifest.manifest_digests(docs.limit(0)).count() == 0


def test_a_changed_row_fails(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", None if i % 2 else 1) for i in range(60)], DOCS)
    got = manifest.manifest_digests(docs).collect()
    hit = {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert {x["doc_id"] for x in got if not x["verified"]} == {i for i in hit if i % 2 == 0} != set()
    assert len({x["root"] for x in got}) == 1


@pytest.mark.parametrize("name", ["op12_repair", "op13_manifest"])
def test_new_queries(spark, name):
    from tessera.llm import queries
    from tests.test_queries import same

    assert set(TABLES)
    same(spark, name, queries.QUERIES, queries.SQL, SF)
