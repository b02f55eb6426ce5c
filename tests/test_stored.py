"""What is kept between runs: versions, stores, vector caches, saved steps; and back ends and tools that fail."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.plans import registry as P
from tessera.sources import files as S
from tessera.sources import shared, stored


def test_versions_are_committed_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert stored.load_version(spark, folder, "id long").isEmpty()
    stored.save_version(spark.range(3), folder)
    stored.write_version(spark.range(9), folder)  # a save that ended before its commit
    shared.put_files(spark, f"{folder}/_commits", {"000000000009": "v-gone"})  # and one that ended while the pointer was written
    assert stored.load_version(spark, folder, "id long").count() == 3
    with pytest.raises(PySparkException):
        stored.save_version(spark.range(2).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), folder)
    assert stored.load_version(spark, folder, "id long").count() == 3
    for n in (4, 5, 6):
        stored.save_version(spark.range(n), folder)
    assert stored.load_version(spark, folder, "id long").count() == 6
    assert len([p for p in (tmp_path / "v" / "_commits").iterdir() if p.name.isdigit() and p.read_text().endswith("\n")]) == 2  # old ones go


def test_a_state_that_cant_be_read_is_no_empty_state(spark, tmp_path):
    S.save_state(spark.range(3), str(tmp_path), "t")
    for f in tmp_path.rglob("part-*.parquet"):
        f.write_bytes(b"no parquet")
    for f in tmp_path.rglob(".part-*.crc"):
        f.unlink()
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        S.load_state(spark, str(tmp_path), "t", "id long").collect()


def test_merge_rewrites_the_parts_that_it_touches(spark, tmp_path):
    path, r, want = str(tmp_path / "s"), random.Random(2), {}
    assert stored.read_store(spark, path, "a long, b string, v string, ord long").isEmpty()
    for turn in range(4):
        rows = [(r.choice([None, *range(30)]), r.choice(["x", "y", None]), f"{turn}-{i}", turn * 100 + i if turn != 2 else i) for i in range(40 if turn < 3 else 1)]
        for a, b, v, o in rows:
            if (a, b) not in want or o >= want[a, b][1]:
                want[a, b] = (v, o)
        n = stored.merge_into(spark.createDataFrame(rows, "a long, b string, v string, ord long"), path, ["a", "b"], "ord", parts=8)
        assert n == 1 if turn == 3 else n > 1
        assert {(x["a"], x["b"]): (x["v"], x["ord"]) for x in stored.read_store(spark, path, "a long, b string, v string, ord long").collect()} == want
    assert stored.merge_into(spark.createDataFrame([], "a long, b string, v string, ord long"), path, ["a", "b"], "ord") == 0
    stored.merge_into(spark.createDataFrame([(*next(iter(want)), "new", 10**6)], "a long, b string, v string, ord long"), path, ["a", "b"], "ord", keep_old=True)
    assert "new" not in {x["v"] for x in stored.read_store(spark, path, "a long, b string, v string, ord long").collect()}


class Lengths:
    name, usd_in, usd_out = "lengths", 1.0, 0.0

    def __init__(self, may=lambda t: True):
        self.may = may

    def run(self, texts):
        return [[float(len(t))] if self.may(t) else ValueError("not again") for t in texts]


def test_cached_vectors_are_not_made_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 50}" if i % 7 else None) for i in range(200)], "id long, text string").withColumns({"key": F.lit(1), "used": F.lit(2)})
    cache = str(tmp_path / "c")
    first = {r["id"]: r["embedding"] for r in P.embed(rows, Lengths(), cache=cache).collect()}
    again = P.embed(rows, Lengths(lambda t: False), cache=cache).collect()
    assert {r["id"]: r["embedding"] for r in again} == first and all(r["error"] is None for r in again)
    more = P.embed(spark.createDataFrame([(1, "text 1"), (2, "other")], "id long, text string"), Lengths(lambda t: t == "other"), cache=cache).collect()
    assert {r["id"]: r["error"] for r in more} == {1: None, 2: None}


def test_cached_vectors_that_were_used_longest_ago_go(spark, tmp_path):
    cache, texts = str(tmp_path / "c"), lambda a, b: spark.createDataFrame([(f"t{i}",) for i in range(a, b)], "text string")
    kept = lambda: stored.load_version(spark, cache, P.CACHE)
    P.embed(texts(0, 40), Lengths(), cache=cache, most=60)
    P.embed(texts(30, 60), Lengths(), cache=cache, most=60)
    assert kept().count() == 60
    P.embed(texts(0, 10), Lengths(), cache=cache, most=45)  # uses the oldest ones again: of the rest 20 must go, of those of the first call
    assert kept().groupBy("used").count().orderBy("used").collect() == [(1, 5), (2, 30), (3, 10)] or kept().count() == 45
    assert kept().where("used = 3").count() == 10 and kept().where("used = 2").count() == 30
    P.embed(texts(100, 130), Lengths(lambda t: False), cache=cache, most=45)  # failures are not kept
    assert kept().count() == 45 and kept().where("used = 4").isEmpty()


class Fails:
    name, usd_in, usd_out = "fails", 1.0, 0.0

    def __init__(self, how):
        self.how = how

    def run(self, texts):
        if self.how == "at once":
            raise RuntimeError("down")
        if self.how == "short":
            return [1.0 for _ in texts[:-1]]
        if self.how == "type":
            return [1.0 if t != "b" else "no number" for t in texts]
        return (1.0 if t != "b" else 1 / 0 for t in texts)


@pytest.mark.parametrize("how, want", [("at once", ["down"] * 3), ("short", [None, None, "no answer"]), ("midway", [None, "division by zero", "division by zero"]), ("type", [None, "?", None])])
def test_back_ends_that_fail_leave_rows(spark, how, want):
    rows = spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, "c")], "id long, text string").coalesce(1)
    got = P.with_model(rows, Fails(how), "double").orderBy("id").collect()
    assert got[1]["error"] is None and got[1]["answer"] is None
    for r, w in zip((got[0], got[2], got[3]), want):
        assert (r["answer"] is None) == (w is not None) and (r["error"] == w or w == "?" and r["error"])


def test_saved_steps_resume(spark, tmp_path):
    folder, steps = str(tmp_path / "s"), spark.createDataFrame([(s, i) for s, n in (("a", 12), ("b", 3), (None, 6)) for i in range(1, n + 1)], "session string, step_num long")
    S.checkpoint_steps(steps.where("step_num < 8"), folder)
    S.checkpoint_steps(steps.where("session = 'a'"), folder)  # others stay as they were saved
    got = S.resume_steps(spark, folder, "session string, step_num long")
    assert {(r["session"], r["step_num"]) for r in got.where("resumes").collect()} == {("a", 10), (None, 5)} and got.count() == 15
    assert S.resume_steps(spark, str(tmp_path / "none"), "session string, step_num long").isEmpty()


class Longest:
    def __init__(self):
        self.best = (None, None)

    def eval(self, row):
        self.best = max(self.best, (len(row["text"] or ""), row["conv"]), key=lambda b: b[0] or 0)

    def terminate(self):
        yield self.best[1], self.best[0]


def test_tools_as_table_functions(spark):
    r = P.Registry()
    r.register_table_function(spark, "tessera_longest", Longest, "conv long, n long")
    rows = spark.createDataFrame([(1, 1, "abc"), (1, 2, "abcde"), (2, 1, None), (2, 2, "x")], "conv long, turn long, text string")
    out = r.run(spark, "tessera_longest", rows, ["conv"], ["turn"])
    assert r.has("tessera_longest") and sorted(x["output"] for x in out.collect()) == ['{"conv":1,"n":5}', '{"conv":2,"n":1}']
    rows.createOrReplaceTempView("said")
    assert spark.sql("SELECT sum(n) FROM tessera_longest(TABLE(said) PARTITION BY conv ORDER BY turn)").first()[0] == 6


def test_mailbox_over_batches(spark, tmp_path):
    from tessera.streaming import steps as ST

    say = lambda *rows: spark.createDataFrame([("s", i, k, t) for i, k, t in rows], "session string, seq long, kind string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: sorted((r["seq"], r["answer"]) for r in ST.drain(ST.mailbox(ST.stream_table(spark, str(tmp_path / "in"), "*.parquet")), folder=str(tmp_path / "out")).collect())
    say((1, "has", None), (2, "guidance", None), (3, "put", "x" * 2000), (4, "peek", None), (5, "guide", "g" * 2000))
    assert run() == [(1, "false"), (2, ""), (4, "x" * 2000)]
    say((6, "has", None), (7, "consume", None), (8, "peek", None), (9, "consume", None), (10, "guidance", None), (11, "put", None), (12, "clear", None), (13, "has", None))
    assert run()[3:] == [(6, "true"), (7, "x" * 2000), (10, "g" * 1000), (13, "false")]
