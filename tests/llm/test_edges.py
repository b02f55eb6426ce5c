"""Second opinions on the corpus operators: other implementations, measured recall, odd rows, very long texts, hot keys and the branches beyond size limits."""

import hashlib
import math
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontaminate, lines, linking, mixing, neardup, pseudonyms, quality, secrets, shards, substrings
from tests.llm.test_corpus import components

TEXTS = "doc_id long, text string"


# ---- other implementations


def plain_shift(part, seed):
    stream = hashlib.sha256(seed.encode()).hexdigest()
    out = ""
    for i, c in enumerate(part):
        k = int(stream[(i * 2) % 60 : (i * 2) % 60 + 3], 16)
        for base, n in (("0", 10), ("a", 26), ("A", 26)):
            if ord(base) <= ord(c) < ord(base) + n:
                c = chr(ord(base) + (ord(c) - ord(base) + k) % n)
                break
        out += c
    return out


def plain_text(value, kind, key):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(8):
        if i % 2 == 0:
            left = plain_shift(left, f"{key}|{kind}|{i}|{right}")
        else:
            right = plain_shift(right, f"{key}|{kind}|{i}|{left}")
    return left + right


def plain_pair(left, right, a, b, kind, key):
    number = lambda seed, n: int(hashlib.sha256(seed.encode()).hexdigest()[:15], 16) % n
    for i in range(8):
        if i % 2 == 0:
            left = (left + number(f"{key}|{kind}|{i}|{right}", a)) % a
        else:
            right = (right + number(f"{key}|{kind}|{i}|{left}", b)) % b
    return left, right


def test_feistel_networks_against_plain_python(spark):
    r = random.Random(3)
    values = ["".join(r.choice("0123456789abcXYZ-.") for _ in range(r.randint(1, 20))) for _ in range(60)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", pseudonyms.feistel_text(F.col("v"), "mail", "secret").alias("p")).collect()
    assert all(x["p"] == plain_text(x["v"], "mail", "secret") for x in got)
    pairs = [(r.randrange(517), r.randrange(142)) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", pseudonyms.feistel_pair(F.col("a"), F.col("b"), 517, 142, "date", "k").alias("p")).collect()
    assert all(tuple(x["p"]) == plain_pair(x["a"], x["b"], 517, 142, "date", "k") for x in got)


def test_addresses_keep_their_widths(spark):
    given = ["10.1.2.3", "010.001.002.003", "192.168.0.255", "0.0.0.0"]
    rows = [(i, v) for i, v in enumerate(given)] + [(9, "10.1.2.3"), (None, "10.1.2.3"), (9, "10.1.2.3"), (None, None)]
    out = pseudonyms.pseudonymise(spark.createDataFrame(rows, TEXTS), "k").collect()
    by = {r["doc_id"]: r["text"] for r in out if r["doc_id"] is not None}
    for i, v in enumerate(given):
        assert [len(x) for x in by[i].split(".")] == [len(x) for x in v.split(".")] and all(int(x) <= 255 for x in by[i].split("."))
        assert [x.startswith("0") and len(x) > 1 for x in by[i].split(".")] == [x.startswith("0") and len(x) > 1 for x in v.split(".")]
    assert len(out) == len(rows) and by[9] == by[0] and sorted(r["text"] or "" for r in out if r["doc_id"] is None) == ["", by[0]]
    every = spark.range(100).select(F.concat(F.lit("1.2.3."), F.col("id").cast("string")).alias("v")).where("length(v) = 8")
    assert every.select(pseudonyms._ip(F.col("v"), "k")).distinct().count() == 90
    with pytest.raises(TypeError):
        pseudonyms.pseudonymise(every)


def test_attention_against_loops():
    r = np.random.default_rng(1)
    bags = [r.normal(size=(n, quality.FEATURES)) for n in (1, 4, 7)]
    model = quality.Attention(np.full(quality.FEATURES, 0.1), np.full(quality.FEATURES, 2.0))
    got = model.forward(np.concatenate(bags), np.array([0, 1, 5, 12]))[0]
    p = model.p
    for bag, score in zip(bags, got):
        hidden, weight = [], []
        for x in bag:
            h = [math.tanh(sum((x[i] - 0.1) / 2 * p["w"][i][j] for i in range(len(x))) + p["b"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * p["v"][i][j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * p["u"][i][j] for i in range(len(h))))) for j in range(len(h))]
            hidden.append(h)
            weight.append(math.exp(sum(g * a for g, a in zip(gate, p["a"]))))
        mean = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(quality.HIDDEN)]
        assert score == pytest.approx(1 / (1 + math.exp(-(sum(m * c for m, c in zip(mean, p["c"])) + p["d"][0]))))


def test_gradients_against_differences():
    r = np.random.default_rng(2)
    x, at, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 2, 9]), np.array([1.0, 0.0])
    model = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    loss = lambda: float(-np.mean(y * np.log(model.forward(x, at)[0]) + (1 - y) * np.log(1 - model.forward(x, at)[0])))
    found = model.gradients(x, at, y)
    for name, place in (("w", (3, 2)), ("v", (1, 4)), ("u", (0, 5)), ("a", (7,)), ("c", (2,)), ("b", (6,))):
        model.p[name][place] += 1e-5
        up = loss()
        model.p[name][place] -= 2e-5
        down = loss()
        model.p[name][place] += 1e-5
        assert found[name][place] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# ---- measured recall and precision


def test_secrets_found_among_random_strings_and_plain_ones_left():
    with open(secrets.VOCABULARY, "rb") as f:
        encode = secrets.encoder(f.read())
    r = random.Random(8)
    both = string.ascii_letters + string.digits
    for alphabet, least in ((both, 0.99), (both + "+/", 0.95), (both + "-_", 0.9), (string.ascii_letters, 0.95), (string.ascii_lowercase, 0.9), (string.ascii_lowercase + string.digits, 0.95)):
        for n in (16, 17, 20, 32, 64):
            texts = [f"key {''.join(r.choice(alphabet) for _ in range(n))} end" for _ in range(200)]
            assert sum(bool(secrets.random_spans(t, [], encode)) for t in texts) >= min(least, 0.85 if n < 20 else 1) * 200, (alphabet, n)
    plain = [
        "this-is-a-long-slug-2024", "2024-01-01T00-00-00Z-run", "/usr/lib/x86_64-linux-gnu/libc6", "ABC-12345-DEF-67890-GHI", "getUserAccountInformation", "src/main/java/com/example/HttpServletRequestWrapper", "internationalization-of-things",
        "release-v2.10.3-rc1-build-20240131", "order_id=1234567890123456", "4111111111111111111", "https://example.org/a/b/index.html", "__init__file_system_watcher__", "Schwierigkeitsgrad-Einstellungen", "SELECT_COUNT_DISTINCT_USER_ID",
        "ACGTACGTTAGCATCGATCGATCGA", "20240101T000000Z-backup-full", "python3-numpy-1-26-4-py311-linux-x86-64", "aaaaaaaaaaaaaaaaaaaaaaaa", "123e4567-e89b-12d3-a456-426614174000", "/blobs/123e4567-e89b-12d3-a456-426614174000/a1b2c3d4", "feature/JIRA-12345-fix-login-redirect-loop",
    ]
    assert [t for t in plain if secrets.random_spans(t, [], encode)] == []


def test_recall_of_near_equal_lines(spark):
    r = random.Random(6)
    rows, texts = [], []
    for n in (20, 40, 60, 100):
        for _ in range(100):
            base = "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
            texts += [f"[{base}]", f"[{base}{''.join(r.choice('xyz') for _ in range(max(1, n // 20)))}]"]
    rows = list(enumerate(texts))
    sets = [lines.character_shingles(t) for t in texts]
    near = [i for i in range(0, len(texts), 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])]
    gone = {x["doc_id"] for x in lines.drop_lines(spark.createDataFrame(rows, TEXTS)).collect() if x["n_removed"]}
    assert len(near) > 250 and len(gone & {i + 1 for i in near}) >= 0.98 * len(near) and gone <= {i + 1 for i in near}


# ---- hot keys, chunks and the branches beyond size limits


def family(r, n, words=60, edits=3):
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def near(texts, percent=80):
    sets = {i: neardup.word_shingles(t) for i, t in enumerate(texts)}
    return components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])


@pytest.mark.parametrize("limits", [{}, {"SAMPLE": 1, "HOT_ROWS": 4}, {"CHUNK": 3, "SMALL": 2}, {"SAMPLE": 1, "HOT_ROWS": 4, "CHUNK": 3, "SMALL": 2, "PACK": 5}])
def test_near_duplicates_whatever_the_limits(spark, monkeypatch, limits):
    r = random.Random(9)
    texts = family(r, 40) + family(r, 12, 40, 2) + family(r, 3) + ["alone in this corpus of words"]
    r.shuffle(texts)
    for name, value in limits.items():
        monkeypatch.setattr(linking, name, value)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_groups(spark.createDataFrame(list(enumerate(texts)), TEXTS)).collect()}
    assert got == near(texts)


@pytest.mark.parametrize("over", [False, True])
def test_joins_beyond_the_broadcast_limits(spark, monkeypatch, over):
    if over:
        monkeypatch.setattr(common, "BROADCAST_IDS", -1)
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    r = random.Random(10)
    texts = family(r, 20, 80) + family(r, 5, 120)
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_groups(df).collect()} == near(texts)
    more = df.unionByName(spark.createDataFrame([(None, "x"), (70, None)], TEXTS))
    assert Counter(x["doc_id"] for x in corpus_pipeline.deduplicate(spark, more, "").collect()) == Counter([*set(near(texts).values()), None, 70])
    side = spark.createDataFrame([(0, 5), (3, 6), (999, 7)], "doc_id long, v int")
    assert {x["doc_id"]: x["v"] for x in common.attach(more, side, ["doc_id"], F.lit(12)).collect()} == {x["doc_id"]: {0: 5, 3: 6}.get(x["doc_id"]) for x in more.collect()}
    first, removed = {}, {}
    split = [t.split() for t in texts]
    for d, w in enumerate(split):
        gone = set()
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s : s + 50]), d) < d:
                gone |= set(range(s, s + 50))
        removed[d] = len(gone)
    assert {x["doc_id"]: x["n_removed"] for x in substrings.drop_substrings(df).collect()} == removed and sum(removed.values()) > 500
    notes = [f"line {i} is one\nthe same closing words in all of these documents\nthe same closing words in all of those documents" for i in range(9)]
    out = lines.drop_lines(spark.createDataFrame(list(enumerate(notes)), TEXTS)).collect()
    assert sorted(x["n_removed"] for x in out) == [0] + [2] * 8  # the two closing lines are just under 0.8


def test_components_of_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 160)] + [(300, 299), (299, 298), (7, 100), (500, 500)]
    got = {x["id"]: x["root"] for x in linking.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components({x for e in edges[:-1] for x in e}, edges[:-1])
    assert got == want


def test_numbered_sets_are_exact():
    r = random.Random(2)
    texts = ["".join(r.choice("abé日x") for _ in range(r.randint(1, 30))) for _ in range(40)]
    sets = lines.numbered_sets(texts)
    plain = [lines.character_shingles(t) for t in texts]
    for i in range(40):
        for j in range(40):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])
    assert lines.numbered_sets(["".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]) is None


# ---- odd rows


def odd(spark):
    rows = [(1, None), (1, None), (None, "a b"), (None, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (4, "word")]
    return spark.createDataFrame(rows, TEXTS).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long"), "shard": F.lit("s"), "copy_no": F.lit("c"), "spans": F.lit("x"), "items": F.lit("y")})


def test_sharding_of_odd_rows(spark):
    out = shards.shard_table(odd(spark)).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [1] * 8 and all(r["slot"] == 0 for r in out)
    assert sorted(r["size"] for r in out if r["doc_id"] == 1) == [1, 1] and shards.shard_table(odd(spark).limit(0)).count() == 0
    few = shards.shard_table(odd(spark).limit(4)).collect()
    assert len({r["shard"] for r in few}) == 4 and all(r["slot"] == 0 for r in few)
    hot = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    out = shards.shard_documents(hot).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {625} and len({(r["shard"], r["slot"]) for r in out}) == 5000


def test_mixing_of_repeated_rows_and_ties(spark):
    rows = [(i // 2, f"t{i // 2}", "s") for i in range(40)] + [(None, "n", "s")] * 3
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"s": 1.0}, total=200).collect()
    n = Counter((r["doc_id"], r["copy_no"]) for r in out)
    assert all(v == (3 if k[0] is None else 2) for k, v in n.items()) and [r["mix_key"] for r in out] == sorted(r["mix_key"] for r in out)
    assert len({r["mix_key"] for r in out}) == len(n)


def test_quality_of_odd_rows(spark):
    good = spark.createDataFrame([(i, "plain words in a row " * 20 if i % 2 else "$$$ !!! ### " * 40) for i in range(200)], TEXTS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(5, 1, 0)] * 3, "doc_id long, quality int, toxic int")
    model = quality.fit(good.unionByName(good.where("doc_id < 50")), labels)
    again = quality.fit(good, labels)
    assert np.allclose(model.p["w"], again.p["w"])  # repeated rows make one bag
    long_ = spark.createDataFrame([(900, "plain words in a row " * 200_000), (901, None)], TEXTS)
    out = {r["doc_id"]: r["score"] for r in quality.score(odd(spark).select("doc_id", "text").unionByName(long_), model).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and out[1] == out[2] == out[901] and out[900] > 0.7
    assert quality.quality_scores(good.limit(0), labels).count() == 0
    assert all(zlib.crc32(str(i).encode()) % 4 == r for i, r in [(x["doc_id"], 2) for x in quality.quality_scores(good, labels).where("held_out").collect()])


def test_secrets_and_benchmark_items_in_long_texts(spark):
    filler = "some plain words of a long text without anything in it " * 60_000
    df = spark.createDataFrame([(1, filler + "password=hunter2222 " + filler), (2, filler)], TEXTS).withColumns({"spans": F.lit("x"), "items": F.lit("y")})
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(df).collect()}
    assert got == {1: f"assign:{len(filler)}:{len(filler) + 19}", 2: ""}
    bench = spark.createDataFrame([(5, "a benchmark question of some length stands here")], "item_id long, text string")
    longer = df.withColumn("text", F.concat("text", F.when(F.col("doc_id") == 2, "A benchmark question of some lenght stands here").otherwise("")))
    assert {r["doc_id"]: r["items"] for r in decontaminate.contamination(longer, bench).collect()} == {1: [], 2: [5]}
    assert decontaminate.drop_contaminated(longer, bench).columns == longer.columns and decontaminate.contamination(df.limit(0), bench).count() == 0
    assert secrets.scan_secrets(odd(spark)).where("spans <> ''").count() == 0


def test_one_very_long_row(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(50_000)}" for _ in range(300_000)]
    text = "\n".join(" ".join(words[i : i + 10]) for i in range(0, len(words), 10))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], TEXTS)
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_groups(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x["doc_id"]: x["n_removed"] for x in substrings.drop_substrings(df).collect()} == {1: 0, 2: 300_000, 3: 0}
    assert {x["doc_id"]: x["n_removed"] for x in lines.drop_lines(df).collect()}[2] >= 29_999


def test_pipeline_stages_on_odd_and_empty_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "never seen in any of these texts")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert out.columns == [*docs.columns, "shard", "slot"] and (out.count() > 0) == (rows is docs)
    docs.write.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    mixed = Counter(corpus_pipeline.mixed(spark, docs, sf).select("doc_id").rdd.map(lambda r: r[0]).collect())
    assert Counter(r["doc_id"] for r in out) == mixed
    assert max(Counter(r["shard"] for r in out).values()) - min(Counter(r["shard"] for r in out).values()) <= 1
