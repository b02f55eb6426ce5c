"""PII against a second implementation of the whole operator; near-duplicates, lines and tasks where names or sizes are odd."""

import datetime
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, lines, linking, neardup, pseudonyms, quality, secrets
from tests.llm.test_corpus import components
from tests.llm.test_edges import plain_pair, plain_text

KEY = "secret"


# ---- PII


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def plain_value(v, kind):
    d = re.sub("[^0-9]", "", v)
    if kind == "card":
        p = plain_text(d[:-1], "card", KEY)
        return refill(v, p + str((10 - luhn(p + "0")) % 10))
    if kind == "email":
        at = v.index("@")
        return plain_text(v[:at], "email", KEY) + v[at:]
    if kind == "phone":
        shape = v.replace("(0)", "(_)")
        d = re.sub("[^0-9]", "", shape)
        n = 1 if d[0] in "17" else 2 if d[:2] in pseudonyms.COUNTRY_2 else 3
        return refill(shape, d[:n] + plain_text(d[n:], "phone", KEY)).replace("(_)", "(0)")
    if kind == "ssn":
        a, g, s = map(int, v.split("-"))
        valid = [x for x in range(1, 900) if x != 666]
        left, right = plain_pair(valid.index(a) * 99 + g - 1, s - 1, 898 * 99, 9999, "ssn", KEY)
        return f"{valid[left // 99]:03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if kind == "date":
        first = datetime.date(1900, 1, 1)
        n = (plain_day(v) - first).days
        left, right = plain_pair(n // 142, n % 142, 517, 142, "date", KEY)
        out = first + datetime.timedelta(left * 142 + right)
        return out.strftime({"-": "%Y-%m-%d", "/": "%Y/%m/%d"}.get(v[4]) or {".": "%d.%m.%Y", "/": "%d/%m/%Y"}[v[2]])
    parts = v.split(".")
    cells = []
    for t in parts:
        zero = t[0] == "0" and len(t) > 1
        every = [x for x in range(256 if not zero else 10 ** (len(t) - 1)) if (zero or len(str(x)) == len(t)) and len(str(x)) <= len(t)]
        cells.append(every)
    at = [c.index(int(t)) for c, t in zip(cells, parts)]
    n = [len(c) for c in cells]
    left, right = plain_pair(at[0] * n[1] + at[1], at[2] * n[3] + at[3], n[0] * n[1], n[2] * n[3], "ip", KEY)
    new = [left // n[1], left % n[1], right // n[3], right % n[3]]
    return ".".join(str(c[x]).rjust(len(t), "0") for c, x, t in zip(cells, new, parts))


def plain_day(v):
    y, m, d = (v[:4], v[5:7], v[8:10]) if v[4] in "-/" else (v[6:], v[3:5], v[:2])
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def plain_kind(v):
    if "@" in v:
        return "email"
    if v[0] == "+":
        return "phone" if 7 <= len(re.sub("[^0-9]", "", v.replace("(0)", ""))) <= 15 else None
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
        return "ip" if max(map(int, v.split("."))) < 256 else None
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", v):
        return None if v[:3] in ("000", "666") or v[0] == "9" or v[4:6] == "00" or v[7:] == "0000" else "ssn"
    if len(v) == 10 and not v.isdigit():
        day = plain_day(v)
        return "date" if day and 1900 <= day.year <= 2100 else None
    return None


def plain_pseudonyms(text):
    """Text and counts, from left to right; a card reaches over the matches inside it."""
    out, at, counts = "", 0, Counter()
    for m in re.finditer(pseudonyms.ANY, text):
        if m.start() < at:
            continue
        value, kind = m.group(0), None
        if m.group(1):
            run = m.group(1)
            for end in range(len(run), 12, -1):
                d = re.sub("[^0-9]", "", run[:end])
                if len(d) >= 13 and run[end - 1].isdigit() and run[end : end + 1] in ("", " ", "-") and luhn(d) == 0:
                    value, kind = run[:end], "card"
                    break
        kind = kind or plain_kind(value)
        if kind:
            out += text[at : m.start()] + plain_value(value, kind)
            at = m.start() + len(value)
            counts[kind] += 1
    return out + text[at:], counts


def piece(r):
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        p = digits(r.choice([12, 14, 15, 18]))
        d = p + str((10 - luhn(p + "0")) % 10)
        sep = r.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    made = [
        card, lambda: card() + " " + digits(r.choice([2, 3, 4])), lambda: digits(r.randint(1, 3)) + " " + card(), lambda: digits(16), lambda: "-".join(map(digits, (3, 2, 4))), lambda: f"{r.choice(['000', '666', '912', '123'])}-{r.choice(['00', '12'])}-{r.choice(['0000', '0001'])}",
        lambda: ".".join(r.choice(["0", "007", "10", "255", "256", "99", "00", digits(1)]) for _ in range(4)), lambda: f"{r.randint(1850, 2150)}-{r.randint(0, 13):02d}-{r.randint(0, 32):02d}", lambda: f"{r.randint(1, 29):02d}{r.choice('./')}{r.randint(1, 12):02d}.{r.randint(1900, 2100)}",
        lambda: f"{r.randint(1900, 2100)}/{r.randint(1, 12):02d}/{r.randint(1, 28):02d}", lambda: f"{r.choice(['a.b', 'X_9', 'jo+n', '7'])}@{r.choice(['ex.org', 'A-b.co.uk', 'no'])}", lambda: "+" + r.choice(["1", "44", "353", "49"]) + r.choice(["", " "]) + digits(3) + r.choice(["", " ", "-"]) + digits(4),
        lambda: f"+49 (0)30 {digits(4)} {digits(3)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: r.choice(["word", "é日", "", "x1", "@", "+", "..", "\n"]), lambda: digits(r.randint(1, 25)),
    ]
    return r.choice(made)()


def test_pseudonyms_against_a_second_implementation(spark):
    r = random.Random(12)
    texts = ["".join(piece(r) + r.choice([" ", " ", ", ", "\n", "", "-", "."]) for _ in range(r.randint(1, 8))) for _ in range(1000)]
    got = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4), KEY).collect()
    found = Counter()
    for x in got:
        want, counts = plain_pseudonyms(texts[x["id"]])
        assert x["text"] == want, texts[x["id"]]
        assert {k: x[f"n_{k}"] for k in pseudonyms.KINDS} == {k: counts[k] for k in pseudonyms.KINDS}, texts[x["id"]]
        found += counts
    assert min(found[k] for k in pseudonyms.KINDS) > 50


def test_social_security_numbers_stay_valid_and_apart(spark):
    r = random.Random(13)
    numbers = list({f"{r.choice([x for x in range(1, 900) if x != 666]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" for _ in range(10_000)} | {"001-01-0001", "899-99-9999", "665-01-0001", "667-99-9999"})
    got = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(numbers)), "id long, text string"), KEY).collect()
    assert all(plain_kind(x["text"]) == "ssn" and x["n_ssn"] == 1 for x in got) and len({x["text"] for x in got}) == len(numbers)


def test_spellings_of_a_telephone_number_stay_linked(spark):
    spellings = ["+15551234567", "+1 555-123-4567", "+1 (555) 123-4567", "+1.555.123.4567", "+1 555 1234567"] + ["+49 30 123456", "+4930123456", "+49 (0)30 123456"] + ["+353 1 234 5678", "+35312345678"]
    got = [re.sub("[^0-9]", "", x["text"].replace("(0)", "")) for x in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(spellings)), "id long, text string"), KEY).orderBy("id").collect()]
    assert [len(set(got[a:b])) for a, b in ((0, 5), (5, 8), (8, 10))] == [1, 1, 1]
    assert [got[0][:1], got[5][:2], got[8][:3]] == ["1", "49", "353"] and got[0] != "15551234567"


# ---- near-duplicates with repeated ids


def odd_ids():
    r = random.Random(14)
    prose = lambda: [f"w{r.randrange(10**6)}" for _ in range(120)]
    a, b, c = prose(), prose(), prose()
    t = lambda w, *more: " ".join([*w, *more])
    return [(1, t(a)), (2, t(a, "more")), (2, t(b)), (5, t(b)), (6, t(b, "more")), (7, t(c)), (7, ""), (8, None), (8, t(c, "other")), (9, t(prose())), (9, t(prose())), (None, t(a)), (None, t(b))]


@pytest.mark.parametrize("turn", [1, -1])
def test_an_id_with_several_texts_links_all_of_them(spark, turn):
    rows = odd_ids()[::turn]
    sets = [(i, neardup.word_shingles(t or "")) for i, t in rows if i is not None]
    links = [(i, j) for i, s in sets for j, u in sets if s and u and 100 * len(s & u) >= 80 * len(s | u)]
    want = components({i for i, _ in rows if i is not None}, links)
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 80).collect()
    assert len(got) == len(rows) and {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None} == want
    assert sorted(x["n_shingles"] for x in got) == sorted(len(neardup.word_shingles(t or "")) for _, t in rows)
    assert all(x["kept"] for x in got if x["doc_id"] is None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(3))
    kept = sorted(str(x["doc_id"]) for x in corpus_pipeline.deduplicate(spark, docs, "").collect())
    assert kept == sorted(str(i) for i, _ in rows if i is None or want[i] == i)


# ---- lines and tasks


def test_lines_that_share_a_hash_are_named_apart():
    import pyarrow as pa

    rows = np.zeros(6, lines._RECORD)
    rows["h1"], rows["h2"], rows["doc"], rows["c"], rows["size"] = [7, 7, 7, 8, 9, 9], [1, 2, 1, 1, 1, 3], [4, 5, 3, 1, 1, 1], 1, 30
    block = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([rows.tobytes()], pa.binary())], names=["pid", "rows"])
    got = pa.Table.from_batches(list(lines._distinct([block]))).to_pylist()
    assert [(x["h1"], x["h2"], x["c"], x["doc"]) for x in got] == [(7, 1, 2, 3), (7, 2, 1, 5), (8, 1, 1, 1), (9, 1, 1, 1), (9, 3, 1, 1)]
    assert len({x["id"] for x in got}) == 5 and [x["id"] for x in got if x["h2"] == 1] == [7, 8, 9]


def test_very_long_lines_in_many_small_buckets(spark):
    """Weights, not only counts, decide how many rows one call compares."""
    rows = spark.range(3000).select(F.col("id").alias("key"), "id", F.col("id").alias("root"), F.lit(1 << 20).cast("long").alias("w"), F.lit(None).cast("binary").alias("sig"))
    packs = lambda texts: linking._dealt(rows, F.lit(1), texts).select("pack").distinct().count()
    assert packs(False) == 1 and packs(True) > 100


def test_very_long_lines_alike(spark):
    r = random.Random(15)
    base = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    texts = [base, base[:200_000] + "XYZ" + base[200_000:], base.upper(), "short line here", "".join(r.choice("stuvwxyz ") for _ in range(400_000))]  # nearly all shingles of an alphabet
    got = {x["doc_id"]: x["n_removed"] for x in lines.drop_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}


def test_tasks_follow_the_bytes(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert linking.dealt_to(spark, 0) == least and linking.dealt_to(spark, 10 << 40) == -(-(10 << 40) // linking.DEALT)


def test_bit_maps_grow_with_their_keys(spark):
    keys = spark.range(0, 60_000, 3).withColumnRenamed("id", "k")
    marked = common._maybe(spark.range(60_000).withColumnRenamed("id", "k"), keys, ["k"]).groupBy((F.col("k") % 3 == 0).alias("in"), "_maybe").count().collect()
    n = defaultdict(int, {(x["in"], x["_maybe"]): x["count"] for x in marked})
    assert n[True, True] == 20_000 and n[True, False] == 0 and n[False, True] < 5_000


# ---- secrets and quality


def plain_base(text):
    """The base patterns character by character."""
    out, n = [], len(text)
    run = lambda i, ok: next((j for j in range(i, n) if not ok(text[j])), n)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    value = lambda c: c.lower() in letters + digits + "+/_.=-" and c.isascii()
    i = 0
    while i < n:
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[i : i + len(word)].isascii() and text[i : i + len(word)].lower() == word:
                j = i + len(word)
                j += text[j : j + 1] in ('"', "'") and j < n
                j = run(j, lambda c: c == " ")
                if text[j : j + 1] in (":", "=") and j < n:
                    j = run(j + 1, lambda c: c == " ")
                    j += text[j : j + 1] in ('"', "'") and j < n
                    end = run(j, value)
                    if end == j:
                        end = None
                    elif end - j >= 6:
                        out.append((i, 0, end))
                break
        i = end or i + 1
    i = 0
    while i < n:
        end = run(i + 4, lambda c: c in letters.upper() + digits) if text.startswith("AKIA", i) else i
        if end > i + 4 and end - i >= 20:
            out.append((i, 1, end))
        i = end if end > i + 4 else i + 1
    i = 0
    while i < n:
        end = run(i, lambda c: c in digits + "abcdef")
        if end - i >= 24:
            out.append((i, 2, end))
        i = max(end, i + 1)
    return sorted(out)


def test_base_spans_against_a_second_implementation():
    r = random.Random(16)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "tokentoken", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAKIA", "abcdef0123456789", "deadbeef", "Z9", "ABCDEFGH12", "x/y+z=", "-_.", "é", "\n", "ſecret", "toKen", "0123456789abcdef01234567"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert secrets.base_spans(text) == plain_base(text), repr(text)


def test_a_byte_bound_leaves_large_documents_out_of_the_fit(spark):
    docs = spark.createDataFrame([(i, ("good words here again " if i % 2 else "zq xv 77 && ") * (8 if i else 50_000)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, train_bytes=20_000)
    out = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    assert min(v for i, v in out.items() if i % 2) > max(v for i, v in out.items() if i % 2 == 0)
    assert quality.fit(docs, labels, train_bytes=0) == 0.5
