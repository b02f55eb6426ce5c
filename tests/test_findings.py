"""Queries on small tables of their own, for the findings of round 4."""

import math
from datetime import datetime

import duckdb

from tessera.operators import eventlog as E
from tessera.plans import catalogue

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(*rows):
    """Events numbered as they come: user, type, value."""
    return [(i, datetime(2024, 1, 1), u, t, float(v), "{}") for i, (u, t, v) in enumerate(rows)]


def sum_in_order(values):
    """The sum of doubles, one after the other (sum() corrects its errors)."""
    now = 0.0
    for v in values:
        now += v
    return now


def both(spark, folder, name, table, rows, schema):
    """Rows of a query over one table, and those of its SQL with one thread, which adds in the order of the file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)), con.sql(catalogue.SQL[name])
    return sorted(map(tuple, got.collect()), key=str), sorted(want.select(*got.columns).fetchall(), key=str)


def test_an_advice_is_answered_with_its_whole_text(spark, tmp_path):
    """Even turns put, odd ones guide or clear. Guidance keeps the first 1,000 characters, as in the reference."""
    text = [f"{t}{'x' * 3000}the end of {t}" for t in range(6)]
    rows = [(7, t, "user", x) for t, x in enumerate(text)]
    got, want = both(spark, tmp_path, "stream_mailbox", "conversations", rows, "conv_id long, turn long, role string, text string")
    assert got == want
    answers = {seq: answer for _, seq, kind, answer in got if kind != "has"}
    assert answers == {4: text[0], 5: text[1][:1000], 7: text[2], 8: text[2], 13: text[4], 14: text[1][:1000], 16: text[4], 17: text[4]}


def test_exact_sums(spark):
    """Equal amounts are equal however they come about; what decimals don't hold is added as doubles; nulls count for nothing."""
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.3), ("b", 0.3), ("c", 1e300), ("c", 1.0), ("d", inf), ("d", None), ("e", None), ("f", nan), ("f", 1.0), *[("g", 9e19)] * 3, ("h", 1e-12), ("h", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for dealt in (df.coalesce(1), df.repartition(5)):
        got = dict(map(tuple, E.exact_sum(dealt, ["k"], "v").collect()))
        assert math.isnan(got.pop("f")) and got == {"a": 0.6, "b": 0.6, "c": 1e300, "d": inf, "e": None, "g": 2.7e20, "h": 1e-12}


def test_a_cost_at_a_limit_does_not_exceed_it(spark, tmp_path):
    """Added as doubles in the order of event_id, the file of session 1 is above 900 and the total of session 4 above 3000."""
    file, total = [113.39, 240.6, 359.67, 186.34], [721.18, 332.15, 625.23, 412.17, 131.25, 272.13, 416.05, 89.84]
    assert sum_in_order(file) > 900 and sum_in_order(total) > 3000
    types = ["click", "view", "signup", "error", "view", "purchase", "error", "signup"]
    rows = events(*[(1, "click", v) for v in file], *[(2, "click", v) for v in [*file, 0.01]], *[(4, t, v) for t, v in zip(types, total)], *[(5, t, v) for t, v in zip(types, [*total[:-1], 89.85])])
    got, _ = both(spark, tmp_path, "cost_escalation", "events", rows, EVENTS)
    assert got == [(2, "click", "file"), (5, None, "total")]


def test_an_average_at_the_limit_reaches_it(spark, tmp_path):
    """Three or four views of 60 on average are an answer, which doubles miss in this order; one cent less is none. Clicks are no votes."""
    three, four = [70.66, 98.42, 10.92], [71.89, 94.88, 3.45, 69.78]
    assert sum_in_order(three) / 3 < 60 and sum_in_order(four) / 4 < 60
    rows = events(*[(1, "view", v) for v in three], *[(2, "view", v) for v in four], *[(3, "view", v) for v in [*three[:-1], 10.91]], (3, "click", 400), (4, "click", 400))
    got, _ = both(spark, tmp_path, "priority_answer", "events", rows, EVENTS)
    assert got == [(1, "view", False), (2, "view", False), (3, "view", True)]


def test_equal_costs_stand_by_name(spark, tmp_path):
    """Added as doubles in the order of event_id, the views cost more than the purchases; both cost 0.60."""
    rows = events((1, "view", 0.1), (1, "view", 0.2), (1, "view", 0.3), (1, "purchase", 0.3), (1, "purchase", 0.3), (1, "click", 0.61), (1, "error", 0.4))
    got, _ = both(spark, tmp_path, "session_report", "events", rows, EVENTS)
    assert got == [(1, "7 steps, 1 errors, $2.21; click ($0.61), purchase ($0.60), view ($0.60)")]
