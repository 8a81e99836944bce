"""Look-ups against brute force, and block-wise work against the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import (Ahead, Behind, Latest, Running, Timeline, attach_outcome,
                                  dig_intervals, fill_down, long_sessions, per_session,
                                  relabel, row_position, row_sequence, running_counter,
                                  state_intervals)
from fieldtrace.operators.intervals import FAMILIES
from fieldtrace.plans import event_table
from fieldtrace.plans.event_table import normalize
from fieldtrace.operators.timeline import settle, shared_folder
from registry.script import dictionary, scripted_log

from .conftest import SMALL, as_rows


def made_up(seed):
    rng = random.Random(seed)
    rows = []
    for session in "abc":
        for seq in range(1, rng.choice([1, 9, 23]) + 1):
            rows.append((session, seq, rng.choice([None, "x", "y"]), rng.random() < 0.3,
                         rng.randrange(4)))
    return rows


def brute(rows):
    out = []
    for s, seq, text, member, amount in rows:
        own = sorted(r for r in rows if r[0] == s)
        later = [r[2] for r in own if r[1] > seq and r[3]]
        earlier = [r[2] for r in own if r[1] < seq and r[3]][::-1]
        raw = [r[2] for r in own if r[1] < seq][::-1]
        known = [r[2] for r in own if r[1] <= seq and r[2] is not None]
        out.append((s, seq, *(later + [None] * 2)[:2], *(earlier + [None] * 3)[:3],
                    raw[0] if raw else None, known[-1] if known else None,
                    sum(r[4] for r in own if r[1] <= seq)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows, group_blocks", [
    (None, None), (1, None), (2, None), (5, None), (100, None), (1, 1), (1, 4), (2, 3), (5, 2)])
def test_looks(spark, block_rows, group_blocks):
    for seed in range(2):
        rows = made_up(seed)
        df = spark.createDataFrame(
            rows, "session_id string, seq int, text string, member boolean, amount int")
        line = Timeline(block_rows=block_rows, group_blocks=group_blocks)
        text, member = F.col("text"), F.col("member")
        got = line.look(df, nxt=Ahead(text, member, 2), back=Behind(text, member, 3),
                        raw=Behind(text), known=Latest(text), total=Running(F.col("amount")))
        cols = ["session_id", "seq", "nxt_1", "nxt_2", "back_1", "back_2", "back_3", "raw",
                "known", "total"]
        assert as_rows(got, *cols) == brute(rows)


def test_carry_in_two_levels(spark, monkeypatch):
    """A session of 100,000 rows in blocks of 7: the same values, and no window over
    more blocks or groups than the square root of the blocks."""
    rows = settle(spark.range(1, 100_001).select(
        F.lit("s").alias("session_id"), F.col("id").alias("seq"),
        F.when(F.xxhash64("id") % 5 == 0, F.col("id")).alias("known"),
        (F.xxhash64("id") % 4_001 == 0).alias("rare"), (F.col("id") % 11).alias("amount")))
    edges = []

    def keep(df):
        out = settle(df)
        if "__group" in df.columns:
            edges.append(out)
        return out

    monkeypatch.setattr("fieldtrace.operators.timeline.settle", keep)

    def work(df, line):
        seq, rare = F.col("seq"), F.col("rare")
        return line.look(df, nxt=Ahead(seq, rare, 2), back=Behind(seq, rare, 3),
                         latest=Latest(F.col("known")), total=Running(F.col("amount")))

    long = spark.createDataFrame([("s",)], "session_id string")
    cut = per_session(rows, work, long=long, block_rows=7)
    plain = work(rows, Timeline())
    assert len(edges) == 1
    groups = edges[0].groupBy("__group").agg(F.countDistinct("__block").alias("n")).collect()
    root = 120                          # of 14,286 blocks, rounded up
    assert len(groups) <= root and max(r["n"] for r in groups) <= root
    assert cut.count() == 100_000
    assert plain.exceptAll(cut.select(*plain.columns)).isEmpty()


def test_running_sum_over_blocks_without_amounts(spark):
    amounts = [None, None, 3, None, None, None, 4, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(amounts, 1)],
                               "session_id string, seq int, amount int")
    look = {"total": Running(F.col("amount"))}
    plain = as_rows(Timeline().look(df, **look))
    for groups in (None, 2):
        cut = Timeline(block_rows=2, group_blocks=groups).look(df, **look)
        assert as_rows(cut, "session_id", "seq", "amount", "total") == plain


@pytest.fixture(scope="module")
def log(spark):
    rows, long = scripted_log(spark, SMALL)
    assert long is None
    return rows


@pytest.fixture(scope="module")
def long(log):
    found = long_sessions(log.select("session_id"), ["session_id"], 66)
    assert 0 < found.count() < log.select("session_id").distinct().count()
    return found


def test_long_sessions_whole_table(spark, log, long):
    """Copies, removals and outcomes that cross block borders come out the same."""
    words = dictionary(spark)
    plain = event_table(log, words)
    cut = event_table(log, words, long=long, block_rows=7)
    assert sorted(plain.columns) == sorted(cut.columns)
    assert as_rows(plain) == as_rows(cut, *plain.columns)


@pytest.mark.parametrize("work", [
    lambda df, line: fill_down(df, line, ["modifiers"]),
    lambda df, line: running_counter(df, line, F.col("behavior") == "GA"),
    lambda df, line: state_intervals(df, line, list(FAMILIES.values())),
    dig_intervals, row_position, lambda df, line: attach_outcome(df, line, "agg_sub"),
], ids=["fill", "count", "families", "digs", "position", "outcome"])
def test_long_sessions_per_operator(log, long, work):
    rows = normalize(log)
    plain, cut = per_session(rows, work), per_session(rows, work, long=long, block_rows=9)
    assert as_rows(plain) == as_rows(cut, *plain.columns)


def test_row_sequence_of_long_sessions(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "ts", "event_id")
    hot = events.withColumn("user_id", F.when(F.col("user_id") < 8, 0).otherwise(F.col("user_id")))
    found = long_sessions(hot, ["user_id"], 200)
    assert [r[0] for r in found.collect()] == [0]
    plain = row_sequence(hot, ["user_id"], ["ts", "event_id"])
    cut = row_sequence(hot.repartition(5), ["user_id"], ["ts", "event_id"], long=found)
    assert as_rows(plain) == as_rows(cut, *plain.columns)


def test_too_many_long_sessions_to_broadcast(log, long, monkeypatch):
    monkeypatch.setattr("fieldtrace.operators.timeline.MAX_BROADCAST_KEYS", 1)
    work = lambda df, line: fill_down(df, line, ["modifiers"])
    rows = settle(log.select("session_id", "seq", "modifiers"))
    cut = per_session(rows, work, long=long, block_rows=9)
    assert as_rows(per_session(rows, work)) == as_rows(cut)
    again = row_sequence(rows.drop("seq"), ["session_id"], ["modifiers"], long=long)
    for df in (cut, again):
        assert "strategy=broadcast" not in df._jdf.queryExecution().toString()


def test_sparse_positions_are_cut_by_place(log, long):
    rows = log.select("session_id", (F.col("seq") * 1000).alias("seq"), "modifiers")
    work = lambda df, line: fill_down(df, line, ["modifiers"])
    blocks = []

    def counted(df, line):
        if line.block_rows is not None:
            blocks.append(df.select("session_id", "__block").distinct().count())
        return work(df, line)

    cut = per_session(rows, counted, long=long, block_rows=9)
    assert as_rows(per_session(rows, work)) == as_rows(cut)
    sizes = log.join(long, "session_id", "left_semi").groupBy("session_id").count().collect()
    assert blocks == [sum(-(-r["count"] // 9) for r in sizes)]


def test_intermediate_tables_lie_in_one_folder(spark, log, long):
    folder = shared_folder(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert folder == shared_folder(spark) and base.split(":")[-1].rstrip("/") in folder
    assert spark.sparkContext.applicationId in folder


def test_large_dictionary(spark, log):
    rows, words = log.select("session_id", "seq", "behavior"), dictionary(spark)
    plain = relabel(rows, words, small=False)
    assert as_rows(relabel(rows, words, small=True)) == as_rows(plain)
    assert "sequence(" not in plain._jdf.queryExecution().toString()
    spread = relabel(rows, words, small=False, hot_rows=20)
    assert as_rows(spread) == as_rows(plain)
    assert "sequence" in spread._jdf.queryExecution().toString().lower()


def test_input_partitioning_does_not_matter(spark, log):
    words = dictionary(spark)
    one = event_table(log.repartition(1), words)
    many = event_table(log.repartition(16, "seq"), words)
    assert as_rows(one) == as_rows(many)


def test_rows_of_long_sessions_are_dealt_evenly(spark):
    """One task wrote them all before, and one task then read them all."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.range(1, 201, 1, 1).selectExpr("'a' AS session_id", "id AS seq")
    long = spark.createDataFrame([("a",)], "session_id string")
    seen = []

    def work(df, line):
        if line.block_rows is not None:
            seen.append(df)
        return df

    spark.conf.set(key, "false")
    try:
        done = per_session(rows, work, long=long, block_rows=50)
        parts = seen[0].groupBy(F.input_file_name().alias("f")).count().collect()
    finally:
        spark.conf.unset(key)
    assert sum(r["count"] for r in parts) == 200
    assert max(r["count"] for r in parts) < 100
    assert sorted(r["seq"] for r in done.collect()) == list(range(1, 201))
