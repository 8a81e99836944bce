"""Reading, writing and column operators."""

import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from fieldtrace import (read_dictionary, read_log, read_sessions, report, write_log,
                        write_sessions, write_table)
from fieldtrace import functions as fx
from fieldtrace import operators as op
from fieldtrace.__main__ import main
from fieldtrace.operators.rows import residual_text
from fieldtrace.plans import event_table
from fieldtrace.sources import LOG_SCHEMA, write_grouped
from fieldtrace.sources.sessions import RAW_HEADINGS, from_headings
from fieldtrace.vocabulary import REPORT_HEADINGS

from .conftest import as_rows, log_of

SESSIONS = {"s1": [(10, "GA", {"comments": "x"}), (20, "GA; End"), (30, "Dig")],
            "s2": [(5, "In burr/BH"), (9, "In burr/BH; End", {"modifiers": "m"})]}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_log_round_trip(spark, tmp_path, fmt):
    log = log_of(spark, SESSIONS)
    path = str(tmp_path / fmt)
    write_sessions(log, path, fmt=fmt, order=["seq"], ranged=True,
                   options={"header": "true"})
    schema = "seq bigint," + ",".join(
        f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA if f.name not in
        ("session_id", "seq")) + ", session_id string"
    back = read_sessions(spark, path, fmt=fmt, options={"header": "true"}, schema=schema)
    assert as_rows(back, *log.columns) == as_rows(log)
    some = read_sessions(spark, path, fmt=fmt, options={"header": "true"}, schema=schema,
                         sessions=["s2"])
    assert some.count() == 2
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = some.select("*")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*session_id#\d+ = s2", plan)


def test_rows_are_numbered_by_place_in_file(spark, tmp_path):
    log = log_of(spark, SESSIONS).drop("seq")
    log.coalesce(1).write.partitionBy("session_id").parquet(str(tmp_path / "p"))
    back = read_sessions(spark, str(tmp_path / "p"))
    assert as_rows(back, "session_id", "seq", "behavior") == as_rows(
        log_of(spark, SESSIONS), "session_id", "seq", "behavior")
    log.coalesce(1).write.partitionBy("session_id").csv(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="seq"):
        read_sessions(spark, str(tmp_path / "c"), fmt="csv", schema=log.schema)


def test_report_to_both_sinks(spark, tmp_path):
    (spark.createDataFrame([("ga", "state.ga", 1)], "behavior string, replacement string, "
                           "dict_seq bigint").write.parquet(str(tmp_path / "words")))
    words = read_dictionary(spark, str(tmp_path / "words"))
    events = report(event_table(log_of(spark, SESSIONS), words), keep_order=True)
    assert events.columns[2:] == list(REPORT_HEADINGS.values())
    write_sessions(events, str(tmp_path / "by_session"))
    write_table(events, str(tmp_path / "one"))
    for name in ("by_session", "one"):
        back = spark.read.parquet(str(tmp_path / name))
        assert as_rows(back.where("session_id = 's1'"), "Behavior", "`S.Duration`") == [
            ("Dig", None), ("state.ga", 10)]


def test_raw_headings(spark):
    names = [*RAW_HEADINGS, "The focal individual", "Sender partner(s)", "Time...9"]
    df = spark.createDataFrame([tuple(str(i) for i in range(len(names)))],
                               ", ".join(f"`{n}` string" for n in names))
    got = from_headings(df)
    assert set(LOG_SCHEMA.fieldNames()) - {"session_id", "seq"} == set(got.columns)


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a_Kind int, b_kind int, c int")
    with pytest.raises(ValueError, match="expected one"):
        op.resolve_column(df, suffix="kind")
    with pytest.raises(ValueError, match="expected one"):
        op.resolve_column(df, prefix="z")
    assert op.resolve_column(df, prefix="A_", suffix="KIND") == "a_Kind"
    with pytest.raises(ValueError, match="no such"):
        op.rename_columns(df, {"z": "y"})


def test_scalar_functions(spark):
    df = spark.createDataFrame([(None,), ("a1b1",), ("\t x y ",), ("",)], "t string")
    got = df.select(
        fx.replace_first("t", "1", "_").alias("first"), fx.trim_blanks("t").alias("trim"),
        fx.count_pattern("t", "1").alias("n"), fx.matches("t", "^a|y").alias("hit"),
        fx.compose_id(["t", F.lit(3)]).alias("id"), fx.attach_text("t", F.lit("z")).alias("both"),
        residual_text("t").alias("left")).collect()
    assert [tuple(r) for r in got] == [
        (None, None, None, False, "NA.3", None, False),
        ("a_b1", "a1b1", 2, True, "a1b1.3", "a1b1 z", True),
        ("\t x y ", "x y", 0, True, "\t x y .3", "\t x y  z", True),
        ("", "", 0, False, ".3", " z", False)]


def test_times(spark):
    texts = ["0.5", "1.5", "1899-12-31 01:02:03", "23:59:59", "noon", None, "0.00000578703704"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fx.normalize_time("t")).collect()] == [
        43200, None, 3723, 86399, None, None, 1]
    clocks = spark.createDataFrame([(0,), (90061,), (-5,), (None,)], "s bigint")
    assert [r[0] for r in clocks.select(fx.format_clock("s")).collect()] == [
        "00:00:00", "25:01:01", "-00:00:05", None]


def test_overlay_matches_null_keys_and_is_idempotent(spark):
    base = spark.createDataFrame([(1, None, "a"), (2, "d", "b"), (3, "d", None)],
                                 "k int, d string, v string")
    patch = spark.createDataFrame([(1, None, "A", None), (2, "d", None, None),
                                   (3, "d", "c", True)], "k int, d string, v string, gone boolean")
    once = op.overlay(base, patch, ["k", "d"], ["v"], "gone")
    assert as_rows(once) == [(1, None, "A"), (2, "d", "b")]
    assert as_rows(op.overlay(once, patch, ["k", "d"], ["v"], "gone")) == as_rows(once)


def test_overlay_with_repeated_keys(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (4, "d")], "k int, v string")
    patch = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, None, 0), (None, "n", 5),
                                   (None, "m", 5), (9, "x", 1), (9, "y", 1)], "k int, v string, at int")
    with pytest.raises(Exception, match="repeated patch key"):
        op.overlay(base, patch, ["k"], ["v"]).collect()
    got = op.overlay(base, patch, ["k"], ["v"], prefer=["at"])
    assert as_rows(got) == sorted([(1, "new"), (1, "new"), (None, "n"), (4, "d")], key=repr)
    # One exchange a side, shared by reducing the patch and joining it.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 2


def test_relabel_with_more_hot_labels_than_the_summary_names(spark):
    """Every label is hot at ``hot_rows=0``; the summary names a few, the rows are the same."""
    rows = spark.range(4_000).selectExpr(
        "id", "IF(id % 3 = 0, 'Hot', IF(id % 97 = 0, NULL, concat('label', id))) AS behavior")
    words = spark.range(4_000).selectExpr(
        "concat('LABEL', id) AS behavior", "concat('r', id) AS replacement", "id AS dict_seq").union(
        spark.createDataFrame([("hot", "warm", 0), (None, "nothing", 1)], "b string, r string, d long"))
    want = as_rows(op.relabel(rows, words, small=True))
    for most in (1, 50):
        assert as_rows(op.relabel(rows, words, small=False, hot_rows=0, most_hot=most)) == want


# -- many sessions ---------------------------------------------------------------

def test_many_directories_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / "log" / f"session_id={i}").mkdir(parents=True)
    rows = spark.createDataFrame([(1, "GA")], "seq long, behavior string")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    made = next((tmp_path / "one").glob("part-*")).read_bytes()
    for folder in (tmp_path / "log").iterdir():
        (folder / "part-00000.parquet").write_bytes(made)
    context, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    given = spark.conf.get(name)
    context.setJobGroup("listing", "listing")
    try:
        back = read_sessions(spark, str(tmp_path / "log"), schema=None)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing")
             for s in tracker.getJobInfo(j).stageIds]
    assert 1 < max(tasks) <= 64 and spark.conf.get(name) == given
    assert as_rows(back, "session_id") == sorted([(i,) for i in range(300)], key=repr)


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_grouped_rows_are_written_as_spark_writes_them(spark, tmp_path, monkeypatch, kind):
    """A session in several batches and row groups; names to escape; null and empty."""
    monkeypatch.setattr("fieldtrace.sources.sessions.GROUP_ROWS", 5)
    ids = [str(i) for i in range(30)] if kind == "bigint" else [
        "a b", "b/c", "50%", "x:y=z", "#1", "[q]^", "t\ts", "Zoë", "it's", "", None]
    rows = [(s, k, None if k % 3 else f"v{k}", "" if k % 2 else None) for i, s in enumerate(ids)
            for k in range(1, 40 if i == 1 else 3 + i % 3)]
    df = spark.createDataFrame(rows, "session_id string, seq int, `Time...2` string, `a (b)` string")
    placed = (df.withColumn("session_id", F.col("session_id").cast(kind)).repartition(3, "session_id")
              .sortWithinPartitions("session_id", "seq"))
    placed.write.partitionBy("session_id").parquet(str(tmp_path / "spark"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        write_grouped(placed, str(tmp_path / "own"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one, two = (spark.read.parquet(str(tmp_path / n)) for n in ("spark", "own"))
    cells = ["session_id", "seq", "`Time...2`", "`a (b)`"]
    assert one.schema == two.schema and as_rows(one, *cells) == as_rows(two, *cells)
    made = {n: sorted((f.parent.name, f.name[:10]) for f in (tmp_path / n).glob("*/*")
                      if not f.name.endswith(".crc")) for n in ("spark", "own")}
    assert made["spark"] == made["own"]
    at = two.select("session_id", "seq", F.col("_metadata.row_index").alias("at"))
    assert at.where("session_id IS NOT NULL AND at != seq - 1").isEmpty()
    # No file of Hadoop's, each of which costs a process on a local file system.
    assert not list((tmp_path / "own").rglob("*.crc")) and not list((tmp_path / "own").rglob(".part*"))


def test_grouped_writer_refuses_rows_apart(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "session_id string, seq int").coalesce(1)
    with pytest.raises(Exception, match="'a' are not together"):
        write_grouped(df, str(tmp_path / "out"))
    write_grouped(df.limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


# -- some sessions written again ------------------------------------------------

@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("buckets", [None, 3])
def test_partial_runs_keep_the_other_sessions(spark, tmp_path, buckets, fmt):
    names = ["a", "b/c", "d e", "f", "g"]
    log = log_of(spark, {s: [(k, "Dig") for k in range(4)] for s in names}).select(
        "session_id", "seq", "behavior", "comments")
    path, options = str(tmp_path / "out"), {"header": "true"} if fmt == "csv" else {}
    how = {"fmt": fmt, "options": options, "order": ["seq"]}
    write_sessions(log, path, buckets=buckets, sessions=names, **how)
    new = log.where("session_id IN ('b/c', 'f') AND seq < 3").withColumn("behavior", F.lit("GA"))
    write_sessions(new, path, sessions=["b/c", "d e", "f"], **how)
    back = read_sessions(spark, path, fmt=fmt, options=options, schema=log.schema)
    want = [(s, k, "Dig") for s in ("a", "g") for k in range(1, 5)]
    want += [(s, k, "GA") for s in ("b/c", "f") for k in (1, 2)]
    assert as_rows(back, "session_id", "seq", "behavior") == sorted(want, key=repr)
    with pytest.raises(Exception, match="not one of the sessions"):
        write_sessions(log, path, sessions=["a"], **how)
    with pytest.raises(ValueError, match="buckets"):
        write_sessions(new, path, sessions=["b/c"], buckets=7, **how)
    assert as_rows(back, "session_id", "seq", "behavior") == sorted(want, key=repr)
    write_sessions(new.limit(0), path, sessions=names, **how)
    left = [f for f in (tmp_path / "out").rglob("part-*") if "_buckets" not in str(f)]
    assert not left


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_partial_run_of_many_sessions(spark, tmp_path, monkeypatch, kind):
    """Names come as a frame and are not listed in the plan; directories are not asked one by one."""
    def no_listing(*_):
        raise AssertionError("sessions' directories are not listed")
    monkeypatch.setattr("fieldtrace.sources.sessions._files", no_listing)
    rows = spark.range(120).selectExpr(f"CAST(id % 40 AS {kind}) AS session_id", "id AS seq", "'a' AS v")
    path = str(tmp_path / "out")
    write_sessions(rows, path, order=["seq"], ranged=True)
    again = rows.where("session_id % 4 > 0").select("session_id")        # repeated names
    new = rows.where("session_id % 4 = 1").withColumn("v", F.lit("b"))
    write_sessions(new, path, order=["seq"], sessions=again)
    back = spark.read.schema(rows.schema).parquet(path)
    want = [(r["session_id"], r["seq"], "b" if int(r["session_id"]) % 4 else "a")
            for r in rows.collect() if int(r["session_id"]) % 4 < 2]
    assert as_rows(back, *rows.columns) == sorted(want, key=repr)
    assert {int(d.name.split("=")[1]) % 4 for d in (tmp_path / "out").glob("session_id=*")} == {0, 1}
    with pytest.raises(Exception, match="not one of the sessions"):
        write_sessions(rows, path, order=["seq"], sessions=again)
    assert as_rows(back, *rows.columns) == sorted(want, key=repr)


def directories(path):
    return sorted({f.parent.name for f in path.glob("*/part-*")})


@pytest.mark.parametrize("kind", ["string", "bigint"])
@pytest.mark.parametrize("again", [[0, 1, 4, 5, 8, 9], [0, 2, 3, 8, 9, 77], []])
def test_own_directories_are_written_as_spark_writes_them(spark, tmp_path, monkeypatch, kind, again):
    """All, and then some: names to escape, null and empty; new, without rows, and absent."""
    names = [str(i) for i in range(100)] if kind == "bigint" else [
        "a b", "b/c", "50%", "x:y=z", "#1", "[q]^", "t\ts", "Zoë", "it's", "", *map(str, range(90))]
    cells = ["seq", "if(seq % 3 = 0, null, concat('v', seq)) AS `Time...2`", "date '2024-03-05' AS d",
             "timestamp_ntz '2024-03-05 01:02:03.000456' AS t", "if(seq = 1, null, struct(seq AS k)) AS o"]
    pairs = [(s, k) for i, s in enumerate(names[:10]) for k in range(1, 3 + i % 3)]
    pairs += [(None, 1), (None, 2)] if kind == "string" else []
    raw = spark.createDataFrame(pairs, "session_id string, seq int").repartition(5)
    log = raw.selectExpr(f"CAST(session_id AS {kind}) AS session_id", *cells)
    some = spark.createDataFrame([(names[i],) for i in again], "s string")
    held = [names[i] for i in again if i % 4 < 2] + ["none"]
    new = log.where(F.col("session_id").cast("string").isin(held)).withColumn("d", F.lit(None).cast("date"))
    new = new.unionByName(new.where("seq = 1").withColumn("seq", F.lit(99)))
    for way in ("own", "spark"):
        if way == "spark":
            monkeypatch.setattr("fieldtrace.sources.sessions._local", lambda *_: None, raising=False)
        path = str(tmp_path / way)
        log.limit(3).write.parquet(path)         # overwritten, whatever it was
        write_sessions(log, path, order=["seq"], ranged=True)
        before = directories(tmp_path / way)
        write_sessions(new, path, order=["seq"], sessions=some)
    one, two = (spark.read.schema(log.schema).parquet(str(tmp_path / n)) for n in ("spark", "own"))
    columns = ["session_id", "seq", "`Time...2`", "d", "t", "o"]
    assert as_rows(one, *columns) == as_rows(two, *columns)
    assert spark.read.parquet(str(tmp_path / "own")).schema == spark.read.parquet(str(tmp_path / "spark")).schema
    assert len(before) == 10 and directories(tmp_path / "own") == directories(tmp_path / "spark")
    # No file of Hadoop's below a session, each of which costs a process on a local file system.
    assert not list((tmp_path / "own").glob("session_id=*/.*")) and (tmp_path / "own" / "_SUCCESS").exists()
    assert [f.name for f in tmp_path.iterdir() if f.name.startswith(".")] == []
    assert [f.name for f in (tmp_path / "own").glob(".*") if not f.name.endswith(".crc")] == []


def test_own_directories_stay_if_a_run_fails_and_are_placed_once(spark, tmp_path, monkeypatch):
    from fieldtrace.sources import sessions as of
    path, rows = str(tmp_path / "out"), spark.range(40).selectExpr(
        "CAST(id % 8 AS string) AS session_id", "id AS seq", "'a' AS v")
    write_sessions(rows, path, order=["seq"], ranged=True)
    want = as_rows(spark.read.schema(rows.schema).parquet(path), *rows.columns)
    bad = rows.withColumn("seq", F.when(F.col("seq") == 31, F.raise_error(F.lit("late")).cast("long"))
                          .otherwise(F.col("seq")))
    for how in ({}, {"sessions": [str(i) for i in range(8)]}):
        with pytest.raises(Exception, match="late"):
            write_sessions(bad, path, order=["seq"], ranged=False, **how)
        assert as_rows(spark.read.schema(rows.schema).parquet(path), *rows.columns) == want
        assert [f.name for f in tmp_path.iterdir()] == ["out"] and not list((tmp_path / "out").glob(".?*[!c]"))
    put, twice = of._put_in_place, []

    def put_again(*given):          # as a task does that runs a second time
        twice.extend(put(*given) for _ in range(2))

    monkeypatch.setattr(of, "_put_in_place", put_again)
    write_sessions(rows.where("session_id < '2'").withColumn("v", F.lit("b")), path, order=["seq"],
                   sessions=["0", "1", "2"])
    back = spark.read.schema(rows.schema).parquet(path)
    assert len(twice) == 2 and as_rows(back, *rows.columns) == sorted(
        [(s, k, "b" if s < "2" else v) for s, k, v in want if s != "2"], key=repr)


def test_partial_run_with_other_columns(spark, tmp_path):
    log = log_of(spark, SESSIONS).select("session_id", "seq", "behavior")
    write_sessions(log, str(tmp_path / "x"), order=["seq"], buckets=2)
    with pytest.raises(ValueError, match="differ in"):
        write_sessions(log.withColumn("more", F.lit(1)), str(tmp_path / "x"), order=["seq"],
                       sessions=["s1", "s2"])


@pytest.mark.parametrize("flags", [[], ["--single", "--repair", "keep_partner"]])
def test_batch_job(spark, tmp_path, flags):
    log_of(spark, SESSIONS).write.parquet(str(tmp_path / "log"))
    spark.createDataFrame([("GA", "x", 1)], "behavior string, replacement string, dict_seq bigint"
                          ).write.parquet(str(tmp_path / "words"))
    main([str(tmp_path / "log"), str(tmp_path / "words"), str(tmp_path / "out"),
          "--sessions", "s1", *flags])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert as_rows(back, "session_id", "Behavior") == [("s1", "Dig"), ("s1", "x")]


# -- sinks keep the order, at any size ------------------------------------------

def restored(back, session="s1"):
    rows = back.where(F.col("session_id") == session).orderBy("row_order")
    return [r["Comments"] for r in rows.collect()]


@pytest.mark.parametrize("flags", [[], ["--buckets", "3"], ["--single"]])
def test_job_keeps_the_order_of_a_cut_session(spark, tmp_path, monkeypatch, flags):
    lines = [(k, "Play", {"comments": f"c{k:03}"}) for k in range(40)]
    log = log_of(spark, {"s1": lines, "s2": lines[:5]})
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    words = spark.createDataFrame([], "behavior string, replacement string, dict_seq bigint")
    words.write.parquet(str(tmp_path / "words"))
    real = op.long_sessions
    monkeypatch.setattr("fieldtrace.__main__.long_sessions",
                        lambda df, keys: real(df, keys, block_rows=7))
    monkeypatch.setattr("fieldtrace.__main__.event_table", partial(event_table, block_rows=7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        main([str(tmp_path / "log"), str(tmp_path / "words"), str(tmp_path / "out"), *flags])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert restored(back) == [f"c{k:03}" for k in range(40)]


def test_text_sink_writes_a_sortable_order(spark, tmp_path):
    lines = [(k, "Play", {"comments": f"c{k:03}"}) for k in range(12)]
    words = spark.createDataFrame([], "behavior string, replacement string, dict_seq bigint")
    events = report(event_table(log_of(spark, {"s1": lines}), words), keep_order=True)
    write_sessions(events, str(tmp_path / "csv"), fmt="csv", options={"header": "true"})
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert restored(back) == [f"c{k:03}" for k in range(12)]


def test_buckets_are_pruned(spark, tmp_path):
    log = log_of(spark, {f"s{k}": [(1, "GA"), (2, "Dig")] for k in range(20)})
    path = str(tmp_path / "b")
    write_sessions(log, path, order=["seq"], buckets=4)
    some = read_sessions(spark, path, sessions=["s3"])
    assert as_rows(some, "session_id", "seq") == [("s3", 1), ("s3", 2)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = some.select("*")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*session_bucket#\d+ (IN|=)", plan)
    assert "seq" in read_sessions(spark, path).columns and read_sessions(spark, path).count() == 40


# -- the reader neither mis-numbers nor mis-binds ----------------------------------

def stops(df, match):
    with pytest.raises(Exception, match=match):
        df.collect()


def test_null_positions_and_sessions_stop_the_job(spark, tmp_path):
    log = log_of(spark, SESSIONS)
    for col in ("seq", "session_id"):
        bad = log.withColumn(col, F.when(F.col("behavior") != "Dig", F.col(col)))
        bad.write.parquet(str(tmp_path / col))
        stops(read_sessions(spark, str(tmp_path / col)), f"null {col}")
    from fieldtrace.sources import check_positions
    check_positions(log)
    with pytest.raises(ValueError, match="repeats seq"):
        check_positions(log.union(log))
    with pytest.raises(ValueError, match="null session key"):
        op.long_sessions(spark.createDataFrame([(None,)], "session_id string"), ["session_id"])


@pytest.mark.parametrize("block_rows", [None, 2])
def test_repeated_positions_stop_the_event_table(spark, block_rows):
    """Found in the pass itself: in one window, and across the borders of blocks."""
    lines = [(k, "Dig") for k in range(9)]
    log = log_of(spark, {"s1": lines, "s2": lines[:3]})
    words = spark.createDataFrame([], "behavior string, replacement string, dict_seq bigint")
    how = {"long": None} if block_rows is None else {"block_rows": block_rows}
    assert event_table(log, words, **how).count() == 12
    twice = log.withColumn("seq", F.when((F.col("session_id") == "s1") & (F.col("seq") == 7), 6)
                           .otherwise(F.col("seq")))
    with pytest.raises(Exception, match="'s1' repeats seq 6"):
        event_table(twice, words, **how).collect()


def test_text_log_is_bound_by_header(spark, tmp_path):
    log = log_of(spark, SESSIONS)
    swapped = log.select("seq", "session_id", *[c for c in log.columns[2:][::-1]])
    swapped.coalesce(1).write.option("header", "true").csv(str(tmp_path / "log"))
    back = read_sessions(spark, str(tmp_path / "log"), fmt="csv", options={"header": "true"})
    assert as_rows(back, *log.columns) == as_rows(log)
    bad = log.withColumn("date", F.lit("03/05/2024"))
    bad.coalesce(1).write.option("header", "true").csv(str(tmp_path / "bad"))
    stops(read_sessions(spark, str(tmp_path / "bad"), fmt="csv", options={"header": "true"}), "(?i)malformed")


def test_files_are_numbered_as_numbers(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    log = log_of(spark, {"s1": [(1, "first"), (2, "second")]}).drop("seq")
    for name, label in (("part-99999", "first"), ("part-100000", "second")):
        log.where(F.col("behavior") == label).coalesce(1).write.parquet(str(tmp_path / name))
        made = next((tmp_path / name).glob("part-*.parquet"))
        (folder / f"{name}-x.parquet").write_bytes(made.read_bytes())
    back = read_sessions(spark, str(folder))
    assert as_rows(back, "seq", "behavior") == [(1, "first"), (2, "second")]


def test_raw_log_with_a_bad_date(spark, tmp_path):
    names = {**{k: k for k in RAW_HEADINGS}, "a": "The focal individual", "b": "Sender partner(s)",
             "c": "Time...9"}
    row = tuple("2024-03-05 12:00:00 AM" if n == "Date" else n for n in names.values())
    df = spark.createDataFrame([("s1", *row)], ["session_id", *names.values()])
    df.write.parquet(str(tmp_path / "ok"))
    back = read_sessions(spark, str(tmp_path / "ok"), raw=True)
    assert [str(r.date) for r in back.collect()] == ["2024-03-05"]
    df.withColumn("Date", F.lit("5 March")).write.parquet(str(tmp_path / "bad"))
    stops(read_sessions(spark, str(tmp_path / "bad"), raw=True), "5 March")


def test_extra_columns_survive_whatever_their_names(spark):
    names = ("found", "ob", "several", "copied", "end_sec", "gone", "packed", "previous", "stays")
    log = log_of(spark, SESSIONS).withColumns({n: F.lit(f"own {n}") for n in names})
    words = spark.createDataFrame([], "behavior string, replacement string, dict_seq bigint")
    rows = event_table(log, words).collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
    with pytest.raises(ValueError, match="columns of the result"):
        event_table(log.withColumn("check", F.lit(True)), words)


def test_log_laid_out_by_session(spark, tmp_path):
    path = str(tmp_path / "it's a log")
    rows = [(s, i, f"{s}{i}") for s in "abcdef" for i in range(1, 40 if s == "a" else 4)]
    log = spark.createDataFrame(rows, "session_id string, seq bigint, `a b` string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_log(log, path, buckets=4, block_rows=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = read_log(spark, path)
    assert back.columns == log.columns and as_rows(back) == as_rows(log)
    files = back.select("session_id", F.input_file_name().alias("f")).distinct()
    spread = {r["session_id"]: r["count"] for r in files.groupBy("session_id").count().collect()}
    assert spread["a"] > 1 and all(spread[s] == 1 for s in "bcdef")
    counted = back.groupBy("session_id").count()
    assert as_rows(counted) == as_rows(log.groupBy("session_id").count())
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("log_")]
    write_log(log.where("session_id < 'c'"), path, buckets=2)
    assert as_rows(read_log(spark, path)) == as_rows(log.where("session_id < 'c'"))
    write_log(log.limit(0), path, buckets=3)
    assert read_log(spark, path).count() == 0
    with pytest.raises(Exception, match="null session_id in the log"):
        write_log(log.withColumn("session_id", F.lit(None).cast("string")), path, buckets=2)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("log_")]
