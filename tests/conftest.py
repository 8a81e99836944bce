import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def log_of(spark, sessions):
    """A raw log from ``{session: [(st_sec, behavior, {column: value}), ...]}``."""
    import datetime

    from fieldtrace.sources import LOG_SCHEMA
    rows = []
    for session, lines in sessions.items():
        for seq, (sec, behavior, *more) in enumerate(lines, 1):
            cells = {"session_id": session, "seq": seq, "date": datetime.date(2024, 3, 5),
                     "behavior": behavior, "time_raw":
                     f"1899-12-31 {sec // 3600:02d}:{sec // 60 % 60:02d}:{sec % 60:02d}"}
            cells.update(more[0] if more else {})
            rows.append(tuple(cells.get(f.name) for f in LOG_SCHEMA.fields))
    return spark.createDataFrame(rows, LOG_SCHEMA)


def table_of(spark, sessions, entries=(), **options):
    """The event table as ``{session: [row dict in order]}``."""
    from fieldtrace.plans import event_table
    from fieldtrace.sources import DICTIONARY_SCHEMA
    words = spark.createDataFrame(
        [(k, v, i) for i, (k, v) in enumerate(entries)], DICTIONARY_SCHEMA)
    out = {s: [] for s in sessions}
    for r in event_table(log_of(spark, sessions), words, **options).collect():
        out[r["session_id"]].append(r.asDict(recursive=True))
    for rows in out.values():
        rows.sort(key=lambda r: tuple(r["row_order"].values()))
    return out
