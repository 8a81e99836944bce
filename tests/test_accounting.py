"""Row counts of the event table."""

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators.timeline import settle
from fieldtrace.plans import REPAIRS, RowCounts, event_table
from registry.script import SCATTERED, dictionary, scripted_log

from .conftest import SMALL


@pytest.fixture(scope="module")
def log(spark):
    return settle(scripted_log(spark, SMALL, SCATTERED)[0])


@pytest.mark.parametrize("repair", [(), sorted(REPAIRS)], ids=["as written", "repaired"])
def test_rows_add_up(spark, log, repair):
    counts = RowCounts()
    out = settle(event_table(log, dictionary(spark), repair=repair, long=None, counts=counts))
    n = counts.check()
    assert n["rows_in"] == log.count() and n["rows_out"] == out.count()
    assert n["original"] == out.select("session_id", "row_order.seq").distinct().count()
    assert n["flagged"] == out.where("check").count()
    assert n["ended"] > 0 and n["tag_label"] > 0 and n["mirrored"] > 0


def test_no_rows(spark, log):
    counts = RowCounts()
    settle(event_table(log.where(F.col("seq") < 0), dictionary(spark), long=None, counts=counts))
    assert set(counts.check().values()) == {0}


def test_lost_rows_are_an_error(monkeypatch):
    counts = RowCounts()
    told = dict.fromkeys(["ended", "unresolved", "original", "rows_out", "mirrored", "approach",
                          "tag_label", "tag", "piece", "size", "marker"], 0)
    monkeypatch.setattr(counts, "read", lambda: told | {"rows_in": 1})
    with pytest.raises(ValueError, match="raw rows do not add up"):
        counts.check()
    monkeypatch.setattr(counts, "read", lambda: told | {"rows_in": 0, "rows_out": 2, "tag": 1})
    with pytest.raises(ValueError, match="added rows do not add up"):
        counts.check()
