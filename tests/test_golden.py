"""Hand-traced cases: small sessions with their expected rows."""

import pytest

from .conftest import table_of


def m(text, **more):
    return {"modifiers": text, **more}


DIG_END, LOOSE = "Dig; End (+Modifiers)", "End (+Modifiers)"

SESSIONS = {
    "paired": [(100, "GA"), (130, "GA; End", m("m", comments="c"))],
    "points": [(100, "GA"), (110, "GA")],
    "spans": [(100, "GA"), (105, "Dig"), (130, "GA; End")],
    "flagged_end": [(100, "GA"), (130, "GA; End", {"pup_care": "y"})],
    "run": [(10, "GT"), (20, "GT"), (30, "GT; End")],
    "touch": [(10, "Burr/BH renn"), (25, "Dig")],
    "open": [(10, "In burr/BH")],
    "by_other": [(60, "Dig"), (65, "GA")],
    "skips_scan": [(60, "Dig"), (62, "Nearest neigh."), (65, "GA")],
    "sized": [(10, "Dig"), (15, DIG_END, m("Small"))],
    "unsized": [(10, "Dig"), (15, DIG_END)],
    "dig_dig": [(10, "Dig"), (20, "Dig"), (30, "GA")],
    "dig_stop": [(10, "Dig"), (20, "End Focal")],
    "loose": [(10, "Play"), (20, LOOSE, m("Large"))],
    "loose_unsized": [(10, LOOSE)],
    "several": [(10, "Dig"), (15, DIG_END, m("Small; Large; Tiny; >5"))],
    "two_tiny": [(10, "Dig"), (15, DIG_END, m("1; Tiny; 2; Tiny"))],
    "receive": [(10, "Play", {"play": "Receive; A; B"})],
    "initiate": [(10, "Play", {"play": "Initiate; Chase"})],
    "contest": [(10, "Aggr./Sub.", {"agg_sub": "Fcomp; Win"})],
    "contest_rows": [(10, "Aggr./Sub.", {"agg_sub": "Fcomp"}),
                     (11, "Aggr./Sub.", {"agg_sub": "Lose"})],
    "parallel": [(10, "Play", {"agg_sub": "a;b", "play": "z"})],
    "category": [(10, "Play", {"play": "Chase"}), (11, "Play")],
    "beside": [(10, "GA", {"play": "Chase"})],
    "twice": [(10, "GA", {"play": "A;B"})],
    "approach": [(10, "Approach;Sniff")],
    "mutual": [(10, "i.groom", {"partner": "Initiate; Receive; X"})],
    "plain_partner": [(10, "i.groom", {"partner": "X"})],
    "ids": [(10, "GA", {"focal_individual": "A (M1) Burrow"}), (11, "GA"),
            (12, "GA", {"focal_individual": "no paren"})],
    "counter": [(10, "GA"), (11, "Start focal"), (12, "GA")],
    "fraction": [(0, "GA", {"time_raw": "0.34205"}),
                 (0, "GA", {"time_raw": "1899-12-31 08:12:33"})],
    "loose_before_end": [(10, LOOSE), (20, DIG_END, m("Large"))],
    "near": [(10, "Other vig.; Dig; End (+Modifiers)"), (11, "Nearest neigh."),
             (12, "Other vig."), (13, LOOSE, m("Small"))],
    "backwards": [(100, "GA"), (90, "GA; End")],
}

EXPECTED = {
    ("paired", "s_duration", "end_time", "modifiers", "comments"):
        [(30, "00:02:10", "m", "c")],
    ("points", "s_duration"): [(1,), (1,)],
    ("spans", "behavior", "s_duration"): [("GA", 30), ("Dig", 1)],
    ("flagged_end", "behavior", "check"): [("GA", None), ("GA; End", True)],
    ("run", "st_time", "s_duration"): [("00:00:10", None), ("00:00:20", 10)],
    ("touch", "behavior", "s_duration"): [("Burr/BH renn", 15), ("Dig", None)],
    ("open", "s_duration", "check"): [(None, True)],
    ("by_other", "behavior", "s_duration"): [("Dig", 5), ("GA", 1)],
    ("skips_scan", "behavior", "s_duration"): [("Dig", 5), ("Nearest neigh.", None), ("GA", 1)],
    ("sized", "behavior", "s_duration", "modifiers"):
        [("Dig", 5, "Small"), ("d.small", None, "Small")],
    ("unsized", "behavior", "s_duration", "modifiers"): [("Dig", 5, "success")],
    ("dig_dig", "behavior", "s_duration"): [("Dig", 1), ("Dig", 10), ("GA", 1)],
    ("dig_stop", "behavior", "s_duration"): [("Dig", 1), ("End Focal", None)],
    ("loose", "behavior"): [("",), ("fa.large",), (LOOSE,)],
    ("loose_unsized", "behavior", "check"): [(LOOSE, True)],
    ("several", "behavior", "modifiers"):
        [("Dig", "Small; Large; Tiny; >5"), ("d.small", "Small"), ("d.large", "Large"),
         ("d.tiny.many", "TinyMany")],
    ("two_tiny", "behavior"): [],
    ("receive", "behavior"): [("Receive A",), ("Receive B",)],
    ("initiate", "behavior"): [("i.chase",)],
    ("contest", "behavior"): [("Fcomp",), ("Fcomp Win",)],
    ("contest_rows", "behavior"): [("Fcomp",), ("Fcomp Lose",)],
    ("parallel", "behavior"): [("a",), ("z",), ("b",), ("z",)],
    ("category", "behavior"): [("Chase",), ("",)],
    ("beside", "behavior"): [("Chase",), ("GA",)],
    ("twice", "behavior"): [("A",), ("B",), ("GA",), ("GA",)],
    ("approach", "behavior"): [("Approach",), ("i.sniff",)],
    ("mutual", "behavior", "partner"): [("r.groom", "Receive;  X"), ("i.groom", "Initiate;  X")],
    ("plain_partner", "partner"): [(None,)],
    ("ids", "kmp_id", "location"): [("M1", "Burrow"), ("M1", None), ("", None)],
    ("counter", "focal_id"): [("3.0.NA",), ("3.1.NA",), ("3.1.NA",)],
    ("fraction", "st_time"): [("08:12:33",), ("08:12:33",)],
    ("loose_before_end", "behavior", "modifiers", "check"):
        [("fa.large", "Large", None), (LOOSE, "Large", None), ("d.large", "Large", None)],
    ("near", "behavior"): [("Other vig.; Dig; End (+Modifiers)",), ("Nearest neigh.",),
                           ("Other vig.",), ("d.small",), (LOOSE,)],
    ("backwards", "s_duration", "duration"): [(-10, "-00:00:10")],
}
WORDS = [("initiate chase", "i.chase"), ("INITIATE CHASE", "never"), ("sniff", "i.sniff")]


@pytest.fixture(scope="module")
def tables(spark):
    return table_of(spark, SESSIONS, WORDS)


@pytest.mark.parametrize("case", list(EXPECTED), ids=lambda c: c[0])
def test_case(tables, case):
    session, *cols = case
    assert [tuple(r[c] for c in cols) for r in tables[session]] == EXPECTED[case]


REPAIRED = {
    "gt_first": [(10, "GT"), (20, "GT"), (30, "GT; End"), (40, "GT"), (45, "Dig")],
    "oov_check": [(10, "Out of view"), (20, "Out of view; End", {"pup_care": "y"})],
    "dig_lookahead": [(60, "Dig"), (65, "GA; End")],
    "keep_flagged": [(15, DIG_END, m("1; Tiny; 2; Tiny"))],
    "fa_multi": [(10, "Play", {"play": "x"}), (20, LOOSE, m("Small; Large; 2"))],
    "own_guard": [(10, "Play", {"play": "Initiate; Z", "agg_sub": "Receive; V; W"})],
    "dedup_original": [(10, "GA", {"play": "A;B"})],
    "keep_partner": [(10, "i.groom", {"partner": "X"})],
    "mirror_literal": [(10, "initiate", {"partner": "Initiate; Receive; X"})],
    "fill_location": [(10, "GA", {"focal_individual": "(M1) Forage"}), (11, "GA")],
    "rollover": [(86390, "GA"), (5, "GA; End")],
    "marker_own_size": [(10, LOOSE, m("Small")), (20, DIG_END, m("Large"))],
}
REPAIRED_ROWS = {
    ("gt_first", "behavior", "s_duration"):
        [("GT", 10), ("GT", 10), ("GT", 5), ("Dig", None)],
    ("oov_check", "behavior"): [("Out of view",), ("Out of view; End",)],
    ("dig_lookahead", "behavior", "s_duration"): [("Dig", 5)],
    ("keep_flagged", "behavior", "check"): [(DIG_END, True)],
    ("fa_multi", "behavior"): [("x",), ("fa.small",), ("fa.large",), (LOOSE,)],
    ("own_guard", "agg_sub"): [("Receive V",), ("Receive V",), ("Receive W",), ("Receive W",)],
    ("dedup_original", "behavior"): [("A",), ("B",), ("GA",)],
    ("keep_partner", "partner"): [("X",)],
    ("mirror_literal", "behavior"): [("initiate",), ("initiate",)],
    ("fill_location", "location"): [("Forage",), ("Forage",)],
    ("rollover", "s_duration"): [(15,)],
    ("marker_own_size", "behavior"): [("fa.small",), (LOOSE,), ("d.large",)],
}


@pytest.fixture(scope="module")
def repaired(spark):
    return table_of(spark, REPAIRED, repair=set(REPAIRED))


@pytest.mark.parametrize("case", list(REPAIRED_ROWS), ids=lambda c: c[0])
def test_repair(repaired, case):
    session, *cols = case
    assert [tuple(r[c] for c in cols) for r in repaired[session]] == REPAIRED_ROWS[case]


def test_repairs_of_markers(spark):
    sessions = {
        "near_original": [(10, DIG_END, m("Large")), (20, LOOSE, m("Small"))],
        "residual_text": [(15, DIG_END, m("Small; Large; lizard"))]}
    plain = table_of(spark, sessions)
    fixed = table_of(spark, sessions, repair=["near_original", "residual_text"])

    def labels(tables, session):
        return [r["behavior"] for r in tables[session]]

    assert labels(plain, "near_original") == ["d.large", "fa.small", LOOSE]
    assert labels(fixed, "near_original") == ["d.large", "d.small", LOOSE]
    assert labels(plain, "residual_text") == ["d.small", "d.large"]
    assert labels(fixed, "residual_text") == []


def test_unknown_repair(spark):
    with pytest.raises(ValueError, match="unknown repairs"):
        table_of(spark, {"a": [(1, "GA")]}, repair=["no_such"])


def test_list_mismatch(spark):
    sessions = {"a": [(10, "Play", {"agg_sub": "a;b", "play": "x;y;z"})]}
    with pytest.raises(Exception, match="lists of different length"):
        table_of(spark, sessions)
    rows = table_of(spark, sessions, on_mismatch="flag")["a"]
    assert {(r["agg_sub"], r["play"], r["check"]) for r in rows} == {("a;b", "x;y;z", True)}


def test_removed_rows_do_not_stop_the_job(spark):
    uneven = {"agg_sub": "a;b", "play": "x;y;z"}
    rows = table_of(spark, {"a": [(10, "GA"), (20, "GA; End", uneven)]})["a"]
    assert [r["behavior"] for r in rows] == ["GA"]
