"""Where the rows of an event table come from, counted while it is made."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Steps that add rows, the last one first: the rank or place that tells such a row,
# and whether it does so by being 0 (a copy) or by being above 0 (a later piece).
ADDING = {
    "mirrored": ("mirror_rank", "copy"), "approach": ("approach_pos", "later"),
    "tag_label": ("tag_rank", "copy"), "tag": ("tag_pos", "later"),
    "piece": ("piece_pos", "later"), "size": ("size_pos", "later"),
    "marker": ("marker_rank", "copy"),
}


class RowCounts:
    """Row counts of one event table, known once a job has run over all of it.

    Give it to ``event_table(counts=...)``.  A row is counted under the last step that
    added it, or as ``original``, so that each raw row is either removed (``ended`` by
    an end marker's family, or ``unresolved`` by review) or original exactly once.

    The first job that runs the table is the one that counts; write the table there.
    Jobs that run it in part (``limit``) or twice (a sort by range samples first)
    count what they run, so sort after the table is written.
    """

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def _watch(self, df: DataFrame, **counted: Column) -> DataFrame:
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        self._seen.append(seen)
        return df.observe(seen, *[F.coalesce(F.count_if(c), F.lit(0)).alias(n)
                                  for n, c in counted.items()])

    def before_removal(self, df: DataFrame, ended: Column, stays: Column) -> DataFrame:
        return self._watch(df, rows_in=F.lit(True), ended=ended, unresolved=~ended & ~stays)

    def finished(self, df: DataFrame, flagged: Column) -> DataFrame:
        """Count rows that have all of ``ROW_ORDER``."""
        causes, earlier = {}, F.lit(False)
        for step, (place, kind) in ADDING.items():
            added = F.col(place) == 0 if kind == "copy" else F.col(place) > 0
            causes[step] = added & ~earlier
            earlier = earlier | added
        return self._watch(df, rows_out=F.lit(True), original=~earlier,
                           flagged=F.coalesce(flagged, F.lit(False)), **causes)

    def read(self) -> dict[str, int]:
        """The counts; waits for the job that counts."""
        total: dict[str, int] = {}
        for seen in self._seen:
            for name, n in seen.get.items():
                total[name] = total.get(name, 0) + n
        return total

    def check(self) -> dict[str, int]:
        """The counts, or an error if rows were lost or made without a step that says so."""
        n = self.read()
        added = sum(n[step] for step in ADDING)
        if n["rows_in"] - n["ended"] - n["unresolved"] != n["original"]:
            raise ValueError(f"raw rows do not add up: {n}")
        if n["original"] + added != n["rows_out"]:
            raise ValueError(f"added rows do not add up: {n}")
        return n

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.check().items()), "measure string, n bigint")
