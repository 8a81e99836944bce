"""Ordered look-ups along a session, for sessions of any length.

A *timeline* is a set of session keys plus a dense 1-based position.  The
look-ups (next / previous member of a subset, last known value, running sum)
are window expressions over one partitioning, so any number of them costs one
shuffle.

A session that is too long for one task is cut into blocks of consecutive
positions.  Windows then run per block, and what has to cross a block border is
carried by *edge rows*: for each block only its first and last row and the few
first or last members of each subset.  Their number depends on the number of
blocks, not rows.  They are a timeline themselves, and cut the same way: groups
of neighbouring blocks, as many blocks to a group as there are groups, so no
window spans more than about the square root of a session's blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.logic import as_column

# A session with more rows than this is cut into blocks.
BLOCK_ROWS = 2_000_000
# Long-session keys are broadcast up to this many, and this many bytes; beyond
# that they are joined by shuffle.
MAX_BROADCAST_KEYS = 200_000
MAX_BROADCAST_BYTES = 16_000_000

# Stands for "count the rows per session first".
MEASURE = "measure"

_BLOCK = "__block"
_GROUP = "__group"


@dataclass(frozen=True)
class Ahead:
    """The next ``depth`` values among later rows where ``where`` holds."""
    value: Column
    where: Column | None = None
    depth: int = 1


@dataclass(frozen=True)
class Behind:
    """The previous ``depth`` values among earlier rows where ``where`` holds."""
    value: Column
    where: Column | None = None
    depth: int = 1


@dataclass(frozen=True)
class Latest:
    """The last non-null value up to and including the row."""
    value: Column


@dataclass(frozen=True)
class Running:
    """Sum of ``amount`` up to and including the row."""
    amount: Column


Look = Ahead | Behind | Latest | Running


@dataclass(frozen=True)
class Timeline:
    """Session keys (never null) and row order.

    ``order[0]`` is the position in the session, from which blocks follow if it
    is dense; further entries break ties among rows that share one.  ``block_rows=None`` means every session
    fits one task.  ``group_blocks`` neighbouring blocks share the window that carries
    across their borders; None means that all blocks of a session do.
    """
    keys: tuple[str, ...] = ("session_id",)
    order: tuple[str, ...] = ("seq",)
    block_rows: int | None = None
    group_blocks: int | None = None

    def ordered_by(self, *order: str) -> Timeline:
        return replace(self, order=order)

    def look(self, df: DataFrame, **asked: Look) -> DataFrame:
        """Add one column per look-up (``name_1``.. when its depth exceeds 1)."""
        slots = {f"__s_{name}": _slot(look) for name, look in asked.items()}
        if self.block_rows is None:
            return self._read(df.withColumns(slots), self.keys, asked, None).drop(*slots)
        if _BLOCK not in df.columns:
            df = df.withColumn(
                _BLOCK, F.floor((F.col(self.order[0]) - 1) / self.block_rows))
        return self._look_in_parts(df.withColumns(slots), (*self.keys, _BLOCK), asked)

    def settle(self, df: DataFrame) -> DataFrame:
        """Cut the lineage between look-ups of block-wise work.

        Block-wise look-ups read their input twice; without a cut, a chain of
        them would recompute its start once per link and branch.
        """
        return df if self.block_rows is None else settle(df)

    def extra(self, df: DataFrame, known: Sequence[str]) -> list[str]:
        """The block column, if the frame has one that is not among ``known``."""
        return [c for c in (_BLOCK,) if c in df.columns and c not in known]

    def leave(self, df: DataFrame) -> DataFrame:
        return df.drop(_BLOCK)

    # -- reading ---------------------------------------------------------

    def _look_in_parts(self, rows: DataFrame, parts: Sequence[str],
                       asked: dict[str, Look]) -> DataFrame:
        carry = self._carry(rows, parts, asked)
        local = self._local(rows, parts, asked).join(carry, list(parts), "left")
        return self._read(local, parts, asked, carry)

    def _windows(self, parts: Sequence[str]):
        w = Window.partitionBy(*parts).orderBy(*self.order)
        return w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _read(self, df: DataFrame, parts: Sequence[str], asked: dict[str, Look],
              carry: DataFrame | None) -> DataFrame:
        if carry is None:
            w, upto = self._windows(parts)
            out = {}
            for name, look in asked.items():
                if isinstance(look, Running):
                    out[name] = F.sum(f"__s_{name}").over(upto)
                elif isinstance(look, Latest):
                    out[name] = F.last(f"__s_{name}", ignorenulls=True).over(upto)["v"]
                else:
                    for k in range(1, look.depth + 1):
                        out[_numbered(name, look, k)] = _neighbour(name, look, k).over(w)["v"]
            return df.withColumns(out)
        out, gone = {}, [f"__s_{n}" for n in asked]
        for name, look in asked.items():
            if isinstance(look, Running):
                own, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
                out[name] = F.coalesce(own + before, own, before)
                gone += [f"__l_{name}", f"__c_{name}"]
            elif isinstance(look, Latest):
                out[name] = F.coalesce(f"__l_{name}", f"__c_{name}_1")["v"]
                gone += [f"__l_{name}", f"__c_{name}_1"]
            else:
                for k in range(1, look.depth + 1):
                    # With j < k members left inside the block, the k-th
                    # member is number k - j of those beyond its border.
                    beyond = F.col(f"__c_{name}_1")
                    for j in range(k - 2, -1, -1):
                        beyond = F.when(F.col(f"__l_{name}_{j + 1}").isNull(),
                                        F.col(f"__c_{name}_{k - j}")).otherwise(beyond)
                    out[_numbered(name, look, k)] = F.coalesce(
                        F.col(f"__l_{name}_{k}"), beyond)["v"]
                    gone += [f"__l_{name}_{k}", f"__c_{name}_{k}"]
        return df.withColumns(out).drop(*gone)

    def _local(self, rows: DataFrame, parts: Sequence[str], asked: dict[str, Look]) -> DataFrame:
        w, upto = self._windows(parts)
        out = {}
        for name, look in asked.items():
            if isinstance(look, Running):
                out[f"__l_{name}"] = F.sum(f"__s_{name}").over(upto)
            elif isinstance(look, Latest):
                out[f"__l_{name}"] = F.last(f"__s_{name}", ignorenulls=True).over(upto)
            else:
                for k in range(1, look.depth + 1):
                    out[f"__l_{name}_{k}"] = _neighbour(name, look, k).over(w)
        return rows.withColumns(out)

    def _carry(self, rows: DataFrame, parts: Sequence[str], asked: dict[str, Look]) -> DataFrame:
        """What each block needs from the others: one row per block."""
        edges = self._edges(rows, parts, asked)
        if self.group_blocks is None:
            across, kept = self._across(edges, asked)
        else:
            across, kept = self._across_groups(edges, asked)
        return across.groupBy(*parts).agg(*[F.any_value(c, F.lit(True)).alias(c) for c in kept])

    def _edges(self, rows: DataFrame, parts: Sequence[str], asked: dict[str, Look]) -> DataFrame:
        """The rows of each block that others may ask for, or that ask for the block."""
        w, upto = self._windows(parts)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        marks = {"__first": F.row_number().over(w) == 1,
                 "__last": F.lead(F.lit(1)).over(w).isNull()}
        edge, slots = F.col("__first") | F.col("__last"), {}
        for name, look in asked.items():
            slot, mark = f"__s_{name}", f"__m_{name}"
            if isinstance(look, Running):
                marks[mark] = F.sum(slot).over(upto)
                # From here on the sum of a block is the amount of its last row.
                slots[slot] = F.when(F.col("__last"), F.col(mark))
                continue
            if isinstance(look, Ahead):
                near = F.count(slot).over(upto) <= look.depth
            else:
                near = F.count(slot).over(whole) - F.count(slot).over(upto) < _depth(look)
            marks[mark] = F.col(slot).isNotNull() & near
            edge = edge | F.col(mark)
        needed = [*parts, *[c for c in self.order if c not in parts],
                  *[f"__s_{n}" for n in asked]]
        return (rows.select(*needed).withColumns(marks).where(edge).withColumns(slots)
                .drop(*[f"__m_{n}" for n in asked]))

    def _across(self, edges: DataFrame, asked: dict[str, Look]) -> tuple[DataFrame, list[str]]:
        """Look along the edge rows of a whole session in one window."""
        across = Window.partitionBy(*self.keys).orderBy(*self._by_block())
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        found = {}
        for name, look in asked.items():
            if isinstance(look, Running):
                found[f"__c_{name}"] = F.when(F.col("__first"), F.sum(f"__s_{name}").over(earlier))
                continue
            at = "__last" if isinstance(look, Ahead) else "__first"
            for k in range(1, _depth(look) + 1):
                found[f"__c_{name}_{k}"] = F.when(
                    F.col(at), _neighbour(name, look, k).over(across))
        return edges.withColumns(found), list(found)

    def _across_groups(self, edges: DataFrame,
                       asked: dict[str, Look]) -> tuple[DataFrame, list[str]]:
        """Look along the edge rows group by group, as along the rows block by block.

        The edge rows are read twice, so they are written first.
        """
        edges = settle(edges.withColumn(_GROUP, F.floor(F.col(_BLOCK) / self.group_blocks)))
        looks: dict[str, Look] = {}
        for name, look in asked.items():
            held = F.col(f"__s_{name}")
            if isinstance(look, Running):
                looks[f"__g_{name}"] = Running(held)
            else:
                # A block gets what lies before or after it, so never its own last value.
                kind = Ahead if isinstance(look, Ahead) else Behind
                looks[f"__g_{name}"] = kind(held, held.isNotNull(), _depth(look))
        above = replace(self, order=self._by_block(), group_blocks=None)
        slots = {f"__s_{name}": _slot(look) for name, look in looks.items()}
        seen = above._look_in_parts(edges.withColumns(slots), (*self.keys, _GROUP), looks)
        found = {}
        for name in asked:
            above_name = f"__g_{name}"
            look = looks[above_name]
            if isinstance(look, Running):
                before = F.col(above_name) - F.coalesce(f"__s_{name}", F.lit(0))
                found[f"__c_{name}"] = F.when(F.col("__first"), before)
                continue
            at = "__last" if isinstance(look, Ahead) else "__first"
            for k in range(1, look.depth + 1):
                found[f"__c_{name}_{k}"] = F.when(
                    F.col(at), F.col(_numbered(above_name, look, k)))
        return seen.withColumns(found), list(found)

    def _by_block(self) -> tuple[str, ...]:
        return (_BLOCK, *[c for c in self.order if c != _BLOCK])


def _depth(look: Look) -> int:
    return 1 if isinstance(look, Latest) else look.depth


def _slot(look: Look) -> Column:
    if isinstance(look, Running):
        return look.amount.cast("bigint")
    held = F.struct(look.value.alias("v"))
    if isinstance(look, Latest):
        return F.when(look.value.isNotNull(), held)
    return held if look.where is None else F.when(look.where, held)


def _numbered(name: str, look: Ahead | Behind, k: int) -> str:
    return name if look.depth == 1 else f"{name}_{k}"


def _neighbour(name: str, look: Look, k: int) -> Column:
    step = "lead" if isinstance(look, Ahead) else "lag"
    return F.expr(f"{step}(`__s_{name}`, {k}) ignore nulls")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session below the one the cluster shares.

    ``spark.checkpoint.dir`` names it; where that is unset, as in tests, the
    warehouse is taken, which a cluster shares as well.  The folder is removed
    when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{base.rstrip('/')}/sessions-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return fs.makeQualified(at).toString()


def settle(df: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again.

    Runs a job.  Later readers scan only the columns they use, and a lost
    executor does not restart the chain.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _null_key(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def long_sessions(df: DataFrame, keys: Sequence[str],
                  block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """Keys of sessions with more than ``block_rows`` rows, or None.

    Runs one narrow, map-side combined count and refuses null keys.  At most
    rows / block_rows keys come back; up to ``MAX_BROADCAST_KEYS`` of them pass
    through the driver, more are written out.
    """
    found = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
             .where((F.col("__n") > block_rows) | _null_key(keys))
             .select(_null_key(keys).alias("__null"), *keys))
    some = found.limit(MAX_BROADCAST_KEYS + 1).collect()
    if any(r["__null"] for r in some):
        raise ValueError(f"null session key in {list(keys)}")
    if len(some) > MAX_BROADCAST_KEYS:
        found = settle(found)
        if not found.where("__null").isEmpty():
            raise ValueError(f"null session key in {list(keys)}")
        return found.drop("__null")
    if not some:
        return None
    return df.sparkSession.createDataFrame([tuple(r)[1:] for r in some], found.drop("__null").schema)


def _apart(df: DataFrame, keys: Sequence[str],
           long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary and of long sessions."""
    listed = sized(long, keys)
    return df.join(listed, list(keys), "left_anti"), df.join(listed, list(keys), "left_semi")


def sized(listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys to join rows with.  Few are broadcast, so that no row is shuffled; the
    size of many is left to Spark to judge.  Runs a job over the keys."""
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(reduce(add, [
        F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys])
    ).alias("bytes")).first()
    few = size["n"] <= MAX_BROADCAST_KEYS and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES
    return F.broadcast(listed) if few else listed


def _placed(df: DataFrame, line: Timeline) -> tuple[DataFrame, Timeline]:
    """Rows of long sessions with their block, and the timeline with its groups of blocks.

    The position gives the block if it is dense; otherwise a place counted in
    the session does, since sparse positions would leave a row or two per block.
    """
    at = line.order[0]
    size = df.groupBy(*line.keys).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__least"),
                                      F.max(at).alias("__most"))
    dense = (F.col("__least") >= 1) & (F.col("__most") <= F.col("__n"))
    found = size.agg(F.max("__n").alias("rows"),
                     F.bool_and(F.coalesce(dense, F.lit(False))).alias("dense")).first()
    blocks = -(-(found["rows"] or 1) // line.block_rows)
    line = replace(line, group_blocks=math.isqrt(blocks - 1) + 1)
    if found["dense"] is not False:
        return df, line
    counted = _numbered_apart(df, line.keys, [F.col(c) for c in line.order], "__place")
    return counted.withColumn(
        _BLOCK, F.floor((F.col("__place") - 1) / line.block_rows)).drop("__place"), line


def per_session(df: DataFrame, work: Callable[[DataFrame, Timeline], DataFrame],
                keys: Sequence[str] = ("session_id",), order: Sequence[str] = ("seq",),
                long: DataFrame | str | None = MEASURE,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``work`` over every session: ordinary ones in one window pass,
    the ones listed in ``long`` block by block.

    ``long`` is what :func:`long_sessions` found, None if it is known that there
    are none; by default it is found here, by a job.  Long sessions run jobs
    while the frame is built.
    """
    plain = Timeline(tuple(keys), tuple(order))
    if isinstance(long, str):
        long = long_sessions(df, keys, block_rows)
    if long is None:
        return work(df, plain)
    blocked = replace(plain, block_rows=block_rows)
    ordinary, lengthy = _apart(df, keys, long)
    # Dealt evenly: the tasks that read them do the heavy work of the first pass.
    dealt = lengthy.repartition(*keys, order[0])
    placed, blocked = _placed(blocked.settle(dealt), blocked)
    return work(ordinary, plain).unionByName(blocked.leave(work(placed, blocked)))


def row_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                 name: str = "seq", long: DataFrame | str | None = MEASURE) -> DataFrame:
    """Number the rows of each session from 1 in the given total order.

    Long sessions are sorted globally, so that a session spans many tasks, and
    numbered by place in their sorted part plus the sizes of the parts before.
    """
    by = [as_column(c) for c in order]

    def in_window(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*by)
        return part.withColumn(name, F.row_number().over(w).cast("bigint"))

    if isinstance(long, str):
        long = long_sessions(df, keys)
    if long is None:
        return in_window(df)
    ordinary, lengthy = _apart(df, keys, long)
    return in_window(ordinary).unionByName(_numbered_apart(lengthy, keys, by, name))


def _numbered_apart(df: DataFrame, keys: Sequence[str], by: Sequence[Column],
                    name: str) -> DataFrame:
    """Number by a global sort: a row's place in its sorted part plus the rows of
    its session in the parts before."""
    placed = settle(df.orderBy(*keys, *by).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    w = Window.partitionBy(*keys).orderBy("__part")
    # One row per long session and sorted part.
    runs = (placed.groupBy(*keys, "__part")
            .agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n"))
            .withColumn("__before", F.coalesce(
                F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .drop("__n"))
    return (placed.join(runs, [*keys, "__part"], "left")
            .withColumn(name, F.col("__at") - F.col("__from") + F.col("__before") + 1)
            .drop("__at", "__part", "__from", "__before"))
