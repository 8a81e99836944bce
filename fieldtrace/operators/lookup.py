"""Dictionary relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import settle

# Dictionaries up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_ENTRIES = 100_000
BROADCAST_CHARS = 32_000_000
# A label with more rows than this is spread over salts when joined by shuffle.
HOT_ROWS = 1_000_000
SALTS = 64
# The summary that finds such labels: counters it keeps, and labels it can name.
TRACKED = 100_000
MOST_HOT = 10_000


def first_matches(dictionary: DataFrame) -> DataFrame:
    """One entry per lower-cased key: the first by ``dict_seq``."""
    return (dictionary.groupBy(F.lower("behavior").alias("__key"))
            .agg(F.min_by(F.struct("replacement"), "dict_seq").alias("__entry")))


def fits_broadcast(dictionary: DataFrame) -> bool:
    size = dictionary.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.length("behavior"), F.lit(0))
              + F.coalesce(F.length("replacement"), F.lit(0))).alias("chars")).first()
    return size["n"] <= BROADCAST_ENTRIES and (size["chars"] or 0) <= BROADCAST_CHARS


def frequent(df: DataFrame, key: Column, rows: int, most: int = MOST_HOT,
             tracked: int = TRACKED) -> DataFrame:
    """``(hot)``: 64-bit hashes of the keys with more than ``rows`` rows, at most ``most``.

    One pass with a frequent-items summary of ``tracked`` counters, which merges
    map-side and never grows with the data.  Its counts are upper bounds, so it may
    name a key too many; of those it does not name, each has less than about
    1 / ``most`` of all rows.
    """
    top = df.select(F.xxhash64(key).alias("key")).agg(
        F.expr(f"approx_top_k(key, {most}, {tracked})").alias("top"))
    return (top.select(F.explode("top").alias("t")).where(F.col("t.count") > rows)
            .select(F.col("t.item").alias("hot")))


def relabel(df: DataFrame, dictionary: DataFrame, col: str = "behavior",
            small: bool | None = None, hot_rows: int = HOT_ROWS,
            most_hot: int = MOST_HOT) -> DataFrame:
    """Replace ``col`` by the dictionary's ``replacement``, ignoring case.

    The first entry of a key wins, also when its replacement is null; a label
    without an entry stays.  Null labels match a null key.  ``small`` states
    whether the dictionary may be broadcast; by default it is measured, by a
    job.  A large one is joined by shuffle; the labels with more than ``hot_rows``
    rows are found by a summary of fixed size (:func:`frequent`), and only their
    rows and entries are spread over salts.  The found labels stay a table, of
    ``most_hot`` hashes at most, which is why it may be broadcast.
    """
    entries = first_matches(dictionary)
    if fits_broadcast(dictionary) if small is None else small:
        joined = df.join(F.broadcast(entries), F.lower(col).eqNullSafe(F.col("__key")), "left")
    else:
        hot = settle(frequent(df, F.lower(col), hot_rows, most_hot))
        same = F.lower(col).eqNullSafe(F.col("__key"))
        if not hot.isEmpty():
            own, of_entry = (F.broadcast(hot.withColumnRenamed("hot", name)) for name in ("__hot", "__hot_key"))
            salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS))
            df = (df.join(own, F.xxhash64(F.lower(col)) == F.col("__hot"), "left")
                  .withColumn("__own", F.when(F.col("__hot").isNotNull(), salt).otherwise(F.lit(0))).drop("__hot"))
            entries = (entries.join(of_entry, F.xxhash64("__key") == F.col("__hot_key"), "left")
                       .withColumn("__salt", F.explode(
                           F.when(F.col("__hot_key").isNotNull(), F.expr(f"sequence(0L, {SALTS - 1}L)"))
                           .otherwise(F.array(F.lit(0).cast("bigint"))))).drop("__hot_key"))
            joined = df.join(entries, same & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
        else:
            joined = df.join(entries, same, "left")
    hit = F.col("__entry").isNotNull()
    return (joined.withColumn(col, F.when(hit, F.col("__entry")["replacement"])
                              .otherwise(F.col(col)))
            .drop("__key", "__entry"))
