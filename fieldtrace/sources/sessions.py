"""Session datasets: one directory per session, or one clustered table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import clean_date
from ..operators.columns import quoted, rename_columns, rename_matching
from ..operators.timeline import BLOCK_ROWS, long_sessions, row_sequence, settle, sized

_TEXTS = ("time_raw", "time_2", "observer", "groups", "focal_individual",
          "behavior", "partner", "agg_sub", "play", "olfactory", "pup_care",
          "modifiers", "sex", "life_history", "time_spent_running", "comments")

LOG_SCHEMA = T.StructType(
    [T.StructField("session_id", T.StringType()), T.StructField("seq", T.LongType()),
     T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in _TEXTS])

DICTIONARY_SCHEMA = T.StructType([
    T.StructField("behavior", T.StringType()), T.StructField("replacement", T.StringType()),
    T.StructField("dict_seq", T.LongType())])

# --- fixed values: headings of the raw log and their column names -------------
RAW_HEADINGS = {
    "Date": "date", "Time...2": "time_raw", "Observer": "observer", "Groups": "groups",
    "Behavior/Category": "behavior", "Aggression/Submission": "agg_sub", "Play": "play",
    "Olfactory": "olfactory", "Pup care": "pup_care", "Modifiers": "modifiers",
    "Sex": "sex", "Life History": "life_history",
    "Time spent running": "time_spent_running", "Comments": "comments",
}
VARYING_HEADINGS = {"focal individual": "focal_individual", "partner(s)": "partner"}


def from_headings(df: DataFrame) -> DataFrame:
    """A raw log under the library's names, its date parsed.

    Two headings vary and are found by their ending.  A date text that does not
    parse stops the job.
    """
    df = rename_columns(df, RAW_HEADINGS)
    for ending, name in VARYING_HEADINGS.items():
        df = rename_matching(df, name, suffix=ending)
    df = rename_matching(df, "time_2", prefix="Time...")
    if dict(df.dtypes)["date"] != "date":
        parsed = clean_date(F.col("date").cast("string"))
        bad = F.raise_error(F.concat(F.lit("not a date: "), F.col("date").cast("string")))
        df = df.withColumn("date", F.when(F.col("date").isNotNull() & parsed.isNull(),
                                          bad.cast("date")).otherwise(parsed))
    return df.withColumns({c: F.col(c).cast("string") for c in _TEXTS if c in df.columns})


def _never_null(df: DataFrame, *cols: str) -> DataFrame:
    """Stop the job at a null in one of the columns."""
    return df.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {c} in the log"))
                                     .cast(dict(df.dtypes)[c])).otherwise(F.col(c)) for c in cols})


def _bound_by_header(spark: SparkSession, path: str, schema: T.StructType | str,
                     options: Mapping[str, str]) -> T.StructType:
    """The schema in the order of a text file's header; unknown headings are texts."""
    declared = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    types = {f.name: f.dataType for f in declared}
    names = spark.read.options(**options).csv(path).columns
    return T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])


@contextmanager
def listed_in_bulk(spark: SparkSession) -> Iterator[None]:
    """Frames read in here list their directories by a few tasks a core.

    Spark starts a task for each directory, up to ten thousand, which takes longer
    to start than to list.  A smaller number that is set is kept.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    given = spark.conf.get(name)
    spark.conf.set(name, min(int(given), max(64, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, given)


def read_sessions(spark: SparkSession, path: str, *, fmt: str = "parquet",
                  schema: T.StructType | str | None = LOG_SCHEMA,
                  sessions: Sequence[str] | None = None,
                  options: Mapping[str, str] | None = None, raw: bool = False,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All sessions under ``path`` as one frame.

    The layout is one ``session_id=...`` directory per session, bucket directories
    (see :func:`write_sessions`) or a table with that column.  ``sessions`` selects
    by directory, so the others are not listed into the scan.  A schema avoids
    inference.  With ``raw`` the log has its raw headings and a date as text.

    Rows of files without ``seq`` are numbered by file and place in the file,
    which only parquet knows; the files' own schema tells, not the declared one.
    A null session or position stops the job that meets it; see
    :func:`check_positions` for repeated ones.  Text files with a header are bound
    by name, and what does not parse stops the job.
    """
    given = dict(options or {})
    reader = spark.read.options(**given)
    with listed_in_bulk(spark):
        if raw:
            df = reader.format(fmt).load(path)
        elif fmt == "csv" and given.get("header", "").lower() == "true" and schema is not None:
            df = (reader.option("mode", "FAILFAST")
                  .schema(_bound_by_header(spark, path, schema, given)).csv(path))
        elif schema is not None:
            own = schema
            if fmt in ("parquet", "orc"):
                declared = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
                there = set(reader.format(fmt).load(path).columns)
                own = T.StructType([f for f in declared if f.name in there or f.name != "seq"])
            df = reader.option("mode", "FAILFAST").schema(own).format(fmt).load(path)
        else:
            df = reader.format(fmt).load(path)
    if sessions is not None:
        df = df.where(F.col("session_id").cast("string").isin(list(sessions)))
        if BUCKET in df.columns and sessions:
            n = buckets_of(spark, path)
            of = spark.createDataFrame([(s,) for s in sessions], "s string").select(
                bucket_of("s", n).alias("b")).distinct().collect()
            df = df.where(F.col(BUCKET).isin([r["b"] for r in of]))
    df = df.drop(BUCKET)
    if "seq" not in df.columns:
        if fmt != "parquet":
            raise ValueError("a text log needs a seq column: its row order is not stored")
        # Files of one write are numbered; their names need not sort as numbers.
        placed = df.select(
            "*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
            .try_cast("bigint").alias("__file_no"), F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.row_index").alias("__row"))
        df = row_sequence(placed, ["session_id"], ["__file_no", "__file", "__row"],
                          long=long_sessions(placed, ["session_id"], block_rows)).drop(
            "__file_no", "__file", "__row")
    if raw:
        df = from_headings(df)
    return _never_null(df, "session_id", "seq")


def check_positions(log: DataFrame) -> None:
    """Raise if a session repeats a position.  Runs one job over two columns.

    For logs that are used by themselves; the event table checks in its own pass.
    """
    twice = log.groupBy("session_id", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if twice:
        raise ValueError(f"session {twice[0]['session_id']!r} repeats seq {twice[0]['seq']}")


def read_dictionary(spark: SparkSession, path: str, *, fmt: str = "parquet",
                    options: Mapping[str, str] | None = None) -> DataFrame:
    """The label dictionary; ``dict_seq`` decides which entry of a key is first."""
    given = dict(options or {})
    schema = DICTIONARY_SCHEMA
    if fmt == "csv" and given.get("header", "").lower() == "true":
        schema = _bound_by_header(spark, path, schema, given)
    return (spark.read.options(**given).option("mode", "FAILFAST").schema(schema)
            .format(fmt).load(path).select(*DICTIONARY_SCHEMA.fieldNames()))


def name_sessions(df: DataFrame, catalogue: DataFrame, position: str = "sheet_no",
                  first: int | None = None, last: int | None = None) -> DataFrame:
    """Give sessions their names by position, optionally only a range of them.

    The catalogue has ``position`` and ``session_id``, one row per session; it
    grows with the data, so Spark decides by size whether to broadcast it.
    """
    if first is not None:
        df = df.where(F.col(position) >= first)
    if last is not None:
        df = df.where(F.col(position) <= last)
    return df.join(catalogue.select(position, "session_id"), position, "inner")


BUCKET = "session_bucket"
# Rows held at once, and written as a row group, where tasks write files through Arrow.
GROUP_ROWS = 100_000


def bucket_of(session: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(session).cast("string")), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, path: str) -> int:
    """The number of buckets a dataset was written with, from its marker file."""
    return int(_marker(spark, path, "_buckets"))


def _with_order(df: DataFrame, fmt: str, order: Sequence[str]) -> DataFrame:
    """Text files cannot hold a struct: there it becomes a text that sorts alike."""
    if fmt != "csv":
        return df
    for c in order:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StructType):
            df = df.withColumn(c, F.concat_ws(".", *[
                F.lpad(F.col(c)[f.name].cast("string"), 12, "0") for f in kind]))
    return df


def _layout(spark: SparkSession, path: str) -> tuple[bool, int | None]:
    """Whether a dataset is there, and the number of its buckets if it has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return False, None
    marker = spark._jvm.org.apache.hadoop.fs.Path(at, "_buckets")
    return True, buckets_of(spark, path) if fs.exists(marker) else None


def _files(spark: SparkSession, path: str, buckets: Sequence[int]) -> dict[str, set[str]]:
    """The names of the files in each of these buckets' directories that is there."""
    jvm, out = spark._jvm, {}
    for bucket in buckets:
        at = jvm.org.apache.hadoop.fs.Path(path, f"{BUCKET}={bucket}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            out[at.toString()] = {f.getPath().getName() for f in fs.listStatus(at)}
    return out


def _delete(spark: SparkSession, directories: Iterable[str]) -> None:
    """Delete directories that may be there, a few at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def gone(directory: str) -> None:
        at = jvm.org.apache.hadoop.fs.Path(directory)
        at.getFileSystem(conf).delete(at, True)

    with ThreadPoolExecutor(8) as pool:
        for some in batched(directories, 10_000):
            list(pool.map(gone, some))


def _directories(spark: SparkSession, path: str, sessions: DataFrame) -> Iterable[str]:
    """The sessions' own directories, one by one."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in sessions.select(F.col("session_id").cast("string")).toLocalIterator():
        name = row[0] if row[0].isalnum() and row[0].isascii() else escape(row[0])
        yield f"{path.rstrip('/')}/session_id={name}"


def _named(df: DataFrame, sessions: Sequence[str] | DataFrame) -> DataFrame:
    """The sessions' names once, as the rows have them, ready to join with rows."""
    spark = df.sparkSession
    if not isinstance(sessions, DataFrame):
        sessions = spark.createDataFrame([(s,) for s in sessions], "session_id string")
    named = (sessions.select(F.col(sessions.columns[0]).cast(df.schema["session_id"].dataType)
                             .alias("session_id")).where("session_id IS NOT NULL").distinct())
    return sized(settle(named), ["session_id"])


def _only(df: DataFrame, named: DataFrame) -> DataFrame:
    """The rows; one of another session stops the job."""
    other = F.raise_error(F.concat(F.lit("not one of the sessions to write: "),
                                   F.col("session_id").cast("string")))
    held = df.join(named.withColumn("__named", F.lit(True)), "session_id", "left")
    return held.select(*[
        (F.when(F.col("__named"), F.col(c)).otherwise(other.cast(df.schema[c].dataType)).alias(c)
         if c == "session_id" else F.col(quoted(c))) for c in df.columns])


def _with_the_others(df: DataFrame, path: str, fmt: str, named: DataFrame,
                     options: Mapping[str, str], touched: Sequence[int]) -> DataFrame:
    """The rows, and those that other sessions have in the buckets ``touched``."""
    reader = df.sparkSession.read.options(**options)
    if fmt in ("parquet", "orc"):
        differ = set(reader.format(fmt).load(path).columns) ^ set(df.columns)
        if differ:
            raise ValueError(f"the dataset and the rows differ in {sorted(differ)}")
    there = reader.schema(df.schema).format(fmt).load(path)
    kept = (there.where(F.col(BUCKET).isin(list(touched)) & F.col("session_id").isNotNull())
            .join(named, "session_id", "left_anti"))
    return df.unionByName(kept)


def write_log(log: DataFrame, path: str, *, buckets: int, block_rows: int = BLOCK_ROWS) -> None:
    """A log laid out by session, so that :func:`read_log` needs no shuffle; overwrites.

    Sessions share ``buckets`` buckets of Parquet files, sorted by session and position.
    A bucket is one task of every later job, so it should hold some tens of megabytes.
    A session of more than ``block_rows`` positions is dealt to tasks by block, so its
    bucket has several files.  A null session or position stops the job.
    """
    spark = log.sparkSession
    table = f"log_{uuid.uuid4().hex}"
    # Spark's own bucket of a session, so that each bucket of short sessions is one file.
    bucket = F.pmod(F.hash("session_id"), F.lit(buckets))
    block = F.floor((F.col("seq") - 1) / block_rows)
    try:
        (_never_null(log, "session_id", "seq").repartition(bucket, block)
         .write.mode("overwrite").format("parquet").option("path", path)
         .bucketBy(buckets, "session_id").sortBy("session_id", "seq").saveAsTable(table))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")      # the files stay
    _mark(spark, path, "_schema", log.schema.json())    # an empty log has no file
    _mark(spark, path, "_buckets", str(buckets))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log that :func:`write_log` wrote, partitioned by session as it lies.

    Windows, counts and joins by session follow without an exchange of the log.
    Spark's catalogue is what knows buckets, so the files pass through it under a
    name of their own, which is gone again when this returns.
    """
    schema = T.StructType.fromJson(json.loads(_marker(spark, path, "_schema")))
    table = f"log_{uuid.uuid4().hex}"
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (session_id) "
              f"SORTED BY (session_id, seq) INTO {buckets_of(spark, path)} BUCKETS "
              "LOCATION '" + path.replace("\\", "\\\\").replace("'", "\\'") + "'")
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def _mark(spark: SparkSession, path: str, name: str, value: str) -> None:
    (spark.range(1).select(F.lit(value).alias("value")).coalesce(1)
     .write.mode("overwrite").text(f"{path.rstrip('/')}/{name}"))


def _marker(spark: SparkSession, path: str, name: str) -> str:
    return spark.read.text(f"{path.rstrip('/')}/{name}").first()[0]


def write_sessions(df: DataFrame, path: str, *, fmt: str = "parquet",
                   order: Sequence[str] = ("row_order",), ranged: bool = False,
                   buckets: int | None = None,
                   sessions: Sequence[str] | DataFrame | None = None,
                   options: Mapping[str, str] | None = None) -> None:
    """One directory per session, rows in order inside each file; overwrites.

    The columns in ``order`` are written too, so that a reader can restore the
    order of a session that lies in several files.  The event table is already
    grouped by session, so sorting inside partitions is enough and each task has
    one file open at a time.  ``ranged`` shuffles by session and order first: for
    rows that are not grouped yet, and for long sessions, which then spread over
    files that follow each other.

    With very many sessions give ``buckets``: sessions share that many
    directories, sorted by session, so neither listing nor commit grows with them.
    Directories of their own are written and replaced by the tasks where the path is on
    a local file system and plain Parquet is asked for; see :func:`write_grouped`.

    ``sessions``, a list or a frame of one column, states that the rows are all of these
    sessions and of no others: they are replaced, also by nothing, and every other
    session stays as it is.  Only their directories are written; in shared ones the
    rows of other sessions are carried over, and the dataset keeps its number of
    buckets.  A row of another session stops the job before anything is replaced.
    """
    spark, given, part = df.sparkSession, dict(options or {}), sessions is not None
    if part:
        there, own = _layout(spark, path)
        if there and buckets is not None and own != buckets:
            raise ValueError(f"the dataset has {own or 'no'} buckets, not {buckets}")
        buckets, part = own if there else buckets, there
        named = _named(df, sessions)
        df = _only(df, named)
    by = "session_id"
    if buckets is not None:
        df, by = df.withColumn(BUCKET, bucket_of("session_id", buckets)), BUCKET
    df = _with_order(df, fmt, order)
    own_way = buckets is None and fmt == "parquet" and not given and _written_alike(spark, df)
    root = _local(spark, path) if own_way else None
    if part and buckets is not None:
        touched = [r[0] for r in named.select(bucket_of("session_id", buckets)).distinct().collect()]
        # Rows carried over are not grouped with the new ones.
        df, ranged = _with_the_others(df, path, fmt, named, given, touched), True
        before = _files(spark, path, touched)
    elif part:
        # Written aside first, which tells the sessions without rows; grouped no longer.
        df, ranged = settle(df), True
    placed = df.repartitionByRange("session_id", *order) if ranged else df
    ordered = placed.sortWithinPartitions(
        *([BUCKET] if buckets is not None else []), "session_id", *order)
    if root is not None:
        _write_own(ordered, path, root, named if part else None)
        return
    # Dynamic: only the directories that get rows are replaced, once all are written.
    (ordered.write.mode("overwrite").options(**given)
     .option("partitionOverwriteMode", "dynamic" if part else "static")
     .partitionBy(by).format(fmt).save(path))
    if part and buckets is not None:
        after = _files(spark, path, touched)
        _delete(spark, [d for d, names in before.items() if after.get(d) == names])
    elif part:
        without = named.join(df.select("session_id"), "session_id", "left_anti")
        _delete(spark, _directories(spark, path, without))
    elif buckets is not None:
        _mark(spark, path, "_buckets", str(buckets))


def _local(spark: SparkSession, path: str) -> str | None:
    """The folder of a path on a local file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath().rstrip("/") or None if uri.getScheme() == "file" else None


_ALIKE = {T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
          T.FloatType, T.DoubleType, T.DateType, T.TimestampNTZType}


def _written_alike(spark: SparkSession, df: DataFrame) -> bool:
    """Whether Arrow writes these columns, by the session's settings, as Spark does."""
    def alike(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return len(kind) > 0 and all(alike(f.dataType) for f in kind)
        return type(kind) in _ALIKE or kind == T.StringType()

    kinds = [f.dataType for f in df.schema if f.name != "session_id"]
    settings = {"spark.sql.parquet.compression.codec": "snappy",
                "spark.sql.parquet.writeLegacyFormat": "false",
                "spark.sql.files.maxRecordsPerFile": "0"}
    return (0 < len(kinds) < len(df.schema) and all(map(alike, kinds))
            and all(spark.conf.get(name) == usual for name, usual in settings.items()))


def write_grouped(df: DataFrame, path: str) -> None:
    """One directory per session, as Parquet, into a folder that is not there yet.

    The rows of a session follow each other in their partition, and get a file there.

    Hadoop's local file system starts a process for every directory, file and checksum
    it makes, so that sessions of some dozen rows take longer to place than to
    write.  There the tasks write through Arrow; each file appears whole and under the
    same name at every attempt.  Elsewhere Spark's own writer does.
    """
    root = _local(df.sparkSession, path)
    if root is None:
        df.write.partitionBy("session_id").parquet(path)
        return
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)
    _write_files(df, root, uuid.uuid4().hex)


# Of the name of a session, what Spark escapes in the name of its directory, and the
# one directory of null and an empty text.
_SPECIAL = r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _write_files(df: DataFrame, root: str, job: str) -> None:
    """Below a local folder a directory for each session with its file, ``job`` in its name."""
    special, no_name = _SPECIAL, _NO_NAME
    names = [c for c in df.columns if c != "session_id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sent by value, with all it needs: the workers may lack this package.
        import os
        import re
        from contextlib import suppress
        from itertools import groupby

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task, done = TaskContext.get(), set()
        name = f"part-{task.partitionId():05d}-{job}.snappy.parquet"

        def runs():
            for batch in batches:
                ends, start = pc.run_end_encode(batch.column(0)), 0
                rows = pa.Table.from_arrays(batch.columns[1:], names)
                for session, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                    yield (re.sub(special, lambda c: f"%{ord(c[0]):02X}", session or "")
                           or no_name), rows.slice(start, end - start)
                    start = end

        for session, parts in groupby(runs(), key=lambda run: run[0]):
            if session in done:
                raise ValueError(f"the rows of session {session!r} are not together")
            done.add(session)
            folder = f"{root}/session_id={session}"
            # Not the root: it is gone if the job has failed meanwhile.
            with suppress(FileExistsError):
                os.mkdir(folder)
            # Readers pass over names with a dot in front.
            made, held = f"{folder}/.{name}.{task.taskAttemptId()}", [next(parts)[1]]
            with pq.ParquetWriter(made, held[0].schema, store_schema=False) as file:
                for _, rows in parts:
                    held.append(rows)
                    if sum(map(len, held)) >= GROUP_ROWS:
                        file.write_table(pa.concat_tables(held))
                        held = []
                if held:
                    file.write_table(pa.concat_tables(held))
            os.replace(made, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"sessions": [len(done)]})

    # A heading may hold a dot, which the names of a Python function's columns may not.
    (df.select(F.col("session_id").cast("string"),
               *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
     .mapInArrow(write, "sessions long").agg(F.sum("sessions")).collect())


def _write_own(df: DataFrame, path: str, root: str, named: DataFrame | None) -> None:
    """The sessions' own directories below a local folder: all of them, or those named.

    Written aside, then put in place of the folder or of the named directories.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    jvm = spark._jvm.org.apache.hadoop.fs
    parent, _, last = root.rpartition("/")
    at = jvm.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    # Readers pass over names with a dot in front.
    aside = f"{parent}/.{last}.{job}" if named is None else f"{root}/.{job}"
    beside = fs.makeQualified(jvm.Path("file", None, aside))
    try:
        if not fs.mkdirs(beside):
            raise OSError(f"cannot make {aside}")
        _write_files(df, aside, job)
        if named is not None:
            _put_in_place(named, aside, root, job)
        else:
            fs.create(jvm.Path(beside, "_SUCCESS")).close()
            if fs.exists(at) and not fs.delete(at, True) or not fs.rename(beside, at):
                raise OSError(f"cannot replace {path}")
    finally:
        # Under another name, where no task of a failed job still writes.
        gone = beside.suffix("-gone")
        if fs.exists(beside) and fs.rename(beside, gone):
            fs.delete(gone, True)
    spark.catalog.refreshByPath(path)


def _put_in_place(named: DataFrame, aside: str, root: str, job: str) -> None:
    """Put each named session's files of this ``job`` in place of those it had, and remove
    the directories of those without.  Any task may run again."""
    special, no_name = _SPECIAL, _NO_NAME

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import re
        import shutil
        from contextlib import suppress

        import pyarrow as pa

        def listed(folder):
            with suppress(FileNotFoundError):
                return os.listdir(folder)
            return []

        n = 0
        for batch in batches:
            for session in batch.column(0).to_pylist():
                name = "session_id=" + (re.sub(special, lambda c: f"%{ord(c[0]):02X}", session) or no_name)
                new, old = f"{aside}/{name}", f"{root}/{name}"
                for file in listed(new):
                    if not file.startswith("."):    # of an attempt that was lost
                        os.makedirs(old, exist_ok=True)
                        with suppress(FileNotFoundError):
                            os.replace(f"{new}/{file}", f"{old}/{file}")
                with suppress(OSError):
                    os.rmdir(new)
                there = listed(old)
                if session == "" and not any(job in file for file in there):
                    continue    # it shares its directory with null
                for file in there:
                    if job in file:
                        continue
                    if os.path.isdir(f"{old}/{file}") and not os.path.islink(f"{old}/{file}"):
                        shutil.rmtree(f"{old}/{file}", ignore_errors=True)
                    else:
                        with suppress(FileNotFoundError):
                            os.remove(f"{old}/{file}")
                if not any(job in file for file in there):
                    with suppress(FileNotFoundError):
                        os.rmdir(old)
                n += 1
        yield pa.RecordBatch.from_pydict({"sessions": [n]})

    few = named.sparkSession.sparkContext.defaultParallelism
    (named.select(F.col("session_id").cast("string")).repartition(4 * few)
     .mapInArrow(put, "sessions long").agg(F.sum("sessions")).collect())


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet",
                order: Sequence[str] = ("row_order",),
                options: Mapping[str, str] | None = None) -> None:
    """One table sorted by session and row, the order columns kept; overwrites.

    The sort is by range, so a long session spreads over many files.
    """
    ordered = _with_order(df.orderBy("session_id", *order), fmt, order)
    ordered.write.mode("overwrite").options(**dict(options or {})).format(fmt).save(path)
