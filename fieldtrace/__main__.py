"""Batch job: ``spark-submit -m fieldtrace LOG DICTIONARY OUT [options]``.

Reads the session logs under LOG, writes the event table under OUT with one
directory per session, or with ``--single`` as one sorted table.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import long_sessions
from .plans import REPAIRS, event_table, report
from .settings import SESSION_SETTINGS
from .sources import read_dictionary, read_sessions, write_sessions, write_table


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fieldtrace", description=__doc__)
    parser.add_argument("log")
    parser.add_argument("dictionary")
    parser.add_argument("out")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv", "orc", "json"))
    parser.add_argument("--sessions", nargs="*", help="only these sessions; those under OUT stay (not with --single)")
    parser.add_argument("--raw", action="store_true",
                        help="the log has its raw headings and dates as text")
    parser.add_argument("--single", action="store_true", help="one table instead of directories")
    parser.add_argument("--buckets", type=int, help="share so many directories among sessions")
    parser.add_argument("--repair", nargs="*", default=(), choices=sorted(REPAIRS))
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("fieldtrace")
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    options = {"header": "true"} if args.format == "csv" else {}
    log = read_sessions(spark, args.log, fmt=args.format, sessions=args.sessions,
                        options=options, raw=args.raw)
    words = read_dictionary(spark, args.dictionary, fmt=args.format, options=options)
    long = long_sessions(log.select("session_id"), ["session_id"])
    events = report(event_table(log, words, repair=args.repair, long=long), keep_order=True)
    if args.single:
        write_table(events, args.out, fmt=args.format, options=options)
    else:
        # A long session is written by several tasks, in order only if ranged.
        write_sessions(events, args.out, fmt=args.format, options=options,
                       ranged=long is not None, buckets=args.buckets, sessions=args.sessions)


if __name__ == "__main__":
    main()
