"""Session settings the library is tuned for; the caller applies them."""

SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    # The event table's projections are long.  Java does not compile methods
    # beyond 8000 bytes, so Spark should fall back to split ones there.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Its plan has more generated classes than the default cache holds.
    "spark.sql.codegen.cache.maxEntries": "1000",
    # Call sites of every column expression cost more than the plan itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}
