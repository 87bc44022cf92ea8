"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Timestamps are compared with an explicit ``as_of``; pinning the zone keeps day
# arithmetic reproducible.  AQE does the run-time work the operators rely on:
# it measures shuffled sides and picks broadcast joins only when they are small,
# splits skewed join partitions and coalesces small ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Parquet files are several times smaller than their rows; without this a
    # compressed table of a few megabytes counts as small enough to broadcast.
    "spark.sql.sources.fileCompressionFactor": "5.0",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the settings above on a running session where its owner has not set them."""
    chosen = dict(spark.sparkContext.getConf().getAll())
    for key, value in SETTINGS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "shelfmark", cpus: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
