"""Session helpers shared by tests, the benchmark and the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session with the settings this engine assumes: UTC, AQE and Arrow on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the star-schema tables; the path may be a file or a folder on any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
