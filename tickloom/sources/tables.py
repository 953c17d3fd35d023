"""Scans and sinks: Parquet with provenance, validated dimensions, journals, staged publishing with evidence, exports."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gates import audit, signature


def scan(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, base: str | None = None) -> DataFrame:
    """Parquet files unioned by name, with source_file; no paths give an empty table of the schema."""
    if not paths:
        if schema is None:
            raise ValueError("an empty scan needs a schema")
        return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("source_file", T.StringType())]))
    reader = spark.read.option("mergeSchema", True)
    if base:
        reader = reader.option("basePath", base)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(*paths)
    return df.select(*df.columns, F.col("_metadata.file_path").alias("source_file"))


def csv_master(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    """A CSV instrument master with a fixed schema and a filter."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return df if where is None else df.where(where)


def slot_rows(df: DataFrame, keys: list[str], slot: str, preference: list[str]) -> DataFrame:
    """One slot per key: the first of the preference list that the key has; other slots are left out."""
    order = F.array_position(F.array(*[F.lit(s) for s in preference]), F.col(slot))
    first = df.where(order > 0).groupBy(*keys).agg(F.min(order).alias("__o"))
    return df.withColumn("__x", order).join(first, keys).where("__x = __o").drop("__x", "__o")


def evidence(df: DataFrame, slots: list[str]) -> DataFrame:
    """First-seen evidence with a reason per bad row: hash form, slot, date order, repeated key; null where good."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("trading_date", "time_slot", "source_sha256"))
    reason = (
        F.when(~F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "BAD_HASH").when(~F.coalesce(F.col("time_slot").isin(slots), F.lit(False)), "BAD_SLOT")
        .when(F.col("first_seen_ts_ist").isNull() | (F.col("first_seen_ts_ist").cast("date") < F.col("trading_date")), "SEEN_BEFORE_DATE").when(n > 1, "REPEATED_KEY")
    )
    return df.withColumn("reason", reason)


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines with line numbers per file; malformed rows fail, but a truncated last line of a file is left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    closed = F.col("value").endswith("\n")
    lines = raw.select("file", closed.alias("closed"), F.posexplode(F.split("value", "\n")).alias("line", "text"), F.size(F.split("value", "\n")).alias("n"))
    lines = lines.where("text <> '' and (closed or line < n - 1)")
    parsed = lines.select("file", "line", F.from_json("text", schema + ", __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"}).alias("e"), "text")
    bad = F.col("e").isNull() | F.col("e.__corrupt").isNotNull()
    checked = parsed.withColumn("__ok", F.when(bad, F.raise_error(F.concat(F.lit("malformed journal line "), F.col("line")))).otherwise(F.lit(True))).where("__ok")
    return checked.select("file", "line", "e.*").drop("__corrupt")


def write_ordered(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None, files: int | None = None, max_records: int = 0) -> None:
    """Zstandard Parquet in total key order: range-partitioned, sorted within files."""
    by = [*(partition_by or []), *keys]
    ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    w = ranged.sortWithinPartitions(*by).write.option("compression", "zstd").option("maxRecordsPerFile", max_records)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str], gzip: bool = False) -> None:
    """A small report as one CSV file in a total order."""
    df.orderBy(*order).coalesce(1).write.option("compression", "gzip" if gzip else "none").csv(path, header=True)


def publish(df: DataFrame, root: str, partition: str, keys: list[str], checks: dict[str, Column], inputs: dict[str, str], expected_rows: int | None = None) -> dict:
    """Staged publishing of one partition with evidence.

    The data goes to a staging folder, is audited there in one scan (rows, every check, repeated keys, row
    conservation), is renamed into place, and the manifest, written last, makes it visible. A violation leaves
    the staging folder under _quarantine and raises. Equal input hashes and a manifest in place mean nothing is done.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(root).getFileSystem(conf)
    fingerprint = hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()
    final, note = f"{root}/{partition}", f"{root}/_manifests/{partition.replace('/', '__')}.json"
    if fs.exists(P(note)):
        have = json.loads("\n".join(r.value for r in spark.read.text(note).collect()))
        if have["inputs_sha256"] == fingerprint:
            return {**have, "action": "skipped"}
    stage = f"{root}/_staging/{uuid.uuid4().hex}"
    write_ordered(df, stage, keys)
    staged = spark.read.parquet(stage)
    found = audit(staged, checks, keys).first().asDict()
    total = found.pop("total_rows") or 0
    bad = {k: v for k, v in found.items() if v}
    if expected_rows is not None and total != expected_rows:
        bad["row_conservation"] = total - expected_rows
    if bad:
        fs.mkdirs(P(f"{root}/_quarantine"))
        fs.rename(P(stage), P(f"{root}/_quarantine/{uuid.uuid4().hex}"))
        raise ValueError(f"{partition} isn't published: {bad}")
    content = signature(staged).first().signature
    if fs.exists(P(note)):
        fs.delete(P(note), False)
    if fs.exists(P(final)):
        fs.mkdirs(P(f"{root}/_quarantine"))
        fs.rename(P(final), P(f"{root}/_quarantine/{uuid.uuid4().hex}"))
    fs.mkdirs(P(final).getParent())
    fs.rename(P(stage), P(final))
    manifest = {"partition": partition, "rows": total, "content": content, "inputs_sha256": fingerprint, "violations": 0}
    out = fs.create(P(note), True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return {**manifest, "action": "published"}


def published(spark: SparkSession, root: str) -> DataFrame:
    """All partitions that have a manifest."""
    notes = [json.loads(r.value) for r in spark.read.text(f"{root}/_manifests").collect()]
    return spark.read.parquet(*[f"{root}/{n['partition']}" for n in sorted(notes, key=lambda n: n["partition"])])


def sample_rows(df: DataFrame, dates: list[str], clocks: list[str], ts: str, order: list[str]) -> DataFrame:
    """A deterministic extract: given dates and clock times, in a total order."""
    return df.where(F.col(ts).cast("date").cast("string").isin(dates) & F.date_format(ts, "HH:mm").isin(clocks)).orderBy(*order)
