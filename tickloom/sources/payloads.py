"""Provider payloads: parallel arrays, strike maps and alias fields in JSON text become rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_text(payload: Column, names: list[str]) -> Column:
    """The first present field among aliases, as text; names may be JSON paths without the leading $."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names])


def first_number(payload: Column, names: list[str]) -> Column:
    """The first alias that parses as a number."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}").try_cast("double") for n in names])


def parallel_arrays(df: DataFrame, payload: str, fields: dict[str, str], path: str = "$") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): arrays of equal length in JSON become one row per position; payloads whose arrays differ in length,
    or that don't parse, are rejected whole with a reason. fields: name -> SQL type of the elements."""
    body = F.get_json_object(F.col(payload), path) if path != "$" else F.col(payload)
    schema = "struct<" + ",".join(f"{n}:array<{k}>" for n, k in fields.items()) + ">"
    p = df.withColumn("__p", F.from_json(body, schema))
    sizes = F.array(*[F.coalesce(F.size(f"__p.{n}"), F.lit(-1)) for n in fields])
    reason = F.when(F.col("__p").isNull(), "UNPARSED").when(F.array_min(sizes) < 0, "MISSING_ARRAY").when(F.array_min(sizes) != F.array_max(sizes), "UNEQUAL_LENGTHS")
    p = p.withColumn("reason", reason)
    zipped = F.explode(F.arrays_zip(*[F.col(f"__p.{n}").alias(n) for n in fields]))
    rest = [c for c in df.columns if c != payload]
    rows = p.where("reason is null").select(*rest, zipped.alias("__z")).select(*rest, *[F.col(f"__z.{n}").alias(n) for n in fields])
    return rows, p.where("reason is not null").drop("__p")


def strike_map(df: DataFrame, payload: str, sides: tuple[str, str] = ("ce", "pe"), fields: dict[str, str] | None = None) -> DataFrame:
    """{strike: {ce: {...}, pe: {...}}} becomes one row per strike and side."""
    fields = fields or {"last_price": "double", "oi": "double", "volume": "double"}
    leaf = "struct<" + ",".join(f"{n}:{k}" for n, k in fields.items()) + ">"
    parsed = F.from_json(payload, "map<string,struct<" + ",".join(f"{s}:{leaf}" for s in sides) + ">>")
    rest = [c for c in df.columns if c != payload]
    each = df.select(*rest, F.explode(parsed).alias("strike", "__v"))
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"__v.{s}").alias("q")) for s in sides]))
    out = each.select(*rest, F.col("strike").try_cast("double").alias("strike"), both.alias("__s")).where("__s.q is not null")
    return out.select(*rest, "strike", F.upper("__s.side").alias("side"), *[F.col(f"__s.q.{n}").alias(n) for n in fields])


def best_level(depth: Column, field: str) -> Column:
    """The field of the first entry of an order-book side; null for an empty book."""
    return F.try_element_at(depth, F.lit(1))[field]


def half_open(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows with start <= ts < end."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def session_status(ts: Column, first: str = "09:15", last: str = "15:30") -> Column:
    """IN_SESSION from first to last minute inclusive, else OUT_OF_SESSION."""
    return F.when(F.date_format(ts, "HH:mm").between(first, last), "IN_SESSION").otherwise("OUT_OF_SESSION")


def parse_date(text: Column) -> Column:
    """ISO, compact or day-first dates; null for anything else."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "dd-MMM-yyyy"), F.try_to_date(text, "dd-MM-yyyy"))


def request_plan(spark, start: str, end: str, dimensions: dict[str, list[str]], days: int = 30) -> DataFrame:
    """Half-open date chunks of at most ``days`` that don't cross months, times all values of the dimensions."""
    months = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{start}', 'month'), date'{end}', interval 1 month)")).alias("m"))
    lo, hi = F.greatest(F.col("m"), F.lit(start).cast("date")), F.least(F.add_months("m", 1), F.lit(end).cast("date"))
    months = months.select(lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    chunks = months.select("hi", F.explode(F.expr(f"sequence(lo, date_sub(hi, 1), interval {days} day)")).alias("chunk_start")).select("chunk_start", F.least(F.date_add("chunk_start", days), F.col("hi")).alias("chunk_end"))
    for name, values in dimensions.items():
        chunks = chunks.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return chunks
