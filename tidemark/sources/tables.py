"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tabular(spark: SparkSession, locator: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, line JSON or CSV with a header, by the locator's suffix."""
    end = locator.rsplit("?", 1)[0].rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if end in ("parquet", "pq"):
        return reader.parquet(locator)
    if end in ("json", "jsonl", "ndjson"):
        return reader.json(locator)
    if end == "orc":
        return reader.orc(locator)
    return reader.csv(locator, header=True, inferSchema=schema is None)


def write_once(df: DataFrame, path: str) -> None:
    """A table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


OUTCOME = "array<struct<name:string,price:double,point:double>>"
QUOTES = f"array<struct<id:string,commence_time:string,home_team:string,away_team:string,bookmakers:array<struct<key:string,last_update:string,markets:array<struct<key:string,last_update:string,outcomes:{OUTCOME}>>>>>>"


def flatten_quotes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per quoted outcome of nested quote JSON; missing levels leave nulls, broken JSON one row of nulls."""
    e = payloads.select(F.explode_outer(F.from_json(column, QUOTES)).alias("e"))
    b = e.select("e.id", "e.home_team", "e.away_team", F.try_to_timestamp("e.commence_time").alias("commence"), F.explode_outer("e.bookmakers").alias("b"))
    m = b.select("id", "home_team", "away_team", "commence", F.col("b.key").alias("book"), F.explode_outer("b.markets").alias("m"))
    o = m.select("id", "home_team", "away_team", "commence", "book", F.col("m.key").alias("market"), F.explode_outer("m.outcomes").alias("o"))
    side = F.when(F.col("o.name") == F.col("home_team"), "home").when(F.col("o.name") == F.col("away_team"), "away").otherwise(F.lower("o.name"))
    return o.select("id", "home_team", "away_team", "commence", "book", "market", side.alias("side"), F.col("o.price").alias("price"), F.col("o.point").alias("point"))


def contract_report(df: DataFrame, required: list[str], unique: list[str], allowed: dict[str, list]) -> DataFrame:
    """(problem, column, n): missing columns, nulls, surplus rows of a key and values outside a set, from two aggregates."""
    spark = df.sparkSession
    gone = [("missing_column", c, 1) for c in required if c not in df.columns]
    have = [c for c in required if c in df.columns]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"null_value|{c}") for c in have] + [F.count_if(~F.col(c).isin(*v)).alias(f"not_allowed|{c}") for c, v in allowed.items() if c in df.columns]
    out = spark.createDataFrame(gone, "problem string, column string, n long")
    if aggs:
        one = df.agg(*aggs)
        out = out.unionByName(one.select(F.explode(F.array(*[F.struct(F.lit(a.split("|")[0]).alias("problem"), F.lit(a.split("|")[1]).alias("column"), F.col(f"`{a}`").alias("n")) for a in one.columns])).alias("r")).select("r.*"))
    if all(c in df.columns for c in unique):
        d = df.groupBy(*unique).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
        out = out.unionByName(d.select(F.lit("surplus_rows").alias("problem"), F.lit(",".join(unique)).alias("column"), "n"))
    return out
