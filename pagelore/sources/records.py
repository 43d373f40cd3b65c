"""CSV, JSON and parameter files around experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore import schema


def rmi_records(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of a collector CSV; lines that start with # are metadata."""
    return spark.read.csv(path, header=True, comment="#", schema=schema.RMI_RECORDS)


def rmi_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the #name,value lines."""
    at = F.split(F.substring("value", 2, 1 << 20), ",", 2)
    return spark.read.text(path).where(F.col("value").startswith("#")).select(F.trim(at[0]).alias("name"), F.trim(F.get(at, F.lit(1))).alias("value"))


def limited_records(records: DataFrame, limit: int) -> DataFrame:
    """The first records in file order (query_idx), with the number that are there."""
    return records.where(F.col("query_idx") < limit)


def optimizer_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configurations of an optimizer grid; without a positive branching factor they are passed over."""
    c = spark.read.json(path, multiLine=True, schema="configs array<struct<layers:string,`branching factor`:bigint,namespace:string,size:bigint,`average log2 error`:double,binary:boolean>>")
    c = c.select(F.explode("configs").alias("c")).select("c.layers", F.col("c.branching factor").alias("branch_factor"), F.col("c.namespace").alias("name"), "c.size", F.col("c.average log2 error").alias("avg_log2"))
    return c.where("branch_factor > 0")


def write_rows(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Result rows as CSV with a header, one file: they are a row per run."""
    rows.coalesce(1).write.mode(mode).csv(path, header=True)


def append_ranked(spark: SparkSession, rows: DataFrame, path: str, policy_order=schema.POLICIES) -> DataFrame:
    """Appends rows to a Parquet log and gives the log back by (policy rank, branch factor)."""
    rows.write.mode("append").parquet(path)
    rank = F.array_position(F.array(*[F.lit(p) for p in policy_order]), F.upper("policy"))
    return spark.read.parquet(path).orderBy(F.when(rank == 0, len(policy_order) + 1).otherwise(rank), "branch_factor")


def env_lines(params: dict[str, str]) -> str:
    return "".join(f"{k}={v}\n" for k, v in params.items())
