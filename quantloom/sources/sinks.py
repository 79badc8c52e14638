"""Sinks: tables replaced, appended or upserted, and small reports over collected metric rows."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..streaming.steps import insert_ignore


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path that Spark can read is there, whatever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a history; readers merge schemas that have changed."""
    df.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The history at path with merged schemas, or an empty table of the schema."""
    return spark.read.option("mergeSchema", "true").parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def upsert_ignore(df: DataFrame, path: str, key: str, *order) -> None:
    """Appends the rows whose key the table at path doesn't have yet, one a key."""
    spark = df.sparkSession
    old = spark.read.parquet(path).select(key) if exists(spark, path) else None
    insert_ignore(df, old, key, *order).write.mode("append").parquet(path)


def cached(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path, computed and written first where it isn't there."""
    if not exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def replace_csv(df: DataFrame, path: str) -> None:
    """A result as one CSV file in the folder at path, in place of what is there. For results of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def replace_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in the folder at path, in place of what is there; missing values stay as nulls."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def state(spark: SparkSession, path: str, schema: str, default: DataFrame) -> DataFrame:
    """What replace_json wrote at path, or the default where there is nothing yet."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else default


def thinned(df: DataFrame, key: str, ts: str, most: int = 600) -> DataFrame:
    """Every n-th row of each key, n the smallest step that leaves about `most` rows."""
    d = df.withColumns({"_k": F.row_number().over(W.partitionBy(key).orderBy(ts)) - 1, "_n": F.count("*").over(W.partitionBy(key))})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return d.where(F.col("_k") % step == 0).drop("_k", "_n")


def markdown(rows: list, columns: list[str], digits: int = 4) -> str:
    """A table of a few collected rows."""
    show = lambda v: "" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def page(title: str, rows: list, columns: list[str], data: dict) -> str:
    """A self-contained HTML page of a few collected rows, with data for charts as JSON."""
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if r[c] is None else str(r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    payload = json.dumps(data, default=str).replace("</", "<\\/")
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table><script type='application/json' id='data'>{payload}</script>"
