"""Texts from files, JSON documents and conversations; results to files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import redacted, scan
from ..plans.policy import Policy

FORMATS = ("parquet", "json", "csv", "text", "orc")


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", text_col: str = "text", **options: str) -> DataFrame:
    """A table of texts; lines of a text file become its rows."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {FORMATS}")
    df = spark.read.options(**options).format(kind).load(path)
    return df.withColumnRenamed("value", text_col) if kind == "text" and text_col != "value" else df


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer splits than there are cores out to all of them; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def texts(spark: SparkSession, values: list[str | None]) -> DataFrame:
    """A list of texts with their places in it, for a handful of them."""
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "n long, text string")


def write_safe(scanned: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", drop: tuple[str, ...] = ("text",), scan_col: str = "scan") -> None:
    """Writes what is safe to store: the sanitised text and the findings' places and types, without the texts themselves."""
    redacted(scanned, scan_col).drop(*drop).write.mode(mode).format(kind).save(path)


def json_leaves(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """key, path and text of every text inside a JSON document; keys of objects are no texts. What isn't JSON gives no rows."""
    kind = "array<struct<path:string,text:string>>"

    @F.pandas_udf(kind)
    def leaves(documents: pd.Series) -> pd.Series:
        out = []
        for d in documents:
            found: list[dict[str, str]] = []
            try:
                todo = [("$", json.loads(d))] if d else []
            except ValueError:
                todo = []
            while todo:
                path, x = todo.pop()
                if isinstance(x, str):
                    found.append({"path": path, "text": x})
                elif isinstance(x, dict):
                    todo += [(f"{path}.{k}", v) for k, v in reversed(x.items())]
                elif isinstance(x, list):
                    todo += [(f"{path}[{k}]", v) for k, v in reversed(list(enumerate(x)))]
            out.append(found)
        return pd.Series(out)

    return df.select(key, F.explode(leaves(json_col)).alias("leaf")).select(key, "leaf.path", "leaf.text")


def guard_requests(df: DataFrame, policy: Policy, key: str, json_col: str, mode: str = "block") -> DataFrame:
    """What is to be done with JSON requests. mode: block (status 422 where anything is found), sanitize or warn."""
    if mode not in ("block", "sanitize", "warn"):
        raise ValueError(f"unknown mode {mode!r}")
    leaves = scan(json_leaves(df, key, json_col), policy)
    found = leaves.groupBy(key).agg(F.sum(F.size("scan.violations")).alias("violations"), F.map_from_entries(F.collect_list(F.struct("path", "scan.sanitized_text"))).alias("sanitized"))
    out = df.select(key).join(found, key, "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    blocked = (F.col("violations") > 0) & F.lit(mode == "block")
    return out.select(key, F.when(blocked, 422).otherwise(200).alias("status"), "violations", *(["sanitized"] if mode == "sanitize" else []))
