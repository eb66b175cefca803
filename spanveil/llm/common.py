"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished write are of no more use.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The columns that the table of documents has.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all runs on one machine (tests, a laptop) a temporary folder of it is set instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/spanveil-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, **options: str) -> None:
    """Writes Parquet, after which the shuffle files that it needed are cleared."""
    conf = df.sparkSession.conf
    old = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(CLEANUP, old) if old is not None else conf.unset(CLEANUP)


def cut(df: DataFrame, name: str = "t", **options: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again.

    It cuts the lineage: what follows survives lost executors without recomputation, and several
    readers share one computation.  The files stay until the folder is emptied (they are named spanveil-*).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    write(df, path, **options)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that cut() has written, once all that was to be made of it is written too."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/spanveil-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with so many underscores before it that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_batch(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """fn over each Arrow batch, for mapInPandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)

    return run


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, with null texts as empty ones; other columns never clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine (part of the cluster's image)."""
    import public_tokenizers

    return public_tokenizers.path(name)
