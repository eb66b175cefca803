"""The scan over streams: it keeps no state, so it needs no watermark; rates over time do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import scan
from ..plans.policy import Policy


def stream_files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    """A folder's Parquet files as a stream; a single file is read through its folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if fs.getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def scan_stream(stream: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    return scan(stream, policy, text_col)


def run_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that has arrived, each row once, and stops."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def findings_by_window(scanned: DataFrame, time_col: str, length: str, late: str, scan_col: str = "scan") -> DataFrame:
    """Violations by type in windows of time; rows later than ``late`` are left out by the watermark."""
    rows = scanned.withWatermark(time_col, late).select(time_col, F.explode(f"{scan_col}.violations.entity_type").alias("entity_type"))
    return rows.groupBy(F.window(time_col, length), "entity_type").count()
