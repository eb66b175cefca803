"""Exact deduplication as a stateful stream, with DataFrame functions only.

Documents stream in; the keyed state, in RocksDB on disk and without expiry, holds for every digest of a
normalised text the stable identifier of the first document (its least doc_id), the content locator
(file and row where that document's text is) and the number of rows so far.  Later batches may go on from the
same checkpoint.  The state is then read back as a table.  A digest hit is not trusted: the first's text is fetched
from where the locator says and compared as a whole, and rows whose bytes differ form groups of their own.  So does a group
whose first isn't found there.  Tables that aren't read from files have null locators; their firsts are found by doc_id.

Keys are combined before each shuffle, so a group of a third of all rows is one row a task.  Where whole texts meet, a group is
split by a salt into parts of about PART rows; the join of digests alone carries no texts, and Spark splits it where it is skewed.

Defined results: null texts count as empty, and all empty texts are equal; repeated rows (same doc_id and text) are members of
one group, each counted, and the stage keeps one of them; a null doc_id is larger than all others, so it stays only where its
whole group has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, read_table, shared_dir

#: Java's class for [\x20\x09-\x0D]+.
SPACES = r"[\x20\x09-\x0D]+"
#: Stands for a null doc_id inside the state: above all others.
NO_ID = (1 << 63) - 1
#: Rows of a group whose texts are compared in one part.
PART = 10_000
LOCATOR = "struct<file:string,row:long>"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # a store is closed when its task has committed, so idle ones hold no memory
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "false",
    # many small stores: no disk is set aside before it is used
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def has_places(docs: DataFrame) -> bool:
    """Whether docs are read from files whose rows have places."""
    if "_metadata" in {c.lower() for c in docs.columns}:
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def locator(docs: DataFrame) -> Column:
    if has_places(docs):
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).cast(LOCATOR).alias("locator")
    return F.struct(F.lit(None).alias("file"), F.lit(None).alias("row")).cast(LOCATOR).alias("locator")


def identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def keyed(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    if set(docs.columns) == {"doc_id", "locator", "digest"}:
        return docs
    return docs.select(identity(), locator(docs), normalised("text").alias("norm")).select("doc_id", "locator", digest(F.col("norm")).alias("digest"))


def state_of(stream: DataFrame, checkpoint: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Runs the stream over all that has arrived and returns its state: digest, keep_id, locator, group_size.

    A later call with the same checkpoint goes on from there.
    """
    spark = stream.sparkSession
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state = keyed(stream, digest).groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        query = state.writeStream.outputMode("update").format("noop").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
        query.awaitTermination()
        if query.lastProgress is None and not query.recentProgress and not stream_began(spark, checkpoint):
            return spark.createDataFrame([], f"digest string, keep_id long, locator {LOCATOR}, group_size long")
        rows = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return rows.select(F.col("key.digest").alias("digest"), F.col("value.*")).toDF("digest", "first", "group_size").select(
        "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("locator"), "group_size"
    )


def stream_began(spark: SparkSession, checkpoint: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


def as_stream(docs_path: str, schema: T.StructType, spark: SparkSession) -> DataFrame:
    """A table's files as a stream; a path to a single file is read through its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(docs_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(str(path.getParent().toString()))
    return reader.parquet(docs_path)


def groups(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, digest and locator of each row, after the comparison of whole texts, and first: whether
    the row is the one that its group's state names."""
    text = docs.select(identity(), locator(docs), normalised("text").alias("norm")).withColumn("digest", digest(F.col("norm")))
    text = text.withColumn("text_sha256", F.col("digest") if digest is sha256 else sha256(F.col("norm")))
    named = state.select("digest", "keep_id", F.col("locator").alias("keep_locator"), "group_size")
    found = cut(text.drop("norm").join(named, "digest"), "hits")
    parts = F.ceil(F.col("group_size") / PART)
    hits = found.filter("group_size > 1").select("doc_id", "locator", "digest", "keep_id", "keep_locator", parts.alias("parts")).distinct().alias("h")
    # only rows with a hit are normalised once more; rows that share a doc_id and have no places are told apart by their digests
    raw = docs.select(identity(), locator(docs), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("r")
    members = raw.join(hits, (F.col("r.doc_id") == F.col("h.doc_id")) & F.col("r.locator").eqNullSafe(F.col("h.locator")))
    members = members.select("h.*", normalised("r.text").alias("norm"))
    members = cut(members if has_places(docs) else members.filter(digest(F.col("norm")) == F.col("digest")), "members")
    firsts = members.filter((F.col("doc_id") == F.col("keep_id")) & F.col("locator").eqNullSafe(F.col("keep_locator"))).dropDuplicates(["digest"])
    firsts = firsts.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("norm").alias("first_norm"))
    dealt = members.select("digest", F.pmod(F.xxhash64("doc_id", "locator"), F.col("parts")).alias("part"), "norm")
    differ = cut(dealt.join(firsts, ["digest", "part"], "left").filter(~F.col("norm").eqNullSafe(F.col("first_norm"))).select("digest").distinct(), "differ")
    if not differ.isEmpty():
        # equal digests of different texts: the texts themselves are the keys
        apart = text.join(differ, "digest", "left_semi")
        own = apart.groupBy("digest", "norm").agg(F.min(F.struct("doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        own = cut(own.select("digest", "norm", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("keep_locator"), "group_size"), "apart")
        apart = apart.join(own, ["digest", "norm"]).select(*found.columns)
        found = found.join(differ, "digest", "left_anti").unionByName(apart)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    kept = F.col("doc_id") == F.col("keep_id")
    first = kept & F.col("locator").eqNullSafe(F.col("keep_locator"))
    return found.select(null("doc_id"), null("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "digest", "locator", first.alias("first"))


def distinct_documents(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Of documents with equal texts only the row with the least doc_id stays; all columns of docs are returned."""
    spark = docs.sparkSession
    keys = f"{shared_dir(spark)}-keys"
    keyed(docs, digest).write.parquet(keys)
    state = state_of(as_stream(keys, spark.read.parquet(keys).schema, spark), f"{shared_dir(spark)}-stream")
    own_id, own_sha, own_place = (free_name(docs, c) for c in ("_id", "_sha", "_place"))
    firsts = groups(docs, state, digest).filter("first")
    if has_places(docs):
        place = firsts.select(F.col("locator").alias(own_place))
        return docs.withColumn(own_place, locator(docs)).join(place, own_place).select(*docs.columns)
    kept = firsts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(own_id), F.col("text_sha256").alias(own_sha)).distinct()
    rows = docs.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), own_sha: sha256(normalised("text"))})
    return rows.join(kept, [own_id, own_sha]).dropDuplicates([own_id, own_sha]).select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    stream = as_stream(f"{sf_dir}/documents.parquet", docs.schema, spark)
    state = state_of(stream, f"{shared_dir(spark)}-stream")
    return groups(docs, state).drop("digest", "locator", "first")


OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
