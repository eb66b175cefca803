"""Training-order materialisation: every sequence of token ids gets a slot from a keyed permutation, and shards hold slots in order.

Documents' ids, each document's closed by a separator, run on within a bucket of documents (by a hash of doc_id and ids, in the order of doc_id) and are cut
into sequences of a fixed number of ids; only the last one of a bucket is filled up with a padding id that no token has.  Buckets
grow in number and in size as the square root of the texts' bytes: neither their sorting nor the table of their counts becomes a task that more machines don't shorten.
A sequence's index is its place by bucket and within it, dense from 0; its slot is a Feistel permutation of the index under the key, walked along its
cycle until it falls below the number of sequences.  So the order is a pure function of the key and the documents, whatever the partitioning.

Slots are dealt by range: each task gets an equal range of whole shards, without a sample, since slots are dense.  A shard holds ``per_shard`` sequences of the same stride, so sequence s
is at byte (s % per_shard) * stride of shard s // per_shard.  Shards are rows of a Parquet table (shard, first_slot, sequences, stride, crc32, data), stored without
compression, so that a sequence is read by its offset: Spark's commit protocol makes their writing safe against lost executors on any file system.
``read_from`` resumes at any slot; ``export_shards`` writes plain files.

Defined results: a null or empty text is only the separator; repeated rows are documents of their own (ties in the order are broken by the ids; equal ones
are interchangeable); null doc_ids come first in their buckets; a text of any length is cut; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, per_batch, read_table, texts_of, tokenizer_path, write
from .words import word_encoder

TOKENIZER = "word_bpe_49k.json"
LENGTH = 1024
#: The tokenizer's end of text, and an id above its vocabulary.
SEPARATOR, PADDING = 49407, 65535
#: Sequences in a shard, and the permutation's rounds and key.
PER_SHARD, ROUNDS, KEY = 512, 6, 0x5EED
#: Bytes of texts of a bucket: at least so many, and so many times the root of all texts' bytes.
LEAST_BUCKET, BY_ROOT = 4 << 20, 8
#: Bytes of ids that a task holds before it passes them on.
HELD = 1 << 22
SHARD = "shard long, first_slot long, sequences int, stride int, crc32 long, data binary"
SEQUENCE = "bucket int, k long, n_tokens int, crc32 long, ids binary, pieces array<struct<doc_id:long,start:long,length:int,offset:int>>"


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) of the keyed half."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    return [int(_mixed(np.asarray([key + k], dtype=np.uint64), 0xC0FFEE)[0]) for k in range(rounds)]


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each index below n (or the index of each slot). The domain of the Feistel network is the least power of four of
    at least n, so under four steps of the cycle are walked on average."""
    if n <= 1 or not len(index):
        return np.asarray(index, dtype=np.int64).copy()
    half = np.uint64(((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)
    x = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mixed(left, k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def filling(length: int, padding: int) -> bytes:
    return np.full(length, padding, dtype="<u2").tobytes()


def bucket_count(total_bytes: int, least: int = LEAST_BUCKET) -> int:
    return max(1, math.ceil(total_bytes / max(least, BY_ROOT * math.sqrt(total_bytes))))


def tokenised(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR) -> DataFrame:
    """doc_id and the ids (little-endian, 16 bits) of each row, with the separator."""
    end = np.asarray([separator], dtype="<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(tokenizer).encode
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                ids = [np.frombuffer(encode(t), dtype="<u4").astype("<u2").tobytes() + end for t in some["text"]]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "ids": ids})

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, ids binary")


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, separator: int = SEPARATOR, padding: int = PADDING, least: int = LEAST_BUCKET) -> DataFrame:
    """Rows of SEQUENCE: the filled-up ids of each sequence, and which ids of which documents they are."""
    filler, stride = filling(length, padding), 2 * length
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = bucket_count(size, least)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["bucket", "k", "n_tokens", "crc32", "ids", "pieces"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, k, begun, pieces, rows, held = -1, 0, bytearray(), [], [], 0

        def close() -> None:
            nonlocal k, begun, pieces, held
            n = len(begun) // 2
            data = bytes(begun) + filler[len(begun) :]
            rows.append((bucket, k, n, zlib.crc32(data), data, pieces))
            k, begun, pieces, held = k + 1, bytearray(), [], held + stride

        for pdf in batches:
            for own, doc_id, ids in zip(pdf["bucket"], pdf["doc_id"].astype("Int64"), pdf["ids"], strict=True):
                if own != bucket:
                    if begun:
                        close()
                    bucket, k = own, 0
                at = 0
                while at < len(ids):
                    n = min(len(ids) - at, stride - len(begun))
                    pieces.append({"doc_id": None if doc_id is pd.NA else int(doc_id), "start": at // 2, "length": n // 2, "offset": len(begun) // 2})
                    begun += ids[at : at + n]
                    at += n
                    if len(begun) == stride:
                        close()
                        if held >= HELD:
                            yield frame(rows)
                            rows, held = [], 0
        if begun:
            close()
        if rows:
            yield frame(rows)

    rows = tokenised(docs, tokenizer, separator).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(buckets)).cast("int"))
    parts = min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "doc_id", "ids")
    return dealt.select("bucket", "doc_id", "ids").mapInPandas(run, SEQUENCE)


def starts_of_buckets(table: DataFrame) -> np.ndarray:
    """How many sequences the buckets before each one hold, and at the end all. There are as many numbers as buckets."""
    counts = table.groupBy("bucket").count().toPandas().sort_values("bucket")
    out = np.zeros((int(counts["bucket"].max()) if len(counts) else -1) + 2, dtype=np.int64)
    out[counts["bucket"].to_numpy(dtype=np.int64) + 1] = counts["count"]
    return np.cumsum(out)


def slotted(table: DataFrame, starts: np.ndarray, key: int = KEY) -> DataFrame:
    """Adds index and slot to rows that have bucket and k, of which they are put in place; ids are compressed, since a shuffle follows."""
    shared = table.sparkSession.sparkContext.broadcast(starts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index = shared.value[pdf["bucket"].to_numpy(dtype=np.int64)] + pdf["k"].to_numpy(dtype=np.int64)
        out = pdf.drop(columns=["bucket", "k"])
        if "ids" in out:
            compress = zstandard.ZstdCompressor().compress
            out["ids"] = [compress(x) for x in out["ids"]]
        if "doc_id" in out:
            out["doc_id"] = out["doc_id"].astype("Int64")
        out["index"], out["slot"] = index, permute(index, int(shared.value[-1]), key)
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name not in ("bucket", "k"))
    return table.mapInPandas(per_batch(run), f"{kinds}, index long, slot long")


def shards(table: DataFrame, n_sequences: int, per_shard: int = PER_SHARD) -> DataFrame:
    """Rows of SHARD from all sequences' slots and compressed ids: dealt by ranges of slots, each shard made by one task."""

    def flush(rows: list[tuple[int, bytes]], shard: int) -> pd.DataFrame:
        data = b"".join(d for _, d in rows)
        return pd.DataFrame([(shard, rows[0][0], len(rows), len(rows[0][1]), zlib.crc32(data), data)], columns=[x.split()[0] for x in SHARD.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, shard = [], -1
        plain = zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            for slot, data in zip(pdf["slot"], pdf["ids"], strict=True):
                if slot // per_shard != shard:
                    if rows:
                        yield flush(rows, shard)
                    rows, shard = [], int(slot) // per_shard
                rows.append((int(slot), plain(data)))
        if rows:
            yield flush(rows, shard)

    n_shards = max(1, -(-n_sequences // per_shard))
    parts = min(n_shards, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = F.floor(F.floor(F.col("slot") / per_shard) * parts / n_shards).cast("int")
    return table.select("slot", "ids").repartitionById(parts, ranges).sortWithinPartitions("slot").mapInPandas(run, SHARD)


def materialise(docs: DataFrame, path: str, tokenizer: str | None = None, length: int = LENGTH, key: int = KEY, per_shard: int = PER_SHARD, least: int = LEAST_BUCKET) -> DataFrame:
    """Writes the shards to path and returns the manifest: a row for each piece of a document, with its sequence's place."""
    table = cut(sequences(docs, tokenizer or tokenizer_path(TOKENIZER), length, least=least), "sequences", compression="zstd")
    starts = starts_of_buckets(table)
    write(shards(slotted(table.select("bucket", "k", "ids"), starts, key), int(starts[-1]), per_shard), path, compression="none", **{"parquet.enable.dictionary": "false"})
    pieces = cut(table.select("bucket", "k", "n_tokens", "crc32", F.inline("pieces")), "pieces")
    discard(table)
    return slotted(pieces, starts, key).select(
        "doc_id", "start", "length", "offset", "n_tokens", "crc32", "index", "slot",
        F.floor(F.col("slot") / per_shard).alias("shard"), (F.col("slot") % per_shard * F.lit(2 * length)).alias("byte_offset"),
    )


def read_from(shard_table: DataFrame, slot: int = 0) -> DataFrame:
    """slot and ids of the sequences from that slot on; whole shards before it are not read."""
    stride = F.col("stride")
    each = shard_table.filter(F.col("first_slot") + F.col("sequences") > slot).select(
        "first_slot", "stride", "data", F.explode(F.sequence(F.lit(0), F.col("sequences") - 1)).alias("k")
    )
    return each.select((F.col("first_slot") + F.col("k")).alias("slot"), F.substring(F.col("data"), F.col("k") * stride + 1, stride).alias("ids")).filter(F.col("slot") >= slot)


def export_shards(shard_table: DataFrame, folder: str) -> int:
    """Writes shard-<n>.bin files into a POSIX folder that all executors share; each appears whole or not at all,
    and those that are there already are left, so an interrupted export can be resumed."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, data in zip(pdf["shard"], pdf["data"], strict=True):
                path = os.path.join(folder, f"shard-{shard:09d}.bin")
                if not os.path.exists(path):
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, path)
            yield pd.DataFrame({"n": [len(pdf)]})

    return shard_table.select("shard", "data").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, each row with the checksum of its sequence's bytes as read back from the shard."""
    from .common import shared_dir

    path = f"{shared_dir(spark)}-shards"
    manifest = materialise(read_table(spark, sf_dir, "documents"), path)
    stored = spark.read.schema(SHARD).parquet(path)
    back = read_from(stored).select("slot", F.crc32("ids").alias("stored_crc32"))
    return manifest.join(back, "slot").select("doc_id", "start", "length", "offset", "n_tokens", "crc32", "stored_crc32", "index", "slot", "shard", "byte_offset")
