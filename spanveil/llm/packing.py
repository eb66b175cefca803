"""Packing documents into windows: best-fit decreasing over a segment tree of remaining capacities.

Each document's ids end with a separator.  Overlong documents are first cut into full windows;
only the remainders compete for room.  Best-fit decreasing depends on lengths alone, of which there are
at most ``window``, so the corpus is reduced to counts of pieces by (length, bucket): at most
(window + 1) * BUCKETS rows however large it is.  The packing is then computed exactly for those counts on
the driver, a whole run of equal pieces at a time, and every piece finds its place from its rank
within its length.  No piece's data goes to the driver; ranks are taken within buckets, so that a
length that a third of all pieces have is spread over BUCKETS tasks.

Defined results: a null or empty text is a document of one id, the separator; repeated rows are packed each on
its own; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, per_batch, read_table, texts_of, tokenizer_path
from .words import word_encoder

WINDOW = 2048
SEPARATOR = 1
TOKENIZER = "word_bpe_49k.json"
#: Buckets among which equal lengths are ranked.
BUCKETS = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """The full windows and the remainder of each document; with_ids adds the ids themselves (little-endian, 32 bits)."""
    end = np.asarray([separator], dtype="<u4").tobytes()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        encode, rows = word_encoder(tokenizer).encode, []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            data = encode(text) + end
            n = len(data) // 4
            for start in range(0, n, window):
                part = data[4 * start : 4 * (start + window)]
                rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, *([part] if with_ids else [])))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Workers live on after their tasks, beside other stages': they keep no words."""
        try:
            yield from per_batch(run)(batches)
        finally:
            word_encoder(tokenizer).forget()

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(task, PIECE + ", ids binary" * with_ids)


class Capacities:
    """A segment tree over remaining capacities 0..size: which are open, and the tightest that holds a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.leaves + capacity
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least open capacity of at least that length."""
        i = self.leaves + length
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit(counts: dict[int, int], window: int) -> np.ndarray:
    """Best-fit decreasing for counts of equal pieces.

    Rows (length, first rank, pieces in each window, first window, fill before): from that rank on, pieces of that
    length go so many to a window.  A window holds at most sqrt(2 * window) different lengths and each
    length opens or splits at most three runs of windows, so there are under 3 * window * sqrt(2 * window)
    rows, however many pieces there are.
    """
    tree, runs, plan = Capacities(window), [deque() for _ in range(window + 1)], []
    windows = 0

    def add(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted((k for k, n in counts.items() if n and k), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                first, n = windows, -(-left // (window // length))
                windows += n
            else:
                first, n = runs[capacity].popleft()
            each = capacity // length
            full = min(n, left // each)
            rest = left - each * full if full < n else 0
            plan.append((length, rank, each, first, window - capacity))
            add(capacity - each * length, first, full)
            add(capacity - rest * length, first + full, 1 if rest else 0)
            used = full + (1 if rest else 0)
            if used < n:
                runs[capacity].appendleft((first + used, n - used))
            tree.set(capacity, bool(runs[capacity]))
            rank += each * full + rest
            left -= each * full + rest
    return np.asarray(plan, dtype=np.int64).reshape(-1, 5)


def place(table: DataFrame, window: int = WINDOW, buckets: int = BUCKETS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length of at most window, other columns)."""
    spark = table.sparkSession
    table = table.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    base = np.zeros((window + 1, buckets), dtype=np.int64)
    for length, bucket, n in table.groupBy("length", "_bucket").count().toLocalIterator():
        base[length, bucket] = n
    counts = {int(k): int(n) for k, n in enumerate(base.sum(axis=1)) if n}
    before = base.cumsum(axis=1) - base
    plan = best_fit(counts, window)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast((before, (plan[:, 0] << 48) + plan[:, 1], plan))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before, keys, plan = shared.value
        length = pdf["length"].to_numpy(dtype=np.int64)
        rank = before[length, pdf["_bucket"].to_numpy()] + pdf["_rank"].to_numpy(dtype=np.int64) - 1
        _, first, each, window_id, fill = plan[np.searchsorted(keys, (length << 48) + rank, side="right") - 1].T
        out = pdf.drop(columns=["_bucket", "_rank"])
        out["sequence_id"] = window_id + (rank - first) // each
        out["offset"] = fill + (rank - first) % each * length
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    ranked = table.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name != "_bucket")
    return ranked.mapInPandas(per_batch(run), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: where its ids begin, how many they are, and where they lie."""
    return place(cut(pieces(docs, tokenizer or tokenizer_path(TOKENIZER), window, separator, with_ids), "pieces"), window)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
