"""Removal of byte strings that documents with smaller doc_id hold too, by merging Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller doc_id.

1. Of equal texts only the one with the least doc_id takes part; the others go whole (if they have LENGTH bytes).
2. Every string of LENGTH bytes has an anchor, its K bytes of least hash.  Anchors that a single document has can't be in a repeated
   string.  Anchors that several documents of one batch share are known to be repeated without a shuffle, so that a line that a third of all
   documents hold is one row a batch there.
3. The strings of a repeated anchor make up a segment: the starts in a row whose anchor has that hash (LENGTH - K + 1 at most, unless the anchor repeats itself, as in a
   line of dashes) and the bytes they reach.  Where all segments of an anchor are equal, the least doc_id settles it.
4. Otherwise their suffixes are needed in order.  Segments are dealt to shards, each shard's transform is built, and the transforms are merged: the
   interleave (which shard each suffix of the merged order comes from) is refined by STEP characters a round, as a stable sort of what the transforms hold,
   until LENGTH characters are in order.  Neighbours stay in one block as long as their common prefix lasts; blocks after the last round are the repeated
   intervals, and each one's least doc_id holds for all its suffixes.  No suffix is sorted again.
   The segments of an anchor that has more than MERGED bytes of them are cut up first: into the starts that lie NEAR each other before the anchor, dealt by the bytes that these
   have in common.  Only strings that agree in all but NEAR - 1 bytes then meet, so a line that a third of all documents hold, each with other
   text around it, isn't one task's work.

Defined results: null and empty texts, and those under LENGTH bytes, keep all bytes; rows of equal doc_id never remove
from each other; a null doc_id removes nothing and loses nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, per_batch, read_table, texts_of

LENGTH, K = 50, 20
#: Bytes of a shard, and shards merged at a time: what a core's cache holds.
SHARD, SHARDS = 1 << 14, 4
#: The most characters by which a round refines the interleave.
STEP = 5
#: Bytes of an anchor's unlike segments up to which one task merges them as they are (it needs some 60 bytes of memory for each), and the places before the
#: anchor that the segments of others are cut up by.
MERGED, NEAR = 4 << 20, 4


@lru_cache(maxsize=64)
def _power(n: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all strings of k bytes, by doubling."""
    with np.errstate(over="ignore"):
        block, size, done, length, rest = data.astype(np.uint64) + np.uint64(1), 1, None, 0, k
        while rest:
            if rest & 1:
                n = len(data) - length - size + 1
                done = block if done is None else done[:n] * _power(size) + block[length : length + n]
                length += size
            rest >>= 1
            if rest:
                n = len(data) - 2 * size + 1
                block = block[:n] * _power(size) + block[size : size + n]
                size *= 2
        x = (done ^ (done >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def anchors(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of starts with one anchor: the anchor's hash, the first start, and the starts. Ties go to the leftmost."""
    if len(data) < length:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    h, w = window_hashes(np.frombuffer(data, dtype=np.uint8), k), length - k + 1
    low, n = h, 1
    while 2 * n <= w:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < w:
        low = np.minimum(low[: len(low) - (w - n)], low[w - n :])
    edges = np.flatnonzero(np.diff(low)) + 1
    first = np.concatenate([[0], edges])
    return low[first], first, np.diff(np.concatenate([first, [len(low)]]))


def build_bwt(strings: list[bytes], step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform of a shard: for its suffixes in order, the step characters before each (read cyclically within its string, as one number
    that keeps their order), and the string and offset it starts at.

    Each string ends in a sign below all characters, the sooner string's below the later's.  Characters stand for themselves plus one, the end for 0.
    """
    data = np.frombuffer(b"".join(s + b"\x00" for s in strings), dtype=np.uint8)
    sizes = np.asarray([len(s) + 1 for s in strings])
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.repeat(sizes, sizes)
    offset = np.arange(len(data)) - begins
    codes = data.astype(np.int64) + 1
    codes[offset == length - 1] = 0
    # the first seven characters as one number, with nothing behind an end; then by doubling
    key = codes.copy()
    left = length - offset
    padded = np.concatenate([codes, np.zeros(8, dtype=np.int64)])
    for k in range(1, 7):
        key = key * 257 + np.where(left > k, padded[k : k + len(codes)], 0)
    # suffixes that reach their string's end differ by their strings
    owner = np.repeat(np.arange(len(strings)), sizes)
    rank = _ranks(key, np.where(left <= 7, owner, -1))
    width = 7
    while width < sizes.max() and rank.max() < len(data) - 1:
        later = np.zeros(len(data), dtype=np.int64)
        later[:-width] = rank[width:] + 1
        later[left <= width] = 0
        rank = _ranks(rank * (len(data) + 1) + later)
        width *= 2
    order = np.empty(len(data), dtype=np.int64)
    order[rank] = np.arange(len(data))  # the ends' order tells all suffixes apart
    number = np.zeros(len(data), dtype=np.int64)
    for k in range(step, 0, -1):
        number = number * 257 + codes[begins + (offset - k) % length]
    return number[order], owner[order], offset[order]


def _ranks(key: np.ndarray, tie: np.ndarray | None = None) -> np.ndarray:
    """Dense ranks; with tie, equal keys rank by it."""
    if tie is not None:
        key = _ranks(key) * (int(tie.max()) + 2) + tie + 1
    order = np.argsort(key)
    k = key[order]
    new = np.empty(len(key), dtype=bool)
    new[0] = False
    new[1:] = k[1:] != k[:-1]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _radix_order(letters: np.ndarray) -> np.ndarray:
    """A stable order by linear passes over 16 bits each."""
    if letters.dtype == np.uint16:
        return np.argsort(letters, kind="stable")
    order = np.argsort(letters.astype(np.uint16), kind="stable")
    return order[np.argsort((letters >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]


def merge_bwts(transforms: list[np.ndarray], rounds: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of transforms after so many rounds of refinement, and whether each merged suffix begins a new interval: it shares fewer than
    rounds * step characters with the one before it.

    In round k the interleave orders suffixes by their first k * step characters.  The next round puts what precedes each suffix by step characters, which the
    transform tells, into the bucket of those characters, in the order of the suffixes: a stable sort.  An end shares nothing with another.
    """
    sizes = [len(t) for t in transforms]
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), sizes)
    joined = np.concatenate(transforms)
    # the numbers in use, so that they fit 16 bits, or twice 16, and sort by radix
    used = np.unique(joined)
    has_end = np.zeros(len(used), dtype=bool)
    rest = used.copy()
    for _ in range(step):
        has_end |= rest % 257 == 0
        rest //= 257
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    joined = np.searchsorted(used, joined).astype(kind)
    block = np.zeros(len(source), dtype=np.int32)
    letters = np.empty(len(source), dtype=kind)
    new = np.empty(len(source), dtype=bool)
    for _ in range(rounds):
        letters[np.argsort(source, kind="stable")] = joined
        order = _radix_order(letters)
        moved, letter, source = block[order], letters[order], source[order]
        new[0] = True
        np.not_equal(letter[1:], letter[:-1], out=new[1:])
        new[1:] |= moved[1:] != moved[:-1]
        new |= has_end[letter]
        np.cumsum(new, out=block)
    return source, new


def least_by_interval(strings: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For every start of each string that has ``length`` bytes, the least of the docs whose strings hold those bytes."""
    step = next(k for k in range(STEP, 0, -1) if length % k == 0)
    sizes = np.asarray([len(s) for s in strings])
    most = max(SHARD, -(-int(sizes.sum()) // SHARDS))
    shards, at, ends = [], 0, np.cumsum(sizes)
    while at < len(strings):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        shards.append((at, build_bwt(strings[at:end], step)))
        at = end
    source, new = merge_bwts([t for _, (t, _, _) in shards], length // step, step)
    place = np.argsort(source, kind="stable")
    owner, offset = np.empty(len(source), dtype=np.int64), np.empty(len(source), dtype=np.int64)
    owner[place] = np.concatenate([own + first for first, (_, own, _) in shards])
    offset[place] = np.concatenate([off for _, (_, _, off) in shards])
    starts = np.flatnonzero(new)
    real = offset + length <= sizes[owner]
    doc = np.where(real, docs[owner], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
    flat = np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))])
    joined = np.empty(flat[-1], dtype=np.int64)
    joined[flat[owner[real]] + offset[real]] = least[real]
    return [joined[a:b] for a, b in zip(flat, flat[1:], strict=False)]


def anchor_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """From doc_id and text: rows (h, doc_id, shared, known).

    Of each distinct anchor of the batch one row goes on to be compared with other batches', with whether several documents of
    the batch share it.  Where they do, a known row for each of them is added: no comparison is needed for these.
    """
    hashes = [np.unique(anchors(t.encode("utf-8", "surrogatepass"))[0]) for t in pdf["text"]]
    h = np.concatenate(hashes)
    doc = np.repeat(pdf["doc_id"].to_numpy(dtype=np.int64), [len(x) for x in hashes])
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
    many = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts) if len(h) else np.empty(0, dtype=bool)
    keep = np.repeat(many, np.diff(np.append(starts, len(h))))
    one = pd.DataFrame({"h": h[starts], "doc_id": doc[starts], "shared": many, "known": False})
    return pd.concat([one, pd.DataFrame({"h": h[keep], "doc_id": doc[keep], "shared": True, "known": True})])


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """(h, doc_id) of the anchors that several documents have. texts: doc_id, text."""

    def settled(rows: pd.DataFrame) -> pd.DataFrame:
        h, doc, shared = rows["h"].to_numpy(), rows["doc_id"].to_numpy(), rows["shared"].to_numpy(dtype=bool)
        if not len(h):
            return pd.DataFrame({"h": h, "doc_id": doc})
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)) | np.logical_or.reduceat(shared, starts)
        keep = np.repeat(many, np.diff(np.append(starts, len(h)))) & ~shared
        return pd.DataFrame({"h": h[keep], "doc_id": doc[keep]})

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From rows sorted by h: the known ones, and those not shared in their own batch whose h other rows have too. An anchor's rows
        that are held are one a batch at most."""
        held = None
        for pdf in batches:
            known = pdf["known"].to_numpy(dtype=bool)
            yield pdf.loc[known, ["h", "doc_id"]]
            rows = pdf.loc[~known, ["h", "doc_id", "shared"]]
            rows = rows if held is None else pd.concat([held, rows])
            if len(rows):
                h = rows["h"].to_numpy()
                at = int(np.searchsorted(h, h[-1]))
                held = rows.iloc[at:]
                yield settled(rows.iloc[:at])
        if held is not None:
            yield settled(held)

    rows = texts.mapInPandas(per_batch(anchor_rows), "h long, doc_id long, shared boolean, known boolean")
    # known rows are spread by document, so that none of them meet for being of one anchor
    dealt = rows.repartition(F.when(F.col("known"), F.xxhash64("doc_id", "h")).otherwise(F.col("h"))).sortWithinPartitions("h")
    return dealt.mapInPandas(several, "h long, doc_id long")


def segments(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """h, doc_id, tag, start, content (a hash of the segment) and bytes of the segments of repeated anchors. texts: doc_id, tag, text."""
    chosen = repeated.groupBy("doc_id").agg(F.collect_set("h").alias("hs"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("h", "doc_id", "tag", "start", "content", "bytes")}
        for doc_id, tag, text, hs in zip(pdf["doc_id"], pdf["tag"], pdf["text"], pdf["hs"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            h, first, n = anchors(data)
            keep = np.isin(h, np.asarray(hs, dtype=np.int64))
            for a, s, k in zip(h[keep].tolist(), first[keep].tolist(), n[keep].tolist(), strict=True):
                part = data[s : s + k + LENGTH - 1]
                out["h"].append(a)
                out["doc_id"].append(doc_id)
                out["tag"].append(tag)
                out["start"].append(s)
                out["content"].append(int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "big", signed=True))
                out["bytes"].append(part)
        return pd.DataFrame(out)

    return texts.join(chosen, "doc_id").mapInPandas(per_batch(run), "h long, doc_id long, tag long, start long, content long, bytes binary")


def near_starts(h: int, data: bytes, length: int = LENGTH, k: int = K, near: int = NEAR) -> list[tuple[int, int, int, bytes]]:
    """A segment's starts by how far before the anchor they are: (first, past the last, place, the bytes that all their strings have in common)."""
    places = np.flatnonzero(window_hashes(np.frombuffer(data, dtype=np.uint8), k) == h)
    starts = np.arange(len(data) - length + 1)
    anchor = places[np.searchsorted(places, starts)]
    place = (anchor - starts) // near
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(place) != 0)]))
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(starts)], strict=True):
        before = int(place[a]) * near
        out.append((a, b, int(place[a]), data[anchor[a] - before : anchor[a] - before + length - near + 1]))
    return out


def cut_up(large: DataFrame) -> DataFrame:
    """h, content, first, key, part (a hash of the bytes), bytes and doc_id of the pieces of the segments of anchors that have many."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for h, content, data, doc_id in zip(pdf["h"], pdf["content"], pdf["bytes"], pdf["doc_id"], strict=True):
            for a, b, place, core in near_starts(h, data):
                part = data[a : b + LENGTH - 1]
                key = hashlib.blake2b(h.to_bytes(8, "big", signed=True) + bytes([place]) + core, digest_size=8).digest()
                rows.append((h, content, a, int.from_bytes(key, "big", signed=True), int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "big", signed=True), part, doc_id))
        return pd.DataFrame(rows, columns=["h", "content", "first", "key", "part", "bytes", "doc_id"])

    return large.select("h", "content", "bytes", "doc_id").mapInPandas(per_batch(run), "h long, content long, first int, key long, part long, bytes binary, doc_id long")


def merged(distinct: DataFrame) -> DataFrame:
    """h, content, least of distinct segments (h, content, bytes, doc_id), by merging the transforms of anchors that lie in one task."""

    def flush(rows: list[tuple]) -> pd.DataFrame:
        found = least_by_interval([r[2] for r in rows], np.asarray([r[3] for r in rows], dtype=np.int64))
        return pd.DataFrame({"h": [r[0] for r in rows], "content": [r[1] for r in rows], "least": found})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                if rows and size > SHARD * SHARDS and rows[-1][0] != r[0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[2])
        if rows:
            yield flush(rows)

    return distinct.repartition("h").sortWithinPartitions("h").select("h", "content", "bytes", "doc_id").mapInPandas(run, "h long, content long, least array<long>")


def least_documents(parts: DataFrame, most: int | None = None) -> DataFrame:
    """h, content, least: for each start of every distinct segment of anchors with unequal segments, the least doc_id that holds the string there."""
    each = parts.groupBy("h", "content").agg(F.max(F.octet_length("bytes")).alias("n"))
    large = cut(each.groupBy("h").agg(F.sum("n").alias("size")).filter(F.col("size") > (most or MERGED)).select("h"), "large")
    distinct = parts.groupBy("h", "content", "bytes").agg(F.min("doc_id").alias("doc_id"))
    plain = merged(distinct.join(large, "h", "left_anti"))
    pieces = cut(cut_up(distinct.join(large, "h")), "pieces")
    one = pieces.groupBy(F.col("key").alias("h"), F.col("part").alias("content"), "bytes").agg(F.min("doc_id").alias("doc_id"))
    found = merged(one).select(F.col("h").alias("key"), F.col("content").alias("part"), "least")
    back = pieces.select("h", "content", "first", "key", "part").join(found, ["key", "part"]).groupBy("h", "content").agg(F.array_sort(F.collect_list(F.struct("first", "least"))).alias("pieces"))
    return plain.union(back.select("h", "content", F.flatten(F.transform("pieces", lambda p: p["least"])).alias("least")))


def runs_removed(gone: DataFrame) -> DataFrame:
    """doc_id, tag, a and b of the runs of bytes that rows (doc_id, tag, start, least) remove."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) for x in pdf["least"]]
        row = np.repeat(np.arange(len(pdf)), sizes)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(np.concatenate(list(pdf["least"])) < pdf["doc_id"].to_numpy()[row])
        row, begin = row[at], (pdf["start"].to_numpy()[row] + offset)[at]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + 1)])) if len(at) else at
        last = np.append(first[1:], len(at)) - 1 if len(at) else at
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row[first]], "tag": pdf["tag"].to_numpy()[row[first]], "a": begin[first], "b": begin[last] + LENGTH})

    return gone.select("doc_id", "tag", "start", "least").mapInPandas(per_batch(run), "doc_id long, tag long, a long, b long")


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, whole (a copy of a document with smaller doc_id), and begins and ends of the spans, which may overlap, of each row."""
    rows = texts_of(docs).select(F.col("doc_id").cast("long"), "text").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    real = rows.filter("doc_id IS NOT NULL").filter(F.octet_length("text") >= LENGTH)
    firsts = cut(real.groupBy("sha").agg(F.min("doc_id").alias("doc_id")), "firsts")
    tag = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    firsts = firsts.select("doc_id", tag.alias("tag"))
    rows = rows.withColumn("tag", tag)
    texts = rows.filter(F.octet_length("text") >= LENGTH).select("doc_id", "tag", "text").join(firsts, ["doc_id", "tag"], "left_semi")
    repeated = cut(repeated_anchors(texts.select("doc_id", "text")), "repeated")
    parts = cut(segments(texts, repeated), "segments")
    kinds = parts.groupBy("h").agg(F.min("doc_id").alias("least_doc"), F.max("doc_id").alias("last_doc"), (F.min("content") == F.max("content")).alias("alike")).filter("least_doc != last_doc")
    kinds = cut(kinds, "kinds")
    n = (F.octet_length("bytes") - (LENGTH - 1)).alias("n")
    alike = parts.select("h", "doc_id", "tag", "start", n).join(kinds.filter("alike").select("h", "least_doc"), "h").filter("least_doc < doc_id")
    spans = alike.select("doc_id", "tag", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))
    mixed = cut(parts.join(kinds.filter("NOT alike").select("h"), "h"), "mixed")
    least = cut(least_documents(mixed), "least")
    more = runs_removed(mixed.select("h", "content", "doc_id", "tag", "start").join(least, ["h", "content"]))
    discard(repeated)
    listed = cut(spans.unionByName(more).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("raw")), "spans")
    for t in (parts, mixed, least, kinds):
        discard(t)
    first = firsts.select("doc_id", "tag", F.lit(True).alias("is_first"))
    known = cut(first.join(listed, ["doc_id", "tag"], "left"), "known")
    whole = F.col("is_first").isNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)
    ends = [F.transform("raw", lambda r: r["a"]).alias("begins"), F.transform("raw", lambda r: r["b"]).alias("ends")]
    return rows.join(known, ["doc_id", "tag"], "left").select("doc_id", "text", whole.alias("whole"), *ends)


def union_of(begins: np.ndarray | None, ends: np.ndarray | None, n_bytes: int, whole: bool) -> list[tuple[int, int]]:
    if whole:
        return [(0, n_bytes)]
    if begins is None or not len(begins):
        return []
    order = np.argsort(begins, kind="stable")
    a, b = np.asarray(begins)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[new].tolist(), b[np.append(new[1:], len(b)) - 1].tolist(), strict=True))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row."""
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc_id, text, whole, begins, ends in zip(pdf["doc_id"], pdf["text"], pdf["whole"], pdf["begins"], pdf["ends"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            spans = union_of(begins, ends, len(data), bool(whole))
            cuts = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            out.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=[x.split()[0] for x in kind.split(", ")]).astype({"doc_id": "Int64"})

    return removed_spans(docs).mapInPandas(per_batch(run), kind)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
