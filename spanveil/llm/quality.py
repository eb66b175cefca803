"""Quality by the perplexity of an interpolated modified Kneser-Ney model of characters.

The model's n-grams are ORDER code points as they stand, without folding and without a ceiling on their number: its tables grow with the trusted texts.
Nothing of them is collected or broadcast.

1. Texts are dealt, compressed, to blocks by a hash of doc_id, and the trusted ids to the same blocks.  A task counts its block's n-grams: a row for each distinct one, with its
   place in the block's order and how often trusted texts have it.
2. Rows are added up by n-gram (shards).  Each order's counts come from the next higher one's: in how many contexts an n-gram goes on.  Joins with the contexts'
   totals, and with the lower order's probabilities by suffix, give every n-gram of the corpus, seen in trusted texts or not, its interpolated
   probability.  Only the four counts' counts that the discounts need go to the driver.
3. The logarithms are joined back to the blocks' rows, and go with the texts, once more, to the blocks, where each text's are summed up by its n-grams' places.

Blocks hold at most BLOCK bytes of texts on average, so a task's memory depends on that, not on the vocabulary.  A document stays if its perplexity is at most its language's threshold: a quantile of the
perplexities of trusted texts that the model hasn't seen (one in HELD_OUT, by a hash of doc_id); a language with too few of them takes the quantile of all, and
if there are none at all, the texts that it has seen stand in.

Defined results: a null or empty text has a null perplexity and is kept; a text of any length is read whole, PIECE code points at a time; a null language is a language of its own; rows of
equal doc_id are scored each on its own; a null doc_id is kept and never trusted; without trusted text every document is kept with a null perplexity; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, per_batch, read_table

ORDER = 5
#: What stands before a text's first sign.
BEGIN = 2
#: The quantile of trusted perplexities, the fewest trusted texts of a language for it, and of how many trusted texts one is kept from the model.
QUANTILE, FEWEST, HELD_OUT = 0.99, 30, 10
#: Bytes of texts of a block: so many times the root of all texts' bytes, at least and at most these.
BY_ROOT, LEAST_BLOCK, BLOCK = 1024, 8 << 20, 64 << 20
#: Code points that are looked at together.
PIECE = 1 << 21
#: Of these so many are hashed at a time, which a core's cache holds.
CACHED = 1 << 14
#: What goes to a block, in this order: logarithms by place, trusted ids, documents.
SCORE, TRUSTED, DOCUMENT = 0, 1, 2
DEALT = "block int, kind int, doc_id long, lang string, data binary, j int, logp float"


def hashed(x: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of all strings of so many code points."""
    out = np.empty(max(len(x) - order + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(out), CACHED):
            h = out[at : at + CACHED]
            part = x[at : at + len(h) + order - 1].astype(np.uint64)
            h[:] = part[: len(h)]
            for k in range(1, order):
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += part[k : k + len(h)]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return out


def distinct_sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each comes."""
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def places_in(known: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function of hashes that are all in known (sorted, distinct): their places. Hashes are spread evenly, so their first bits nearly tell."""
    bits = len(known).bit_length() + 1
    shift = np.uint64(64 - bits)
    near = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32)

    def places(h: np.ndarray) -> np.ndarray:
        at = near[h >> shift]
        off = np.flatnonzero(known[at] != h)
        while len(off):
            at[off] += 1
            off = off[known[at[off]] != h[off]]
        return at

    return places


def some_places_of(wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each wanted hash (sorted, distinct, all in h) a place in h that has it."""
    out = np.zeros(len(wanted), dtype=np.int64)
    if len(wanted):
        bits = len(wanted).bit_length() + 3
        shift = np.uint64(64 - bits)
        marked = np.zeros(1 << bits, dtype=bool)
        marked[wanted >> shift] = True
        may = np.flatnonzero(marked[h >> shift])
        at = np.minimum(np.searchsorted(wanted, h[may]), len(wanted) - 1)
        same = wanted[at] == h[may]
        out[at[same]] = may[same]
    return out


def pieces(texts: Iterable[str], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Code points, the starts in them of the n-grams that end in each sign of the texts, and whose and how many these are: (number of the text, n)."""
    begin = np.full(order - 1, BEGIN, dtype="<u4")
    held: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []

    def joined() -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        x = np.concatenate(held)
        real = np.ones(len(x), dtype=bool)
        ends = np.cumsum([len(h) for h in held])
        for k in range(1, order):
            real[ends - k] = False
        return x, np.flatnonzero(real), owners

    size = 0
    for number, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for at in range(0, len(codes), PIECE):
            part = codes[at : at + PIECE]
            held.append(np.concatenate([codes[at - order + 1 : at] if at else begin, part]))
            owners.append((number, len(part)))
            size += len(part)
            if size >= PIECE:
                yield joined()
                held, owners, size = [], [], 0
    if held:
        yield joined()


def gram_strings(x: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The strings of so many code points that start there."""
    flat = x[starts[:, None] + np.arange(order)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return np.asarray([flat[k : k + order] for k in range(0, len(flat), order)], dtype=object)


def distinct_grams(texts: list[str], learn: list[bool], order: int = ORDER) -> pd.DataFrame:
    """j, gram and n of the distinct n-grams of texts: their places by hash, and how often texts to learn from have them."""
    known, grams, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=object), np.empty(0, dtype=np.int64)
    for part in (True, False):
        for x, starts, _ in pieces((t for t, own in zip(texts, learn, strict=True) if own is part), order):
            own = hashed(x, order)[starts]
            h, n = distinct_sorted(own)
            at = np.searchsorted(known, h)
            old = at < len(known)
            old[old] = known[at[old]] == h[old]
            if part:
                counts[at[old]] += n[old]
            # only new ones become strings
            new, at, n = h[~old], at[~old], n[~old]
            known, counts = np.insert(known, at, new), np.insert(counts, at, n if part else 0)
            grams = np.insert(grams, at, gram_strings(x, starts[some_places_of(new, own)], order))
    return pd.DataFrame({"j": np.arange(len(known)), "gram": grams, "n": counts})


def sums_of(texts: list[str], scores: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Of each text the sum over its signs of the score at the place of the n-gram that ends there."""
    known = np.empty(0, dtype=np.uint64)
    for x, starts, _ in pieces(texts, order):
        known = distinct_sorted(np.concatenate([known, distinct_sorted(hashed(x, order)[starts])[0]]))[0]
    places, out = places_in(known), np.zeros(len(texts))
    for x, starts, owners in pieces(texts, order):
        own = scores[places(hashed(x, order)[starts])].astype(np.float64)
        ends = np.cumsum([n for _, n in owners])
        np.add.at(out, [number for number, _ in owners], np.add.reduceat(own, ends - [n for _, n in owners]))
    return out


def block_count(total_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / min(BLOCK, max(LEAST_BLOCK, BY_ROOT * math.sqrt(total_bytes)))))


def block_of(doc_id: Column, text: Column, blocks: int) -> Column:
    return F.pmod(F.when(doc_id.isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(text)), F.lit(blocks)).cast("int")


def compressed(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows of DEALT, a document each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        data = [squeeze(t.encode("utf-8", "surrogatepass")) for t in pdf.pop("text")]
        return pdf.assign(kind=DOCUMENT, doc_id=pdf["doc_id"].astype("Int64"), data=data, j=None, logp=None)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("block", block_of(F.col("doc_id"), F.col("text"), blocks)).mapInPandas(per_batch(run), DEALT)


def by_block(rows: DataFrame, blocks: int, of_block: Callable[..., pd.DataFrame], kind: str) -> DataFrame:
    """of_block(block, doc_ids, langs, texts, trusted, scores) of each block of rows of DEALT; what it gets of texts is unpacked only there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        block, docs, trusted, places, logs = -1, [], set(), [], []

        def closed() -> pd.DataFrame:
            # one decompressor for each text: the sizes are in the frames
            texts = [zstandard.ZstdDecompressor().decompress(d).decode("utf-8", "surrogatepass") for _, _, d in docs]
            scores = np.empty(0, dtype=np.float32)
            if places:
                scores = np.empty(sum(map(len, places)), dtype=np.float32)
                scores[np.concatenate(places)] = np.concatenate(logs)
            ids = [None if pd.isna(i) else int(i) for i, _, _ in docs]
            return of_block(block, ids, [lang for _, lang, _ in docs], texts, [i is not None and i in trusted for i in ids], scores)

        for pdf in batches:
            for own, rows in pdf.groupby("block", sort=True):
                if own != block:
                    if docs:
                        yield closed()
                    block, docs, trusted, places, logs = own, [], set(), [], []
                kinds = rows["kind"].to_numpy()
                if (some := kinds == SCORE).any():
                    places.append(rows["j"].to_numpy()[some].astype(np.int64))
                    logs.append(rows["logp"].to_numpy()[some].astype(np.float32))
                trusted.update(rows["doc_id"][kinds == TRUSTED].astype("int64"))
                of = rows[kinds == DOCUMENT]
                docs += zip(of["doc_id"].astype("Int64"), of["lang"], of["data"], strict=True)
        if docs:
            yield closed()

    parts = min(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(parts, F.col("block") % parts).sortWithinPartitions("block", "kind")
    return dealt.mapInPandas(run, kind)


def held_out(doc_id: int) -> bool:
    """Whether a trusted text is kept from the model."""
    return int(hashed(np.asarray([doc_id & 0xFFFFFFFF, (doc_id >> 32) & 0xFFFFFFFF], dtype=np.uint64), 2)[0]) % HELD_OUT == 0


def block_grams(rows: DataFrame, blocks: int, order: int = ORDER) -> DataFrame:
    """block, j, gram and n of the distinct n-grams of each block."""

    def run(block, ids, langs, texts, trusted, scores) -> pd.DataFrame:
        return distinct_grams(texts, [t and not held_out(i) for i, t in zip(ids, trusted, strict=True)], order).assign(block=block)

    return by_block(rows, blocks, run, "block int, j int, gram string, n long")


def text_sums(rows: DataFrame, blocks: int, order: int = ORDER) -> DataFrame:
    """doc_id, lang, trusted, held_out and perplexity of each document."""

    def run(block, ids, langs, texts, trusted, scores) -> pd.DataFrame:
        sums = sums_of(texts, scores, order)
        per = [math.exp(-s / len(t)) if t else None for s, t in zip(sums, texts, strict=True)]
        held = [t and held_out(i) for i, t in zip(ids, trusted, strict=True)]
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "lang": langs, "trusted": trusted, "held_out": held, "perplexity": pd.array(per, dtype="Float64")})

    return by_block(rows, blocks, run, "doc_id long, lang string, trusted boolean, held_out boolean, perplexity double")


def discounts(level: DataFrame) -> list[float]:
    """What is taken from counts of 1, 2 and more."""
    kinds = dict(level.filter("n BETWEEN 1 AND 4").groupBy("n").count().collect())
    n1, n2, n3, n4 = (kinds.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    return [min(max(i - (i + 1) * y * b / a, 0.0), i - 0.01) if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and p of all n-grams of counts (gram, n): n is how often trusted texts have it, 0 if they don't."""
    levels = [counts]
    for _ in range(order - 1):
        # the next lower order counts in how many contexts an n-gram goes on
        below = levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))
        levels.append(cut(below, "counts"))
    lower = None
    for k, level in enumerate(reversed(levels), 1):
        d = discounts(level)
        taken = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        each = level.select("gram", "n", taken.alias("d"))
        if lower is None:
            seen, total, left = each.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum("d")).first()
            p = (F.col("n") - F.col("d")) / total + F.lit(left / total / (seen + 1))
            lower = cut(each.select("gram", p.alias("p")), "p")
            continue
        context = F.substring("gram", 1, k - 1)
        totals = each.filter("n > 0").groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        joined = each.withColumns({"context": context, "suffix": F.expr("substring(gram, 2)")}).join(totals, "context", "left").join(below, "suffix")
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise((F.col("n") - F.col("d") + F.col("left") * F.col("q")) / F.col("total"))
        lower = cut(joined.select("gram", p.alias("p")), "p")
    return lower


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, trusted, perplexity, threshold and kept of each row. trusted: the doc_id of texts to learn from, all of which are used."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = block_count(size)
    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in DEALT.split(", "))]
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    ids = ids.select(block_of(F.col("doc_id"), F.lit(""), blocks).alias("block"), F.lit(TRUSTED).alias("kind"), "doc_id", *none[3:])
    rows = compressed(docs, blocks).union(ids)
    grams = cut(block_grams(rows, blocks), "grams", compression="zstd")
    counts = cut(grams.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    if counts.filter("n > 0").isEmpty():
        null = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.lit(False).alias("trusted"), null.alias("perplexity"), null.alias("threshold"), F.lit(True).alias("kept"))
    p = probabilities(counts)
    scores = cut(grams.join(p, "gram").select("block", "j", F.log("p").cast("float").alias("logp")), "scores", compression="zstd")
    discard(grams)
    scored = cut(text_sums(rows.union(scores.select("block", F.lit(SCORE).alias("kind"), *none[2:5], "j", "logp")), blocks), "scored")
    discard(scores)
    real = scored.filter("trusted AND perplexity IS NOT NULL")
    unseen = real.filter("held_out")
    known = real if unseen.isEmpty() else unseen
    at = lambda c: F.percentile_approx(c, quantile, 10_000)
    overall = known.agg(at("perplexity")).first()[0]
    by_lang = cut(known.groupBy("lang").agg(at("perplexity").alias("own"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEWEST), "thresholds")
    joined = scored.join(by_lang.select(F.col("lang").alias("l"), "own"), F.col("lang").eqNullSafe(F.col("l")), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double")).alias("threshold")
    return joined.select("doc_id", "lang", "trusted", "perplexity", threshold).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that labels call good."""
    good = read_table(spark, sf_dir, "labels").filter("quality = 1")
    return quality(read_table(spark, sf_dir, "documents"), good)
