"""Near-duplicates by HyperMinHash, confirmed on full shingle sets.

A document's set holds 64-bit hashes of its distinct five-word shingles.  Its sketch has REGISTERS buckets, each with the count of
leading zeros of the bucket's least hash and MANTISSA bits behind them, in 16 bits.  Documents with equal sets
form a class, for which the least doc_id stands.  Bands of registers deal the classes into buckets:

1. in each bucket every class is paired with one centre (the class that meets most others), and pairs whose estimated similarity (corrected for chance
   collisions) or sizes rule out a link are put aside; the others are confirmed on full sets;
2. links are contracted to components; for buckets that still hold several, ``still_possible`` finds the pairs across components that can be links at all,
   by their rarer shingles, and these are estimated and confirmed, so that nothing depends on the choice of the centre.  Nowhere are all pairs of
   a group made, although no pair that shares a band is lost.

With 32 bands of 4 registers two documents of similarity 0.75 share a band but for 5 in a million; nothing is capped.  Bucket
keys are combined before shuffles, and joins on them are plain sort-merge joins, which Spark splits where they are skewed.

Defined results: without words or text the set is empty and linked with nothing; a null doc_id stands apart: it is linked with nothing
and kept; rows of equal doc_id are one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, per_batch, read_table, texts_of
from .components import components

WORDS, SIMILARITY = 5, 75
REGISTERS, LOG_REGISTERS, MANTISSA, BAND = 128, 7, 10, 4
BANDS = REGISTERS // BAND
#: Standard deviations below the threshold at which an estimate rules a link out; from so many filled registers on.
SAFE, LEAST_FILLED = 5.5, 64
#: The most holders of a light shingle.
LIGHT = 100
#: The collision constant of the HyperMinHash paper.
COLLISIONS = 0.169919487159739


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; A-Z are lowered, words end at white space of ASCII."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    with np.errstate(over="ignore"):
        x = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unique(x)


def registers(hashes: np.ndarray) -> np.ndarray:
    """From sorted hashes: leading zeros + 1 above MANTISSA bits, 0 where a bucket is empty. The bucket is the hash's first bits."""
    rest = 64 - LOG_REGISTERS
    first = np.searchsorted(hashes, np.arange(REGISTERS, dtype=np.uint64) << np.uint64(rest))
    out = np.zeros(REGISTERS, dtype="<u2")
    if not len(hashes):
        return out
    least = hashes[np.minimum(first, len(hashes) - 1)]
    full = (first < len(hashes)) & ((least >> np.uint64(rest)) == np.arange(REGISTERS, dtype=np.uint64))
    low = (least & np.uint64((1 << rest) - 1)) | np.uint64(1)
    bits = np.frexp(low.astype(np.float64))[1]
    bits -= (low >> (bits - 1).astype(np.uint64)) == 0
    mantissa = np.where(bits > MANTISSA, low >> np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64), low << np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64))
    value = ((rest - bits + 1) << MANTISSA) | (mantissa & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    out[full] = value[full]
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and its registers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            s = shingle_hashes(text)
            rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, registers(s).tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "registers"]).astype({"doc_id": "Int64"})

    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(per_batch(run), "doc_id long, n_shingles long, digest binary, registers binary")


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of rows of registers, without the collisions that chance gives, and the filled registers."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = COLLISIONS * 2.0 ** (LOG_REGISTERS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(equal - chance, 0) / np.maximum(filled, 1), filled


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes those that sizes and estimates don't rule out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(b"".join(pdf[c]), dtype="<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
        similar, filled = estimates(*rows, pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy())
        least = SIMILARITY / 100 - SAFE * np.sqrt(SIMILARITY / 100 * (1 - SIMILARITY / 100) / np.maximum(filled, 1))
        return pdf.loc[(filled < LEAST_FILLED) | (similar >= least), ["a", "b"]]

    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILARITY)
    return sized.mapInPandas(per_batch(run), "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and hashes of the classes in wanted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rep": pdf["doc_id"], "hashes": [shingle_hashes(t).view(np.int64) for t in pdf["text"]]})

    return texts_of(docs).withColumnRenamed("doc_id", "rep").join(wanted.hint("merge"), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "text").mapInPandas(per_batch(run), "rep long, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs those whose full sets are similar enough."""
    one, two = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("h_a")), sets.select(F.col("rep").alias("b"), F.col("hashes").alias("h_b"))
    common: Column = F.size(F.array_intersect("h_a", "h_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("i"), (F.size("h_a") + F.size("h_b")).alias("n")).filter(F.col("i") * (100 + SIMILARITY) >= F.col("n") * SIMILARITY).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketch = cut(sketches(docs), "sketches")
    real = sketch.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    least = cut(real.groupBy("digest").agg(F.min("doc_id").alias("rep")), "least")
    classes = cut(
        real.select(F.col("doc_id").alias("rep"), "digest", "n_shingles", "registers").join(least, ["rep", "digest"]).groupBy("rep").agg(
            F.max(F.struct("n_shingles", "registers")).alias("c")).select("rep", "c.*"), "classes")
    empty = F.lit(b"\x00" * 2 * BAND)
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("i"), F.substring(F.col("registers"), i * 2 * BAND + 1, F.lit(2 * BAND)).alias("r")))
    bands = classes.select("rep", F.explode(keys).alias("k")).filter(F.col("k.r") != empty).select(F.xxhash64("k.i", "k.r").alias("key"), "rep")
    shared = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = cut(bands.join(shared, "key"), "members")
    # of a bucket's members the one that shares most bands with most others is likest to be what they were copied from
    score = cut(members.groupBy("rep").agg(F.sum("n").alias("score")), "score")
    scored = members.select("key", "rep").join(score, "rep")
    centres = cut(scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("minus"))).alias("c")).select("key", (-F.col("c.minus")).alias("centre")), "centres")
    pairs = members.select("key", "rep").join(centres, "key").filter("rep != centre")
    first = cut(likely(pairs.select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct(), classes), "likely")
    sets = cut(full_sets(docs, ends_of(first)), "sets")
    links = cut(confirmed(first, one_of_each(sets)), "links")
    found = components(links)
    rest = mixed_buckets(members.select("key", "rep"), found, classes.select("rep", "n_shingles"))
    if not rest.isEmpty():
        pairs = still_possible(docs, rest)
        second = cut(likely(pairs.join(first, ["a", "b"], "left_anti"), classes), "likely2")
        if not second.isEmpty():
            more = ends_of(second).join(sets.select("rep"), "rep", "left_anti")
            sets = cut(sets.unionByName(full_sets(docs, more)), "sets2")
            links = cut(links.union(confirmed(second, one_of_each(sets))), "links2")
            found = components(links)
    of_class = cut(least.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "of_class")
    rows = sketch.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()


def mixed_buckets(members: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, rep, label (of its component) and n_shingles of the members of buckets that still hold several components and a pair not yet tried."""
    labels = cut(members.select("rep").distinct().join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("label")).join(sizes, "rep"), "labels")
    labelled = cut(members.join(labels, "rep"), "labelled")
    mixed = cut(labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).filter("x != y AND n > 2").select("key"), "mixed")
    return cut(labelled.join(mixed, "key"), "open")


def still_possible(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that can still be similar enough.

    Shingles are heavy if more than LIGHT members of open buckets have them, else light.  Two sets share at most the lesser count of heavy ones and their
    common light ones.  So a set that has too few heavy ones for any partner's size needs common light ones, at least ``need`` of them, and one of
 these is among its rarest (light - need + 1): such pairs are found by joining on these, of which each has few holders.  Copies that have strayed too far from
    what they were copied from are of this sort.  Where both sets have enough heavy ones, members outside their bucket's largest component meet the bucket.
    """
    least_here = rest.groupBy("key").agg(F.min("n_shingles").alias("least_here"))
    own = rest.join(cut(least_here, "least_here"), "key").groupBy("rep", "label", "n_shingles").agg(F.min("least_here").alias("partner"))
    each = cut(full_sets(docs, own.select("rep")).select("rep", F.explode("hashes").alias("h")), "shingles")
    holders = cut(each.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1"), "holders")
    counted = cut(each.join(holders, "h"), "counted")
    discard(each)
    light = F.col("holders") <= LIGHT
    sums = counted.groupBy("rep").agg(F.sum((~light).cast("int")).alias("heavy"), F.sum(light.cast("int")).alias("light"))
    partner = F.greatest("partner", F.ceil(F.col("n_shingles") * SIMILARITY / 100))
    common = F.ceil((F.col("n_shingles") + partner) * SIMILARITY / (100 + SIMILARITY))
    own = cut(own.join(sums, "rep").withColumn("need", F.greatest(F.lit(1), common - F.col("heavy"))), "needs")
    of_light = cut(counted.filter(light).select("rep", "h", "holders"), "light")
    side = lambda x: [F.col("rep").alias(x), F.col("label").alias(f"l_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("heavy").alias(f"h_{x}")]
    asking = of_light.join(own.filter("light >= need"), "rep").withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("holders", "h"))).filter("rank <= light - need + 1")
    asked = of_light.join(own, "rep")
    sized = f"l_a != l_b AND least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {SIMILARITY}"
    enough = f"least(h_a, h_b) * {100 + SIMILARITY} >= (n_a + n_b) * {SIMILARITY}"
    # the one with fewer heavy shingles asks
    by_light = cut(asking.select(*side("a"), "h"), "asking").join(cut(asked.select(*side("b"), "h"), "asked"), "h").filter(f"{sized} AND h_a <= h_b AND NOT ({enough})").select("a", "b")
    heavy = rest.select("key", "rep").join(own.filter(f"heavy * {100 + SIMILARITY} >= (n_shingles + partner) * {SIMILARITY}"), "rep").select("key", "rep", "label", "n_shingles", "heavy")
    heavy = cut(heavy, "heavy")
    # all but the members of a bucket's largest component ask all of the bucket
    largest = heavy.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("largest"))
    asking = cut(heavy.join(cut(largest, "largest"), "key").filter("label != largest").select("key", *side("a")), "minor")
    by_bucket = asking.join(heavy.select("key", *side("b")), "key").filter(f"{sized} AND {enough}").select("a", "b")
    return by_light.union(by_bucket).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def one_of_each(sets: DataFrame) -> DataFrame:
    """Rows of equal doc_id are one document: the largest set stands for it."""
    if sets.groupBy("rep").count().filter("count > 1").isEmpty():
        return sets
    return cut(sets.groupBy("rep").agg(F.max_by("hashes", F.struct(F.size("hashes"), F.xxhash64("hashes"))).alias("hashes")), "sets_of_each")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id; all columns of docs are returned."""
    dropped = cut(near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_id"], "left_anti")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.other)
SELECT doc_id, cast(any_value(n) AS bigint) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""
