"""What Spark's own operators say about violations: densities, rollups, windows, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def density(scanned: DataFrame, *by: str, text_col: str = "text", scan_col: str = "scan") -> DataFrame:
    """Documents, documents with findings, violations, and violations in a million characters, by the given columns."""
    n = F.size(f"{scan_col}.violations")
    out = scanned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.sum((n > 0).cast("long")).alias("with_findings"), F.sum(n.cast("long")).alias("violations"),
        F.sum(F.length(text_col).cast("long")).alias("characters"),
    )
    return out.withColumn("per_million", F.round(F.col("violations") * 1e6 / F.greatest("characters", F.lit(1)), 6))


def by_type(violations: DataFrame, *by: str, rollup: bool = False) -> DataFrame:
    """Violations and distinct values by type; with rollup also the totals above them."""
    grouped = violations.rollup(*by, "entity_type") if rollup else violations.groupBy(*by, "entity_type")
    return grouped.agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("original").alias("distinct_values"))


def gaps(violations: DataFrame, key: str) -> DataFrame:
    """Each violation with its number in the document and the characters since the one before."""
    w = Window.partitionBy(key).orderBy("start")
    return violations.withColumns({"number": F.row_number().over(w), "gap": F.col("start") - F.lag("end").over(w)})


def evaluate(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1 by type, and for all of them together (MICRO).

    Both tables have (key, entity_type, value); equal rows are matched one to one.
    """
    count = lambda df, name: df.groupBy(key, "entity_type", "value").agg(F.count(F.lit(1)).alias(name))
    both = count(gold, "g").join(count(found, "f"), [key, "entity_type", "value"], "full").na.fill(0, ["g", "f"])
    sums = [F.sum(F.least("g", "f")).alias("tp"), F.sum(F.greatest(F.col("f") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("f"), F.lit(0))).alias("fn")]
    out = both.rollup("entity_type").agg(*sums).withColumn("entity_type", F.coalesce("entity_type", F.lit("MICRO")))
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    out = out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))
