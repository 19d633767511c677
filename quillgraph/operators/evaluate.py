"""Scores of returned against expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(returned: DataFrame, expected: DataFrame, acceptable: DataFrame | None = None, by: str = "question", item: str = "item") -> DataFrame:
    """by, precision, recall, f1 (4 decimals), hits, extra, missed: sets of trimmed lower-case items; acceptable ones count as neither extra nor missed."""
    key = F.trim(F.lower(item)).alias("k")
    got = returned.select(by, key).distinct().withColumn("g", F.lit(1))
    want = expected.select(by, key).distinct().withColumn("e", F.lit(1))
    both = got.join(want, [by, "k"], "full")
    if acceptable is not None:
        both = both.join(acceptable.select(by, key).distinct().withColumn("a", F.lit(1)), [by, "k"], "left").where("e = 1 or a is null or g is null")
    sums = both.groupBy(by).agg(F.count_if(F.expr("g = 1 and e = 1")).alias("hits"), F.count_if(F.expr("g = 1 and e is null")).alias("extra"), F.count_if(F.expr("g is null and e = 1")).alias("missed"))
    p = F.when(F.expr("hits + extra > 0"), F.expr("hits / (hits + extra)")).otherwise(0.0)
    r = F.when(F.expr("hits + missed > 0"), F.expr("hits / (hits + missed)")).otherwise(0.0)
    out = sums.select(by, p.alias("p"), r.alias("r"), "hits", "extra", "missed")
    f1 = F.when(F.expr("p + r > 0"), F.expr("2 * p * r / (p + r)")).otherwise(0.0)
    return out.select(by, F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"), "hits", "extra", "missed")


def regressions(now: DataFrame, baseline: DataFrame, by: str = "question", most: float = 0.05) -> DataFrame:
    old = baseline.select(by, F.col("f1").alias("f1_before"))
    return now.join(old, by).where(F.col("f1_before") - F.col("f1") > most).select(by, "f1_before", "f1")


def misfiled(names: DataFrame, pattern: str) -> DataFrame:
    """Names of a type that the words of another type give away."""
    return names.where(F.col("name").rlike(pattern))
