"""Splits by group: all rows of a group stand on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(groups: DataFrame, key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def validation_groups(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """The keys of the validation side: the first max(1, floor(n * ratio)) in the order of a seeded hash.

    Keys are counted by the first four digits of the hash, 65,536 buckets at most; buckets go in whole up to the one where
    the share ends, and ranks are taken within a bucket, so no task sorts all keys."""
    groups = rows.select(key).distinct()
    dealt = groups.withColumn("__hash", shuffled(groups, key, seed)).withColumn("__bucket", F.substring("__hash", 1, 4))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = dealt.groupBy("__bucket").agg(F.count("*").alias("__n"))
    told = buckets.select("__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("__all") * F.lit(ratio)))
    some = told.select("__bucket", "__before", wanted.alias("__wanted")).where("__before < __wanted")
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__hash", key))
    ranked = dealt.join(F.broadcast(some), "__bucket").withColumn("__rank", rank + F.col("__before"))
    return ranked.where("__rank <= __wanted").select(key)


def by_group(rows: DataFrame, key: str, ratio: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation)"""
    chosen = validation_groups(rows, key, ratio, seed)
    return rows.join(chosen, key, "left_anti"), rows.join(chosen, key, "left_semi")


def overfit(rows: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The rows of n groups, on both sides."""
    groups = rows.select(key).distinct()
    some = rows.join(groups.orderBy(shuffled(groups, key, seed), key).limit(n), key, "left_semi")
    return some, some


def sample_groups(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The rows of n groups, or of all if there are fewer."""
    return overfit(rows, key, n, seed)[0]
