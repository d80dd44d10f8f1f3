"""Caps, samples, running bests and other choices of rows. Every order is an explicit column, never an arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(df: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    """The first rows of each group; the rank limit is applied before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rn") <= cap).drop("_rn")


def capped_families(df: DataFrame, family: str, family_order: str, row_order: str, n: int, n_families: int) -> DataFrame:
    """max(4, n // families) rows of each family in row order, then the first n by row and family."""
    return cap_per_group(df, [family], [row_order], max(4, n // n_families)).orderBy(row_order, family_order).limit(n)


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows; n = 0 is all."""
    return df.orderBy(*order).limit(n) if n else df


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows, in order; a missing key sorts first."""
    return df.orderBy(F.coalesce(F.col(order).cast("string"), F.lit("")).desc()).limit(n)


def running_best(df: DataFrame, group: list[str], order: str, score: str) -> DataFrame:
    """Adds best_before and kept: whether a round beats all rounds before it; the first always does."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("best_before", F.max(score).over(w))
    return df.withColumn("kept", F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))


def best_trial(df: DataFrame, group: list[str], score: Column, trial: str) -> DataFrame:
    """The row with the largest score of each group; the earlier trial wins a tie. Aggregated, not sorted."""
    every = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*group).agg(F.max_by(every, F.struct(score.alias("s"), (-F.col(trial)).alias("t"))).alias("b"))
    return best.select("b.*")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key: what stays of an append-only table with overwriting keys."""
    every = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*key).agg(F.max_by(every, F.struct(*order)).alias("b")).select("b.*")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that the seed decides, the same in any engine and for any partitioning."""
    mark = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("sample_key", mark).orderBy("sample_key").limit(n)


def ordered_union(a: Column, b: Column) -> Column:
    """The distinct elements of two arrays in the order in which they first occur."""
    return F.array_distinct(F.concat(a, b))


def strategy_score(rows: DataFrame, group: list[str], order: list, fidelity: str, n: int = 3) -> DataFrame:
    """group, score: the mean over the first n rows of each group, an unjudged row counting as 0."""
    return cap_per_group(rows, group, order, n).groupBy(*group).agg(F.avg(F.coalesce(F.col(fidelity), F.lit(0.0))).alias("score"))


def cyclic(order: Column, choices: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(order, F.lit(len(choices))) + 1).cast("int"))
