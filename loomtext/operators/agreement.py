"""Agreement among the valid candidates of a passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import chrf, with_grams

# Limits of disagreement and of a valid candidate.
CONVERGENT, DIVERGENT, VALID_SEMANTIC = 0.3, 0.55, 0.5


def is_valid(gate: Column, semantic: Column) -> Column:
    return F.coalesce((gate == "PASS") & (semantic >= VALID_SEMANTIC), F.lit(False))


def verdict(disagreement: Column, n_valid: Column) -> Column:
    return F.when(n_valid < 2, "insufficient-candidates").when(disagreement < CONVERGENT, "convergent").when(disagreement < DIVERGENT, "mixed").otherwise("divergent-review")


def candidate_disagreement(df: DataFrame, group: str, item: str, text: str, valid: str) -> DataFrame:
    """group, n_valid, agreement, disagreement, verdict: one less the mean chrF of all pairs of valid candidates.

    Gram sets are built once for each text, before the pairs are joined within their passage. The pairs of a very large passage
    are split over tasks by adaptive execution: both sides of the join are dealt by the passage alone.
    """
    sets = with_grams(df.filter(valid), text, "g").select(group, item, "g_1", "g_2", "g_3")
    a = sets.select(group, F.col(item).alias("i"), *[F.col(f"g_{n}").alias(f"a_{n}") for n in (1, 2, 3)])
    b = sets.select(group, F.col(item).alias("j"), *[F.col(f"g_{n}").alias(f"b_{n}") for n in (1, 2, 3)])
    means = a.join(b, group).filter("i < j").select(group, chrf("a", "b").alias("c")).groupBy(group).agg(F.avg("c").alias("agree"))
    n = df.groupBy(group).agg(F.count_if(valid).alias("n_valid"))
    out = n.join(means, group, "left")
    agreement = F.round(F.coalesce("agree", F.lit(1.0)), 3)
    gap = F.round(1 - F.coalesce("agree", F.lit(1.0)), 3)
    return out.select(group, "n_valid", agreement.alias("agreement"), gap.alias("disagreement"), verdict(gap, F.col("n_valid")).alias("verdict"))
