"""Hypotheses about families of errors: which to try after what a judge saw, and how their candidates do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import gates, lexicon, text

# Families of errors with the hint that each known hypothesis gives.
KNOWN = {
    "compound semantic loss": "Decompose every compound into its members before translating; preserve each member's meaning.",
    "case-role inversion": "Carefully track the grammatical case/role of each noun; preserve subject-object structure.",
    "negation loss": "Check for negation markers; make sure the negation is preserved in English.",
    "implicit subject": "Identify the implicit subject from verb agreement; make it explicit in English.",
    "technical-term substitution": "Use the canonical glossary; keep technical terms (jñāna, māyā, ātman) consistent.",
    "scope loss": "Preserve quantifier scope and universal/all claims exactly.",
    "metaphor literalisation": "Recognize figurative language; render metaphor as metaphor, not literal prose.",
    "dropped pāda": "Translate every clause/pāda; ensure full verse coverage.",
}
# The hypothesis where no known family was seen, and the hint of one for what is new; what a low row is.
GENERAL, GENERAL_HINT, NOVEL_HINT = "general care", "Translate carefully, verbatim meaning.", "Attend to the specific issue the judge flagged."
LEAST_FIDELITY, LEAST_CHRF = 0.7, 0.55
# The label of what no known family explains; characters that are kept of a judgment.
NOVEL, SNIPPET, NOVEL_SNIPPET = "novel", 80, 120


def low_rows(rows: DataFrame, fidelity: str, chrf: str, judgment: str) -> DataFrame:
    """Rows that a judge or the metric finds low and about which a judgment says something, with its family."""
    low = (F.col(fidelity) < LEAST_FIDELITY) | (F.col(chrf) < LEAST_CHRF)
    said = (F.coalesce(judgment, F.lit("")) != "") & ~F.col(judgment).startswith("__")
    return rows.filter(low & said).withColumn("family", lexicon.error_family(F.col(judgment)))


def observations(low: DataFrame, judgment: str, order: str) -> DataFrame:
    """kind, family, snippet and order: what was seen of each known family, and, as kind novel, of none, shortened, a row for each.

    A family's observations stay rows, in the order of `order`: a family that a third of all rows belong to is no list.
    """
    novel = F.col("family") == NOVEL
    snippet = F.when(novel, F.substring(judgment, 1, NOVEL_SNIPPET)).otherwise(F.substring(judgment, 1, SNIPPET))
    return low.select(F.when(novel, NOVEL).otherwise("family").alias("kind"), F.when(~novel, F.col("family")).alias("family"), snippet.alias("snippet"), order)


def latest_rows(experiments: DataFrame, order: str, rows: str = "rows") -> DataFrame:
    """The rows of the last experiment: what the next hypotheses are proposed from."""
    return experiments.orderBy(F.desc(order)).limit(1).select(F.explode(rows).alias("_r")).select("_r.*")


def proposed(low: DataFrame, judgment: str, order: str) -> DataFrame:
    """ord, family, hint: known hypotheses of a family that was seen, else general care, and one for the first new judgment."""
    spark = low.sparkSession
    known = spark.createDataFrame([(k, f, h) for k, (f, h) in enumerate(KNOWN.items())], "ord int, family string, hint string")
    seen = known.join(low.select("family").distinct(), "family", "left_semi").select("ord", "family", "hint")
    general = spark.createDataFrame([(len(KNOWN), GENERAL, GENERAL_HINT)], seen.schema).join(F.broadcast(seen.limit(1).select(F.lit(True).alias("any"))), how="left").filter("any IS NULL").drop("any")
    first = low.filter("family = 'novel'").agg(F.min_by(judgment, order).alias("j")).filter("j IS NOT NULL")
    novel = first.select(F.lit(len(KNOWN) + 1).alias("ord"), F.concat(F.lit("novel: "), F.substring("j", 1, 40)).alias("family"), F.lit(NOVEL_HINT).alias("hint"))
    return seen.unionByName(general).unionByName(novel)


def trials(hypotheses: DataFrame, golds: DataFrame) -> DataFrame:
    """Every hypothesis with every gold row; hypotheses are ten rows at most and are broadcast."""
    return golds.crossJoin(F.broadcast(hypotheses))


def outcomes(tried: DataFrame) -> DataFrame:
    """Of each trial (source, gold, candidate, ..) the first 60 characters of the hint, 200 of the candidate, both metrics and the gate."""
    m = text.with_metrics(tried, "gold", "candidate")
    m = m.withColumn("proof_blocking", gates.blocking(F.col("source"), F.col("candidate"))).withColumn("proof_gate", gates.gate(F.col("proof_blocking")))
    return m.withColumn("hint", F.substring("hint", 1, 60)).withColumn("candidate", F.substring("candidate", 1, 200))


def best_of_round(results: DataFrame, group: list[str]) -> DataFrame:
    """The family with the largest mean chrF of each round, the first tried of equals, and whether it beats all rounds before."""
    means = results.groupBy(*group, "family", "ord").agg(F.avg("chrf").alias("score"))
    best = means.groupBy(*group).agg(F.max_by(F.struct("family", "score"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b")).select(*group, "b.family", "b.score")
    before = F.max("score").over(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1))  # a row a round
    return best.withColumn("before", before).withColumn("kept", F.col("before").isNull() | (F.col("score") > F.col("before"))).drop("before")
