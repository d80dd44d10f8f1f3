"""Search of strategies by a computed score: a tree for each search, of any number of searches at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.select import strategy_score

# The base strategy's hint, and the strategies that nodes are expanded by, in order, with theirs.
BASE_HINT = "Translate faithfully, preserving meaning."
MUTATIONS = {
    "compound": "Decompose every compound into its members before translating.",
    "case": "Track the grammatical case/role of each noun carefully.",
    "terms": "Keep technical terms transliterated and consistent with the glossary.",
    "negation": "Check negation markers and preserve them in English.",
    "plain": "Render into clear, plain modern English.",
    "precise": "Translate with scholarly precision.",
}
#: The number of the base strategy; the others count from 0.
BASE = -1


def hint_of(strategy: Column) -> Column:
    hints = F.create_map(*[F.lit(x) for k, h in enumerate([BASE_HINT, *MUTATIONS.values()], BASE) for x in (k, h)])
    return hints[strategy]


def scored_strategies(rows: DataFrame, search: list[str], strategy: str, order: list, fidelity: str, n: int = 3) -> DataFrame:
    """search, strategy, score: each strategy's mean fidelity over the first n rows on which the search tried it."""
    return strategy_score(rows, [*search, strategy], order, fidelity, n)


def tree_search(scores: DataFrame, search: list[str], depth: int = 2, fanout: int = 2, strategies: int = len(MUTATIONS)) -> DataFrame:
    """The nodes of each search's tree: search, path, parent, depth, strategy, score, kept.

    scores: search, strategy, score, a row for each strategy that was tried; BASE is the root's. At depth d, from 1 on, the i-th
    child of a node tries strategy (d * fanout + i) modulo strategies, whatever its parent's, and has that strategy's own
    score, 0 if it was not tried. The best `fanout` children of a depth are kept and expanded; of equal ones those that
    were expanded first. A path holds the places of a node and those above it among their parents' children, so that paths in
    order are the tree in pre-order.

    A search is one row until its nodes are told: its scores are gathered (as many as strategies), and every depth is an
    expression over its frontier. So all searches cost one shuffle together, and none is held by the driver.
    """
    entry = F.struct(F.col("strategy").cast("int"), F.col("score").cast("double"))
    state = scores.groupBy(*search).agg(F.map_from_entries(F.collect_list(entry)).alias("_known"))
    score = lambda s: F.coalesce(F.try_element_at("_known", s), F.lit(0.0))

    def node(path: Column, parent: Column, at: int, strategy: Column, place: Column) -> Column:
        return F.struct(path.alias("path"), parent.alias("parent"), F.lit(at).alias("depth"), strategy.alias("strategy"), score(strategy).alias("score"), place.alias("place"))

    nowhere = F.lit(None).cast("array<int>")
    state = state.withColumn("_kept0", F.array(node(F.array().cast("array<int>"), nowhere, 0, F.lit(BASE), F.lit(0))))
    state = state.withColumn("_nodes0", F.col("_kept0"))
    for d in range(1, depth + 1):
        child = lambda x, k: lambda i: node(F.concat(x["path"], F.array(i)), x["path"], d, F.pmod(i + d * fanout, F.lit(strategies)), k * fanout + i)  # noqa: B023, E731
        places = F.sequence(F.lit(0), F.lit(fanout - 1))
        state = state.withColumn(f"_nodes{d}", F.flatten(F.transform(f"_kept{d - 1}", lambda x, k: F.transform(places, child(x, k)))))  # noqa: B023
        ranked = F.array_sort(F.transform(f"_nodes{d}", lambda x: F.struct((-x["score"]).alias("s"), x["place"].alias("p"), x.alias("x"))))
        state = state.withColumn(f"_kept{d}", F.slice(F.transform(ranked, lambda r: r["x"]), 1, fanout))
    told = lambda d: F.transform(f"_nodes{d}", lambda x: F.struct(x.alias("x"), F.exists(f"_kept{d}", lambda y: y["place"] == x["place"]).alias("kept")))
    nodes = state.select(*search, F.explode(F.concat(*map(told, range(depth + 1)))).alias("n"))
    return nodes.select(*search, *(f"n.x.{c}" for c in ("path", "parent", "depth", "strategy", "score")), "n.kept")


def best_node(nodes: DataFrame, search: list[str]) -> DataFrame:
    """Each search's first node, in pre-order, of the largest score, with the root's score and whether the search improved on it."""
    best = F.min_by(F.struct("path", "strategy", "score"), F.struct((-F.col("score")).alias("s"), "path"))
    out = nodes.groupBy(*search).agg(best.alias("b"), F.max(F.when(F.col("depth") == 0, F.col("score"))).alias("root_score"))
    out = out.select(*search, F.col("b.path").alias("path"), F.col("b.strategy").alias("strategy"), "root_score", F.col("b.score").alias("best_score"))
    return out.withColumn("hint", hint_of(F.col("strategy"))).withColumn("improved", F.col("best_score") > F.col("root_score"))
