"""Rank agreement of metrics with a judge, and rankings from pairwise comparisons, by counts over sorted ranges instead of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators import ranges
from loomtext.sources.scratch import written


#: Points whose inversions a task counts at once.
BLOCK = 1 << 16


def pairs_within(df: DataFrame, group: list[str], item: str, columns: list[str]) -> DataFrame:
    """Each pair of items i < j of a passage once, with a_ and b_ columns: as many as a judge is asked about. Passages are the candidates of one text: tens of rows."""
    a = df.select(*group, F.col(item).alias("a_item"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(*group, F.col(item).alias("b_item"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, group).filter("a_item < b_item")


def greater_before(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place the weight of all earlier places with a greater value. Merges sorted halves bottom-up, all blocks of a width at once."""
    n, out = len(values), np.zeros(len(values), np.int64)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), values))] = np.arange(n)  # of equal values the earlier is the smaller: they never count
    at, width = np.arange(n), 1
    while width < n:
        block = at // (2 * width)
        order = at[np.argsort(block * n + rank[at], kind="stable")]
        left = (order // width) % 2 == 0
        mass = np.cumsum(np.where(left, weights[order], 0))
        block = order // (2 * width)
        last = np.searchsorted(block, block, side="right") - 1
        out[order] += np.where(left, 0, mass[last] - mass)
        at, width = order, 2 * width
    return out


def _counter(first: str, second: str):
    """Counts, for each group, the weighted inversions of the points of one block: `first` rises strictly while `second` falls strictly."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_g=pd.factorize(pdf["g"], sort=True)[0]).sort_values(["_g", first, second], ignore_index=True)
        w = pdf["w"].to_numpy(np.int64)
        found = greater_before(pdf.groupby(["_g", second]).ngroup().to_numpy(np.int64), w) * w
        return pd.DataFrame({"g": pdf["g"], "d": found}).groupby("g", as_index=False, sort=False)["d"].sum()

    return count


def inversions(points: DataFrame) -> DataFrame:
    """g, d: the weighted number of pairs of a group's points (g, x, y, w) of which one has the smaller x and the greater y.

    Points are numbered twice over the whole cluster: by x, and by y. Numbers are cut into blocks of BLOCK. A pair is counted in
    the block of x numbers that both share, or else in their block of y numbers, or else lies between blocks, where only
    blocks matter: these are points again, fewer by about the square of BLOCK over their number, and are counted the same way.
    So no pair is formed, every task has BLOCK points, however large one group is, and groups of few points share blocks.
    Numbers run through all groups, one after another in both orders, so that points of different groups are never inverted.
    """
    found = points.sparkSession.createDataFrame([], "g string, d long")
    while points.count() > BLOCK:
        # Ties fall in an order that makes no inversion: of equal x the smaller y first, of equal y the smaller number by x.
        cut = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
        placed = written(ranges.numbered(points, ["g", "x", "y"], name="nx"))
        placed = written(ranges.numbered(placed, ["g", "y", "nx"], name="ny").select("g", "nx", "ny", "w", cut("nx").alias("bx"), cut("ny").alias("by")))
        found = found.unionByName(placed.groupBy("bx").applyInPandas(_counter("nx", "ny"), "g string, d long"))
        spans = placed.groupBy("g").agg(F.min("bx").alias("low"), F.max("bx").alias("high")).filter("low < high").select("g")
        across = written(placed.join(F.broadcast(spans), "g", "left_semi"))  # groups that go on into a block are at most as many as blocks
        found = found.unionByName(across.groupBy("by").applyInPandas(_counter("bx", "ny"), "g string, d long"))
        points = written(across.groupBy("g", "bx", "by").agg(F.sum("w").alias("w")).select("g", F.col("bx").alias("x"), F.col("by").alias("y"), "w"))
    return found.unionByName(points.groupBy().applyInPandas(_counter("x", "y"), "g string, d long"))  # one block


def gamma(df: DataFrame, group: list[str], item: str, metrics: list[str], judge: str) -> DataFrame:
    """group, metric, n_pairs, gamma: concordant less discordant pairs over both; ties are ignored, no pair at all gives 0.

    Every passage has a row for every metric, also one of a single candidate. A row is an item, whatever its id. A null metric or
    judgment takes no part. Pairs are
    counted, never formed: of all pairs of a passage those tied in either are taken away by counts of equal values, and the
    discordant ones are the inversions of the order by the metric against that by the judge. A passage of any share of all
    rows, with a judge as fine as one likes, costs the same as many small ones.
    """
    stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    key = F.to_json(F.struct(*group, "metric"))
    long = df.select(*group, F.col(judge).cast("double").alias("y"), F.expr(f"stack({len(metrics)}, {stack}) AS (metric, x)")).withColumn("g", key)
    points = written(long.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("g", "x", "y").agg(F.count("*").alias("w")))
    # Of n rows, sums of squares tell the pairs that are tied: all pairs, less those tied in either, and back those tied in both.
    square = lambda c: F.col(c) * F.col(c)
    zero = F.lit(0).cast("long").alias("d")
    terms = points.groupBy("g").agg(F.sum("w").alias("t"), F.sum(square("w")).alias("q")).select("g", (square("t") + F.col("q")).alias("n2"), zero)
    for c in ("x", "y"):
        terms = terms.unionByName(points.groupBy("g", c).agg(F.sum("w").alias("t")).select("g", (-square("t")).alias("n2"), zero))
    terms = terms.unionByName(inversions(points).select("g", F.lit(0).cast("long").alias("n2"), "d"))
    signs = terms.groupBy("g").agg(F.shiftright(F.sum("n2"), 1).alias("n"), F.sum("d").alias("d")).select("g", "n", (F.col("n") - 2 * F.col("d")).alias("s"))
    every = df.select(*group).distinct().withColumn("metric", F.explode(F.array(*map(F.lit, metrics)))).withColumn("g", key)
    out = every.join(signs, "g", "left")
    return out.select(*group, "metric", F.coalesce("n", F.lit(0)).cast("long").alias("n_pairs"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("gamma"))


def best_metric(gammas: DataFrame, order: list[str], baseline: str) -> DataFrame:
    """The mean gamma of each metric over passages, the best one (the first in `order` of equals), and whether it beats the baseline."""
    means = gammas.groupBy("metric").agg(F.avg("gamma").alias("avg_gamma"), F.count("*").alias("n_passages"))
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("metric"))
    best = means.agg(F.max(F.struct(F.col("avg_gamma"), (-place).alias("p"), "metric")).alias("b"), F.max(F.when(F.col("metric") == baseline, F.col("avg_gamma"))).alias("base"))
    return means.crossJoin(F.broadcast(best)).select("metric", "n_passages", F.round("avg_gamma", 6).alias("avg_gamma"), (F.col("metric") == F.col("b.metric")).alias("is_best"), (F.col("b.avg_gamma") > F.col("base")).alias("claim"))


def points_won(pairs: DataFrame, group: list[str], item: str, verdict: Column) -> DataFrame:
    """Points of each item over judged pairs (a_item, b_item): 1 for a pair won, a half for a tie or an unread verdict; verdict says "A", "B" or anything else."""
    a = F.when(verdict == "A", 1.0).when(verdict == "B", 0.0).otherwise(0.5)
    both = pairs.select(*group, F.explode(F.array(F.struct(F.col("a_item").alias("item"), a.alias("p")), F.struct(F.col("b_item").alias("item"), (1 - a).alias("p")))).alias("x"))
    return both.groupBy(*group, F.col("x.item").alias(item)).agg(F.sum("x.p").alias("points"))


def normalised(points: DataFrame, group: list[str]) -> DataFrame:
    """Adds norm: points over the best of the passage, which is written before it is joined, so that a hot passage can be split."""
    best = written(points.groupBy(*group).agg(F.max("points").alias("_top")))
    share = F.round(F.col("points") / F.coalesce(F.nullif("_top", F.lit(0.0)), F.lit(1.0)), 3)
    return points.join(best, group).withColumn("norm", share).drop("_top")


def pairwise_wins(df: DataFrame, group: list[str], item: str, verdict: Column, columns: list[str]) -> DataFrame:
    """Of each item its points, and points over the passage's best, where a judge has a say on every pair of a passage.

    verdict: over the a_ and b_ columns, "A", "B" or anything else.
    """
    points = points_won(pairs_within(df, group, item, columns), group, item, verdict)
    every = df.select(*group, item).join(points, [*group, item], "left").withColumn("points", F.coalesce("points", F.lit(0.0)))
    return normalised(written(every), group)


def margin_wins(df: DataFrame, group: list[str], item: str, value: str, margin: float) -> DataFrame:
    """The same where an item wins a pair if its value less the margin is above the other's: counted over sorted ranges, without pairs.

    Each item stands in the order twice: with its value, and with its value less the margin. What stands before the lower one
    among the values it beats; whoever's lower one stands after its value beats it; the rest are ties. An item that occurs once in its
    passage has a row; a null value takes no part and has no row. Passages of any size, and values of any number of ties.
    """
    v = F.col("_v")
    values = written(df.select(*group, item, F.col(value).cast("double").alias("_v")).filter(v.isNotNull()))  # ranges are found by reading twice
    both = F.explode(F.array(F.struct((v - margin).alias("pos"), F.lit(0).alias("kind")), F.struct(v.alias("pos"), F.lit(1).alias("kind"))))
    rows = values.select(*group, item, both.alias("e")).select(*group, item, "e.pos", "e.kind")
    # At equal positions lowered ones come first: a value is no win over what it only equals after the margin.
    placed = ranges.running(ranges.laid_out(rows, [*group, "pos", "kind", item]), group, {"values": F.col("kind"), "lowered": 1 - F.col("kind")})
    # Of an item's pairs with the n others it wins `wins` and loses n + 1 less those counted at its value: ties are what is left, and n drops out.
    reached = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    points = placed.groupBy(*group, item).agg(((reached(0, "values") + reached(1, "lowered") - 1) / 2).alias("points"))
    return normalised(written(points), group)
