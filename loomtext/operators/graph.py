"""Graphs of what must be done before what: reachability, cycles, levels and what blocks a node, by rounds of joins that are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.sources.scratch import written


def edges_of(nodes: DataFrame, name: str = "name", prereqs: str = "prereqs") -> DataFrame:
    """name and prereq: each distinct pair of a node and what it requires."""
    return nodes.select(F.col(name).alias("name"), F.explode(prereqs).alias("prereq")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """name and prereq: everything that a node requires, however indirectly; a node on a cycle requires itself.

    Each round joins the pairs that the last one found with all pairs known, which doubles the length of the paths that are
    covered, and keeps what is new. A cycle finds nothing new after its length and ends like any other path.
    """
    found = [written(edges.select("name", "prereq").distinct())]
    while not found[-1].isEmpty():
        known = reduce(DataFrame.unionByName, found)
        onward = known.select(F.col("name").alias("prereq"), F.col("prereq").alias("_far"))
        longer = found[-1].join(onward, "prereq").select("name", F.col("_far").alias("prereq")).distinct()
        found.append(written(longer.join(known, ["name", "prereq"], "left_anti")))
    return reduce(DataFrame.unionByName, found)


def levels(nodes: DataFrame, edges: DataFrame, name: str = "name") -> DataFrame:
    """name and level of the nodes that can be put in order: 0 without a prerequisite, else one more than the highest of them.

    Nodes on a cycle, and those that require one, have no row. Prerequisites that are no nodes play no part. A round goes on
    from the nodes that the last one placed: only what requires them is counted, and waits until all of its prerequisites are placed.
    """
    every = nodes.select(F.col(name).alias("name"))
    real = edges.join(every.select(F.col("name").alias("prereq")), "prereq", "left_semi")
    need = written(real.groupBy("name").agg(F.count("*").alias("need")))
    onward = written(real.join(need, "name").select("name", "prereq", "need"))
    placed = [written(every.join(need, "name", "left_anti").withColumn("level", F.lit(0)))]
    waiting = None
    while not placed[-1].isEmpty():
        hit = placed[-1].select(F.col("name").alias("prereq")).join(onward, "prereq").groupBy("name", "need").agg(F.count("*").alias("hits"))
        if waiting is not None:
            hit = waiting.unionByName(hit).groupBy("name", "need").agg(F.sum("hits").alias("hits"))
        hit = written(hit)
        waiting = hit.filter("hits < need")
        placed.append(hit.filter("hits = need").select("name", F.lit(len(placed)).alias("level")))
    return reduce(DataFrame.unionByName, placed)


def on_cycles(edges: DataFrame, ordered: DataFrame) -> DataFrame:
    """The names of the nodes that require themselves; ordered: levels(), none of whose nodes can be on a cycle."""
    rest = edges.join(ordered.select("name"), "name", "left_anti")
    return closure(rest).filter("name = prereq").select("name")


def blockers(nodes: DataFrame, edges: DataFrame, name: str = "name", status: str = "status") -> DataFrame:
    """name and blocker: all that is still to be done, however indirectly, before a node can be: prerequisites that are not DONE
    or do not exist, and theirs. What a DONE one required plays no part any more."""
    done = nodes.filter(F.col(status) == "DONE").select(F.col(name).alias("prereq")).distinct()
    return closure(edges.join(done, "prereq", "left_anti")).select("name", F.col("prereq").alias("blocker"))


def standing(nodes: DataFrame, order: str, name: str = "name", status: str = "status", prereqs: str = "prereqs") -> DataFrame:
    """nodes with ready, is_next, level (null on or behind a cycle), on_cycle and n_blockers. nodes is written first: it is read by every round."""
    from loomtext.operators.summaries import next_node, ready

    nodes = written(nodes)
    edges = written(edges_of(nodes, name, prereqs))
    ordered = written(levels(nodes, edges, name))
    cyclic = on_cycles(edges, ordered).withColumn("on_cycle", F.lit(True))
    blocked = blockers(nodes, edges, name, status).groupBy("name").agg(F.count("*").alias("n_blockers"))
    following = next_node(nodes, order).select(name).withColumn("is_next", F.lit(True))
    out = ready(nodes, name, prereqs, status).join(F.broadcast(following), name, "left")  # one row
    for side in (ordered, cyclic, blocked):
        out = out.join(side.withColumnRenamed("name", name), name, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({"is_next": flag("is_next"), "on_cycle": flag("on_cycle"), "n_blockers": F.coalesce("n_blockers", F.lit(0)).cast("long")})
