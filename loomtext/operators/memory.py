"""A memory of facts as an append-only table of events: what held when, how it came about, and how far two states lie apart.

Events: key, seq (grows with time, a number of its own for each event), value (null: the key is forgotten), metric, cause
(the seq of the event that led to it, or null), and any further columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import ranges
from loomtext.sources.scratch import written

#: Quantiles by which the metrics of two states are compared, and the accuracy of their sketch.
QUANTILES, ACCURACY = tuple(k / 32 for k in range(1, 32)), 10_000


def facts(events: DataFrame) -> DataFrame:
    """events with until: the seq from which on the key's next event holds instead; null for what still holds.

    Events are laid out by key and seq over sorted ranges, so that a key with any share of all events is no single task's.
    """
    laid = ranges.laid_out(events, ["key", "seq"])
    return ranges.following(laid, ["key"], "seq", "until").drop("_part", "_at")


def as_of(facts_: DataFrame, seq: int | Column) -> DataFrame:
    """The state after the event of that seq: at most one fact for each key, none for a key that was forgotten."""
    return facts_.filter((F.col("seq") <= seq) & (F.col("until").isNull() | (F.col("until") > seq)) & F.col("value").isNotNull())


def search(events: DataFrame, query: str) -> DataFrame:
    """Events whose key or value holds a text, whatever its case."""
    return events.filter(F.lower(F.concat_ws(" ", "key", "value")).contains(query.lower()))


def history(facts_: DataFrame, key: str) -> DataFrame:
    """All that held of a key, in order."""
    return facts_.filter(F.col("key") == key).orderBy("seq")


def trace(events: DataFrame, starts: DataFrame) -> DataFrame:
    """start, depth and the event for each event of a chain of causes: from each start (seq) up to what nothing led to.

    A round joins the causes that the last one named, until none is left; a chain that comes back to an event it holds stops there.
    """
    links = written(events)
    frontier = written(starts.select(F.col("seq").alias("start"), "seq").join(links, "seq").select("start", F.lit(0).alias("depth"), *links.columns))
    found = [frontier]
    while not found[-1].isEmpty():
        up = found[-1].filter("cause IS NOT NULL").select("start", F.col("depth") + 1, "cause").toDF("start", "depth", "seq")
        seen = reduce(DataFrame.unionByName, found).select("start", "seq")
        found.append(written(up.join(seen, ["start", "seq"], "left_anti").join(links, "seq").select("start", "depth", *links.columns)))
    return reduce(DataFrame.unionByName, found)


def drift(facts_: DataFrame, one: int, two: int) -> DataFrame:
    """One row on two states of a memory: same, changed, added and lost keys, the share of keys that differ, and distance, the
    mean difference of the quantiles of their metrics, from sketches that are merged across tasks; null where a state has no metric."""
    side = lambda seq, x: as_of(facts_, seq).select("key", F.col("value").alias(f"v{x}"), F.col("metric").alias(f"m{x}"), F.lit(True).alias(f"in{x}"))
    both = side(one, 1).join(side(two, 2), "key", "full")
    there, then = F.col("in1").isNotNull(), F.col("in2").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    sketch = lambda x: F.percentile_approx(f"m{x}", list(QUANTILES), ACCURACY).alias(f"q{x}")
    out = both.agg(n(there & then & (F.col("v1") == F.col("v2")), "same"), n(there & then & (F.col("v1") != F.col("v2")), "changed"), n(~there, "added"), n(~then, "lost"), sketch(1), sketch(2))
    apart = F.aggregate(F.zip_with("q1", "q2", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, d: acc + d) / len(QUANTILES)
    total = F.col("same") + F.col("changed") + F.col("added") + F.col("lost")
    return out.select("same", "changed", "added", "lost", ((total - F.col("same")) / F.nullif(total, F.lit(0))).alias("share"), apart.alias("distance"))
