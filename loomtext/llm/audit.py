"""Audit of how filters interact: signed parity sums, inverted exactly to counts of failure masks, tell every order of the filters."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialise, n_words, small

#: The filters of failure_masks(), in the order of their bits.
FILTERS = "ABCDE"
#: Rows of a broadcast at most: repeated texts' digests, labelled documents.
MOST_BROADCAST = 100_000
_SPLIT = r"[\x20\x09-\x0D]+"


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each row of docs (doc_id, text, source): bit k of the mask is set where the row fails FILTERS[k].

    A: under 200 words. B: fewer than half of the words distinct, case-sensitive. C: over 2 % of the code points in A to Z.
    D: holds one of # $ % & * |. E: the same text stands under a smaller doc_id anywhere in the table.

    Digests of texts are shuffled, never texts; the first ids of repeated texts are written before they are joined, so that a
    hot text can be split. A null text is the empty text and a null source the empty part; a null doc_id is smaller than none
    and never fails E; rows that repeat an id are judged each for itself; other columns play no part.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words, distinct = n_words(F.col("text")), F.size(F.array_remove(F.array_distinct(F.split("text", _SPLIT)), ""))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    measured = rows.select("doc_id", "part", words.alias("words"), distinct.alias("kinds"), capitals.alias("capitals"), F.length("text").alias("size"), F.col("text").rlike("[#$%&*|]").alias("marked"), F.unhex(F.sha2("text", 256)).alias("digest"))
    fails = (F.col("words") < 200, 100 * F.col("kinds") < 50 * F.col("words"), 100 * F.col("capitals").cast("long") > 2 * F.col("size"), F.col("marked"))
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))
    rows = materialise(measured.select("doc_id", "part", mask.alias("mask"), "digest"))
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    repeated = materialise(repeated.select("digest", "first"))
    late = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(fails))).otherwise(F.lit(0))
    return rows.join(small(repeated, MOST_BROADCAST), "digest", "left").select("doc_id", "part", (F.col("mask") + late).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """masks with a column `label`: 1 for a document of quality 1, plus 2 for a toxic one, else 0. Of several labels of an id any counts; ids without a label have 0."""
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, F.lit(bit)).otherwise(F.lit(0)))
    told = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((flag("quality", 1) + flag("toxic", 2)).alias("label"))
    told = materialise(told)
    return masks.join(small(told, MOST_BROADCAST), "doc_id", "left").select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"))


def _sign(x: Column) -> Column:
    return (1 - 2 * F.bit_count(x).bitwiseAND(F.lit(1))).cast("long")


def parity_sums(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, label and sums: element w is the sum over rows (part, mask, label) of -1 to the number of w's filters that a row fails."""
    return rows.groupBy("part", "label").agg(F.array(*(F.sum(_sign(F.col("mask").bitwiseAND(F.lit(w)))) for w in range(1 << len(filters)))).alias("sums"))


def mask_cells(sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, and cells with an entry (mask, n, good, toxic) for every mask in order, from parity sums.

    The Walsh-Hadamard transform is its own inverse but for the factor of its size, by which every signed total divides without rest.
    """
    size = 1 << len(filters)
    at = F.sequence(F.lit(0), F.lit(size - 1))
    total = lambda m: F.aggregate(at, F.lit(0).cast("long"), lambda acc, w: acc + _sign(m.bitwiseAND(w)) * F.col("sums")[w])
    counts = sums.select("part", "label", F.posexplode(F.transform(at, lambda m: F.shiftright(total(m), len(filters)))).alias("mask", "n"))
    having = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(F.lit(0)))
    by_mask = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), having(1).alias("good"), having(2).alias("toxic"))
    return by_mask.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # as many as masks


def evaluate_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the part's cells alone.

    Shapley's sum over all orders has a closed form: of a row that fails c filters, each of them is the first in one c-th of the orders.
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = cells.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(c)), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters)), F.lit(0))
    steps = steps.withColumn("own", bits(F.expr("substring(filter_order, step, 1)"))).withColumn("before", bits(F.expr("left(filter_order, step - 1)")))
    own, before = F.col("own"), F.col("before")
    fails, past = lambda c: c["mask"].bitwiseAND(own) != 0, lambda c: c["mask"].bitwiseAND(before) != 0

    def total(of, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(where(c), of(c)).otherwise(F.lit(0).cast("long")))

    n, removed = lambda c: c["n"], lambda c: fails(c) & ~past(c)
    share = lambda c: F.element_at(F.array(*(F.lit(factorial(len(filters)) // k).cast("long") for k in range(1, len(filters) + 1))), F.bit_count(c["mask"]))
    return steps.select(
        "part", "filter_order", "step",
        total(n, lambda c: ~fails(c) & ~past(c)).alias("kept"), total(n, removed).alias("removed"), total(n, lambda c: fails(c) & past(c)).alias("redundant"), total(n, lambda c: c["mask"] == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"), total(lambda c: c["toxic"], removed).alias("toxic_lost"), total(lambda c: c["n"] * share(c), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does in each of the orders in which the filters can be applied, for each part (source) of docs.

    Rows go once through failure_masks(); then a part is 32 signed sums for each of the four label classes, whatever its size, so
    that a part with a third of all rows is summed where its rows are. Returns part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley, zeros included; nothing for an empty table of documents.
    Labels of ids that docs lacks play no part; an empty table of labels gives no good and no toxic document.
    """
    return evaluate_orders(mask_cells(parity_sums(labelled(failure_masks(docs), labels))))
