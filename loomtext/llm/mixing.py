"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import checkpoint, materialise, n_words, plain_names, small

#: Ranks are logarithms of odds; they are first counted in so many bins a unit, up to FAR, so that only the rows of the bin at the cut are
#: ordered, and at most about 1 in 8,000 of a source's rows fall into one bin, whatever its probabilities.
BINS, WIDE, FAR, CERTAIN = 2048, 256, 64, -1e9
#: A table of sources up to so many rows is broadcast (a few MB); a longer one is joined by a shuffle.
MOST_SOURCES = 50_000
_LEAST = -(2**63)


def _targets(totals: DataFrame, weights: tuple[float, ...], share: float, most_copies: float) -> DataFrame:
    """Adds target: share of all words by weight, at most most_copies times the source's words, the excess shared by weight.

    Sources reach their caps in the order of cap / weight; those before a source in that order are capped if it is, so
    running sums tell which are capped, and the others share what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", w).withColumn("cap", most_copies * F.col("source_size")).withColumn("due", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, on = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("left", F.col("due") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))).withColumn("heavy", F.sum("weight").over(on))
    t = t.withColumn("capped", F.col("cap") * F.col("heavy") <= F.col("left") * F.col("weight"))
    everything = Window.partitionBy()
    rest = F.col("due") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    level = rest / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))).select("source", "source_size", "n_docs", "target")


def _weight(size: Column) -> Column:
    """What a document's wish to be included grows with: about the square root of its size, equal for sizes of an eighth of a doubling."""
    return F.pow(F.lit(2.0), F.floor(F.log2(size + 1) * 8) / 16)


def _scales(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """source and scale: inclusion probabilities are least(1, scale * weight), and the words expected of them are what is left to take.

    Documents whose probability would pass 1 are certain; the largest weights are reached first, so running sums over the few
    weights of a source tell which, and the others share what is left.
    """
    by_weight = sized.groupBy("source", _weight(F.col("size")).alias("weight")).agg(F.sum("size").alias("words"))
    w = by_weight.alias("w").join(small(plan, MOST_SOURCES).alias("p"), F.expr("w.source <=> p.source")).select("w.*", "p.rest")
    down = Window.partitionBy("source").orderBy(F.desc("weight"))  # some hundreds of rows at most
    before, on = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("heavy", F.sum(F.col("words") * F.col("weight")).over(on))
    certain = F.col("left") * F.col("weight") >= F.col("heavy")
    sums = w.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(certain, F.col("words"))), F.lit(0))).alias("left"), F.sum(F.when(~certain, F.col("words") * F.col("weight"))).alias("heavy"))
    return sums.select("source", F.coalesce(F.greatest(F.col("left"), F.lit(0.0)) / F.nullif("heavy", F.lit(0.0)), F.lit(0.0)).alias("scale"))


def _inclusion(size: Column, scale: Column) -> Column:
    return F.least(F.lit(1.0), scale * _weight(size))


def _rank(size: Column, scale: Column, doc_id: Column, mark: Column, seed: int) -> Column:
    """The logarithm of random odds over inclusion odds; certain documents come before all others, impossible ones after."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id, size, mark), F.lit(2**52)) + 0.5) / float(2**52)
    p = _inclusion(size, scale)
    return F.when(p >= 1, CERTAIN).when(p <= 0, -CERTAIN).otherwise(F.ln(u / (1 - u)) - F.ln(p / (1 - p)))


def _plan(sized: DataFrame, weights, share, most_copies, seed) -> DataFrame:
    """A row for each source: whole copies of all, and the rank, id and row up to which one more is taken."""
    totals = checkpoint(_targets(checkpoint(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))), weights, share, most_copies))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = totals.withColumn("whole", times).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    scales = _scales(sized, plan).alias("s")
    plan = checkpoint(plan.alias("p").join(scales, F.expr("p.source <=> s.source")).select("p.*", "s.scale"))
    joined = small(plan, MOST_SOURCES).alias("p")
    rank = _rank(F.col("d.size"), F.col("p.scale"), F.col("d.doc_id"), F.col("d.mark"), seed)
    ranked = sized.alias("d").join(joined, F.expr("d.source <=> p.source")).select("d.*", "p.rest", rank.alias("rank"))
    near = F.greatest(F.lit(float(-FAR)), F.least(F.lit(float(FAR)), F.col("rank")))
    ranked = ranked.withColumn("bin", F.when(F.col("rank") == CERTAIN, -(FAR + 1) * BINS).otherwise(F.floor(near * BINS)).cast("int"))
    bins = checkpoint(ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
    # The bin at the cut by prefix sums over wide bins, then over the bins in that one: some hundreds of rows for a source each.
    wide = bins.groupBy("source", F.floor(F.col("bin") / WIDE).alias("wide")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest")).withColumn("begin", F.lit(0))
    wide = checkpoint(_cut(wide, "wide").select("source", "wide", F.col("before").alias("begin")))
    inner = bins.alias("b").join(small(wide, MOST_SOURCES).alias("w"), F.expr(f"b.source <=> w.source AND floor(b.bin / {WIDE}) = w.wide")).select("b.*", "w.begin")
    cut = checkpoint(_cut(inner, "bin").select("source", "bin", "before", F.col("rest").alias("goal")))
    edge = ranked.alias("r").join(small(cut, MOST_SOURCES).alias("c"), F.expr("r.source <=> c.source AND r.bin = c.bin")).select("r.source", _key(F.col("r.rank"), F.col("r.doc_id"), F.col("r.row")).alias("key"), "r.size", "c.before", "c.goal", "c.bin")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = (
        edge.withColumn("run", run)
        .filter(F.col("before") + F.col("run") - F.col("size") / 2 <= F.col("goal"))  # a document enters if that brings the sum nearer
        .groupBy("source")
        .agg(F.max("key").alias("last"), F.max("run").alias("run"))
    )
    ends = cut.alias("c").join(last.alias("l"), F.expr("c.source <=> l.source"), "left")
    whole_bins = _key(F.col("c.bin") / BINS, F.lit(None).cast("long"), F.lit(_LEAST))  # none of the cut bin enters
    ends = ends.select("c.source", F.coalesce("l.last", whole_bins).alias("last"), (F.col("c.goal") - F.col("c.before") - F.coalesce("l.run", F.lit(0))).alias("gap"))
    ends = checkpoint(ends)
    swaps = checkpoint(_exchange(ranked, ends))
    ends = ends.alias("e").join(swaps.alias("w"), F.expr("e.source <=> w.source"), "left").select("e.source", "e.last", "w.swap")
    out = plan.alias("p").join(small(ends, MOST_SOURCES).alias("e"), F.expr("p.source <=> e.source"), "left")
    out = out.select("p.source", "p.source_size", "p.target", "p.scale", "p.whole", "e.last", "e.swap", (F.col("p.rest") > 0).alias("more"))
    return checkpoint(out)


def _exchange(ranked: DataFrame, ends: DataFrame) -> DataFrame:
    """source and swap: the one document of each source whose entering or leaving brings the words taken nearest to the rest, of
    equals the nearest to the cut; none where no document brings them nearer. Certain documents stay. An aggregate: nothing is sorted."""
    d = ranked.filter(f"size > 0 AND abs(rank) < {-CERTAIN}").alias("d").join(small(ends, MOST_SOURCES).alias("e"), F.expr("d.source <=> e.source"))
    key = _key(F.col("d.rank"), F.col("d.doc_id"), F.col("d.row"))
    left = F.abs(F.col("e.gap") - F.when(key <= F.col("e.last"), -F.col("d.size")).otherwise(F.col("d.size")))
    choice = F.struct(left.alias("left"), F.abs(F.col("d.rank") - F.col("e.last.rank")).alias("far"), key.alias("key"))
    return d.filter(left < F.abs(F.col("e.gap"))).groupBy("d.source").agg(F.min(choice).alias("best")).select("source", F.col("best.key").alias("swap"))


def _cut(bins: DataFrame, order: str) -> DataFrame:
    """The bin of each source in which the words from `begin` on reach the rest, and the words before it."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("upto", F.col("begin") + upto).withColumn("before", F.col("upto") - F.col("words"))
    return bins.filter((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest")))


def _key(rank: Column, doc_id: Column, row: Column) -> Column:
    return F.struct(rank.cast("double").alias("rank"), F.coalesce(doc_id, F.lit(_LEAST)).alias("id"), row.cast("long").alias("row"))


def _copies(last: Column, swap: Column, more: Column, whole: Column, key: Column) -> Column:
    enters = (key <= last) != F.coalesce(key == swap, F.lit(False))
    return (whole + F.when(more & last.isNotNull() & enters, 1).otherwise(0)).cast("int")


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mark (a hash of the text) and row, a number of each row's own in the scan of the table."""
    rows = docs.withColumn("__loom_row", F.monotonically_increasing_id())
    return materialise(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), F.col("__loom_row").alias("row")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_copies: float = 2.0, seed: int = 7) -> DataFrame:
    """How many words of each document a mix of the sources to target weights takes.

    Sources, by code point with null last, weigh weights in turn and share `share` times all words; a source's target stops
    at most_copies times its words and the excess goes to the others by weight. A source whose target is r times its words
    takes floor(r) whole copies of each document; the rest is a Pareto order sample of unequal inclusion probabilities: these
    grow with about the square root of the length, documents that would pass 1 are certain, and the words expected of them
    are the rest. Documents are ranked by random odds over inclusion odds and enter until their words come nearest to the rest;
    then one document of each source enters or leaves, if that brings them nearer still.
    Only the few rows of one rank bin in each source are ever sorted, so a source with a third of all rows is no burden.

    A null text or one without words has size 0 and takes 0 words; a null source is a source; rows that repeat an id rank
    each for itself, equal rows by their place in the table, of which it doesn't matter which enters; an empty table gives an
    empty result; other columns play no part. Equal input and seed give equal results.
    Returns doc_id, size, source_size, target, taken, copies, source, inclusion (the probability that one more copy is taken).
    """
    sized = _sized(docs)
    plan = _plan(sized, weights, share, most_copies, seed)
    d = sized.alias("d").join(small(plan, MOST_SOURCES).alias("p"), F.expr("d.source <=> p.source"))
    rank = _rank(F.col("d.size"), F.col("p.scale"), F.col("d.doc_id"), F.col("d.mark"), seed)
    d = d.withColumn("copies", _copies(F.col("p.last"), F.col("p.swap"), F.col("p.more"), F.col("p.whole"), _key(rank, F.col("d.doc_id"), F.col("d.row"))))
    return d.select("d.doc_id", "d.size", F.col("p.source_size").cast("long").alias("source_size"), F.col("p.target").cast("double").alias("target"), (F.col("d.size") * F.col("copies")).cast("long").alias("taken"), "copies", "d.source", _inclusion(F.col("d.size"), F.col("p.scale")).alias("inclusion"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_copies: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it. Texts are not shuffled while the sources fit a broadcast.

    docs is read twice, and equal rows are told apart by their place in it: a table scan, which gives them the same places again.
    """
    names, docs = docs.columns, plain_names(docs, "doc_id", "text", "source")
    plan = _plan(_sized(docs), weights, share, most_copies, seed)
    d = docs.withColumn("row", F.monotonically_increasing_id()).alias("d").join(small(plan, MOST_SOURCES).alias("p"), F.expr("d.source <=> p.source"))
    doc_id = F.col("d.doc_id").cast("long")
    rank = _rank(n_words(F.col("d.text")), F.col("p.scale"), doc_id, F.xxhash64("d.text"), seed)
    d = d.withColumn("copies", _copies(F.col("p.last"), F.col("p.swap"), F.col("p.more"), F.col("p.whole"), _key(rank, doc_id, F.col("d.row")))).filter("copies > 0")
    return d.select(*[F.col(f"d.{c}") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy").toDF(*names)
