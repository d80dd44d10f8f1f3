"""Summaries: experiments, costs, leaderboards, checkpoints, ledgers, challenge rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import ranges
from loomtext.sources.scratch import written

# Prices a token times these give a text's cost; families that count for the challenge rate; its least value.
PROMPT_TOKENS, COMPLETION_TOKENS, LEAST_PASS_RATE, NOT_SEMANTIC = 15_000, 5_000, 0.9, "STYLE"


def experiment_summary(rows: DataFrame, by: list[str], gate: str, chrf: str, bleu: str, semantic: str, latency: str) -> DataFrame:
    """Mean scores (the semantic one over judged rows, null if none), the share of passed gates of all rows, and total time."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(chrf), 4).alias("avg_chrf"),
        F.round(F.avg(bleu), 4).alias("avg_bleu1"),
        F.round(F.avg(semantic), 3).alias("avg_semantic"),
        F.round(F.avg(F.when(F.col(semantic) > 0, F.col(semantic))), 3).alias("avg_semantic_nonzero"),
        F.round(F.avg(F.when(F.col(gate) == "PASS", 1.0).otherwise(0.0)), 3).alias("proof_pass_rate"),
        F.round(F.sum(latency), 1).alias("total_time"),
    )


def counts_with_zeros(rows: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """A count for every label of a list, also of those that no row has."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], f"{label} string")
    return every.join(rows.groupBy(label).agg(F.count("*").alias("c")), label, "left").select(label, F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def challenge_rates(rows: DataFrame, family: str, passed: str) -> DataFrame:
    """Pass rate of each family and, as ALL, over all semantic ones, with whether it reaches the least rate. One pass, by rollup."""
    semantic = F.col(family) != NOT_SEMANTIC
    out = rows.rollup(family).agg(
        F.grouping(family).alias("g"), F.count("*").alias("c"), F.count_if(passed).alias("p"), F.count_if(semantic).alias("cs"), F.count_if(semantic & F.col(passed)).alias("ps")
    )
    total, good = F.when(F.col("g") == 1, F.col("cs")).otherwise(F.col("c")), F.when(F.col("g") == 1, F.col("ps")).otherwise(F.col("p"))
    rate = F.round(good / total, 4)
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(family)).alias(family), total.alias("total"), good.alias("passed"), rate.alias("rate"), (rate >= LEAST_PASS_RATE).alias("reached"))


#: Characters of the pieces by which ids that contain a text are found.
GRAM = 3


def _grams(text: Column, n: Column | int) -> Column:
    """The distinct pieces of n characters of a text of at least so many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def first_containing(needles: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """p1, p2 and the first id, by order, that contains both: by an inverted index of the ids' pieces instead of a product.

    Of all pieces of a needle the one that the fewest ids have is looked up, and what it finds is compared. Pieces have GRAM
    characters, or as many as a shorter text has. Both texts empty: every id contains them.
    """
    needles = written(needles.select("p1", "p2").distinct())
    of = lambda c: F.when(F.length(c) > 0, _grams(F.col(c), F.least(F.length(c), F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    probes = written(needles.select("p1", "p2", F.explode(F.array_union(of("p1"), of("p2"))).alias("gram")))
    listed = ids.select(key, order, F.explode(F.concat(*(F.when(F.length(key) >= k, _grams(F.col(key), k)).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1)))).alias("gram"))
    index = written(listed.join(probes.select("gram").distinct(), "gram", "left_semi"))
    sizes = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = probes.join(sizes, "gram", "left").groupBy("p1", "p2").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    found = written(rarest).join(index, "gram").filter(F.col(key).contains(F.col("p1")) & F.col(key).contains(F.col("p2")))
    first = F.min_by(key, order).alias(key)
    any_id = needles.filter("p1 = '' AND p2 = ''").join(F.broadcast(ids.filter(F.col(key).isNotNull()).agg(first)))  # one row
    return found.groupBy("p1", "p2").agg(first).unionByName(any_id.filter(F.col(key).isNotNull()))


def price_lookup(usage: DataFrame, model: str, prices: DataFrame, price_id: str, order: str) -> DataFrame:
    """Each distinct model with its price: of the equal id, else of its last path segment, else of the first id that contains its first two parts.

    Of rows that repeat an id the last has the price, and the first gives the id its place. The catalogue is joined by key; only
    the distinct first two parts of models that no key finds are looked up in an inverted index, and none is held against every id.
    """
    fields = [c for c in prices.columns if c not in (price_id, order)]
    p = written(prices.filter(F.col(price_id).isNotNull()).groupBy(price_id).agg(F.max_by(F.struct(*fields), order).alias("p"), F.min(order).alias(order)).select(price_id, order, "p.*"))
    m = usage.select(model).distinct().withColumn("last", F.element_at(F.split(model, "/"), -1))
    parts = F.split("last", "-")
    m = written(m.withColumn("p1", F.get(parts, F.lit(0))).withColumn("p2", F.get(parts, F.lit(1))))
    exact = m.join(p, F.col(model) == F.col(price_id)).withColumn("level", F.lit(1))
    by_last = m.join(p, F.col("last") == F.col(price_id)).withColumn("level", F.lit(2))
    row = F.struct(price_id, "level", *fields)
    keyed = written(exact.unionByName(by_last).groupBy(model).agg(F.min_by(row, "level").alias("b")))
    rest = m.filter("p2 IS NOT NULL").join(keyed, model, "left_anti")
    loose = rest.join(first_containing(rest, p, price_id, order), ["p1", "p2"]).join(p, price_id).withColumn("level", F.lit(3)).select(model, row.alias("b"))
    best = keyed.unionByName(loose)
    return m.select(model).join(best, model, "left").select(model, f"b.{price_id}", F.col("b.level").alias("match_level"), *[f"b.{c}" for c in fields])


def with_cost(df: DataFrame, prompt_price: str, completion_price: str, quality: str) -> DataFrame:
    """Cost of a text and of 1,000, and quality per cost of 1,000 where both are there and not 0."""
    cost = F.col(prompt_price) * PROMPT_TOKENS + F.col(completion_price) * COMPLETION_TOKENS
    df = df.withColumn("cost", F.round(cost, 6)).withColumn("cost_per_1000", F.round(cost * 1000, 3))
    both = (F.col(quality) != 0) & (F.col("cost_per_1000") != 0)
    return df.withColumn("quality_per_cost", F.when(both, F.round(F.col(quality) / F.greatest(F.col("cost_per_1000"), F.lit(1e-9)), 6)))


def ready(nodes: DataFrame, name: str = "name", prereqs: str = "prereqs", status: str = "status") -> DataFrame:
    """Adds ready: whether each prerequisite exists and is DONE; a node without any is ready."""
    edges = nodes.select(F.col(name).alias("_n"), F.explode(prereqs).alias("_p"))
    done = nodes.filter(F.col(status) == "DONE").select(F.col(name).alias("_p")).distinct()
    unmet = edges.join(done, "_p", "left_anti").select(F.col("_n").alias(name)).distinct().withColumn("_unmet", F.lit(True))
    return nodes.join(unmet, name, "left").withColumn("ready", F.col("_unmet").isNull()).drop("_unmet")


def next_node(nodes: DataFrame, order: str) -> DataFrame:
    """The first node that is ready and not DONE."""
    return ready(nodes).filter("ready AND status <> 'DONE'").orderBy(order).limit(1)


def missing_files(manifest: DataFrame, key: str, files: DataFrame, path: str) -> DataFrame:
    return manifest.join(files.select(F.col(path).alias(key)), key, "left_anti")


def path_tokens(text: Column, roots: list[str]) -> Column:
    """Paths under the given roots in a text: without closing punctuation, distinct and sorted."""
    found = F.regexp_extract_all(text, F.lit(r"((?:" + "|".join(roots) + r")/[\w./-]+)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"[.,;:)/-]+$", ""))))


def level_split(defended: Column, levels: list[str]) -> tuple[Column, Column]:
    """The levels of a fixed list that are declared, and the others."""
    every = F.array(*[F.lit(x) for x in levels])
    return F.filter(every, lambda x: F.array_contains(defended, x)), F.array_except(every, defended)


def _lacking(required: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required), F.lit(False))


def registry_audit(runs: DataFrame, required: list[str], key: str) -> DataFrame:
    """How many records there are, how many have, and lack, the required fields, and `missing`: incomplete_records() in order, between commas.

    The keys are sorted over range partitions and joined there; one task joins what the partitions give, which is the value itself. It is null without such a record.
    """
    bad = _lacking(required)
    counts = runs.agg(F.count("*").alias("n"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"))
    ranged = ranges.laid_out(incomplete_records(runs, required, key), ["missing"])
    in_order = lambda by, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda r: r[what]), ",")
    joined = ranged.groupBy("_part").agg(in_order("_at", "missing").alias("some")).agg(F.count("*").alias("parts"), in_order("_part", "some").alias("missing"))
    return counts.crossJoin(joined.select(F.when(F.col("parts") > 0, F.col("missing")).alias("missing")))


def incomplete_records(runs: DataFrame, required: list[str], key: str) -> DataFrame:
    """missing: the first 12 characters of the key of each record that lacks a required field, once."""
    return runs.filter(_lacking(required)).select(F.substring(key, 1, 12).alias("missing")).distinct()


def missing_references(texts: DataFrame, key: str, text: str, files: DataFrame, path: str) -> DataFrame:
    """key, line (from 0) and path of each absolute path between back-ticks that is no file."""
    found = texts.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line", "_t")).select(key, "line", F.explode(F.regexp_extract_all("_t", F.lit("`(/[^`\\s]+)`"), 1)).alias("path"))
    return found.join(files.select(F.col(path).alias("path")), "path", "left_anti").select(key, "line", "path")


def challenge_verdict(bad_fidelity: Column) -> Column:
    """Whether the judge saw a controlled error: the bad text's fidelity is not full. An unread reply did not."""
    return F.coalesce(bad_fidelity < 1, F.lit(False))


def server_health(spark) -> DataFrame:
    return spark.createDataFrame([("ok", "1.0.0", ["audit", "translate", "bench"])], "status string, version string, products array<string>")


def server_bench(rows: DataFrame, order: list, n: int) -> DataFrame:
    """product, n, avg_bleu and pass_rate over the first n rows of source, gold and translation; zeros where there is none."""
    from loomtext.functions import gates
    from loomtext.functions.text import bleu1, strip, words

    head = rows.orderBy(*order).limit(n).withColumn("b", bleu1(words(F.col("gold")), words(strip(F.col("translation")))))
    passed = F.when(gates.gate(gates.blocking(F.col("source"), F.col("translation"))) == "PASS", 1.0).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return head.agg(F.lit("bench").alias("product"), F.count("*").alias("n"), zero(F.round(F.avg("b"), 4)).alias("avg_bleu"), zero(F.round(F.avg(passed), 3)).alias("pass_rate"))
