"""Append-only ledgers of JSON lines: union, counts, search, tail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_lines(lines: DataFrame, ledger: str, column: str = "value") -> DataFrame:
    """ledger, ts, step, experiment_id and the raw line of each readable object; blank and malformed lines are skipped."""
    raw = F.col(column)
    keys = [F.get_json_object(raw, f"$.{k}").alias(k) for k in ("ts", "step", "experiment_id")]
    good = (F.trim(raw) != "") & F.try_parse_json(raw).isNotNull() & F.json_object_keys(raw).isNotNull()
    return lines.filter(good).select(F.lit(ledger).alias("ledger"), *keys, raw.alias("raw"))


def union(ledgers: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ledgers)


def step_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("ledger", F.coalesce("step", "experiment_id", F.lit("?")).alias("step")).agg(F.count("*").alias("n"))


def ledger_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("ledger").agg(F.count("*").alias("n"))


def recent(entries: DataFrame, n: int) -> DataFrame:
    """The last n entries by time; those without a time come first, equals by their raw line."""
    return entries.orderBy(F.coalesce("ts", F.lit("")).desc(), F.col("raw").desc()).limit(n)


def of_step(entries: DataFrame, name: str, n: int = 10) -> DataFrame:
    return recent(entries.filter((F.col("step") == name) | F.col("experiment_id").contains(name)), n)


def search(entries: DataFrame, text: str, n: int = 10) -> DataFrame:
    return recent(entries.filter(F.lower("raw").contains(text.lower())), n)
