"""Order across a cluster: rows laid out in sorted range partitions, with running sums that are carried from one partition to the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.sources.scratch import written

#: Bits of a row's place within its partition.
_PLACE = 33


def laid_out(df: DataFrame, by: list, parts: int | None = None) -> DataFrame:
    """df in the order of `by`, written, with `_part`, the number of its range partition, and `_at`, which grows with the order.

    Partitions hold nearly equal numbers of rows as long as no single value of all of `by` holds many: let `by` end in what
    tells rows apart. The order of rows that are equal in `by` is fixed by writing them. parts: 0 for as many as their bytes need, up to
    Spark's number of shuffle partitions, neighbours of which are then joined; None for that number.
    """
    n = [] if parts == 0 else [parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))]
    placed = df.repartitionByRange(*n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return written(placed.withColumn("_part", F.shiftright("_at", _PLACE).cast("int")))


def running(rows: DataFrame, group: list[str], totals: dict[str, Column]) -> DataFrame:
    """Of rows that are laid out with `group` first: for each name the total of its column over the rows of the group that come before.

    A partition's rows are summed where they are; what a group has in earlier partitions is a row for each partition that it
    goes on into, so that the carries of all groups are at most as many as partitions and can be broadcast.
    """
    here = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("_part", *group).agg(*(F.sum(c).alias(k) for k, c in totals.items()))
    spans = held.select("_part", *group, *(F.sum(k).over(earlier).alias(f"_carry_{k}") for k in totals))
    carries = spans.filter(" OR ".join(f"_carry_{k} IS NOT NULL" for k in totals)).alias("c")  # at most a group for each partition
    local = rows.withColumns({k: F.coalesce(F.sum(c).over(here), F.lit(0)) for k, c in totals.items()}).alias("r")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in ("_part", *group)))
    added = (F.col(f"r.{k}") + F.coalesce(F.col(f"c._carry_{k}"), F.lit(0)) for k in totals)
    kept = [F.col(f"r.{c}") for c in rows.columns]
    return local.join(F.broadcast(carries), same, "left").select(*kept, *(a.alias(k) for a, k in zip(added, totals)))


def following(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Of rows that are laid out with `group` first: as `name` the value of the group's next row, null for its last one. What a
    partition's last row of a group needs is the group's first row in a later partition: again at most one for each partition."""
    here, later = Window.partitionBy("_part", *group).orderBy("_at"), Window.partitionBy(*group).orderBy("_part")
    firsts = rows.groupBy("_part", *group).agg(F.min_by(value, "_at").alias("_first"))
    carries = firsts.select("_part", *group, F.lead("_first").over(later).alias("_next")).filter("_next IS NOT NULL").alias("c")
    local = rows.withColumn(name, F.lead(value).over(here)).alias("r")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in ("_part", *group)))
    return local.join(F.broadcast(carries), same, "left").select(*(F.col(f"r.{c}") for c in rows.columns), F.coalesce(F.col(f"r.{name}"), F.col("c._next")).alias(name))


def numbered(df: DataFrame, by: list, group: list[str] | None = None, name: str = "_n", parts: int | None = None) -> DataFrame:
    """df with the number, from 0, that each row has within its group in the order of `by`. Without a group, among all rows."""
    group = group or []
    out = running(laid_out(df, [*group, *by], parts), group, {name: F.lit(1)})
    return out.drop("_part", "_at")
