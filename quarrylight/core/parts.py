"""Ranks, running sums, percentiles and digests of groups of any size, worked out in parts.

A group is cut into parts along its order; small totals of the parts give each part its start, and only rows of one
part meet in a task. So one key may hold a third of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(rows: DataFrame, keys: list[str], order: str, value: Column, width: int = 10_000) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same keys that come first by ``order`` (a unique whole number)."""
    marked = rows.withColumn("_part", F.floor(F.col(order) / width)).withColumn("_value", value)
    totals = marked.groupBy(*keys, "_part").agg(F.sum("_value").alias("_total"))
    first = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(first), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = [local[k].eqNullSafe(starts[k]) for k in [*keys, "_part"]]
    joined = local.join(starts, reduce(lambda a, b: a & b, same))
    return joined.select(*[local[c] for c in rows.columns], (F.col("_start") + F.col("_local")).alias("before"))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``key`` and one column for each of ``shares``: exact percentiles, linear between neighbours.

    Values are counted first; a key's counts are added up in parts by the whole number below the value.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")).withColumn("_part", F.floor(value))
    totals = counted.groupBy(key, "_part").agg(F.sum("n").alias("_total"))
    first = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, "_part", F.coalesce(F.sum("_total").over(first), F.lit(0)).alias("_start"))
    size = totals.groupBy(key).agg(F.sum("_total").alias("_size"))
    inside = Window.partitionBy(key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.sum("n").over(inside)).join(starts, [key, "_part"]).join(size, key)
    last = F.col("_start") + F.col("_upto") - 1  # places of the equal values, from 0
    from_ = last - F.col("n") + 1

    def at(place: Column) -> Column:
        return F.max(F.when((from_ <= place) & (place <= last), F.col(value)))

    ends = []
    for name, share in shares.items():
        place = (F.col("_size") - 1) * share
        ends += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    found = placed.groupBy(key).agg(*ends)
    return found.select(key, *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares])


def digest_tree(rows: DataFrame, keys: list[str], leaf: Column, order: Column, branch: Column) -> DataFrame:
    """``keys, root, items``: one digest over all rows: of the ordered digests of branches, each over its ordered leaves.

    Equal groups have equal roots, whatever order their rows come in; a task gets one branch, not a group.
    """
    marked = rows.select(*keys, branch.alias("_branch"), F.struct(order.alias("o"), leaf.alias("x")).alias("_leaf"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_leaf")), lambda x: x["x"]), "")
    branches = marked.groupBy(*keys, "_branch").agg(F.sha2(text, 256).alias("_digest"), F.count("*").alias("_n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_branch", "_digest"))), lambda x: x["_digest"]), "")
    return branches.groupBy(*keys).agg(F.sha2(joined, 256).alias("root"), F.sum("_n").alias("items"))
