"""Walking linked lists: allocation chains and other next-pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk(links: DataFrame, group: str, node: str, next_node: str, head: str, guard: int | None = None) -> DataFrame:
    """(group, node, step) along each chain from its heads, at most ``guard`` steps; as many as
    the group has nodes if it is None, which cuts no chain without a cycle.

    A chain lies within its group, so each group is gathered once and followed in a map; a
    group is one volume or one file's chain, which fits a row. A chain that runs into itself
    repeats nodes up to the guard; a pointer to no node ends it.
    """
    grouped = links.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(node, next_node))).alias("next"), F.array_sort(F.collect_list(F.when(F.col(head), F.col(node)))).alias("heads"))
    start = F.explode("heads").alias("start")

    def step(path, _):
        follow = F.try_element_at(F.col("next"), F.element_at(path, -1))
        known = F.map_contains_key("next", F.coalesce(follow, F.lit(-1)))
        return F.when(follow.isNotNull() & known, F.concat(path, F.array(follow))).otherwise(path)

    steps = F.size("next") if guard is None else F.least(F.size("next") * 2, F.lit(guard))
    path = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), F.array(F.col("start")), lambda p, i: F.when(F.size(p) == i, step(p, i)).otherwise(p))
    return grouped.select(group, "next", start).select(group, F.posexplode(path).alias("step", "node")).select(group, "node", "step")
