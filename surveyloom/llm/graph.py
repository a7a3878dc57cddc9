"""Connected components as joins and sums: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, meet, merged


#: Edges a partition, so that a small graph doesn't leave thousands of small files.
EDGES_A_PART = 50_000
#: Edges from which a hub can be a task too long.
HUBS_FROM = 200_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame, total: int, parts: int) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbourhood; hubs meet
    their edges where they are."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both.coalesce(parts)).select("u", F.least("u", "m").alias("m"), "n")
    if total > HUBS_FROM:
        least = cut(least)
        moved = meet(both.filter("v > u"), least, "u", 2 * total)
    else:
        moved = merged(both.filter("v > u"), least.drop("n"), "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """A node's smaller neighbours and itself go to the least of them; u > v."""
    least = _least(edges).drop("n")
    moved = merged(edges, least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): the least node that is reachable.

    Self links and null ends are ignored, repeated edges do no harm and no
    edge gives no row. The stars shrink to depth one in about log² rounds;
    each round is checkpointed in the shared folder, and nothing is collected
    but counts and a hash.
    """
    now = cut(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state or not seen[0]:
            roots = now.select("v").distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
            )
        state = seen
        parts = 1 + seen[0] // EDGES_A_PART
        now = cut(_small_star(_large_star(now.coalesce(parts), seen[0], parts), parts).coalesce(parts))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
