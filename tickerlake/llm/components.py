"""Connected components of links by alternating large and small stars.

Every round is two shuffles over the links; the number of rounds grows with
the logarithm of the longest chain. Nothing but one count a round reaches
the driver. The minimum of a vertex's links is taken before anything is
joined back, so a vertex with very many links is aggregated map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake.llm.tables import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or smaller and own (small star) neighbours to the least."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(id, root) for every vertex of ``links`` (a, b) that is not itself the least of its component."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen = None
    for _ in range(max_rounds):
        now = stored(_star(_star(now, True), False), name)
        # links only ever move to smaller ends: equal sums mean nothing moved
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
