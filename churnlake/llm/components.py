"""Connected components of a table of links, by contraction.

Every node points to its smallest neighbour (or itself), pointers are followed by doubling until they rest, links are carried over to what
their ends point to, and the rounds go on until no link is left. The links shrink from round to round; nothing is collected but
emptiness tests, and every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.tables import kept_table


def _resting(parent: DataFrame) -> DataFrame:
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("component").alias("top"))
        moved = kept_table(parent.join(above, F.col("component") == F.col("up")).select(
            "node", F.col("top").alias("component"), (F.col("top") != F.col("component")).alias("moved")), "pointers")
        parent = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every end of a link; ``links`` has columns a and b."""
    links = kept_table(links.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    kind = links.schema["a"].dataType
    found = links.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    first = True
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parent = _resting(kept_table(parent.select("node", F.least("node", "least").alias("component")), "pointers"))
        to_a, to_b = (parent.select(F.col("node").alias(x), F.col("component").alias(f"to_{x}")) for x in ("a", "b"))
        if first:
            found = parent
        else:
            step = parent.select(F.col("node").alias("component"), F.col("component").alias("next"))
            found = kept_table(found.join(step, "component", "left").select(
                "node", F.coalesce("next", "component").alias("component")), "components")
        first = False
        links = kept_table(links.join(to_a, "a").join(to_b, "b").where(F.col("to_a") != F.col("to_b")).select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    return found
