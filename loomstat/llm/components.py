"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (u, v); returns (node, root) for every node of an edge, root the smallest node it reaches.

    Each round maps every node to the smallest neighbour of its smallest neighbour and the
    edges to what their ends are mapped to, until no edge is left.  A node never leaves its
    component, and the ends of an edge stay joined.  Rounds are written to the shared folder;
    hubs are only ever aggregated or joined.  Loops and repeated edges do no harm; null ends
    are ignored.
    """
    ordered = lambda u, v: (F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    whole = edges.where("u is not null and v is not null")
    left = stored(whole.select(*ordered(F.col("u"), F.col("v"))).distinct(), "edges")
    roots = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    roots = stored(roots.select("node", F.col("node").alias("root")), "roots")
    while not (left := left.where("u < v")).isEmpty():
        both = left.union(left.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("a"), F.least("u", "v").alias("b"))
        far = near.select(F.col("a").alias("b"), F.col("b").alias("c"))
        # The smallest node of a neighbourhood is itself a node of some edge, so the join finds it.
        to = stored(near.join(far, "b").select("a", "c"), "step")
        ends = left.join(to.toDF("u", "cu"), "u").join(to.toDF("v", "cv"), "v")
        left = stored(ends.select(*ordered(F.col("cu"), F.col("cv"))).where("u < v").distinct(), "edges")
        roots = stored(roots.join(to.toDF("root", "next"), "root", "left")
                       .select("node", F.coalesce("next", "root").alias("root")), "roots")
    return roots
