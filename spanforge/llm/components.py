"""Connected components of a link table, by contraction; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (u, v: bigint); root is one of its component's ids, the same for all of them.

    Each round hooks every vertex to its least neighbour and contracts; ids should be hashes, so that chains shrink by
    a constant factor a round. Rows with a null end and loops count for nothing; repeated links are as good as one;
    without links the result is empty. Rounds are written to the shared folder: the plan stays small and lost
    executors cost one round.
    """
    edges = materialize(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-links")
    written = [edges]
    labels = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("root"))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*")
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        # one jump: a vertex's parent may itself hook lower
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = materialize(hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "cc-parents")
        written.append(parent)
        labels = labels.join(parent, labels.root == parent.a, "left").select("id", F.coalesce("p", "root").alias("root"))
        pu, pv = parent.select(F.col("a").alias("u"), F.col("p").alias("pu")), parent.select(F.col("a").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        edges = materialize(moved, "cc-links")
        written.append(edges)
    out = materialize(labels, "cc-labels")
    discard(*written)
    return out
