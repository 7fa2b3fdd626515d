"""Connected components in the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import cut, release


def _written(edges: DataFrame, *more: Column) -> tuple[DataFrame, tuple]:
    """The rows, cut, and what was seen of them on the way: their number, then ``more`` aggregates."""
    seen = Observation()
    values = [F.count("*"), *more]
    edges = cut(edges.observe(seen, *[v.alias(f"s{k}") for k, v in enumerate(values)]))
    return edges, tuple(seen.get[f"s{k}"] for k in range(len(values)))


def _digest() -> Column:
    return F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of each node of an undirected graph that isn't itself the smallest of its component.

    Large-star and small-star steps alternate until the edges form stars about the
    smallest nodes. Each step is a minimum by node (combined before the shuffle),
    written to the shared folder, and an equi-join of two written sides, so no task
    holds a node's neighbours at once and Spark can split those of a hub; the edges
    never become more, and every round is written. An empty graph gives no rows.

    What the driver keeps of each job (plans, broadcasts, shuffles, threads) is dear, so
    counts are taken as rows are written, and what a round leaves behind is released.
    The end is seen halfway through a round: edges are stars if each node that isn't
    the smallest of its neighbourhood has one edge down, and large-star changes none.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, state = _written(edges, _digest())
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low, (nodes, smallest) = _written(low, F.count_if(F.col("u") == F.col("m")))
        large, after = _written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), _digest())
        if after == state and state[0] == nodes - smallest:
            break
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, state = _written(small.union(low).distinct(), _digest())
        del both, low, large, small
        release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
