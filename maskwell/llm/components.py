"""Connected components of an edge table, by Spark joins alone, and spanning links within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import looked_up, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that it reaches), for every node of an edge.

    Every round, each node takes the smallest label among its own, its neighbours' and its label's label; a round
    is written to the shared folder, so lineage stays short. Ends when no label changes. Hooking by the labels'
    labels halves long chains, so rounds grow with the logarithm of a component's diameter in the common case.
    Labels of giant components and hubs with very many links are broadcast, fewer than a thousand rows a join.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stored(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    links, nodes = both.count(), labels.count()
    while True:
        told = looked_up(both, "y", labels.select(F.col("node").alias("y"), "component"), links)
        near = told.groupBy("x").agg(F.min("component").alias("m"))
        # a node also tells its old label's root what it has found, so that whole trees move at once
        found = stored(labels.join(near, labels["node"] == near["x"]).select("node", "component", F.least("component", "m").alias("low")), "labels")
        roots = found.groupBy("component").agg(F.min("low").alias("root_low"))
        hooked = looked_up(found, "component", roots, nodes)
        step = stored(hooked.select("node", F.col("component").alias("old"), F.least("low", "root_low").alias("component")), "labels")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up_label"))
        hopped = looked_up(step, "component", jump, nodes, "left")
        new = stored(hopped.select("node", "old", F.least("component", F.coalesce("up_label", "component")).alias("component")), "labels")
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links connect what all the links connect; fewer than the n nodes. Others close circles."""
    root, left, kept = np.arange(n), np.arange(len(a)), []
    while len(left):
        x, y = root[a[left]], root[b[left]]
        on = x != y
        left, x, y = left[on], x[on], y[on]
        if not len(left):
            break
        high, low = np.maximum(x, y), np.minimum(x, y)
        # each root hangs under one smaller root that it has a link to
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], np.diff(high[order]) != 0])]
        kept.append(left[first])
        root[high[first]] = low[first]
        while (root[root] != root).any():
            root = root[root]
    return np.concatenate([np.zeros(0, np.int64), *kept]).astype(np.int64)
