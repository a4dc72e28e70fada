"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def forest(batches):
    """Links of a partition as links to the smallest node of each local component."""
    for b in batches:
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
        a, c = at[: len(x)], at[len(x) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[c])
            was = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[c], low)
            root = root[root]
            if (root == was).all():
                break
        far = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["x", "y"])


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of links (x, y: long): the smallest node it reaches.

    Partitions contract their links first. Then each round takes the least root among a node and its neighbours and
    follows it once more, so the rounds grow with the logarithm of a component's width. Tables are written between rounds.
    """
    short = cut(links.select("x", "y").mapInArrow(forest, "x long, y long"))
    both = short.union(short.select("y", "x")).distinct()
    roots = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).select(F.col("x").alias("node"), "root"))
    while True:
        seen = both.join(roots, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("low"))
        step = roots.join(seen, F.col("node") == F.col("x"), "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = step.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = cut(step.join(jump, F.col("root") == F.col("at"), "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        roots = new.select("node", "root")
        if not new.filter("root <> was").head(1):
            return roots
