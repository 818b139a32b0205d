"""Connected components over link tables, without the driver seeing a link."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import hot_join
from .common import discard, materialize


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` local nodes over links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Large-star / small-star contraction (Kiveris et al., SoCC 2014) of ``edges(src, dst)``.

    Returns ``(node, root)`` for every node of a link whose component has a smaller id than it;
    roots and lonely nodes are absent. Nulls, loops and repeated links are ignored. A star's
    least node is an aggregate (combined before the shuffle); where it is joined back, the links
    of a node with over 1 / SHARE of them are dealt to pieces. A round never has more links than the one
    before, so its files are as few as those need; its links go once the next are written. Raises RuntimeError where ``max_rounds`` rounds do not show the fixed point.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialize(e, "links")
    seen = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hot_join(both.where("v > u"), least, ["u"], ["v"], total=now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "stars", now[0])
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hot_join(large, low, ["u"], ["v"], total=now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, materialize(small, "links", now[0])
        discard(before, large)
    else:
        raise RuntimeError(f"components have not converged in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
