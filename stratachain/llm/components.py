"""Connected components of a link table by distributed union-find: hooking to the smallest neighbour, then pointer jumping.

Links and labels stay in tables; the driver sees one count a round. Each round's labels are a written table. A round costs a dozen
stages whatever the number of links, so a few links (up to ``ALONE``) are better joined in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged

#: Links up to which one task finds the components: 8 MB of digests.
ALONE = 1 << 18


def _smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n numbers reaches by links between them."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (low == np.maximum(x, y)).all():
            return label
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def components_alone(links: DataFrame) -> DataFrame:
    """The same as ``components``, in one task that holds all links; these are read again for it, so give a written table."""

    def run(batches):
        tables = list(batches)
        if not tables:
            return
        ends = pa.chunked_array([x for t in tables for x in t.columns[:1]] + [x for t in tables for x in t.columns[1:]])
        v = pc.unique(ends)
        v = v.take(pc.sort_indices(v))
        at = pc.index_in(ends, v).to_numpy().astype(np.int64)
        yield pa.record_batch([v, v.take(pa.array(_smallest(*np.split(at, 2), len(v))))], names=["v", "c"])

    kind = links.schema["a"].dataType.simpleString()
    return staged(links.select("a", "b").coalesce(1).mapInArrow(run, f"v {kind}, c {kind}"), "labels")


def components(links: DataFrame) -> DataFrame:
    """(v, c) for each vertex of ``links`` (a, b): c is the smallest vertex that it can reach. Loops are allowed."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF("a", "b")
    both = staged(both.distinct(), "links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("c"))
    labels = staged(labels, "labels")
    while True:
        near = both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("n"))
        hooked = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        # the smallest label that anyone with this label has seen goes for all of them
        root = hooked.groupBy(F.col("old").alias("o")).agg(F.min("c").alias("r"))
        jumped = hooked.join(root, hooked["old"] == root["o"]).select("v", "old", F.least("c", "r").alias("c"))
        top = labels.toDF("c", "above")
        new = staged(jumped.join(top, "c").select("v", "old", F.least("c", "above").alias("c")), "labels")
        if new.where("c < old").limit(1).count() == 0:
            return labels
        labels = new.select("v", "c")
