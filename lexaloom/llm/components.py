"""Connected components of a graph that need not fit on one machine."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition, a batch at a time: each node
    is linked with the smallest of its tree."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i), dtype=np.int64) for i in (0, 1))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = np.array([root(x) for x in range(len(nodes))], dtype=np.int64)
        own = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[roots[own]])], ["a", "b"])


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); a component is
    named by its smallest node. Null ends and loops are ignored.

    Union-find thins out each partition's edges; then rounds of the large-star
    and small-star rewriting move every node to its component's smallest node.
    Neighbours are never gathered: a round takes minima and joins."""
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    edges = materialize(edges.mapInArrow(_forest, "a long, b long"), name)
    seen = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        before = edges
        edges = materialize(small.where("b <> m").select("b", "m").union(small.select("a", "m").distinct()).toDF("a", "b").distinct(), name)
        release(before)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    return edges.toDF("node", "component").union(edges.select("b", "b").distinct()).distinct() if seen["n"] else spark.createDataFrame([], "node long, component long")


@dataclass(frozen=True)
class Sets:
    """What ``bucket_components`` may know of the documents, so that it rules out pairs of sets less alike than ``percent``.

    sketches: (doc_id, n, sketch, bands), n being the set's size and bands the list
    of its ``n_bands`` bands, each always in the same place. likely: false only
    for sketches of sets that are not alike. elements: (doc_id, element) of the
    sets of the given documents (doc_id)."""

    percent: int
    sketches: DataFrame
    likely: Callable[[Column, Column], Column]
    elements: Callable[[DataFrame], DataFrame]
    n_bands: int

    def of(self, df: DataFrame, side: str) -> DataFrame:
        """``df`` with the size and sketch of the document in its column ``side``."""
        return df.join(self.sketches.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)

    def near(self) -> Column:
        """Whether a and b may be alike, by their sizes and then their sketches."""
        return (100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")) & self.likely(F.col("sketch_a"), F.col("sketch_b"))


def _bare(rows: DataFrame, sets: Sets, name: str) -> DataFrame:
    """``rows`` (band, doc_id, component) with ``shared``, a bound of how many elements
    any other document has in common with this one, without documents for which it is too low.

    An element that none of the other documents has can't be shared, so n less
    the number of such elements bounds every intersection. Texts around a common
    passage, however many, mostly are ruled out here, at a cost in proportion to
    their elements and before any pair is formed."""
    ids = materialize(rows.select("doc_id").distinct(), f"{name}-open")
    own = sets.elements(ids).groupBy("element").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id")).where("times = 1").groupBy("doc_id").agg(F.count("*").alias("own"))
    bound = ids.join(sets.sketches.select("doc_id", "n"), "doc_id").join(own, "doc_id", "left").select("doc_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"), "n")
    some = materialize(bound.where(100 * F.col("shared") >= sets.percent * F.col("n")).select("doc_id", "shared"), f"{name}-bound")
    return rows.join(some, "doc_id")


def bucket_components(rows: DataFrame, confirmed: Callable[[DataFrame], DataFrame], name: str, sets: Sets | None = None) -> DataFrame:
    """(node, component) of the nodes that have a confirmed link to another.

    rows: (band, doc_id), a candidate pair being two documents of one band.
    confirmed: keeps the true ones of the distinct pairs (a, b), a < b.
    sets: rules out candidates before their texts are fetched.

    A band first links its members with its smallest member alone. Pairs within
    a band follow only between what then is in different components and can
    be alike. So a large group of copies costs a few pairs per member, and every
    candidate pair is confirmed, refuted or already connected."""
    hubs = rows.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(rows.join(hubs, "band").select("band", "doc_id", "hub"), f"{name}-buckets")
    first = buckets.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    if sets:
        first = sets.of(sets.of(first, "a"), "b").where(sets.near()).select("a", "b")
    links = materialize(confirmed(first), f"{name}-links")
    groups = connected_components(links, f"{name}-components")

    named = buckets.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    apart = materialize(named.join(mixed.select("band"), "band"), f"{name}-apart")
    release(buckets)
    rows = materialize(_bare(apart, sets, name) if sets else apart, f"{name}-rest")
    release(apart)
    # a pair is formed once, in the first band that both are in
    if sets:
        known = rows.join(sets.sketches, "doc_id").withColumn("place", F.array_position("bands", F.col("band")) - 1)
        once = functools.reduce(lambda x, y: x & y, [(F.col("place_a") <= i) | (F.get("bands_a", F.lit(i)) != F.get("bands_b", F.lit(i))) for i in range(sets.n_bands)])
        # shared / (n_a + n_b - shared) at its most
        can = ((100 + sets.percent) * F.least("shared_a", "shared_b") >= sets.percent * (F.col("n_a") + F.col("n_b"))) & once & sets.near()
    else:
        known = rows.join(rows.groupBy("doc_id").agg(F.collect_set("band").alias("bands")), "doc_id")
        can = F.col("band_a") == F.array_min(F.array_intersect("bands_a", "bands_b"))
    # within a band, what is outside its largest component is held against all others
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("members"))
    main = sizes.groupBy("band").agg(F.max(F.struct("members", "component")).alias("most")).select(F.col("band").alias("of"), F.col("most.component").alias("main"))
    known = known.join(main, F.col("band") == F.col("of")).drop("of").withColumn("outside", F.col("component") != F.col("main")).drop("main")
    one, two = (known.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in known.columns if c != "doc_id"]) for x in "ab")
    once_each = ~F.col("outside_b") | (F.col("a") < F.col("b"))
    second = one.where("outside_a").join(two, (F.col("band_a") == F.col("band_b")) & (F.col("component_a") != F.col("component_b")) & once_each & can).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = materialize(confirmed(second), f"{name}-late")
    release(rows)
    if not late.limit(1).isEmpty():
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late), f"{name}-components")
    return groups
