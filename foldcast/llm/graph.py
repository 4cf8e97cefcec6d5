"""Connected components of large edge tables and of similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.llm.common import counted, discard, staged

#: Gives a member's column by name.
Side = Callable[[str], Column]
#: Members of a list that meet all others in one task; longer lists are split.
LIST_PART = 512


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """Label each node that has an edge with the smallest node of its component.

    Tasks first contract the edges that they hold, each by itself. Then two contractions alternate until only stars
    are left: each node hangs its larger neighbours on its smallest neighbour, then its smaller neighbours and
    itself. The number of rounds grows with the logarithm of the longest chain; a node with very many neighbours is
    reduced by partial aggregation and a splittable join, never gathered.

    Returns (node, component). Self edges and edges with a null end are ignored. An empty
    table gives an empty result.
    """
    e = edges.select(F.least(a, b).cast("long").alias("v"), F.greatest(a, b).cast("long").alias("u")).where("u <> v").mapInArrow(_contract, "v long, u long")
    e, n = counted(e, "edges")
    for _ in range(rounds):
        if not n or _is_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().union(e.select("v", "v").distinct())
        before = e
        e, n = counted(_small_star(_large_star(before)).mapInArrow(_contract, "v long, u long"), "edges")
        discard(before)
    raise RuntimeError("components did not converge")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (v, u) of a task as stars: each node and the smallest that it reaches by these edges."""
    held = [(b.column("v").to_numpy(), b.column("u").to_numpy()) for b in batches]
    if not held:
        return
    v, u = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    x, y, least = at[: len(v)], at[len(v) :], np.arange(len(nodes))
    while True:
        # hang the root of either end on the smaller one, then let every node see its root
        lo, hi = np.minimum(least[x], least[y]), np.maximum(least[x], least[y])
        if (lo == hi).all():
            break
        np.minimum.at(least, hi, lo)
        while (least != (up := least[least])).any():
            least = up
    own = np.flatnonzero(least != np.arange(len(nodes)))
    yield from pa.Table.from_arrays([pa.array(nodes[least[own]], pa.int64()), pa.array(nodes[own], pa.int64())], ["v", "u"]).to_batches()


def _is_stars(e: DataFrame) -> bool:
    """Whether each node hangs on one other only, on which nothing else is hung the other way round."""
    both = e.select(F.col("u").alias("x"), "v").union(e.select(F.col("v").alias("x"), F.col("v")).distinct())
    odd = both.groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi")
    return odd.isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (node, component) after more edges (a, b): only the components that they join are worked on."""
    to = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    ends = found.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    moved = staged(components(ends), "moved")
    new = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = labels.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return kept.unionByName(moved.join(labels, "node", "left_anti"))


def link_lists(lists: DataFrame, can_link: Callable[[Side, Side], Column], judge: Callable[[DataFrame], DataFrame], pivot_rounds: int = 2) -> DataFrame:
    """Components of a similarity join that is given by lists of members.

    ``lists`` has key, id, indexed and what ``can_link`` reads. Two members of a key may link
    if one of them at least is indexed and ``can_link`` holds; ``judge`` takes distinct pairs
    (a, b) and returns them with a boolean ``linked``. Members first meet one pivot of
    their list; all other pairs are judged afterwards, but for those whose two members are
    already known to be connected. So components are exact, while a list of copies costs about
    its length.

    Returns (node, component) for nodes with links.
    """
    tried = labels = None
    for k in range(pivot_rounds + 1):
        now = lists.withColumn("component", F.col("id")) if labels is None else lists.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        pairs = _pivot_pairs(now, can_link, k) if k < pivot_rounds else _other_pairs(now, can_link)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs, n = counted(pairs, "pairs")
        if labels is not None and not n:
            continue
        judged, linked = counted(judge(pairs), "judged", F.count_if("linked"))
        discard(pairs)
        tried = judged.select("a", "b") if tried is None else tried.union(judged.select("a", "b"))
        found = judged.where("linked").select("a", "b")
        if labels is None:
            labels = staged(components(found), "labels")
        elif linked:
            before = labels
            labels = staged(merged(before, found), "labels")
            discard(before)
    return labels


def _pivot_pairs(lists: DataFrame, can_link: Callable[[Side, Side], Column], k: int) -> DataFrame:
    rest = [c for c in lists.columns if c not in ("key", "id")]
    # one order for all lists first, so that few pairs are judged; then one for each list, should the first pivots be odd ones
    turn = F.xxhash64("id") if k == 0 else F.xxhash64(F.lit(k), "id", "key")
    # written, so that a long list's join with its pivot can be split at run time
    pivots = staged(lists.where("indexed").groupBy("key").agg(F.min(F.struct(turn.alias("h"), "id", *rest)).alias("p")), "pivots")
    met = lists.join(pivots, "key").where((F.col("component") != F.col("p.component")) & can_link(F.col, lambda c: F.col(f"p.{c}")))
    return met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _other_pairs(lists: DataFrame, can_link: Callable[[Side, Side], Column]) -> DataFrame:
    """All pairs of a list whose members are in different components.

    A long list is split: its indexed members are dealt to parts of about ``LIST_PART``, and every part
    meets all members, so that no task does the whole list.
    """
    parts = F.ceil(F.sum(F.col("indexed").cast("long")) / LIST_PART).cast("int").alias("parts")
    open_ = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("indexed").alias("x"), parts).where("lo <> hi and x").select("key", "parts")
    both = staged(lists.join(open_, "key"), "open")
    left = both.where("indexed").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    right = both.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = right.select(*(F.col(c).alias(f"{c}_") for c in right.columns))
    once = (F.col("id") < F.col("id_")) | ~F.col("indexed_")
    met = left.join(right, (F.col("key") == F.col("key_")) & (F.col("part") == F.col("part_")) & once & (F.col("component") != F.col("component_")) & can_link(F.col, lambda c: F.col(f"{c}_")))
    return met.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()
