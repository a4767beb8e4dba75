"""Consistent sides of a graph whose edges say "same" or "flipped", and repair of what lies on the wrong side.

Tasks contract the edges that they hold to stars about the smallest node of each piece, a bounded number of edges at a time,
so edges that lie together are gone before anything is shuffled. A node in several stars links their centres, and a star
that contradicts itself links its centre to itself: only these links, few where edges lie together, are spread in rounds.

There, every node is doubled, once for each side; a "same" edge joins equal sides, a "flipped" edge opposite ones. Minimum labels
on the doubled graph carry the component and the side together: a node's two copies carry different labels if its
component can be satisfied, and the same one if some cycle flips an odd number of times. Such a component has no sides; its
edges are reported as contradictory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis import storage
from parallaxis.operators import graph, sizes

#: Edges that a task contracts at once.
CHUNK_EDGES = 200_000


def _stars(u: np.ndarray, v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, centre, turned) of the pieces of some edges; a centre has a row of its own, and a turned one in a contradiction."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = 2 * at[: len(u)], 2 * at[len(u) :]
    x, y = np.concatenate([a, a + 1]), np.concatenate([b + turn, b + 1 - turn])
    label = np.arange(2 * len(ids))
    while True:
        low, moved = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(moved, label[x], low)
        np.minimum.at(moved, label[y], low)
        while ((up := moved[moved]) != moved).any():
            moved = up
        if (moved == label).all():
            break
        label = moved
    even, odd = label[::2], label[1::2]
    wrong = np.flatnonzero((even == odd) & (even // 2 == np.arange(len(ids))))
    return np.concatenate([ids, ids[wrong]]), np.concatenate([ids[even // 2], ids[wrong]]), np.concatenate([even % 2 == 1, np.ones(len(wrong), bool)])


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """(node, centre, turned): stars of the edges that a task meets together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def close() -> pa.RecordBatch:
            found = _stars(*(np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in ("u", "v", "turn")))
            return pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["node", "centre", "turned"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield close()
                held, rows = [], 0
        if rows:
            yield close()

    return edges.mapInArrow(run, "node long, centre long, turned boolean")


def _spread(links: DataFrame) -> DataFrame:
    """(centre, component, away, satisfied) of all centres in ``links(u, v, flipped)``."""
    centres = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    both = centres.select(F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"))
    turn = F.col("flipped").cast("long")
    doubled = links.select(F.explode(F.array(*(F.struct((F.col("u") * 2 + s).alias("u"), (F.col("v") * 2 + (turn + s) % 2).alias("v")) for s in (0, 1)))).alias("e")).select("e.*")
    labels = graph.label_components(both, doubled.distinct())
    # the copies of a node carry the two copies of the component's smallest node, or one of them twice
    each = labels.groupBy(F.floor(F.col("node") / 2).alias("centre")).agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.min(F.when(F.col("node") % 2 == 0, F.col("component"))).alias("own"))
    return each.select("centre", F.floor(F.col("least") / 2).alias("component"), (F.col("own") % 2 == 1).alias("away"), (F.col("least") < F.col("most")).alias("satisfied"))


def signed_components(nodes: DataFrame, edges: DataFrame, closed: bool = False, chunk: int = CHUNK_EDGES) -> DataFrame:
    """(node, component, side, satisfied) of ``nodes(node)`` under undirected ``edges(u, v, flipped)``.

    ``component`` is the smallest node reachable, ``side`` whether the node is opposite to it (null where no assignment
    of sides satisfies all edges). Nodes are non-negative longs. A node without edges is a satisfied component of its own;
    a flipped edge from a node to itself contradicts it; edges with a null, or to unknown nodes, count for nothing.
    Repeated edges that differ contradict each other. ``closed`` says that no edge has an unknown node, so edges stay in the
    tasks that make them. The result is stored.
    """
    known = nodes.select(F.col("node").cast("long").alias("node")).filter("node is not null")
    usable = edges.filter("u is not null and v is not null and flipped is not null")
    if not closed:
        usable = usable.join(known.withColumnRenamed("node", "u"), "u", "left_semi").join(known.withColumnRenamed("node", "v"), "v", "left_semi")
    usable = usable.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("flipped").cast("long").alias("turn"))
    stars = _contracted(usable, chunk).unionByName(known.select("node", F.lit(None).cast("long").alias("centre"), F.lit(False).alias("turned")))
    by_node = Window.partitionBy("node").orderBy(F.col("centre").asc_nulls_last(), "turned")
    first = F.first(F.struct("centre", "turned")).over(by_node)
    met = stars.withColumns({"first": first, "place": F.row_number().over(by_node)}).filter("place = 1 or (centre is not null and (centre <> first.centre or turned <> first.turned))")
    met = storage.materialize(met.select("node", "centre", "turned", "first", (F.col("place") == 1).alias("own")), "stars")
    links = met.filter("not own and centre is not null").select(F.col("centre").alias("u"), F.col("first.centre").alias("v"), (F.col("turned") != F.col("first.turned")).alias("flipped"))
    links = storage.materialize(links.distinct(), "star-links")
    hooks = met.filter("own").select("node", F.coalesce("centre", "node").alias("centre"), "turned")
    labels = storage.materialize(_spread(links), "centre-labels")
    found = hooks.join(sizes.small(labels), "centre", "left")
    satisfied = F.coalesce("satisfied", F.lit(True))
    side = F.when(satisfied, F.coalesce("away", F.lit(False)) != F.col("turned"))
    sides = storage.materialize(found.select("node", F.coalesce("component", "centre").alias("component"), side.alias("side"), satisfied.alias("satisfied")), "sides")
    storage.drop(met, links, labels)
    return sides


def contradictory(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of components that no assignment satisfies."""
    return edges.join(sides.filter(~F.col("satisfied")).select(F.col("node").alias("u")), "u", "left_semi")


def minority(sides: DataFrame) -> DataFrame:
    """Adds ``mirrored``: whether a node is on the smaller side of its component (ties: the side of the smallest node stays).

    Null in components without sides.
    """
    sizes = sides.filter("satisfied").groupBy("component").agg(F.count_if(F.col("side")).alias("_opposite"), F.count(F.lit(1)).alias("_all"))
    small = F.when(2 * F.col("_opposite") > F.col("_all"), ~F.col("side")).otherwise(F.col("side"))
    return sides.join(sizes, "component", "left").select("node", "component", "side", "satisfied", F.when(F.col("satisfied"), small).alias("mirrored"))


def interpolated(frame: DataFrame, order: str, valid: Column, values: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """``values`` of rows that are not valid, on the line between the nearest valid rows before and after in ``order``.

    With a valid row on one side only its value is taken, with none the value becomes null. ``order`` is numeric and
    total within ``by``; the columns before_<order> and after_<order> say where the values come from.
    """
    whole = Window.partitionBy(*by).orderBy(order)
    held = F.when(valid, F.struct(order, *values))
    before = F.last(held, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(held, ignorenulls=True).over(whole.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    b, a = (storage.fresh(frame.columns, n) for n in ("_before", "_after"))
    met = frame.withColumns({b: before, a: after})
    share = (F.col(order) - F.col(f"{b}.{order}")) / (F.col(f"{a}.{order}") - F.col(f"{b}.{order}"))
    line = {
        v: F.when(F.coalesce(valid, F.lit(False)), F.col(v))
        .when(F.col(b).isNotNull() & F.col(a).isNotNull(), F.col(f"{b}.{v}") + (F.col(f"{a}.{v}") - F.col(f"{b}.{v}")) * share)
        .otherwise(F.coalesce(F.col(f"{b}.{v}"), F.col(f"{a}.{v}")))
        for v in values
    }
    kept = [c for c in frame.columns if c not in values]
    return met.select(*kept, *(x.alias(v) for v, x in line.items()), F.col(f"{b}.{order}").alias(f"before_{order}"), F.col(f"{a}.{order}").alias(f"after_{order}"))
