"""Weakly and strongly connected components and what rests on them.

Labels are the smallest member id. The loops pass only changed labels on, keep all
months in one job, and write each round to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import safe_ratio
from ..functions.skew import hot_join, with_small
from ..session import settle, settle_flagged
from . import whole
from .build import K, GraphSet, Links, induced

N = [*K, "node_id"]
STRONG = "node_id string, scc string"


def _hear(state: DataFrame, links: Links, label: str) -> DataFrame:
    """Smallest ``label`` that reaches each node over one link from a fresh node."""
    sent = links.send(state.where("fresh").select(*links.keys, label))
    return (sent.groupBy(*links.keys[:-1], F.col("other").alias("node_id")).agg(F.min(label).alias("heard")))


def _flood(state: DataFrame, links: Links, label: str) -> DataFrame:
    """Carry the smallest label along ``links`` among the nodes of ``state`` until nothing changes."""
    state, going = settle_flagged(state.withColumn("fresh", F.lit(True)), "fresh")
    while going:
        better = F.coalesce(F.col("heard") < F.col(label), F.lit(False))
        state, going = settle_flagged(state.join(_hear(state, links, label), links.keys, "left").select(
            *links.keys, F.when(better, F.col("heard")).otherwise(F.col(label)).alias(label), better.alias("fresh")), "fresh")
    return state.drop("fresh")


def weak_labels(nodes: DataFrame, links: Links, slot_rows: int) -> DataFrame:
    """Smallest node number of each node's component: labels of the neighbours, with labels of labels as short cuts."""
    keys, above = links.keys, links.keys[:-1]
    state = settle(nodes.select(*keys, F.col("node_id").alias("component")).withColumn("fresh", F.lit(True)))
    rows, going = state.count(), True
    while going:
        near = state.join(_hear(state, links, "component"), keys, "left").select(
            *keys, F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        # What a node hears also moves the node it is labelled by, so whole trees are hooked at once.
        hooks = near.where(F.col("component") < F.col("was")).groupBy(*above, F.col("was").alias("node_id")).agg(
            F.min("component").alias("hook"))
        near = settle(near.join(hooks, keys, "left").select(*keys, "was", F.least("component", "hook").alias("component")))
        # Labels that have themselves a smaller label; the distinct set is small where labels are widely held.
        held = near.select(*above, "component").distinct()
        onward = near.where(F.col("component") < F.col("node_id")).select(
            *above, F.col("node_id").alias("component"), F.col("component").alias("next"))
        onward = onward.join(held, [*above, "component"], "left_semi")
        label = F.coalesce("next", "component")
        state, going = settle_flagged(
            hot_join(near, onward, [*above, "component"], "left", rows=rows, slot_rows=slot_rows).select(
                *keys, label.alias("component"), (label < F.col("was")).alias("fresh")), "fresh")
    return state.drop("fresh")


def weak_numbers(g: GraphSet) -> DataFrame:
    """``component`` of every node, both by number."""
    return g.once("weak numbers", lambda: weak_labels(g.ids, g.pair_links, g.slot_rows))


def weak_components(g: GraphSet) -> DataFrame:
    """``component`` of every node."""
    return g.once("weak", lambda: g.in_tasks(whole.weak, "node_id string, component string", lambda big: big.named(weak_numbers(big), "component")))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy(*K, "component").agg(F.count(F.lit(1)).alias("size"))


def component_table(g: GraphSet, components: DataFrame) -> DataFrame:
    """Size and density of each weak component; every arc lies inside one."""
    rows = g.arcs.count()
    inside = hot_join(g.arcs.select(*K, F.col("source").alias("node_id")), components, N, rows=rows)
    edges = inside.groupBy(*K, "component").agg(F.count(F.lit(1)).alias("edges"))
    n = F.col("size")
    return component_sizes(components).join(edges, [*K, "component"], "left").select(
        *K, "component", "size",
        safe_ratio(F.coalesce("edges", F.lit(0)).cast("double"), n * (n - 1)).alias("density"))


def largest_component(components: DataFrame) -> DataFrame:
    """Id and size of the largest weak component (the smallest id among equals)."""
    best = F.min(F.struct((-F.col("size")).alias("negative"), "component")).alias("best")
    return component_sizes(components).groupBy(*K).agg(best).select(
        *K, F.col("best.component").alias("component"), (-F.col("best.negative")).alias("largest_component_size"))


def largest_component_nodes(components: DataFrame) -> DataFrame:
    largest = largest_component(components).select(*K, "component")
    return with_small(components, largest, [*K, "component"]).select(*N)


def largest_subgraph(g: GraphSet, components: DataFrame) -> DataFrame:
    return induced(g.arcs, settle(largest_component_nodes(components)))


def component_count(components: DataFrame) -> DataFrame:
    count = components.groupBy(*K).agg(F.count_distinct("component").alias("num_components"))
    return count.withColumn("is_weakly_connected", F.col("num_components") == 1)


def strong_components(g: GraphSet) -> DataFrame:
    """``scc`` of every node.

    In rounds, nodes without an arc in or out among the rest are components of their own and are cut
    off first. Then the smallest id flows forward; a node that keeps its own id is a root,
    and those of its colour that reach it are its component (colouring after Orzan, 2004).
    """
    return g.once("strong", lambda: g.in_tasks(whole.strong, STRONG, _strong))


def _strong(g: GraphSet) -> DataFrame:
    done: list[DataFrame] = []
    active, left = settle(g.ids.select("node_id")), True
    while left:
        active, left = _trim(active, g, done)
        if not left:
            break
        colour = _flood(active.withColumn("colour", F.col("node_id")), g.out_links, "colour")
        reached = _reach_back(colour, g.in_links)
        done.append(reached.where("reached").select("node_id", F.col("colour").alias("scc")))
        active, left = settle_flagged(reached.where(~F.col("reached")).select("node_id", F.lit(True).alias("left")), "left")
        active = active.select("node_id")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return g.named(result, "scc")


def _trim(active: DataFrame, g: GraphSet, done: list[DataFrame]) -> tuple[DataFrame, bool]:
    """Cut lone nodes off until none is left; tells whether other nodes remain."""
    while True:
        seen = None
        for name, links in (("into", g.out_links), ("outof", g.in_links)):
            ways = links.send(active).where(F.col("other") != F.col("node_id")).select(
                F.col("other").alias("node_id"), *[F.lit(1 if n == name else 0).alias(n) for n in ("into", "outof")])
            seen = ways if seen is None else seen.unionByName(ways)
        seen = seen.groupBy("node_id").agg(F.max("into").alias("into"), F.max("outof").alias("outof"))
        kept = F.coalesce(F.col("into") + F.col("outof") == 2, F.lit(False))
        marked, any_lone = settle_flagged(active.join(seen, "node_id", "left").select("node_id", (~kept).alias("lone")), "lone")
        active = marked.where(~F.col("lone")).select("node_id")
        if not any_lone:
            return active, not active.isEmpty()
        done.append(marked.where("lone").select("node_id", F.col("node_id").alias("scc")))


def _reach_back(colour: DataFrame, links: Links) -> DataFrame:
    """Mark the nodes that reach the root of their colour."""
    root = F.col("node_id") == F.col("colour")
    state, going = settle_flagged(colour.select("node_id", "colour", root.alias("reached"), root.alias("fresh")), "fresh")
    while going:
        sent = links.send(state.where("fresh").select("node_id", "colour"))
        heard = sent.select(F.col("other").alias("node_id"), "colour").distinct().withColumn("heard", F.lit(True))
        fresh = ~F.col("reached") & F.coalesce("heard", F.lit(False))
        state, going = settle_flagged(state.join(heard, ["node_id", "colour"], "left").select(
            "node_id", "colour", (F.col("reached") | fresh).alias("reached"), fresh.alias("fresh")), "fresh")
    return state


def strong_component_count(scc: DataFrame) -> DataFrame:
    return scc.groupBy(*K).agg(F.count_distinct("scc").alias("connected_components"))


def cycle_edge_ratio(g: GraphSet, scc: DataFrame) -> DataFrame:
    """Share of arcs on a directed cycle: those with both ends in one strong component."""
    from .local import label_ends
    inside = (F.col("source_scc") == F.col("target_scc")).cast("double")
    return label_ends(g.arcs.select(*K, "source", "target"), scc, "scc").groupBy(*K).agg(
        F.avg(inside).alias("cycle_edge_ratio"))
