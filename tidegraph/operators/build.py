"""Graph construction: simple arcs, node sets, undirected pairs, induced subgraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import KEY
from ..functions.skew import SLOT, SLOT_ROWS, hot_join, hot_keys, replicate, split, with_small
from ..session import settle, width
from . import whole

K = list(KEY)
BATCH_ROWS = 100_000
"""Rows that a task hands on at once."""


def simple_arcs(edges: DataFrame, on_duplicate: str = "last") -> DataFrame:
    """One arc per (source, target).

    Of repeated arcs, read by falling weight, the last one's attributes hold: those of
    the smallest weight. ``on_duplicate="sum"`` adds them up instead.
    """
    edges = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    groups = edges.groupBy(*K, "source", "target")
    if on_duplicate == "sum":
        arcs = groups.agg(F.sum("weight").alias("weight"), F.sum("sum_toxicity").alias("sum_toxicity"))
        return arcs.withColumn("avg_toxicity", F.try_divide("sum_toxicity", "weight"))
    kept = F.min(F.struct("weight", "sum_toxicity", "avg_toxicity")).alias("kept")
    return groups.agg(kept).select(*K, "source", "target", "kept.*")


def node_set(arcs: DataFrame) -> DataFrame:
    """Distinct sources and targets."""
    ends = F.explode(F.array("source", "target")).alias("node_id")
    return arcs.select(*K, ends).distinct()


def undirected_pairs(arcs: DataFrame, weight: str = "max", loops: bool = False, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Unordered pairs (a ≤ b) with flags for the two directions.

    The weight is that of the heavier arc, or with ``weight="sum"`` of both.
    """
    merged = F.sum("weight") if weight == "sum" else F.max("weight")
    pairs = (arcs.groupBy(*keys, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
             .agg(merged.alias("weight"),
                  F.max(F.when(F.col("source") <= F.col("target"), 1).otherwise(0)).alias("forward"),
                  F.max(F.when(F.col("source") >= F.col("target"), 1).otherwise(0)).alias("backward")))
    return pairs if loops else drop_selfloops(pairs)


def drop_selfloops(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("a") != F.col("b"))


def induced(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs with both ends in ``nodes``; ``arcs`` should be settled."""
    for end in ("source", "target"):
        arcs = hot_join(arcs, nodes.select(*K, F.col("node_id").alias(end)), [*K, end], "left_semi")
    return arcs


class Links:
    """Adjacency (``keys`` … ``node_id``, ``other``, …) laid out by node for message passing.

    A node whose links exceed ``slot_rows`` is split over several slots, and its messages
    are copied to each, so that no task receives more than about ``slot_rows`` links of a hub.
    """

    def __init__(self, links: DataFrame, slot_rows: int = SLOT_ROWS, keys: tuple[str, ...] = ("node_id",)):
        self.keys = list(keys)
        self.hot = hot_keys(links, self.keys, slot_rows)
        self.on = self.keys if self.hot is None else [*self.keys, SLOT]
        self.frame = split(links, self.keys, self.hot).repartition(width(links.sparkSession), *self.on).persist()

    def send(self, state: DataFrame) -> DataFrame:
        """Rows of ``state`` copied along their node's links: adds ``other`` and the link's columns."""
        return replicate(state, self.keys, self.hot).join(self.frame, self.on).drop(SLOT)

    def close(self) -> None:
        self.frame.unpersist()


class GraphSet:
    """Graphs of all months, with the frames that several metrics share.

    Graphs and nodes get numbers: ``gid`` and a node number that is unique over all graphs
    and rises with (graph, month, node id). Loops and triangle counts move these numbers
    only; ``named`` puts the names back. Frames are written once, on first use; ``close``
    frees the cached adjacency.

    Graphs of at most ``task_links`` arcs (four slots if not given) go to one task each where a metric
    has a solver for that (``in_tasks``); larger ones, all with 0, are worked on in rounds over all tasks.
    """

    def __init__(self, edges: DataFrame, on_duplicate: str = "last", slot_rows: int = SLOT_ROWS, task_links: int | None = None):
        self.slot_rows = slot_rows
        self.task_links = 4 * slot_rows if task_links is None else task_links
        self.arcs = settle(simple_arcs(edges, on_duplicate), "arcs")
        self._links: dict[str, Links] = {}
        self._results: dict[object, DataFrame] = {}
        self._together: dict[tuple, DataFrame] = {}
        self._larger: GraphSet | None = None

    def once(self, name: object, make: Callable[[], DataFrame]) -> DataFrame:
        """A result that several metrics rest on, computed and written on first use."""
        if name not in self._results:
            made = make()
            written = any(made is found for found in self._together.values())
            self._results[name] = made if written else settle(made, "result")
        return self._results[name]

    def __enter__(self) -> GraphSet:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for links in self._links.values():
            links.close()
        self._links.clear()
        if self._larger is not None:
            self._larger.close()

    @cached_property
    def _by_task(self) -> tuple[DataFrame | None, GraphSet | None]:
        """Arcs of the graphs that one task holds, and a set of the larger ones; either may be missing."""
        loads = settle(self.arcs.na.drop(subset=K).groupBy(*K).agg(F.count(F.lit(1)).alias("links")), "loads")
        small = F.col("links") <= self.task_links
        graphs, fit = loads.agg(F.count(F.lit(1)), F.count_if(small)).first()
        # By the number of graphs, since what counts is the work in a group, not its bytes.
        self._tasks = max(64, width(self.arcs.sparkSession), min(fit, 256))
        if fit == graphs:
            return self.arcs.na.drop(subset=K), None
        self._larger = GraphSet(with_small(self.arcs, loads.where(~small).select(*K), K, rows=graphs - fit), "last", self.slot_rows, 0)
        return with_small(self.arcs, loads.where(small).select(*K), K, rows=fit) if fit else None, self._larger

    def in_tasks(self, solve: Callable[..., dict], fields: str, rounds: Callable[[GraphSet], DataFrame], *settings,
                 origins: DataFrame | None = None, per_graph: bool = False) -> DataFrame:
        """A metric by ``solve`` (of ``whole``) in one task per graph, and by ``rounds`` for graphs beyond ``task_links``.

        ``fields`` are the solver's columns after graph and month; ``origins`` are nodes that it gets marked, with their ``label`` if they have one.
        A solver may yield its rows in parts, which are then handed on one by one. ``per_graph`` adds a row of nulls for each graph without id or month, as ``by_graph`` does for graphs without a row.
        """
        if self.task_links <= 0:
            return rounds(self)
        if per_graph:
            keyless = self.arcs.where(F.col(K[0]).isNull() | F.col(K[1]).isNull()).select(*K).distinct()
            return self.in_tasks(solve, fields, rounds, *settings, origins=origins).unionByName(keyless, allowMissingColumns=True)
        small, larger = self._by_task
        if small is None:
            return rounds(larger)
        found = self._together.get((solve, settings))
        if found is None:
            names = [f.name for f in T.StructType.fromDDL(fields)]

            def solved(table: pa.Table) -> Iterator[pa.Table]:
                found = solve(table, *settings)
                for part in [found] if isinstance(found, dict) else found:
                    yield pa.table({c: part[c] for c in names})

            found = self._solved(solved, fields, origins)
        return found if larger is None else found.unionByName(rounds(larger).select(*found.columns))

    def in_shares(self, solve: Callable[..., dict], fields: str, rounds: Callable[[GraphSet], DataFrame], weighted: bool) -> DataFrame:
        """``in_tasks`` for searches from all nodes, whose work is that of links times nodes: a graph's components and origins go to many tasks.

        ``solve`` gets each share (``whole.shares``) as a graph with its origins marked. A node has a row from every share that has links of its own.
        """
        if self.task_links <= 0:
            return rounds(self)
        small, larger = self._by_task
        if small is None:
            return rounds(larger)
        names = [f.name for f in T.StructType.fromDDL(fields)]
        work, keys = whole.SHARE_WORK, small.select(*K).schema
        links = T.StructType.fromDDL("share int, source string, target string, weight double")

        def dealt(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, share in enumerate(whole.shares(whole.Graph(pa.Table.from_batches(batches)), weighted, work)):
                rows = len(share["source"])
                named = {**{k: pa.repeat(v, rows) for k, v in zip(K, key)}, "share": pa.repeat(pa.scalar(i, pa.int32()), rows), **share}
                yield from pa.table(named).to_batches(BATCH_ROWS)

        def solved(key: tuple, table: pa.Table) -> pa.Table:
            found = solve(table, weighted)
            return pa.table({**{k: pa.repeat(v, len(found[names[0]])) for k, v in zip(K, key)}, **{c: found[c] for c in names}})

        graphs = small.select(*K, "source", "target", "weight").repartition(self._tasks, *K).groupBy(*K)
        rows = graphs.applyInArrow(dealt, T.StructType([*keys, *links]))
        shares = rows.repartition(max(256, width(small.sparkSession)), *K, "share").groupBy(*K, "share")
        found = shares.applyInArrow(solved, T.StructType([*keys, *T.StructType.fromDDL(fields)]))
        return found if larger is None else found.unionByName(rounds(larger).select(*found.columns))

    def solve_together(self, *parts: tuple[Callable[..., dict], str, tuple], origins: DataFrame | None = None) -> None:
        """Let solvers, each with its columns and settings, share one pass over the graphs that a task holds; ``in_tasks`` then finds their rows written.

        ``origins`` must be nodes of the graphs. Solvers that need other origins do not belong together.
        """
        parts = [p for p in parts if (p[0], p[2]) not in self._together]
        if self.task_links <= 0 or not parts or self._by_task[0] is None:
            return
        columns = [T.StructType.fromDDL(fields) for _, fields, _ in parts]
        every = {f.name: f for f in [T.StructField("part", T.IntegerType()), *[f for c in columns for f in c]]}
        schema, solvers = T.StructType([*every.values()]), [(solve, settings) for solve, _, settings in parts]
        empty = to_arrow_schema(schema).empty_table()

        def solved(table: pa.Table) -> Iterator[pa.Table]:
            yield pa.concat_tables([empty, whole.together(table, solvers)], promote_options="permissive").select(empty.column_names)

        found = settle(self._solved(solved, schema, origins), "together")
        for i, ((solve, _, settings), own) in enumerate(zip(parts, columns), 1):
            rows = found.where(F.col("part") == (0 if "node_id" in own.names else i))
            self._together[solve, settings] = rows.select(*K, *own.names)

    def _solved(self, solve: Callable[[pa.Table], Iterator[pa.Table]], fields: str | T.StructType, origins: DataFrame | None) -> DataFrame:
        """Rows of ``solve`` for each graph that a task holds."""
        small, larger = self._by_task
        rows = small.select(*K, "source", "target", "weight")
        if origins is not None:
            labels = [c for c in ("label",) if c in origins.columns]
            marks = origins.select(*K, F.col("node_id").alias("source"), F.lit(None).cast("string").alias("target"),
                                   F.lit(None).cast(rows.schema["weight"].dataType).alias("weight"), *labels)
            rows = rows.select("*", *[F.lit(None).cast(origins.schema[c].dataType).alias(c) for c in labels])
            rows = rows.unionByName(marks if larger is None else with_small(marks, settle(small.select(*K).distinct()), K, "left_semi"))
        schema = T.StructType([*small.select(*K).schema, *(T.StructType.fromDDL(fields) if isinstance(fields, str) else fields)])

        def solved(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in solve(pa.Table.from_batches(batches)):
                rows = {**{k: pa.repeat(v, found.num_rows) for k, v in zip(K, key)}, **{c: found[c] for c in found.column_names}}
                yield from pa.table(rows).to_batches(BATCH_ROWS)

        groups = rows.repartition(self._tasks, *K).groupBy(*K)
        return groups.applyInArrow(solved, schema)

    @cached_property
    def graphs(self) -> DataFrame:
        """Graph, month and ``gid``."""
        return settle(self.arcs.select(*K).distinct().orderBy(*K).withColumn("gid", F.monotonically_increasing_id()), "graphs")

    @cached_property
    def months(self) -> int:
        """Number of graphs."""
        return self.graphs.count()

    @cached_property
    def numbered(self) -> DataFrame:
        """Graph, month, node id, ``gid`` and node number ``vid``: rows of a global sort, numbered in order."""
        nodes = with_small(node_set(self.arcs), self.graphs, K, rows=self.months)
        return settle(nodes.orderBy("gid", "node_id").withColumn("vid", F.monotonically_increasing_id()), "nodes")

    @property
    def nodes(self) -> DataFrame:
        """Graph, month and node id."""
        return self.once("names", lambda: node_set(self.arcs.na.drop(subset=K)))

    @cached_property
    def node_rows(self) -> int:
        return self.numbered.count()

    @property
    def ids(self) -> DataFrame:
        """``gid`` and ``node_id`` as numbers."""
        return self.numbered.select("gid", F.col("vid").alias("node_id"))

    @cached_property
    def arc_rows(self) -> int:
        return self.arcs.count()

    @cached_property
    def coded(self) -> DataFrame:
        """Arcs between node numbers."""
        arcs = self.arcs.select(*K, "source", "target", "weight")
        for end in ("source", "target"):
            one = self.numbered.select(*K, F.col("node_id").alias(end), F.col("vid").alias(f"{end}_vid"), F.col("gid").alias(f"{end}_gid"))
            arcs = hot_join(arcs, one, [*K, end], rows=self.arc_rows, slot_rows=self.slot_rows)
        return settle(arcs.select(F.col("source_gid").alias("gid"), F.col("source_vid").alias("source"),
                                  F.col("target_vid").alias("target"), "weight"), "coded")

    @cached_property
    def pairs(self) -> DataFrame:
        """Undirected pairs of node numbers, self-loops included (``a = b``)."""
        return settle(undirected_pairs(self.coded, keys=("gid",), loops=True), "pairs")

    @property
    def simple_pairs(self) -> DataFrame:
        """Undirected pairs of node numbers without self-loops."""
        return drop_selfloops(self.pairs)

    def join_month(self, df: DataFrame, per_month: DataFrame, how: str = "inner") -> DataFrame:
        """Join a frame with one row per graph to any other frame, by graph and month or by ``gid``."""
        on = ["gid"] if "gid" in per_month.columns else K
        return with_small(df, per_month, on, how, self.months)

    def by_graph(self, per_gid: DataFrame, how: str = "inner") -> DataFrame:
        """One row per graph: ``gid`` gives way to graph and month; ``how="right"`` keeps graphs without a row."""
        return (with_small(per_gid, self.graphs, ["gid"], rows=self.months) if how == "inner" else per_gid.join(self.graphs, "gid", how)).select(
            *K, *[c for c in per_gid.columns if c != "gid"])

    def named(self, df: DataFrame, *labels: str) -> DataFrame:
        """Names for ``node_id`` and for ``labels`` that hold node numbers."""
        rest = [c for c in df.columns if c not in ("gid", "node_id")]
        out = df.select("node_id", *rest).join(
            self.numbered.select(F.col("vid").alias("node_id"), *K, F.col("node_id").alias("name")), "node_id")
        out = out.select(*K, F.col("name").alias("node_id"), *rest)
        for label in labels:
            one = self.numbered.select(F.col("vid").alias(label), F.col("node_id").alias("name"))
            out = hot_join(out, one, [label], rows=self.node_rows, slot_rows=self.slot_rows).select(
                *[F.col("name").alias(c) if c == label else F.col(c) for c in out.columns])
        return out

    def numbers_of(self, df: DataFrame) -> DataFrame:
        """The reverse of ``named`` for a frame with one row per node."""
        rest = [c for c in df.columns if c not in (*K, "node_id")]
        return df.join(self.numbered, [*K, "node_id"]).select("gid", F.col("vid").alias("node_id"), *rest)

    def _kept(self, name: str, links) -> Links:
        if name not in self._links:
            self._links[name] = Links(links(), self.slot_rows)
        return self._links[name]

    @property
    def out_links(self) -> Links:
        """From source to target."""
        return self._kept("out", lambda: self.coded.select(F.col("source").alias("node_id"), F.col("target").alias("other"), "weight"))

    @property
    def in_links(self) -> Links:
        """From target back to source."""
        return self._kept("in", lambda: self.coded.select(F.col("target").alias("node_id"), F.col("source").alias("other"), "weight"))

    @property
    def pair_links(self) -> Links:
        """Both ways along the undirected pairs."""
        return self._kept("pair", lambda: self.simple_pairs.select(both_ways()))


def both_ways():
    """A pair (a, b) as two links."""
    return F.inline(F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("other")),
                            F.struct(F.col("b").alias("node_id"), F.col("a").alias("other"))))
