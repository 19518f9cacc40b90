"""Property graphs: node and edge tables, and path patterns as joins on their keys.

An element is struct<id, labels>; a path is two arrays, of node ids and of edge
ids. A quantified step is unrolled to its bounds; TRAIL and ACYCLIC drop paths
as soon as they repeat an edge or a node, so paths don't grow past the mode.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Graph:
    """nodes: label to (table, key); edges: label to (table, key, source key, target key)."""

    nodes: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    edges: dict[str, tuple[DataFrame, str, str, str]] = field(default_factory=dict)

    def match(self, source: tuple[str, Column | None], edge: str, target: tuple[str, Column | None], *, direction: str = "->", optional: bool = False) -> DataFrame:
        """(a)-[e]->(b) with inline conditions: columns a_*, e_*, b_*. OPTIONAL keeps each a."""
        (an, acond), (bn, bcond) = source, target
        a, b, e = self._named(an, "a", acond), self._named(bn, "b", bcond), self.edges[edge]
        rows = e[0].select(*[F.col(c).alias(f"e_{c}") for c in e[0].columns])
        src, dst = (f"e_{e[2]}", f"e_{e[3]}") if direction == "->" else (f"e_{e[3]}", f"e_{e[2]}")
        if direction == "-":
            both = rows.withColumns({"_s": F.col(f"e_{e[2]}"), "_d": F.col(f"e_{e[3]}")})
            back = rows.where(F.col(f"e_{e[2]}") != F.col(f"e_{e[3]}")).withColumns({"_s": F.col(f"e_{e[3]}"), "_d": F.col(f"e_{e[2]}")})
            rows, src, dst = both.unionByName(back), "_s", "_d"
        hop = rows.join(b, F.col(dst) == F.col(f"b_{self.nodes[bn][1]}"))
        out = a.join(hop, F.col(f"a_{self.nodes[an][1]}") == F.col(src), "left" if optional else "inner")
        return out.drop("_s", "_d")

    def _named(self, label: str, name: str, cond: Column | None) -> DataFrame:
        df = self.nodes[label][0]
        df = df if cond is None else df.where(cond)
        return df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])

    def walk(self, edge: str, least: int, most: int, *, mode: str = "WALK", start: DataFrame | None = None, cost: str | None = None) -> DataFrame:
        """Paths of ``least`` to ``most`` edges: head, tail, nodes, edges, cost."""
        table, key, src, dst = self.edges[edge]
        weight = F.col(cost).cast("double") if cost else F.lit(1.0)
        hop = table.select(F.col(src).alias("_from"), F.col(dst).alias("_to"), F.col(key).alias("_edge"), weight.alias("_cost"))
        heads = start if start is not None else hop.select(F.col("_from").alias("id")).union(hop.select(F.col("_to").alias("id"))).distinct()
        now = heads.select(F.col("id").alias("head"), F.col("id").alias("tail"), F.array("id").alias("nodes"), F.array().cast(f"array<{dict(hop.dtypes)['_edge']}>").alias("edges"), F.lit(0.0).alias("cost"))
        found = [now] if least == 0 else []
        for n in range(1, most + 1):
            now = now.join(hop, F.col("tail") == F.col("_from"))
            if mode == "TRAIL":
                now = now.where(~F.array_contains("edges", F.col("_edge")))
            if mode == "ACYCLIC":
                now = now.where(~F.array_contains("nodes", F.col("_to")))
            now = now.select("head", F.col("_to").alias("tail"), F.array_append("nodes", F.col("_to")).alias("nodes"), F.array_append("edges", F.col("_edge")).alias("edges"), (F.col("cost") + F.col("_cost")).alias("cost"))
            if n >= least:
                found.append(now)
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out


    def best(self, edge: str, least: int, most: int, *, cost: str | None = None) -> DataFrame:
        """ANY SHORTEST (without ``cost``) or ANY CHEAPEST walks: head, tail, nodes, edges, cost.

        After every hop one walk is kept for each head and tail, so what is
        held never exceeds the number of pairs.
        """
        table, key, src, dst = self.edges[edge]
        weight = F.col(cost).cast("double") if cost else F.lit(1.0)
        hop = table.select(F.col(src).alias("_from"), F.col(dst).alias("_to"), F.col(key).alias("_edge"), weight.alias("_cost"))
        now = hop.select(F.col("_from").alias("head"), F.col("_to").alias("tail"), F.array("_from", "_to").alias("nodes"), F.array("_edge").alias("edges"), F.col("_cost").alias("cost"))
        found = []
        for n in range(1, most + 1):
            if n > 1:
                now = now.join(hop, F.col("tail") == F.col("_from")).select("head", F.col("_to").alias("tail"), F.array_append("nodes", F.col("_to")).alias("nodes"), F.array_append("edges", F.col("_edge")).alias("edges"), (F.col("cost") + F.col("_cost")).alias("cost"))
            now = _least(now)
            if n >= least:
                found.append(now)
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return _least(out)


def _least(paths: DataFrame) -> DataFrame:
    """One path for each head and tail, by a partial aggregation."""
    rank = F.struct("cost", F.size("edges").alias("size"), "edges", "nodes")
    kept = paths.groupBy("head", "tail").agg(F.min(rank).alias("r"))
    return kept.select("head", "tail", "r.nodes", "r.edges", "r.cost")


def any_path(paths: DataFrame, prefix: str = "ANY SHORTEST") -> DataFrame:
    """One path for each head and tail: of the fewest edges, or (ANY CHEAPEST) of the least cost."""
    key = F.col("cost") if prefix == "ANY CHEAPEST" else F.size("edges")
    w = Window.partitionBy("head", "tail").orderBy(key, F.size("edges"), F.col("edges"))
    return paths.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def path_length(edges: Column) -> Column:
    return F.size(edges).cast("long")


def path_first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def path_last(nodes: Column) -> Column:
    return F.element_at(nodes, -1)


def is_trail(edges: Column) -> Column:
    return F.size(F.array_distinct(edges)) == F.size(edges)


def is_acyclic(nodes: Column) -> Column:
    return F.size(F.array_distinct(nodes)) == F.size(nodes)


def is_simple(nodes: Column) -> Column:
    """Acyclic, but that the ends may be one node."""
    inner = F.when(F.get(nodes, F.lit(0)) == F.element_at(nodes, -1), F.slice(nodes, F.lit(2), F.size(nodes) - 1)).otherwise(nodes)
    return is_acyclic(inner)
