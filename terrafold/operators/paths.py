"""Shortest paths: set-wise relaxation for all targets, a search kernel for single pairs.

Relaxation joins the rows improved in the last round with the edges and keeps the smaller sums;
it scales with the graph and needs as many rounds as the longest best path has edges. The kernel gets the
adjacency of the graph as a broadcast, if its measured size allows, and serves queries from a
partitioned table. ``backend`` names one of the two; "auto" takes the kernel for graphs of :data:`BROADCAST_EDGES` edges at
most. Both give the same costs, successes and reasons.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.store import drop_stored, stored

#: Edges that a broadcast adjacency may have (8 bytes each, and 36 for each node).
BROADCAST_EDGES = 8_000_000
MAX_ROUNDS = 100_000
BACKENDS = ("auto", "kernel", "relaxation")
#: The reason of a search that expanded too many nodes.
LIMIT = "expansion limit"


def sssp(edges: DataFrame, seeds: DataFrame, limit: float = math.inf, hops: bool = False) -> DataFrame:
    """source, node, dist of everything within ``limit`` of each seed row (source, node).

    With ``hops`` also via: the node before on a best path (the seed's own is itself).
    """
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    names = ["source", "node", "dist", *["via"] * hops]
    best = stored(seeds.select("source", "node").distinct().withColumn("dist", F.lit(0.0)).withColumn("via", F.col("node")).select(*names), "dist")
    front = best
    for _ in range(MAX_ROUNDS):
        reach = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("via"))
        least = [F.min("dist").alias("dist"), *[F.min_by("via", "dist").alias("via")] * hops]
        reach = reach.filter(F.col("dist") <= limit).groupBy("source", "node").agg(*least)
        old = best.select("source", "node", F.col("dist").alias("old"))
        better = stored(reach.join(old, ["source", "node"], "left").filter(F.col("old").isNull() | (F.col("dist") < F.col("old"))).select(*names), "front")
        if better.isEmpty():
            drop_stored(better)
            return best
        now = stored(best.join(better.select("source", "node"), ["source", "node"], "left_anti").unionByName(better), "dist")
        if front is not best:
            drop_stored(front)
        drop_stored(best)
        best, front = now, better
    raise RuntimeError("relaxation did not settle")


def reachable_set(edges: DataFrame, start: int, max_cost: float = math.inf, graph: Graph | None = None) -> DataFrame:
    """node, dist of everything within ``max_cost`` of a node."""
    seeds = edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("source"), F.lit(start).cast("long").alias("node"))
    return distances(edges, seeds, max_cost, graph).select("node", "dist")


def distances(edges: DataFrame, seeds: DataFrame, limit: float = math.inf, graph: Graph | None = None) -> DataFrame:
    """As :func:`sssp`; graphs that may be broadcast are searched by seed in parallel, larger ones relaxed set-wise."""
    shared = (graph or Graph(None, edges)).shared()
    if shared is None:
        return sssp(edges, seeds, limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = shared.value
        for b in batches:
            for source, node in zip(b.source, b.node, strict=True):
                found = k.spread(k.index(int(node)), limit) if k.index(int(node)) is not None else {}
                at = k.ids[list(found)] if found else np.array([node])
                yield pd.DataFrame({"source": int(source), "node": at, "dist": list(found.values()) or [0.0]})

    return seeds.select("source", "node").distinct().mapInPandas(run, "source long, node long, dist double")


def landmarks(edges: DataFrame, nodes: DataFrame, count: int, graph: Graph | None = None) -> DataFrame:
    """landmark_id, node_id, d: distances to ``count`` nodes far from each other in the largest component.

    The first is the free node of that component with the largest x + y; each next one is farthest from all before.
    Every landmark's distances are computed and written once.
    """
    free = nodes.filter("NOT lethal")
    big = free.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").first()
    if big is None or count <= 0:
        return edges.sparkSession.createDataFrame([], "landmark_id int, node_id long, d float")
    pool = free.filter(F.col("component").eqNullSafe(F.lit(big["component"])))
    seed = pool.orderBy(F.desc(F.col("x") + F.col("y")), "node_id").first()["node_id"]
    graph, out = graph or Graph(nodes, edges), None
    for i in range(count):
        rows = reachable_set(edges, seed, graph=graph).select(F.lit(i).alias("landmark_id"), F.col("node").alias("node_id"), F.col("dist").cast("float").alias("d"))
        rows = stored(rows, "landmark")
        out = rows if out is None else out.unionByName(rows)
        if i + 1 < count:
            seed = out.groupBy("node_id").agg(F.min("d").alias("d")).orderBy(F.desc("d"), "node_id").first()["node_id"]
    return out


def landmark_bound(table: DataFrame, goal: int) -> DataFrame:
    """node_id, h: a lower bound of each node's distance to ``goal`` (the largest over landmarks)."""
    at = table.filter(F.col("node_id") == goal).select("landmark_id", F.col("d").cast("double").alias("dg"))
    near = table.join(F.broadcast(at), "landmark_id")  # one row for each landmark
    return near.groupBy("node_id").agg(F.max(F.abs(F.col("dg") - F.col("d").cast("double"))).alias("h"))


class Side:
    """One end's half of a two-sided search."""

    def __init__(self, root: int, guide: memoryview) -> None:
        self.guide, self.cost, self.parent, self.closed = guide, {root: 0.0}, {root: -1}, set()
        self.heap = [(guide[root], root)]

    def settle(self) -> bool:
        """Drops entries that are done with; whether anything is left."""
        while self.heap and self.heap[0][1] in self.closed:
            heapq.heappop(self.heap)
        return bool(self.heap)

    def improve(self, node: int, cost: float, parent: int) -> bool:
        if cost >= self.cost.get(node, math.inf):
            return False
        self.cost[node], self.parent[node] = cost, parent
        heapq.heappush(self.heap, (cost + self.guide[node], node))
        return True


class Kernel:
    """Adjacency in flat arrays with searches on it; holds no Spark objects."""

    def __init__(self, ids: np.ndarray, xyz: np.ndarray, component: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, self.xyz, self.component = ids[order], xyz[order], component[order]
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        by = np.lexsort((d, s))
        self.to, self.w = d[by].astype(np.int32), w[by].astype(np.float32)
        self.at = np.searchsorted(s[by], np.arange(len(ids) + 1)).astype(np.int64)
        self.marks: np.ndarray | None = None

    def marked(self, ids: np.ndarray, landmark: np.ndarray, d: np.ndarray) -> Kernel:
        """The same graph with a row of distances for each landmark."""
        out = copy.copy(self)
        out.marks = np.full((int(landmark.max()) + 1 if len(landmark) else 0, len(self.ids)), np.inf, np.float32)
        out.marks[landmark, np.searchsorted(self.ids, ids)] = d
        return out

    def arrays(self) -> tuple[memoryview, memoryview, memoryview]:
        return memoryview(self.at), memoryview(self.to), memoryview(self.w)

    def index(self, node: int | None) -> int | None:
        if node is None:
            return None
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else None

    def heuristic(self, goal: int, weight: float) -> np.ndarray:
        if weight <= 0:
            return np.zeros(len(self.ids))
        h = np.sqrt(((self.xyz - self.xyz[goal]) ** 2).sum(axis=1))
        if self.marks is not None and len(self.marks):
            with np.errstate(invalid="ignore"):
                at = self.marks[:, goal : goal + 1].astype(float)
                bound = np.abs(self.marks - at) - 2.4e-7 * (self.marks + at)  # distances are stored as floats
            h = np.maximum(h, np.nan_to_num(bound, nan=0.0, posinf=0.0, neginf=0.0).max(axis=0))
        return weight * h

    def refuse(self, start: int | None, goal: int | None, prune: bool) -> str | None:
        if start is None or goal is None:
            return "no such node"
        if prune and self.component[start] != self.component[goal]:
            return "not connected"
        return None

    def best_first(self, start: int, goal: int, weight: float, most: int) -> tuple[list[int], float, int, str]:
        if start == goal:
            return [start], 0.0, 0, "ok"
        h = memoryview(self.heuristic(goal, weight))
        at, to, w = self.arrays()
        cost, parent, closed = {start: 0.0}, {start: -1}, set()
        heap, seen = [(h[start], start)], 0
        while heap:
            _, u = heapq.heappop(heap)
            if u in closed:
                continue
            closed.add(u)
            seen += 1
            if u == goal:
                return self.trace(parent, goal), cost[goal], seen, "ok"
            if seen > most:
                return [], math.inf, seen, LIMIT
            base = cost[u]
            for e in range(at[u], at[u + 1]):
                v = to[e]
                c = base + w[e]
                if v not in closed and c < cost.get(v, math.inf):
                    cost[v], parent[v] = c, u
                    heapq.heappush(heap, (c + h[v], v))
        return [], math.inf, seen, "unreachable"

    def two_sided(self, start: int, goal: int, weight: float, most: int) -> tuple[list[int], float, int, str]:
        """Best-first search from both ends, each guided towards the other.

        No path cheaper than the best meeting can be left once the least estimate of either side reaches it: each side's
        estimates bound every path from below (``weight`` 1 at most; above, by that factor).
        """
        if start == goal:
            return [start], 0.0, 0, "ok"
        at, to, w = self.arrays()
        sides = [Side(start, memoryview(self.heuristic(goal, weight))), Side(goal, memoryview(self.heuristic(start, weight)))]
        best, meet, seen = math.inf, -1, 0
        while all(x.settle() for x in sides) and max(x.heap[0][0] for x in sides) < best:
            if seen > most:
                return [], math.inf, seen, LIMIT
            own = min(sides, key=lambda x: len(x.heap))
            other = sides[1 - sides.index(own)].cost
            _, u = heapq.heappop(own.heap)
            own.closed.add(u)
            seen += 1
            for e in range(at[u], at[u + 1]):
                v, c = to[e], own.cost[u] + w[e]
                if v not in own.closed and own.improve(v, c, u) and c + other.get(v, math.inf) < best:
                    best, meet = c + other[v], v
        if meet < 0:
            return [], math.inf, seen, "unreachable"
        return self.trace(sides[0].parent, meet) + self.trace(sides[1].parent, meet)[::-1][1:], best, seen, "ok"

    def spread(self, start: int, limit: float) -> dict[int, float]:
        """Distances of all nodes within ``limit``, by their place in ``ids``."""
        at, to, w = self.arrays()
        best, done, heap = {start: 0.0}, {}, [(0.0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = d
            for e in range(at[u], at[u + 1]):
                v, c = to[e], d + w[e]
                if c <= limit and c < best.get(v, math.inf):
                    best[v] = c
                    heapq.heappush(heap, (c, v))
        return done

    @staticmethod
    def trace(parent: dict[int, int], node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = parent[node]
        return out[::-1]

    def search(self, start: int | None, goal: int | None, weight: float, two_sided: bool, most: int, prune: bool) -> tuple[list[int], float, int, bool, str]:
        s, t = self.index(start), self.index(goal)
        if (why := self.refuse(s, t, prune)) is not None:
            return [], math.inf, 0, False, why
        path, cost, seen, why = (self.two_sided if two_sided else self.best_first)(s, t, weight, most)
        return self.ids[path].tolist() if path else [], cost, seen, bool(path), why


class Graph:
    """The graph of a map for searches: its arrays are fetched and broadcast once, if it may be broadcast at all."""

    def __init__(self, nodes: DataFrame | None, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges
        self._kernel: Kernel | None = None
        self._shared: Broadcast | None = None
        self._small: bool | None = None

    def kernel(self) -> Kernel | None:
        if self._small is None:
            self._small = self.edges.count() <= BROADCAST_EDGES
        if self._small and self._kernel is None:
            e = self.edges.select("src", "dst", "w").toPandas()
            src, dst, w = (e[c].to_numpy() for c in ("src", "dst", "w"))
            if self.nodes is None:
                ids = np.unique(np.concatenate([src, dst])) if len(e) else np.empty(0, np.int64)
                self._kernel = Kernel(ids, np.zeros((len(ids), 3)), np.zeros(len(ids)), src, dst, w)
            else:
                n = self.nodes.select("node_id", "x", "y", "z", F.coalesce("component", F.lit(-1)).alias("component")).toPandas()
                self._kernel = Kernel(n.node_id.to_numpy(), n[["x", "y", "z"]].to_numpy(), n.component.to_numpy(), src, dst, w)
        return self._kernel

    def shared(self, marks: DataFrame | None = None) -> Broadcast | None:
        """The kernel, with ``marks`` if given, as a broadcast; None if the graph is too large for one."""
        if (own := self.kernel()) is None:
            return None
        sc = self.edges.sparkSession.sparkContext
        if marks is not None:
            m = marks.toPandas()
            return sc.broadcast(own.marked(m.node_id.to_numpy(), m.landmark_id.to_numpy(), m.d.to_numpy()))
        if self._shared is None:
            self._shared = sc.broadcast(own)
        return self._shared


RESULT = "query_id long, start_id long, goal_id long, path array<long>, cost double, expanded long, success boolean, reason string"


def shortest_paths(
    nodes: DataFrame, edges: DataFrame, queries: DataFrame, weight: float = 1.0, two_sided: bool = False,
    marks: DataFrame | None = None, prune: bool = True, max_expansions: int = 5_000_000, backend: str = "auto", graph: Graph | None = None,
) -> DataFrame:
    """RESULT rows for ``queries`` (query_id, start_id, goal_id; ids may be null: a failure record).

    weight 0 is Dijkstra's search, 1 A*, more a bounded detour. Costs are exact up to weight 1 (infinite
    if there is no path); which of several equally good paths comes back isn't fixed. Searches that expand more than
    ``max_expansions`` nodes fail. See :func:`by_relaxation` for what that backend does with the settings.
    """
    if backend not in BACKENDS:
        raise ValueError(f"backend is one of {', '.join(BACKENDS)}")
    shared = None if backend == "relaxation" else (graph or Graph(nodes, edges)).shared(marks)
    if shared is None:
        if backend == "kernel":
            raise ValueError(f"the graph has over {BROADCAST_EDGES} edges; the kernel can't have it")
        return by_relaxation(edges, queries, nodes, prune, max_expansions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = shared.value
        whole = lambda x: None if pd.isna(x) else int(x)
        for b in batches:
            rows = []
            for q, s, t in zip(b.query_id, b.start_id, b.goal_id, strict=True):
                path, cost, seen, ok, why = k.search(whole(s), whole(t), weight, two_sided, max_expansions, prune)
                rows.append((whole(q), whole(s), whole(t), path, cost, seen, ok, why))
            out = pd.DataFrame(rows, columns=["query_id", "start_id", "goal_id", "path", "cost", "expanded", "success", "reason"])
            yield out.astype({"query_id": "Int64", "start_id": "Int64", "goal_id": "Int64"})

    return queries.select("query_id", "start_id", "goal_id").mapInPandas(run, RESULT)


def by_relaxation(edges: DataFrame, queries: DataFrame, nodes: DataFrame | None = None, prune: bool = True, max_expansions: int = 5_000_000) -> DataFrame:
    """RESULT rows by set-wise relaxation from the goals; costs are exact, so a weight or landmarks have nothing to change.

    ``expanded`` counts the nodes that were reached from the goal, which ``max_expansions`` bounds as it does in a search;
    queries that can't succeed (no such node, not connected under ``prune``) are told so without any relaxation. Without
    ``nodes``, those are the ends of edges, and nothing is pruned.
    """
    if nodes is None:
        part = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct().withColumn("component", F.lit(-1))
    else:
        part = nodes.select("node_id", F.coalesce("component", F.lit(-1)).alias("component"))
    asked = queries.select("query_id", "start_id", "goal_id")
    for end in ("start", "goal"):
        asked = asked.join(part.select(F.col("node_id").alias(f"{end}_id"), F.col("component").alias(f"{end}_part")), f"{end}_id", "left")
    none = F.col("start_part").isNull() | F.col("goal_part").isNull()
    apart = F.lit(prune) & (F.col("start_part") != F.col("goal_part"))
    why = F.when(none, "no such node").when(apart, "not connected").when(F.col("start_id") == F.col("goal_id"), "ok")
    asked = stored(asked.select("query_id", "start_id", "goal_id", why.alias("why")), "asked")
    open_ = asked.filter("why IS NULL")
    dist = sssp(edges, open_.select(F.col("goal_id").alias("source"), F.col("goal_id").alias("node")), hops=True)
    reached = dist.groupBy(F.col("source").alias("goal_id")).agg(F.count(F.lit(1)).alias("expanded"))
    found = open_.join(reached, "goal_id").join(dist.select(F.col("source").alias("goal_id"), F.col("node").alias("start_id"), F.col("dist").alias("cost")), ["goal_id", "start_id"], "left")
    verdict = F.when(F.col("cost").isNull(), "unreachable").when(F.col("expanded") > max_expansions, LIMIT).otherwise("ok")
    found = stored(found.select("query_id", "start_id", "goal_id", verdict.alias("why"), "cost", "expanded"), "relaxed")
    walks = traced(dist, found.filter("why = 'ok'"))
    ok = F.col("why") == "ok"
    with_path = found.join(walks, "query_id", "left")
    told = asked.filter("why IS NOT NULL").select("*", F.when(ok, 0.0).alias("cost"), F.lit(0).cast("long").alias("expanded"), F.when(ok, F.array("start_id")).alias("path"))
    return told.unionByName(with_path).select(
        "query_id", "start_id", "goal_id", F.when(ok, F.col("path")).otherwise(F.array().cast("array<long>")).alias("path"),
        F.when(ok, F.col("cost")).otherwise(F.lit(math.inf)).alias("cost"), "expanded", ok.alias("success"), F.col("why").alias("reason"),
    )


def traced(hops: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, path: nodes from start_id to goal_id (not equal) along ``hops`` (source = the goal, node, via).

    Jumps of 1, 2, 4, ... hops are tabled until the longest reaches every goal; then places are filled in from the longest
    jump down. That is two joins for each doubling, however long the paths.
    """
    ask = queries.select("query_id", F.col("goal_id").alias("source"), F.col("start_id").alias("node"))
    jumps = [stored(hops.join(ask.select("source").distinct(), "source", "left_semi").select("source", "node", F.col("via").alias("to")), "jump")]
    while not ask.join(jumps[-1], ["source", "node"]).filter("to <> source").isEmpty():
        last = jumps[-1]
        twice = last.join(last.select("source", F.col("node").alias("to"), F.col("to").alias("then")), ["source", "to"])
        jumps.append(stored(twice.select("source", "node", F.col("then").alias("to")), "jump"))
    places = stored(ask.withColumn("at", F.lit(0).cast("long")), "places")
    for i in range(len(jumps) - 1, -1, -1):
        more = places.join(jumps[i], ["source", "node"]).filter("to <> source")
        now = stored(places.unionByName(more.select("query_id", "source", F.col("to").alias("node"), (F.col("at") + (1 << i)).alias("at"))), "places")
        drop_stored(places)
        drop_stored(jumps[i])
        places = now
    ordered = places.groupBy("query_id", "source").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("p"))
    return ordered.select("query_id", F.concat(F.transform("p", lambda x: x["node"]), F.array("source")).alias("path"))


def parent_trace(parents: DataFrame, leaves: DataFrame, view: str = "parents") -> DataFrame:
    """leaf, node, step along the parent chain of each leaf; a parent that is null or negative ends it. Chains may be of any length.

    Jumps of 1, 2, 4, ... parents are tabled until no chain is as long; then steps are filled in from the longest jump down, so
    every row of the result is made once. Raises if parents go round in a circle.
    """
    jumps = [stored(parents.filter("parent >= 0").select("node", F.col("parent").alias("to")), "jump")]
    longest = jumps[0].count()
    while not jumps[-1].isEmpty():
        if 1 << (len(jumps) - 1) > longest:
            raise ValueError("the parents go round in a circle")
        last = jumps[-1]
        jumps.append(stored(last.join(last.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to")), "jump"))
    drop_stored(jumps.pop())
    walk = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("step"))
    if jumps:
        walk = stored(walk, "walk")
    for i in range(len(jumps) - 1, -1, -1):
        more = walk.join(jumps[i], "node").select("leaf", F.col("to").alias("node"), (F.col("step") + (1 << i)).alias("step"))
        if i:  # the last rows, half of all, are made where they are read
            more = stored(more, "walk")
            drop_stored(jumps[i])
        walk = walk.unionByName(more)
    return walk


def register_udtf(nodes: DataFrame, edges: DataFrame, name: str = "shortest_path", weight: float = 1.0) -> None:
    """SQL table function ``name(start, goal)``: seq, node_id, cost so far; no rows if there is no path."""
    from pyspark.sql.functions import udtf

    shared = Graph(nodes, edges).shared()
    if shared is None:
        raise ValueError("the graph is too large to be broadcast; use by_relaxation")
    spark = nodes.sparkSession

    class ShortestPath:
        def eval(self, start: int, goal: int):  # noqa: ANN202
            k = shared.value
            path, _, _, _, _ = k.search(start, goal, weight, False, 1 << 60, True)
            at, to, w = k.arrays()
            total, places = 0.0, [k.index(node) for node in path]
            for i, (node, b) in enumerate(zip(path, places, strict=True)):
                if i:
                    a = places[i - 1]
                    total += min(w[e] for e in range(at[a], at[a + 1]) if to[e] == b)
                yield i, node, total

    spark.udtf.register(name, udtf(ShortestPath, returnType="seq int, node_id long, cost double"))
