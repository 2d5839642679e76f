"""Graph operators over edges (src, dst): degrees, PageRank, components, searches, betweenness, communities, paths.

Loops write their state to the shared folder by a `store` function given by the caller, so
that lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Store = Callable[[DataFrame], DataFrame]
DAMPING = 0.85
#: Graphs with more nodes are not gathered for kernels that need the whole graph in memory (betweenness, communities).
MOST_NODES, MOST_EDGES = 1_000_000, 20_000_000
#: Starts that walk together in reach().
BITS = 62


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours once: a < b."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, indeg, outdeg, degree."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def pagerank(edges: DataFrame, store: Store, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """node, pr: power iteration from 1/n, the ranks of nodes without out-edges spread evenly.

    Ends when the ranks change by less than n * tolerance in all (no such test with None), or after `rounds`.
    A node's successors are one row, so that a round deals nodes, not edges, to their ranks.
    """
    links = store(edges.groupBy("src").agg(F.collect_list("dst").alias("to")))
    state = nodes(edges).join(links.select(F.col("src").alias("node"), F.size("to").alias("outdeg")), "node", "left")
    state = store(state.select("node", F.coalesce("outdeg", F.lit(0)).alias("outdeg")))
    n = state.count()
    if not n:
        return state.select("node", F.lit(0.0).alias("pr"))
    state = state.withColumn("pr", F.lit(1.0 / n))
    for _ in range(rounds):
        given = links.join(state.where("outdeg > 0").select(F.col("node").alias("src"), (F.col("pr") / F.col("outdeg")).alias("g")), "src").select(F.explode("to").alias("node"), "g").groupBy("node").agg(F.sum("g").alias("g"))
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("outdeg") == 0, F.col("pr"))), F.lit(0.0)).alias("lost"))
        fresh = state.select("node", "outdeg", F.col("pr").alias("before")).join(given, "node", "left").crossJoin(F.broadcast(lost))  # one row
        state = store(fresh.select("node", "outdeg", "before", (F.lit((1 - DAMPING) / n) + DAMPING * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / n)).alias("pr")))
        if tolerance is not None and state.agg(F.sum(F.abs(F.col("pr") - F.col("before")))).first()[0] < n * tolerance:
            break
    return state.select("node", "pr")


def components(edges: DataFrame, store: Store) -> DataFrame:
    """node, component (its smallest node), by labels that spread to neighbours and jump to their own label's."""
    both = store(both_ways(edges))
    state = store(nodes(edges).select("node", F.col("node").alias("component")))
    while True:
        near = both.join(state.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("m"))
        low = state.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("was"))
        jump = low.select(F.col("node").alias("c"), F.col("c").alias("further"))
        after = store(low.join(jump, "c", "left").select("node", F.least("c", F.coalesce("further", "c")).alias("component"), "was"))
        if after.where("component <> was").isEmpty():
            return after.select("node", "component")
        state = after.select("node", "component")


def bounded_search(edges: DataFrame, starts: DataFrame, cutoff: int, store: Store) -> DataFrame:
    """start, node, distance, parent: every node within `cutoff` undirected steps of each start (distinct starts, together).

    Of several shortest paths the one by the smallest parent counts.
    """
    both = store(both_ways(edges))
    seen = frontier = store(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")).distinct())
    for d in range(1, cutoff + 1):
        step = frontier.join(both.withColumnRenamed("src", "node"), "node").groupBy("start", F.col("dst").alias("node")).agg(F.min("node").alias("parent"))
        frontier = store(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(d).alias("distance"), "parent"))
        seen = store(seen.unionByName(frontier))
    return seen


def reach(edges: DataFrame, starts: DataFrame, cutoff: int, store: Store) -> DataFrame:
    """start, node, distance as of bounded_search, without parents.

    BITS starts make a block and walk together: a row per node and block has a bit per start that has come there, so that
    an edge is passed once for a whole block and only what comes out has a row per start.
    """
    both = store(both_ways(edges))
    starts = store(starts.select("start").distinct().withColumn("_id", F.monotonically_increasing_id()))
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    starts = starts.select("start", (F.shiftleft(F.shiftright("_id", 33), 31) + F.floor(place / BITS)).alias("block"), (place % BITS).cast("int").alias("bit"))
    fresh = seen = store(starts.groupBy(F.col("start").alias("node"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    levels = [fresh]
    for d in range(1, cutoff + 1):
        step = fresh.join(both.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
        new = step.join(seen.withColumnRenamed("bits", "old"), ["node", "block"], "left").select("node", "block", F.expr("bits & ~coalesce(old, 0L)").alias("bits"))
        fresh = store(new.where("bits <> 0"))
        levels.append(fresh)
        if d < cutoff:
            seen = store(seen.unionByName(fresh).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))
    out = None
    for d, level in enumerate(levels):
        one = level.join(starts, "block").where("shiftright(bits, bit) & 1 = 1").select("start", "node", F.lit(d).alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


def distances(edges: DataFrame, pairs: DataFrame, cutoff: int, store: Store) -> DataFrame:
    """a, b, distance of the distinct pairs (a, b) that are at most `cutoff` undirected steps apart.

    Neighbours are found by a join. For the others the end with more neighbours walks, with BITS such ends in a row as in
    reach(), and the other end asks its neighbours, so that the last step is taken for the pairs only. Ends
    whose pairs are all found walk no further.
    """
    near = store(both_ways(edges))
    pairs = store(pairs.select("a", "b").distinct())
    out = pairs.where("a = b").join(nodes(near).withColumnRenamed("node", "a"), "a", "left_semi").select("a", "b", F.lit(0).alias("distance"))
    of_pair = near.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    out = out.unionByName(pairs.join(of_pair, ["a", "b"], "left_semi").withColumn("distance", F.lit(1)))
    size = near.groupBy("src").agg(F.count("*").alias("n"))
    rest = pairs.where("a <> b").join(of_pair, ["a", "b"], "left_anti")
    for c in ("a", "b"):
        rest = rest.join(size.select(F.col("src").alias(c), F.col("n").alias(f"n_{c}")), c)
    wide = F.col("n_a") > F.col("n_b")
    rest = store(rest.select("a", "b", F.when(wide, F.col("a")).otherwise(F.col("b")).alias("end"), F.when(wide, F.col("b")).otherwise(F.col("a")).alias("node")))
    ends = store(rest.select("end").distinct().withColumn("_id", F.monotonically_increasing_id()))
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    ends = ends.select("end", (F.shiftleft(F.shiftright("_id", 33), 31) + F.floor(place / BITS)).alias("block"), (place % BITS).cast("int").alias("bit"))
    rest = store(rest.join(ends, "end"))
    fresh = seen = store(ends.groupBy(F.col("end").alias("node"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    for d in range(2, cutoff + 1):
        if rest.isEmpty():
            break
        alive = rest.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("alive"))
        going = fresh.join(alive, "block").select("node", "block", F.expr("bits & alive").alias("bits")).where("bits <> 0")
        step = going.join(near.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
        new = step.join(seen.withColumnRenamed("bits", "old"), ["node", "block"], "left").select("node", "block", F.expr("bits & ~coalesce(old, 0L)").alias("bits"))
        fresh = store(new.where("bits <> 0"))
        seen = store(seen.unionByName(fresh).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))
        asked = rest.select("a", "b", "block", "bit", F.col("node").alias("src")).join(near, "src").select("a", "b", "block", "bit", F.col("dst").alias("node"))
        hit = store(asked.join(fresh, ["node", "block"]).where("shiftright(bits, bit) & 1 = 1").select("a", "b").distinct())
        out = out.unionByName(hit.withColumn("distance", F.lit(d)))
        rest = store(rest.join(hit, ["a", "b"], "left_anti"))
    return out


def numbered(edges: DataFrame) -> tuple[int, DataFrame, DataFrame]:
    """How many nodes, (node, id) from 0 by name, distinct (src, dst, s, d) with the ids of both; refused beyond MOST_NODES or MOST_EDGES."""
    known, pairs = nodes(edges), edges.select("src", "dst").distinct()
    n = known.count()
    if n > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes: the kernel holds the whole graph in each task; take pivots of a smaller part")
    if pairs.count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges: the kernel holds the whole graph in each task")
    ids = known.select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("int").alias("id"))  # MOST_NODES rows at most
    of_src, of_dst = (ids.select(F.col("node").alias(c), F.col("id").alias(i)) for c, i in (("src", "s"), ("dst", "d")))
    return n, ids, pairs.join(of_src, "src").join(of_dst, "dst").select("src", "dst", "s", "d")


def gathered(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ends of numbered edges: eight bytes each, no names."""
    table = pairs.select("s", "d").toArrow()
    return table["s"].to_numpy().astype(np.int32), table["d"].to_numpy().astype(np.int32)


class Adjacency:
    """Out-neighbours in rows: those of node i are to[first[i]:first[i + 1]]."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        order = np.lexsort((dst, src))
        self.n, self.to = n, dst[order]
        self.first = np.searchsorted(src[order], np.arange(n + 1))

    def out_of(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges (from, to, place in self.to) that leave the nodes of a level."""
        counts = self.first[level + 1] - self.first[level]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[level] - ends + counts, counts)
        return np.repeat(level, counts), self.to[at], at

    def keys(self) -> np.ndarray:
        """from * n + to of every edge, by its place."""
        return np.repeat(np.arange(self.n), np.diff(self.first)) * self.n + self.to

    def dependencies(self, start: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Brandes' sums of one source, level by level: per node, and per edge (place, share)."""
        distance, paths, delta = np.full(self.n, -1), np.zeros(self.n), np.zeros(self.n)
        distance[start], paths[start] = 0, 1
        level, levels, d = np.array([start]), [], 0
        while len(level):
            a, b, at = self.out_of(level)
            distance[np.unique(b[distance[b] < 0])] = d + 1
            good = distance[b] == d + 1
            a, b, at = a[good], b[good], at[good]
            np.add.at(paths, b, paths[a])
            levels.append((a, b, at))
            level, d = np.unique(b), d + 1
        edges = []
        for a, b, at in reversed(levels):
            share = paths[a] / paths[b] * (1 + delta[b])
            np.add.at(delta, a, share)
            edges.append((at, share))
        delta[start] = 0
        return delta, edges


def betweenness(edges: DataFrame, tasks: int, pivots: int | None = None, of_edges: bool = False) -> DataFrame:
    """node, bc (or src, dst, bc): share of shortest paths, over all sources or `pivots` of them.

    Normalised by (n - 1)(n - 2), or n(n - 1) for edges, and by the share of sources taken.
    Sources are rows dealt over tasks that each hold the graph and give partial sums. The driver sees
    the graph's numbers once, to send them to the tasks; names stay in Spark.
    """
    spark = edges.sparkSession
    n, ids, pairs = numbered(edges)
    held = spark.sparkContext.broadcast(Adjacency(n, *gathered(pairs)))  # bounded by MOST_EDGES
    order = spark.range(n).orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id").limit(pivots) if pivots and pivots < n else spark.range(n)
    taken = min(pivots or n, n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = held.value
        total = np.zeros(len(graph.to) if of_edges else graph.n)
        for f in frames:
            for start in f["id"]:
                delta, shares = graph.dependencies(int(start))
                if of_edges:
                    for at, share in shares:
                        total[at] += share  # an edge leaves one level only
                else:
                    total += delta
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": graph.keys()[at] if of_edges else at, "s": total[at]})

    sums = order.repartition(tasks).mapInPandas(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
    scale = (n / max(1, taken)) / max(1, n * (n - 1) if of_edges else (n - 1) * (n - 2))
    bc = (F.coalesce("s", F.lit(0.0)) * scale).alias("bc")
    if of_edges:
        return pairs.withColumn("at", F.col("s").cast("long") * n + F.col("d")).drop("s", "d").join(sums, "at", "left").select("src", "dst", bc)
    return ids.withColumnRenamed("id", "at").join(sums, "at", "left").select("node", bc)


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """n_edges, intra, inter, modularity of a partition (node, community) of the undirected graph."""
    und = undirected(edges)
    placed = und.join(partition.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(partition.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    counts = placed.agg(F.count("*").alias("n_edges"), F.count_if(F.col("ca") == F.col("cb")).alias("intra"))
    weight = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k")).join(partition, "node").groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    out = counts.crossJoin(weight)  # one row each
    m = F.greatest("n_edges", F.lit(1))
    return out.select("n_edges", "intra", (F.col("n_edges") - F.col("intra")).alias("inter"), (F.col("intra") / m - F.coalesce("kk", F.lit(0)) / (4 * m * m)).alias("modularity"))


def communities(edges: DataFrame, local_moves: bool = False) -> DataFrame:
    """node, community (numbered by falling size, then by its first name) by greedy modularity.

    local_moves: nodes move to the neighbouring community that gains most before communities
    are merged, as in Louvain's method. One join after another: a single task holds the graph, up to MOST_EDGES, and not the driver.
    """
    n, ids, pairs = numbered(edges)

    def merge(links: dict[int, dict[int, float]], strength: dict[int, float], total: float) -> dict[int, int]:
        """Greedy agglomeration: the join with the largest gain in modularity, until none gains."""
        owner = {i: i for i in strength}
        gain = lambda a, b: links[a][b] / total - strength[a] * strength[b] / (2 * total * total)
        heap = [(-gain(a, b), a, b) for a in links for b in links[a] if a < b]
        heapq.heapify(heap)
        while heap:
            g, a, b = heapq.heappop(heap)
            if a not in strength or b not in strength or b not in links[a] or g != -gain(a, b):
                continue
            if g >= 0:
                break
            if len(links[a]) < len(links[b]):
                a, b = b, a
            for c, w in links.pop(b).items():
                links[c].pop(b)
                if c != a:
                    links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
            strength[a] += strength.pop(b)
            owner[b] = a
            for c in links[a]:
                heapq.heappush(heap, (-gain(a, c), min(a, c), max(a, c)))

        def root(i: int) -> int:
            while owner[i] != i:
                owner[i] = i = owner[owner[i]]
            return i

        return {i: root(i) for i in owner}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = list(range(n))  # one object a node, however many edges it has
        links: list[dict[int, float]] = [{} for _ in number]
        for f in frames:
            for a, b in zip(f["s"].to_numpy(), f["d"].to_numpy()):
                if a != b:
                    links[a][number[b]] = links[b][number[a]] = 1.0
        degree = [float(len(x)) for x in links]
        total = max(1.0, sum(degree) / 2)
        place = list(number)
        if local_moves:
            weight = list(degree)
            moved = True
            while moved:
                moved = False
                for i in number:
                    near: dict[int, float] = defaultdict(float)
                    for j, w in links[i].items():
                        near[place[j]] += w
                    weight[place[i]] -= degree[i]
                    best = max(sorted({*near, place[i]}), key=lambda c: (near.get(c, 0.0) - weight[c] * degree[i] / (2 * total), c == place[i]))
                    moved |= best != place[i]
                    place[i] = best
                    weight[best] += degree[i]
        group: dict[int, dict[int, float]] = defaultdict(dict)
        strength: dict[int, float] = defaultdict(float)
        for i in number:
            strength[place[i]] += degree[i]
            for j, w in links[i].items():
                if place[i] != place[j]:
                    group[place[i]][place[j]] = group[place[i]].get(place[j], 0.0) + w
            links[i] = {}
        root = merge(group, dict(strength), total)
        members: dict[int, list[int]] = defaultdict(list)
        for i in number:
            members[root[place[i]]].append(i)
        ranked = sorted(members.values(), key=lambda m: (-len(m), m[0]))
        yield pd.DataFrame({"id": np.concatenate(ranked or [np.zeros(0, int)]), "community": np.repeat(np.arange(len(ranked)), [len(m) for m in ranked])})

    placed = pairs.select("s", "d").repartition(1).mapInPandas(run, "id int, community long")
    return placed.join(ids, "id").select("node", "community")


def centers(edges: DataFrame, partition: DataFrame, least: int = 3, name: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """community, size, node: the member with most neighbours inside, the first by name on ties, of communities with `least` members."""
    inside = undirected(edges).join(partition.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(partition.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    ends = inside.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    ranked = partition.join(ends, "node", "left").select("community", "node", F.coalesce("k", F.lit(0)).alias("k"))
    best = ranked.groupBy("community").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("k")).alias("k"), name(F.col("node")).alias("name"), "node")).alias("first"))
    return best.where(F.col("size") >= least).select("community", "size", "first.node")


def outward(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """node: those with a neighbour in another community."""
    both = both_ways(edges).join(partition.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src").join(partition.select(F.col("node").alias("dst"), F.col("community").alias("cb")), "dst")
    return both.where("ca <> cb").select(F.col("src").alias("node")).distinct()


# --- paths ------------------------------------------------------------------------------


def expand(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """Simple paths one step longer: paths (nodes, ...) and steps (src, dst, ...)."""
    return paths.withColumn("src", F.element_at("nodes", -1)).join(steps, "src").where(~F.array_contains("nodes", F.col("dst")))


def known_layers(layers: Column) -> Column:
    return F.size(F.array_distinct(F.filter(layers, lambda x: x != "unknown")))


def mine_paths(edges: DataFrame, layers: DataFrame, store: Store, shortest: int = 2, longest: int = 5, cap: int = 50, carry: tuple = (), own: tuple = ()) -> DataFrame:
    """source, hops, pos, nodes, layers, n_layers: per source with a known layer its first `cap`
    simple paths over two layers or more, in the order of a breadth-first search.

    edges: src, dst, first (when the edge was first seen; the order of neighbours). carry: columns of edges that
    `steps`, an array with a struct per step, brings along; own: columns of layers that are the source's own.

    Each level is expanded for sources that are still short of the cap, and no further than the cap asks for: the
    out-degrees of a path's last node by layer say how many good paths it leads to at least, so of a source
    that will reach the cap only its first paths grow, and these by no more than first neighbours of each layer.
    Paths stay with their common beginning as one row (source, nodes, kids) until they are read.
    """
    names = ["unknown", *sorted(r[0] for r in layers.select("layer").distinct().collect() if r[0] not in (None, "unknown"))]
    code = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("layer")).cast("int") - 1, F.lit(0))
    coded = layers.select("node", code.alias("code"), *own)
    say = F.struct(*carry) if carry else F.lit(0)
    steps = edges.join(coded.select(F.col("node").alias("dst"), "code"), "dst", "left").select("src", "first", "dst", F.coalesce("code", F.lit(0)).alias("code"), say.alias("say"))
    steps = store(steps)
    kid = F.struct("first", "dst", "code", "say")
    most = cap + longest  # of a node's neighbours in one layer, the path itself holds fewer than `longest`
    ranked = steps.repartition("src").withColumn("r", F.row_number().over(Window.partitionBy("src", "code").orderBy("first")))
    ahead = ranked.groupBy("src").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= most, kid))).alias("near"), F.count("*").alias("total"), F.array(*[F.count_if(F.col("code") == i) for i in range(len(names))]).alias("by_code"))
    ahead = store(ahead.withColumnRenamed("src", "last"))
    last = F.element_at("nodes", -1)
    single = F.array_max("codes")  # of a path over one layer: that layer
    kinds = F.size(F.array_distinct(F.filter("codes", lambda c: c > 0)))
    good = lambda x: (kinds >= 2) | ((kinds == 1) & (x["code"] > 0) & (x["code"] != single))
    by_pos = Window.partitionBy("source").orderBy("pos")
    before, every = by_pos.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    out = None
    level = coded.select(F.col("node").alias("source"), F.array("node").alias("nodes"), F.array("code").alias("codes"), F.array().cast(f"array<{steps.schema['say'].dataType.simpleString()}>").alias("said"), F.lit(1).cast("long").alias("pos"), F.lit(0).cast("long").alias("had"), *own)
    for hops in range(1, longest + 1):
        if hops < shortest:
            grown = level.withColumn("src", last).join(steps, "src").where(~F.array_contains("nodes", F.col("dst")))
            at = F.col("first") if hops == 1 else F.row_number().over(Window.partitionBy("source").orderBy("pos", "first")).cast("long")
            level = grown.select("source", F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("codes", F.array("code")).alias("codes"), F.concat("said", F.array("say")).alias("said"), at.alias("pos"), "had", *own)
            continue
        rows = level.withColumn("last", last).join(ahead.select("last", "total", "by_code"), "last")
        surely = F.when(kinds >= 2, F.greatest(F.lit(0), F.col("total") - F.size("nodes") + 1)).when(kinds == 1, F.col("total") - F.get("by_code", F.lit(0)) - F.get("by_code", single)).otherwise(0)
        rows = rows.withColumn("surely", surely).withColumn("before", F.col("had") + F.coalesce(F.sum("surely").over(before), F.lit(0))).withColumn("ends", F.col("had") + F.sum("surely").over(every) >= cap)
        rows = rows.where(F.col("before") < cap).drop("by_code", "surely", "total").join(ahead.select("last", "near", "total"), "last")
        new = lambda x: ~F.array_contains("nodes", x["dst"])
        first = F.slice(F.filter("near", lambda x: new(x) & good(x)), F.lit(1), (F.lit(cap) - F.col("before")).cast("int"))
        rows = rows.withColumn("whole", F.size("near") == F.col("total"))
        kept = rows.where("ends OR whole").withColumn("kids", F.when(F.col("ends"), first).otherwise(F.filter("near", new)))
        plain = ["source", "pos", "nodes", "codes", "said", "had", *own]
        rest = rows.where("NOT ends AND NOT whole").select(*plain, F.col("last").alias("src")).join(steps, "src").where(~F.array_contains("nodes", F.col("dst")))
        rest = rest.groupBy(*plain).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        rows = kept.select(*plain, "kids").unionByName(rest.select(*plain, "kids")).withColumn("goods", F.size(F.filter("kids", good)))
        rows = store(rows.withColumn("c", F.col("had") + F.coalesce(F.sum("goods").over(before), F.lit(0))).withColumn("all", F.col("had") + F.sum("goods").over(every)))
        paths = rows.where((F.col("goods") > 0) & (F.col("c") < cap)).select("*", F.posexplode(F.slice(F.filter("kids", good), F.lit(1), (F.lit(cap) - F.col("c")).cast("int"))).alias("i", "kid"))
        paths = paths.withColumns({"nodes": F.concat("nodes", F.array("kid.dst")), "codes": F.concat("codes", F.array("kid.code")), "steps": F.concat("said", F.array("kid.say"))})
        paths = paths.select("source", F.lit(hops).alias("hops"), (F.col("c") + F.col("i") + 1).alias("pos"), "nodes", F.transform("codes", lambda c: F.get(F.array(*map(F.lit, names)), c)).alias("layers"), kinds.alias("n_layers"), *(["steps"] if carry else []), *own)
        out = paths if out is None else out.unionByName(paths)
        open_ = rows.where(F.col("all") < cap)
        if hops == longest or open_.isEmpty():
            break
        grown = open_.select("source", "nodes", "codes", "said", "pos", F.col("all").alias("had"), *own, F.posexplode("kids").alias("i", "kid"))
        at = F.row_number().over(Window.partitionBy("source").orderBy("pos", "i")).cast("long")
        level = store(grown.select("source", F.concat("nodes", F.array("kid.dst")).alias("nodes"), F.concat("codes", F.array("kid.code")).alias("codes"), F.concat("said", F.array("kid.say")).alias("said"), at.alias("pos"), "had", *own))
    return out


def mined_sql(shortest: int = 2, longest: int = 5, cap: int = 50) -> str:
    """The same as CTEs over cl and nl; the last is mined."""
    out = ["fe AS (SELECT src, dst, min(ordinal) AS first, coalesce(any_value(layer), 'unknown') AS dl FROM cl LEFT JOIN nl ON dst = node WHERE src <> dst GROUP BY src, dst)", "l0 AS (SELECT node AS source, [node] AS nodes, [layer] AS layers, 1 AS pos, 0 AS total FROM nl)"]
    for h in range(1, longest + 1):
        out.append(f"g{h} AS MATERIALIZED (SELECT source, list_append(nodes, dst) AS nodes, list_append(layers, dl) AS layers, row_number() OVER (PARTITION BY source ORDER BY pos, first) AS pos, total AS had FROM l{h - 1} JOIN fe ON fe.src = nodes[-1] WHERE NOT list_contains(nodes, dst))")
        good = f"len(list_distinct(list_filter(layers, lambda x: x <> 'unknown'))) >= 2 AND {'TRUE' if h >= shortest else 'FALSE'}"
        out.append(f"c{h} AS (SELECT *, {h} AS hops, {good} AS good, had + sum(CASE WHEN {good} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY pos) AS c, had + sum(CASE WHEN {good} THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS total FROM g{h})")
        out.append(f"l{h} AS (SELECT source, nodes, layers, pos, total FROM c{h} WHERE total < {cap})")
    union = " UNION ALL ".join(f"SELECT source, hops, pos, nodes, layers FROM c{h} WHERE good AND c <= {cap}" for h in range(shortest, longest + 1))
    out.append(f"mined AS MATERIALIZED (SELECT *, array_to_string(nodes, '>') AS path, len(list_distinct(list_filter(layers, lambda x: x <> 'unknown'))) AS n_layers FROM ({union}))")
    return ", ".join(out)


def pagerank_sql(rounds: int) -> str:
    """A fixed number of rounds as CTEs over ed and deg; the last is pr (node, pr)."""
    out = ["pr0 AS (SELECT node, outdeg, 1.0::DOUBLE / (SELECT count(*) FROM deg) AS pr FROM deg)"]
    for i in range(1, rounds + 1):
        b = f"pr{i - 1}"
        out.append(
            f"pr{i} AS MATERIALIZED (SELECT d.node, d.outdeg, {1 - DAMPING}::DOUBLE / (SELECT count(*) FROM deg) + {DAMPING}::DOUBLE * (coalesce(g.g, 0) + (SELECT coalesce(sum(pr), 0) FROM {b} WHERE outdeg = 0) / (SELECT count(*) FROM deg)) AS pr FROM {b} d LEFT JOIN (SELECT dst AS node, sum(pr / outdeg) AS g FROM ed JOIN {b} ON src = node GROUP BY dst) g ON d.node = g.node)"
        )
    out.append(f"pr AS (SELECT node, pr FROM pr{rounds})")
    return ", ".join(out)
