"""Queries that SQL doesn't check, against plain Python over whole small tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import graph, layers, resolve
from ripplegraph.plans import catalog_graph, registry, runtime

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    return runtime.frames(spark, DATA)


def test_every_line_is_a_triple(spark, frames):
    assert frames.kg.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_records_hold_whole_texts(spark, frames):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").collect()}
    for r in frames.records.where("doc is not null").collect():
        assert texts[r.doc_id].replace("\n", " ")[100:] in r.doc


def test_path_audit(spark, frames):
    by_edge = defaultdict(list)
    for r in frames.clean.where("src <> dst").collect():
        by_edge[r.src, r.dst].append(r)
    layer = {r.node: r.layer for r in frames.node_layers.collect()}
    nodes = {r.path_id: r.nodes for r in frames.paths.select("path_id", "nodes").collect()}
    best = sorted((-r.score, r.path_id) for r in frames.scored.collect())[:20]
    want = []
    for _, path in best:
        for step, (a, b) in enumerate(zip(nodes[path], nodes[path][1:]), 1):
            rows = by_edge.get((a, b)) or by_edge.get((b, a)) or []
            top = min(rows, key=lambda r: (-len(r.ev), r.ordinal), default=None)
            short = lambda n: layer[n][0].upper() if n in layer else "?"
            ev = None if top is None else top.ev if len(top.ev) <= 110 else top.ev[:107] + "..."
            want.append((path, step, a, b, len({r.paper_id for r in rows}), f"{short(a)}>{short(b)}", ev, top and top.paper_id))
    got = registry.QUERIES["prov_path_audit"](spark, DATA).select("path_id", "step", "src", "dst", "papers", "shift", "evidence", "paper_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_components_and_betweenness_of_the_whole_graph(spark, frames):
    """Union-find, and Brandes' sums by plain breadth-first search, over every edge."""
    edges = [(r.src, r.dst) for r in frames.edges.select("src", "dst").distinct().collect()]
    owner = {n: n for e in edges for n in e}

    def root(n):
        while owner[n] != n:
            n = owner[n]
        return n

    out = defaultdict(list)
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        owner[y] = x
        out[a].append(b)
    got = {r.node: r.component for r in registry.QUERIES["gr_components"](spark, DATA).collect()}
    smallest = {}
    for n in owner:
        smallest[root(n)] = min(smallest.get(root(n), n), n)
    assert got == {n: smallest[root(n)] for n in owner}

    total = defaultdict(float)
    for s in owner:
        distance, count, order, before = {s: 0}, defaultdict(float, {s: 1.0}), [s], defaultdict(list)
        for v in order:
            for w in out[v]:
                if w not in distance:
                    distance[w] = distance[v] + 1
                    order.append(w)
                if distance[w] == distance[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order[1:]):
            for v in before[w]:
                share[v] += count[v] / count[w] * (1 + share[w])
            total[w] += share[w]
    n = len(owner)
    for r in registry.QUERIES["gr_betweenness"](spark, DATA).collect():
        assert r.bc == pytest.approx(total[r.node] / ((n - 1) * (n - 2)), abs=2e-9)


def test_no_single_merge_of_communities_gains(spark, frames):
    """The greedy partition can't be made better by joining two of its communities; its modularity is that of its definition."""
    edges = {tuple(sorted((r.src, r.dst))) for r in frames.edges.collect() if r.src != r.dst}
    place = {r.node: r.community for r in graph.communities(frames.edges).collect()}
    m = len(edges)
    degree, inside, between = defaultdict(int), defaultdict(int), defaultdict(int)
    for a, b in edges:
        x, y = place[a], place[b]
        degree[x] += 1
        degree[y] += 1
        if x == y:
            inside[x] += 1
        else:
            between[min(x, y), max(x, y)] += 1
    q = sum(inside.values()) / m - sum(d * d for d in degree.values()) / (4 * m * m)
    assert q > 0
    row = registry.QUERIES["gr_communities"](spark, DATA).first()
    assert row.n_edges == m and row.modularity == pytest.approx(q)
    assert all(w / m - degree[x] * degree[y] / (2 * m * m) <= 1e-12 for (x, y), w in between.items())


def test_local_moves_leave_no_node_that_gains(spark):
    """Louvain's first phase on a graph of three clear groups finds them."""
    draw = random.Random(1)
    groups = [[f"{g}{i}" for i in range(12)] for g in "abc"]
    edges = {(x, y) for g in groups for x in g for y in g if x < y and draw.random() < 0.6} | {("a0", "b0"), ("b1", "c1")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    found = defaultdict(set)
    for r in graph.communities(df, local_moves=True).collect():
        found[r.community].add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))


def merged(near, threshold):
    """One free entity after another, by id, absorbs its free neighbours nearer than the threshold."""
    taken, out = set(), {}
    for v in sorted(near):
        if v not in taken:
            taken.add(v)
            for w, sim in near[v]:
                if w not in taken and 1 - sim < threshold:
                    taken.add(w)
                    out[w] = v
    return out


def test_merging_rounds_and_stability(spark, frames):
    import numpy as np

    raw = {r.vec_id: np.array(r.embedding, float) for r in frames.table("embeddings").select("vec_id", "embedding").collect()}

    def near(vectors):
        ids = sorted(vectors)
        sims = np.round(np.stack([vectors[i] for i in ids]) @ np.stack([vectors[i] for i in ids]).T, 9)
        return {v: [(ids[j], row[j]) for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[: runtime.KNN_TOP]] for v, row in zip(ids, sims)}

    first = near(raw)
    owned = lambda rows: {r.entity: r.canonical for r in rows if r.entity != r.canonical}
    assert owned(registry.QUERIES["er_greedy_round"](spark, DATA).collect()) == merged(first, 0.65)
    for r in registry.QUERIES["er_stability"](spark, DATA).collect():
        want = merged(first, r.threshold)
        assert (r.groups, r.merged) in {(len(set(want.values())), len(want)), (len(set(want.values())), len(want) + len(set(want.values())))}

    mapping, current = {}, raw
    for _ in range(3):
        found = merged(near(current), 0.65)
        if not found:
            break
        mapping = {e: found.get(c, c) for e, c in mapping.items()} | found
        groups = defaultdict(list)
        for i, v in raw.items():
            groups[mapping.get(i, i)].append(v)
        current = {c: np.mean(vs, 0) / (np.linalg.norm(np.mean(vs, 0)) or 1.0) for c, vs in groups.items()}
    assert owned(registry.QUERIES["er_multi_round"](spark, DATA).collect()) == {e: c for e, c in mapping.items() if e != c}


def test_showcase_and_table_rows(spark, frames):
    """snk_latex_audit has the rows of the audit, escaped."""
    audit = {(r.path_id, r.step): r for r in registry.QUERIES["prov_path_audit"](spark, DATA).collect()}
    rows = registry.QUERIES["snk_latex_audit"](spark, DATA).collect()
    assert {(r.path_id, r.step) for r in rows} == set(audit)
    for r in rows:
        a = audit[r.path_id, r.step]
        assert r.row.startswith(f"{a.step} & ") and f" & {a.shift} & {a.papers} & " in r.row and (a.paper_id is None or r.row.endswith(a.paper_id))


def test_null_walks_are_counted_whole(spark, frames):
    """st_permutation: one row per sampled path, p from all permutations; gr_random_walk: one row per permutation."""
    from ripplegraph.plans import catalog_stats

    sample = {r.path_id for r in catalog_graph._pair_sample(frames).collect()}
    rows = registry.QUERIES["st_permutation"](spark, DATA).collect()
    assert {r.path_id for r in rows} == sample and len(rows) == len(sample)
    assert all(r.p == pytest.approx((r.exceed + 1) / (catalog_stats.PERMS + 1), abs=1e-6) for r in rows)
    walks = registry.QUERIES["gr_random_walk"](spark, DATA).agg(F.count("*").alias("n"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    assert (walks.n, walks.low, walks.high) == (catalog_stats.PERMS, len(sample), len(sample))
    cut = max((r.p for i, r in enumerate(sorted(rows, key=lambda r: r.p), 1) if r.p <= i / len(rows) * 0.05), default=None)
    assert all(r.significant == (cut is not None and r.p <= cut) for r in rows)


def test_changed_data_gives_new_frames(spark, tmp_path):
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert runtime.frames(spark, str(tmp_path)).table("documents").count() == n
        first = runtime.frames(spark, str(tmp_path))
        assert runtime.frames(spark, str(tmp_path)) is first
    assert layers.LAYERS and resolve.BLOCK
