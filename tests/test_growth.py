"""Steps whose rows have to grow no faster than their input: results by definition, and what is stored on the way."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import benchmark, graph, resolve
from ripplegraph.plans import runtime
from ripplegraph.plans.runtime import stored


@pytest.fixture
def counted():
    """A store that counts the rows it writes."""

    def store(df, what="step"):
        out = stored(df, what)
        store.rows += out.count()
        return out

    store.rows = 0
    return store


def test_pairs_of_large_groups_are_counted_not_made(spark):
    draw = random.Random(3)
    rows = [(draw.choice("xyz"), f"e{i}", draw.choice([1, 2, 3, None])) for i in range(60)]
    members = spark.createDataFrame(rows, "canonical string, entity string, outdeg long")
    value = {e: v for _, e, v in rows}
    pairs = [(a, b) for (c, a, _), (d, b, _) in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2) if c == d]
    yes = sum(value[a] is not None and value[a] == value[b] for a, b in pairs)
    got = resolve.pair_agreement(members, "outdeg").first()
    assert (got.yes, got.no, got.invalid, got.rate) == (yes, len(pairs) - yes, 0, round(yes / len(pairs), 6))
    many = spark.range(2_000_000).select(F.lit("all").alias("canonical"), F.col("id").alias("entity"), (F.col("id") % 2).alias("outdeg"))
    got = resolve.pair_agreement(many, "outdeg").first()
    assert (got.yes, got.no) == (10**6 * (10**6 - 1), 10**12)


def test_pairs_of_a_group_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 7)
    rows = [(c, f"{c}{i}") for c, n in (("x", 40), ("y", 1), ("z", 7)) for i in range(n)]
    got = Counter((r.canonical, r.a, r.b) for r in resolve.group_pairs(spark.createDataFrame(rows, "canonical string, entity string")).collect())
    want = Counter((c, *sorted((a, b))) for (c, a), (d, b) in itertools.combinations(rows, 2) if c == d)
    assert got == want


def test_paths_through_a_hub_are_not_all_made(spark, counted):
    """300 sources, a hub, 300 ends: 90,000 paths of two steps, of which each source keeps 5."""
    pairs = [(f"a{i}", "hub") for i in range(300)] + [("hub", f"z{i}") for i in range(300)]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, first long")
    layers = spark.createDataFrame([(n, {"a": "physical", "h": "social", "z": "economic"}[n[0]]) for n in {x for p in pairs for x in p}], "node string, layer string")
    got = {(r.source, tuple(r.nodes)) for r in graph.mine_paths(edges, layers, counted, cap=5).collect()}
    assert got == {(f"a{i}", (f"a{i}", "hub", f"z{j}")) for i in range(300) for j in range(5)}
    assert counted.rows < 3000


@pytest.mark.parametrize("cap", [3, 20])
def test_mined_paths_with_long_lists_of_one_layer(spark, cap):
    """Sources with few good paths need all of a long list of neighbours of their own layer, not only its first."""
    draw = random.Random(cap)
    names = [f"n{i}" for i in range(60)]
    layer = {n: "social" if draw.random() < 0.06 else "physical" for n in names if draw.random() < 0.9}
    pairs = list(dict.fromkeys([("n0", n) for n in names[1:]] + [("n1", "n0"), ("n2", "n0")] + [(draw.choice(names), draw.choice(names)) for _ in range(25)]))
    pairs = [p for p in pairs if p[0] != p[1]]
    draw.shuffle(pairs)
    edges = spark.createDataFrame([(a, b, i, float(i)) for i, (a, b) in enumerate(pairs)], "src string, dst string, first long, w double")
    found = graph.mine_paths(edges, spark.createDataFrame(list(layer.items()), "node string, layer string"), stored, longest=3, cap=cap, carry=("w",)).collect()
    weight = {p: float(i) for i, p in enumerate(pairs)}
    assert all([s.w for s in r.steps] == [weight[p] for p in zip(r.nodes, r.nodes[1:])] and r.layers == [layer.get(n, "unknown") for n in r.nodes] for r in found)
    want = set()
    for source in layer:
        queue, n = [[source]], 0
        while queue and n < cap:
            path = queue.pop(0)
            if len(path) > 2 and len({layer.get(x) for x in path} - {None}) > 1:
                want.add(tuple(path))
                n += 1
            if len(path) < 4:
                queue += [path + [b] for a, b in pairs if a == path[-1] and b not in path]
    assert {tuple(r.nodes) for r in found} == want and len(found) == len(want)


def test_novel_paths_start_from_known_edges(spark, counted):
    draw = random.Random(5)
    names = [f"n{i:02}" for i in range(30)]
    arcs = sorted({(draw.choice(names), draw.choice(names)) for _ in range(260)})
    arcs = [a for a in arcs if a[0] != a[1]]
    known = set(arcs[::25]) | {(a, b) for a, b in zip(names, names[1:])}
    holdout = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(arcs)], "src string, dst string, ordinal long")
    have = spark.createDataFrame(sorted(known), "src string, dst string")
    out = defaultdict(list)
    for a, b in arcs:
        out[a].append(b)
    for hops in (1, 2, 3):
        paths = [[a] for a in names]
        for _ in range(hops):
            paths = [p + [b] for p in paths for b in out[p[-1]] if b not in p]
        n = lambda p: sum(s in known for s in zip(p, p[1:]))
        want = sorted((tuple(p), n(p)) for p in paths if n(p) > 0 and (n(p) < hops or hops == 1))
        assert sorted((tuple(r.nodes), r.n_known) for r in benchmark.novel_paths(holdout, have, hops, counted).collect()) == want
    assert counted.rows == 3 * len(arcs)  # the steps only, no path that may yet come to nothing


@pytest.mark.parametrize("short, steps", [(1000, 1), (6, 1), (6, 2)])
def test_walks_of_questions(spark, monkeypatch, short, steps):
    """Against plain Python, where the first candidates touch the end, and where the end's list is long."""
    monkeypatch.setattr(benchmark, "SHORT", short)
    draw = random.Random(short)
    names = [f"n{i}" for i in range(40)]
    pairs = {(draw.choice(names), draw.choice(names)) for _ in range(160)} | {("n0", n) for n in names[1:]} | {("n1", n) for n in names[6:30]}
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    questions = [["n0", "n3", "n1"], ["n2", "n0", "n5"], ["n4", "n5", "n0"], ["n7", "n8", "n9"]]
    digest = lambda q, n: (hashlib.md5(f"42|{'>'.join(q)}|{n}".encode()).hexdigest(), n)
    want = {}
    for q in questions:
        walks = [[]]
        for i in range(steps):
            grown = []
            for w in walks:
                new = [n for n in near[(w or q)[-1 if w else 0]] if n not in q and n not in w and (i < steps - 1 or n not in near[q[-1]])]
                grown += [w + [n] for n in sorted(new, key=lambda n: digest(q, n))[:4]]
            walks = grown
        if walks:
            want[tuple(q)] = sorted(walks)
    found = benchmark.walk_candidates(spark.createDataFrame([(q,) for q in questions], "nodes array<string>"), spark.createDataFrame(sorted(pairs), "src string, dst string"), steps, stored, branch=4)
    assert {tuple(r.nodes): sorted(r.seqs) for r in found.collect()} == want


def test_triples_are_stored_in_few_bytes(spark):
    """A raw triple is kept as numbers and flags, an edge as the triple it is made from; their text is made when read."""
    frames = runtime.Frames(spark, "/root/testdata/sf0.001")
    assert {t for c, t in frames.coded.dtypes if c not in ("l_returnflag", "l_linestatus")} <= {"bigint", "int"}
    assert set(frames.chosen.columns) == {*frames.coded.columns, "first", "triples"}


def test_ordinals_count_only_lines_with_an_order(spark, tmp_path):
    """Orders given twice count twice, lines without an order or customer not at all, as in the SQL."""
    spark.sql("SELECT CAST(a AS BIGINT) AS o_orderkey, CAST(b AS BIGINT) AS o_custkey, TIMESTAMP '1999-01-02' AS o_orderdate FROM VALUES (1, 1), (2, 9), (3, 1), (3, 2), (5, 2) AS t(a, b)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT CAST(a AS BIGINT) AS c_custkey, 3 AS c_nationkey FROM VALUES (1), (2) AS t(a)").write.parquet(f"{tmp_path}/customer.parquet")
    line = "CAST(a AS BIGINT) AS l_orderkey, b AS l_linenumber, CAST(7 AS BIGINT) AS l_partkey, CAST(8 AS BIGINT) AS l_suppkey, 1D AS l_quantity, 1D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, 'R' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1999-01-02' AS l_shipdate"
    spark.sql(f"SELECT {line} FROM VALUES (1, 2), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (NULL, 1) AS t(a, b)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [(r.ordinal, r.l_orderkey, r.l_linenumber) for r in runtime.Frames(spark, str(tmp_path)).coded.orderBy("ordinal").collect()]
    assert got == [(1, 1, 1), (2, 1, 2), (3, 3, 1), (4, 3, 1), (5, 5, 1)]


def test_searches_walk_together(spark, counted, monkeypatch):
    monkeypatch.setattr(graph, "BITS", 5)
    draw = random.Random(9)
    names = [f"n{i}" for i in range(50)]
    pairs = sorted({(draw.choice(names), draw.choice(names)) for _ in range(60)})
    edges = spark.createDataFrame(pairs, "src string, dst string")
    starts = spark.createDataFrame([(n,) for n in names[:23]], "start string")
    slow = graph.bounded_search(edges, starts, 3, stored)
    want = {(r.start, r.node): r.distance for r in slow.collect()}
    found = graph.reach(edges, starts.union(starts), 3, counted).collect()
    assert len(found) == len(want) and {(r.start, r.node): r.distance for r in found} == want


def test_names_stay_out_of_the_driver(spark, monkeypatch):
    """Betweenness and communities take numbers of the graph at most."""
    from pyspark.sql import DataFrame

    seen = []
    for method in ("collect", "toPandas", "toArrow"):
        monkeypatch.setattr(type(spark.range(1)), method, lambda df, real=getattr(type(spark.range(1)), method): (seen.append(df.dtypes), real(df))[1])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    made = [graph.betweenness(edges, 2), graph.betweenness(edges, 2, of_edges=True), graph.communities(edges), graph.communities(edges, True)]
    assert all(isinstance(df, DataFrame) for df in made) and seen
    assert not any(t == "string" for types in seen for _, t in types)


def test_json_is_compressed(spark, tmp_path):
    import glob
    import os

    from ripplegraph.sources import readers, sinks

    rows = spark.range(20_000).select(F.col("id").alias("ordinal"), F.lit("HeatStress1").alias("start_node"), F.lit("causes").alias("relationship"), F.lit("CropYield1").alias("end_node"))
    sinks.write_json(rows, f"{tmp_path}/json")
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/json/part*"))) < 20_000 * 20
    assert readers.read_triples(spark, f"{tmp_path}/json", extra="ordinal long").agg(F.count_distinct("ordinal")).first()[0] == 20_000


def test_a_round_of_ranks_deals_nodes_not_edges(spark, counted):
    """Ranks of 400 edges from 4 nodes: stored are 4 lists, the nodes, and the nodes of each round."""
    edges = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(4) for j in range(100)], "src string, dst string")
    graph.pagerank(edges, counted, 3, None).collect()
    assert counted.rows == 4 + 104 + 3 * 104


def test_distances_of_pairs_are_found_without_whole_searches(spark, counted, monkeypatch):
    monkeypatch.setattr(graph, "BITS", 3)
    draw = random.Random(11)
    names = [f"n{i}" for i in range(80)]
    arcs = sorted({(draw.choice(names), draw.choice(names)) for _ in range(75)})
    edges = spark.createDataFrame(arcs, "src string, dst string")
    pairs = sorted({(draw.choice(names), draw.choice([*names, "far"])) for _ in range(150)} | {(names[3], names[3])})
    whole = graph.bounded_search(edges, spark.createDataFrame([(n,) for n in names], "start string"), 4, stored)
    inside = {n for a, b in arcs if a != b for n in (a, b)}
    want = {(r.start, r.node): r.distance for r in whole.collect() if r.start in inside}
    found = graph.distances(edges, spark.createDataFrame(pairs, "a string, b string"), 4, counted).collect()
    got = {(r.a, r.b): r.distance for r in found}
    assert len(found) == len(got) and got == {p: want[p] for p in pairs if p in want}
    hub = spark.createDataFrame([("hub", f"x{i}") for i in range(2000)] + [("hub", "y"), ("x0", "z")], "src string, dst string")
    counted.rows = 0
    asked = spark.createDataFrame([(f"x{i}", "hub") for i in range(1000)] + [("y", "z")], "a string, b string")
    assert {r.distance for r in graph.distances(hub, asked, 4, counted).collect()} == {1, 3}
    assert counted.rows < 20_000  # 1,000 searches from each start would have two million rows
