"""Graph operators on small graphs with answers from textbooks and definitions."""

import itertools
import random

import pytest

from ripplegraph.operators import benchmark, graph, resolve, scores
from ripplegraph.plans.runtime import stored


def edges(spark, pairs):
    return spark.createDataFrame([(str(a), str(b), 1.0, "r", i) for i, (a, b) in enumerate(pairs)], "src string, dst string, cf double, rel string, ordinal long")


def rank_by_definition(pairs, rounds=200):
    names = sorted({str(x) for p in pairs for x in p})
    out = {n: [str(b) for a, b in pairs if str(a) == n] for n in names}
    pr = dict.fromkeys(names, 1 / len(names))
    for _ in range(rounds):
        lost = sum(pr[n] for n in names if not out[n])
        pr = {n: 0.15 / len(names) + 0.85 * (lost / len(names) + sum(pr[m] * out[m].count(n) / len(out[m]) for m in names if out[m])) for n in names}
    return pr


PATH, STAR, DIAMOND, CYCLE = [(1, 2), (2, 3), (3, 4)], [(0, 1), (0, 2), (0, 3)], [(1, 2), (1, 3), (2, 4), (3, 4)], [(1, 2), (2, 3), (3, 1)]


@pytest.mark.parametrize("pairs", [PATH, STAR, DIAMOND, CYCLE])
def test_pagerank(spark, pairs):
    found = {r.node: r.pr for r in graph.pagerank(edges(spark, pairs), stored).collect()}
    want = rank_by_definition(pairs)
    assert abs(sum(found.values()) - 1) < 1e-9
    assert all(abs(found[n] - want[n]) < 1e-5 for n in want)


def test_betweenness(spark):
    found = {r.node: r.bc for r in graph.betweenness(edges(spark, PATH), 2).collect()}
    assert found == pytest.approx({"1": 0, "2": 2 / 6, "3": 2 / 6, "4": 0})
    found = {r.node: r.bc for r in graph.betweenness(edges(spark, DIAMOND), 3).collect()}
    assert found == pytest.approx({"1": 0, "2": 0.5 / 6, "3": 0.5 / 6, "4": 0})
    of_edges = {(r.src, r.dst): r.bc for r in graph.betweenness(edges(spark, PATH), 2, of_edges=True).collect()}
    assert of_edges == pytest.approx({("1", "2"): 3 / 12, ("2", "3"): 4 / 12, ("3", "4"): 3 / 12})


def test_components_and_search(spark):
    pairs = [(1, 2), (3, 2), (5, 6), (6, 7), (7, 7), (8, 7)]
    found = {r.node: r.component for r in graph.components(edges(spark, pairs), stored).collect()}
    assert found == {"1": "1", "2": "1", "3": "1", "5": "5", "6": "5", "7": "5", "8": "5"}
    starts = spark.createDataFrame([("1",), ("5",), ("5",)], "start string")
    reach = {(r.start, r.node): r.distance for r in graph.bounded_search(edges(spark, pairs), starts, 2, stored).collect()}
    assert reach == {("1", "1"): 0, ("1", "2"): 1, ("1", "3"): 2, ("5", "5"): 0, ("5", "6"): 1, ("5", "7"): 2}


@pytest.mark.parametrize("local_moves", [False, True])
def test_two_cliques(spark, local_moves):
    pairs = [*itertools.combinations("abcd", 2), *itertools.combinations("wxyz", 2), ("d", "w")]
    found = {r.node: r.community for r in graph.communities(edges(spark, pairs), local_moves).collect()}
    assert {frozenset(n for n in found if found[n] == c) for c in set(found.values())} == {frozenset("abcd"), frozenset("wxyz")}
    m = graph.modularity(edges(spark, pairs), graph.communities(edges(spark, pairs))).first()
    assert (m.n_edges, m.intra, m.inter) == (13, 12, 1) and m.modularity == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2)


def test_mined_paths_are_those_of_a_breadth_first_search(spark):
    draw = random.Random(4)
    names = [f"n{i}" for i in range(14)]
    layer = {n: draw.choice(["physical", "social", "economic"]) for n in names[:-2]}
    pairs = list(dict.fromkeys((draw.choice(names), draw.choice(names)) for _ in range(45)))
    pairs = [p for p in pairs if p[0] != p[1]]
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, first long")
    layers = spark.createDataFrame(list(layer.items()), "node string, layer string")
    for cap in (1, 7, 1000):
        got = {(r.source, tuple(r.nodes)) for r in graph.mine_paths(rows, layers, stored, longest=4, cap=cap).collect()}
        want = set()
        for source in layer:
            queue, n = [[source]], 0
            while queue and n < cap:
                path = queue.pop(0)
                if len(path) > 2 and len({layer.get(x) for x in path} - {None}) > 1:
                    want.add((source, tuple(path)))
                    n += 1
                if len(path) < 5:
                    queue += [path + [b] for a, b in pairs if a == path[-1] and b not in path]
        assert got == want


def test_greedy_merge_is_the_sequential_one(spark):
    for seed in range(4):
        draw = random.Random(seed)
        arcs = sorted({(draw.randrange(40), draw.randrange(40)) for _ in range(90)})
        owner: dict[int, int] = {}
        passed: set[int] = set()
        for i in range(40):
            if i in passed:
                continue
            passed.add(i)
            mine = [b for a, b in arcs if a == i and b not in passed]
            passed.update(mine)
            if mine:
                owner.update(dict.fromkeys([i, *mine], i))
        near = spark.createDataFrame([(a, b, 0.9) for a, b in arcs], "src long, dst long, sim double")
        got = {r.entity: r.canonical for r in resolve.greedy_merge(near, 0.2, stored).collect()}
        assert got == owner


def test_null_walks_follow_edges_or_jump(spark):
    import numpy as np

    adjacency = graph.Adjacency(3, np.array([0, 1]), np.array([1, 2]))
    model = scores.Null(["a", "b", "c"], adjacency, (np.array([1, 5]), np.array([3.0, 3.0])), np.array([1.0, 2.0, 1.0]), np.array([0, 1, 1]), np.array([0.1, 0.2, 0.3]), (2.0, 0.5))
    walks = model.walk(np.arange(500), np.zeros(500, np.int64), 4)
    assert all(b == a + 1 for w in walks for a, b in zip(w, w[1:]) if a < 2)
    assert set(walks[:, 0]) == {0, 1, 2} and ((model.score(walks) >= 0) & (model.score(walks) <= 1)).all()
    assert (walks == model.walk(np.arange(500), np.zeros(500, np.int64), 4)).all()


def test_distractors_keep_apart(spark):
    cands = spark.createDataFrame([("q", [a, b]) for a, b in itertools.permutations("uvwxyz", 2)], "path_id string, seq array<string>")
    picked = benchmark.distractors(cands).first().seqs
    assert len(picked) == 3 and all(len(set(a) & set(b)) <= 1 for a, b in itertools.combinations(picked, 2))


def test_registered_permutations_reach_small_p_values(spark, monkeypatch):
    from types import SimpleNamespace

    import numpy as np

    from ripplegraph.plans import catalog_stats

    to = graph.Adjacency(2, np.array([0]), np.array([1]))
    null = scores.Null(["a", "b"], to, (np.array([1]), np.array([2.0])), np.array([1.0, 1.0]), np.array([0, 1]), np.array([0.1, 0.1]), (1.0, 0.5))
    monkeypatch.setattr(catalog_stats, "_null", lambda k: spark.sparkContext.broadcast(null))
    k = SimpleNamespace(spark=spark, scored=spark.createDataFrame([("never", 2.0), ("always", -1.0)], "path_id string, score double"), paths=spark.createDataFrame([("never", ["a", "b"], ["physical", "social"]), ("always", ["a", "b"], ["physical", "social"])], "path_id string, nodes array<string>, layers array<string>"))
    both = catalog_stats._permuted(k)
    assert {r.path_id: r.p for r in scores.per_path(both, catalog_stats.PERMS).collect()} == {"never": 1 / 10_001, "always": 1.0}
    assert scores.per_permutation(both).count() == 10_000
