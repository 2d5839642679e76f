import random

import numpy as np

from ripplegraph.llm import mixing


def sample(n=1500):
    draw = random.Random(4)
    rows = []
    for i in range(n):
        words = [draw.choice(["short", "longerword", "another1", "sevenletters", "elsewhere"]) for _ in range(draw.randrange(0, 60))]
        rows.append((i, " ".join(words), draw.choice(["a", "a", "a", "b", None]), draw.choice(["en", "de"]), "clash"))
    return rows


SCHEMA = "doc_id long, text string, source string, lang string, weight string"


def brute(rows):
    """Raking by its definition, over a dict of cells."""
    cells = {}
    for _, text, source, lang, _ in rows:
        key = (source or mixing.NONE, lang, mixing.topic((text or "").lower().split()))
        cells[key] = cells.get(key, 0) + len((text or "").split())
    total = sum(cells.values())
    weight = dict.fromkeys(cells, 1.0)
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        share = {}
        for k, n in cells.items():
            share[k[d]] = share.get(k[d], 0) + n / total
        raised = {k: v ** mixing.TEMPER[name] for k, v in share.items() if v}
        goals.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(500):
        for d, goal in enumerate(goals):
            have = {}
            for k, n in cells.items():
                have[k[d]] = have.get(k[d], 0) + n * weight[k] / total
            for k in cells:
                weight[k] *= goal.get(k[d], 0) / have[k[d]] if have[k[d]] else 0
    return cells, weight, goals


def test_weights_meet_the_marginals_and_the_budget(spark):
    rows = sample()
    cells, weight, goals = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    for few in (mixing.DRIVER_CELLS, 0):
        mixing_rounds, mixing.ROUNDS = mixing.ROUNDS, 12 if not few else 200
        out = mixing.mix_to_targets(docs, driver_cells=few).collect()
        mixing.ROUNDS = mixing_rounds
        assert len(out) == len(rows)
        for r in out:
            if r.n_tokens:
                assert abs(r.weight / weight[r.source, r.lang, r.topic] - 1) < 1e-3
        got = sum(r.n_tokens * r.probability for r in out)
        assert abs(got / sum(cells.values()) - mixing.BUDGET) < 1e-6
        kept = sum(r.n_tokens for r in out if r.kept) / sum(cells.values())
        assert abs(kept - mixing.BUDGET) < 0.04
        if few:
            first = {r.doc_id: r.kept for r in out}
    assert sum(first[r.doc_id] != r.kept for r in out) <= 3


def test_given_targets():
    keys = [("a", "x", "t"), ("a", "y", "t"), ("b", "x", "t"), ("b", "y", "t")]
    tokens = np.array([10.0, 20, 30, 40])
    w = mixing.rake(keys, tokens, [{"a": 0.5, "b": 0.5}, {"x": 0.9, "y": 0.1}, {"t": 1}]) * tokens / tokens.sum()
    assert np.allclose([w[0] + w[1], w[0] + w[2]], [0.5, 0.9], atol=1e-5)


def test_edges(spark):
    assert mixing.mix_to_targets(spark.createDataFrame([], SCHEMA)).count() == 0
    out = mixing.mix_to_targets(spark.createDataFrame([(1, None, None, None, ""), (None, "", "s", "l", "")], SCHEMA)).collect()
    assert len(out) == 2 and all(r.kept and r.n_tokens == 0 for r in out)
