import random

import numpy as np

from ripplegraph.llm import quality

SCHEMA = "doc_id long, text string, score double"


def texts(n=600):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        words = [draw.choice(["river", "stone", "walked", "slowly", "toward", "light", "quiet", "Garden,"]) for _ in range(draw.randrange(20, 80))]
        if not good:
            words = [w.upper() + draw.choice(["!!!", "|", "$$", "99"]) for w in words]
        rows.append((i, " ".join(words), 0.0))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = texts()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.id: r for r in quality.judge(docs, marks, only=lambda c: c % 5 != 0).collect()}
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if i % 5 == 0]
    assert sum(out[i].keep == bool(truth[i]) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= quality.KEEP_SCORE) for r in out.values())
    kept = {r.doc_id for r in quality.good(docs, marks).collect()}
    assert sum((i in kept) == bool(q) for i, q in truth.items()) / len(truth) > 0.97


def test_weights_have_the_smallest_loss():
    draw = np.random.default_rng(1)
    better, worse = draw.normal(0.5, 1, (400, 3)), draw.normal(0, 1, (400, 3))
    w = quality.learn(better, worse, pairs=5000)
    pick = np.random.default_rng(7)
    d = better[pick.integers(400, size=5000)] - worse[pick.integers(400, size=5000)]
    loss = lambda v: np.log1p(np.exp(-d @ v)).mean() + quality.RIDGE * v @ v / 2
    assert all(loss(w) <= loss(w + s) for s in draw.normal(0, 0.05, (50, 3)))


def test_nulls_repeats_and_missing_labels(spark):
    rows = [(1, None, 0.0), (2, "", 0.0), (2, "twice", 0.0), (None, "no id", 0.0), (3, "x" * 50_000, 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, none).collect()
    assert len(out) == 5 and all(r.keep for r in out)
    assert quality.good(docs, none).count() == 5
    only_bad = spark.createDataFrame([(1, 0, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert not any(r.keep for r in quality.judge(docs, only_bad).collect())
    assert quality.judge(docs.limit(0), none).count() == 0


def plain_features(text):
    """The features by their definitions, character by character."""
    words = (text or "").split()
    if not words:
        return [0.0] * 16
    dark = [c for c in text if ord(c) < 65536 and not c.isspace()] + [c for c in text if ord(c) >= 65536]
    low = [c for c in dark if ord(c) < 65536]
    upper, lower = sum(c.isupper() for c in low), sum(c.isalpha() and not c.isupper() for c in low)
    digit, mark = sum(c.isdigit() and not c.isalpha() and not c.isupper() for c in low), sum(c in ".,;:'\"()-" for c in low)
    symbol = sum(33 <= ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"()-" for c in low)
    seen, n, lines = max(1, len(dark)), len(words), [x for x in text.split("\n") if x]
    distinct, lengths = len(set(words)) / n, [len(w) for w in words]
    return [
        upper / max(1, upper + lower), digit / seen, symbol / seen, mark / seen, text.count("|") / n, text.count("!") / n,
        distinct if n < 40 else distinct**0.5, max(map(words.count, set(words))) / n if n > 4 else 0.2,
        sum(words[i] == words[i + 1] for i in range(n - 1)) / n, min(sum(lengths) / n, 20) / 10, 1 - len(set(lines)) / max(1, len(lines)),
        np.log(1 + n) / 10, sum(w[-1] in "#$%&*|!^~" for w in words) / n, max(1, upper + lower) / seen, sum(x > 20 for x in lengths) / n,
        sum(x.count("|") > 1 or x.isupper() for x in lines) / max(1, len(lines)),
    ]


def test_features_by_definition():
    draw = random.Random(6)
    made = ["".join(draw.choice("aB9é \n|!.,$ß字😀\t-") for _ in range(draw.randrange(0, 300))) for _ in range(200)] + ["x" * 50_000, None, ""]
    for text in made:
        assert np.allclose(quality.features(text), plain_features(text))


def test_scores_by_definition(spark):
    """The whole judgement from plain features: pairs, weights, the quantile of the strengths and the score."""
    rows, labels = texts(300)
    out = {r.id: r.score for r in quality.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    x = {i: plain_features(t) for i, t, _ in rows}
    side = lambda q: np.array([v for _, v in sorted((i, x[i]) for i, label, _ in labels if label == q)])
    w = quality.learn(side(1), side(0))
    strength = {i: float(np.dot(w, v)) for i, v in x.items()}
    ordered, bad = sorted(strength.values()), sum(q == 0 for _, q, _ in labels)
    threshold = (ordered[bad - 1] + ordered[bad]) / 2
    for i, score in out.items():
        want = 1 / (1 + np.exp(-np.clip(strength[i] - threshold + np.log(0.3 / 0.7), -40, 40)))
        assert abs(score - want) < 1e-6


def test_ties_at_the_threshold_are_kept(spark):
    docs = spark.createDataFrame([(i, "same text of all", 0.0) for i in range(20)], SCHEMA)
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, marks).collect()
    assert len({r.score for r in out}) == 1 and all(r.keep for r in out)
