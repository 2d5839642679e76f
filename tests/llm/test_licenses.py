import random

from ripplegraph.llm import licenses


def test_anchors_lose_nothing():
    chosen = set(licenses.anchors(licenses.TEMPLATES))
    for _, text in licenses.TEMPLATES:
        w = licenses.words_of(text)
        shingles = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        assert sum(not chosen & set(s) for s in shingles) < licenses.CONTAINED * len(shingles)


def brute(rows):
    out = {}
    for doc, text in {(d, t) for d, t in rows if t}:
        words = licenses.words_of(text)
        for name, template in licenses.TEMPLATES:
            t = licenses.words_of(template)
            own = {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
            n = len(t)
            for start in range(0, max(1, len(words)), n):
                held = {tuple(words[i : i + 3]) for i in range(start, min(start + 2 * n, len(words) - 2))} & own
                if len(held) / len(own) >= licenses.CONTAINED:
                    best, count, first = out.get((doc, name), (0, 0, start))
                    out[doc, name] = max(best, len(held) / len(own)), count + 1, min(first, start)
    return out


def test_same_as_every_window(spark):
    draw = random.Random(6)
    rows = [(0, None), (1, ""), (2, "the MIT"), (None, "x Released under the MIT License. y"), (3, "Released under the\nMIT\tlicense")]
    for i in range(4, 120):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            parts += [draw.choice(["of", "the", "license", "under", "mit", "public", "foo"]) for _ in range(draw.randrange(0, 40))]
            words = licenses.words_of(draw.choice(licenses.TEMPLATES)[1])
            if draw.random() < 0.5:
                words[draw.randrange(len(words))] = "changed"
            parts += words
        rows.append((i, " ".join(parts)))
    rows += rows[:6] + [(5, "Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame([(i, t, "MIT") for i, t in rows], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): (r.containment, r.n_windows, r.first_word) for r in licenses.scan(docs).collect()}
    assert got == brute(rows)
    assert licenses.scan(docs.limit(0)).count() == 0
