import itertools
import random

import pytest

from ripplegraph.llm import near_dedup as nd


def brute(rows, words):
    """Components over all pairs of full shingle sets; rows that repeat an id are one node."""

    def shingles(text):
        t = (text or "").encode().lower().split()
        return {tuple(t[i : i + words]) for i in range(len(t) - words + 1)} if len(t) >= words else {tuple(t)} if t else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def found(spark, rows, words):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, comp string")
    out = nd.near_duplicates(docs, words=words).collect()
    assert all(r.kept == (r.component_id is None or r.component_id == r.doc_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def family(draw, n, size, edits):
    base = [draw.choice("abcdefghijklmnopqrstuvwxyz") + draw.choice("aeiou") + draw.choice("nrst") for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(edits + 1)):
            words[draw.randrange(size)] = draw.choice(["zz", "yy", "xx", "ww"]) + str(draw.randrange(9))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_same_as_all_pairs(spark, words):
    draw = random.Random(words)
    texts = [t for _ in range(12) for t in family(draw, 12, draw.choice([6, 30, 120]), 6)]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "One  two", "é É", "é é"] + [texts[0]] * 30
    rows = list(enumerate(draw.sample(texts, len(texts))))
    assert found(spark, rows, words) == brute(rows, words)


def test_chain_of_near_copies_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[:-k] + [f"v{k}{i}" for i in range(k)] if k else words) for k in range(0, 30, 3)]
    rows = [(100 - i, t) for i, t in enumerate(chain)] + [(5, "p q r s t u"), (5, chain[2]), (None, chain[1]), (4, "p q r s t u")]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_empty_table(spark):
    assert found(spark, [], 2) == []


def test_very_long_texts(spark):
    draw = random.Random(3)
    long = [f"w{draw.randrange(5000)}" for _ in range(200_000)]
    other = long[:100_000] + [f"v{i}" for i in range(100_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long + ["end"])), (3, " ".join(other)), (4, "x" * 2_000_000)]
    assert [(i, c) for i, _, c in found(spark, rows, 5)] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_members_apart_from_their_centre(spark):
    """All links of a bucket across components, from few pairs where members lack the same part of the centre."""
    draw = random.Random(8)
    centre = frozenset(range(100))
    sets = {0: centre}
    for near in range(1, 60):
        sets[near] = centre - {draw.randrange(100) for _ in range(6)} | {draw.randrange(100, 130) for _ in range(6)}
    for family in range(60):
        kept = {i for i in centre if draw.random() > 0.1}
        base = kept | {1000 + 100 * (family % 40) + i for i in range(draw.randrange(8, 30))}
        for _ in range(3):
            i = len(sets)
            sets[i] = frozenset(base - {draw.randrange(100) for _ in range(4)} | {draw.randrange(100, 130) for _ in range(draw.randrange(6))})
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    comp = {i: 0 if linked(centre, s) else i for i, s in sets.items()}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    buckets = spark.createDataFrame([(i, 0, len(sets)) for i in sets], "id long, centre long, members long")
    stars = spark.createDataFrame([(i, 0) for i, c in comp.items() if c == 0], "id long, comp long")
    met = {tuple(r) for r in nd._apart(buckets, stars, rows).collect()}
    wanted = {(a, b) for a, b in itertools.combinations(sets, 2) if comp[a] != comp[b] and linked(sets[a], sets[b])}
    assert wanted and wanted <= met and all(comp[a] != comp[b] for a, b in met)
    assert len(met) < len(sets) * len(sets) / 20


def test_group_of_members_that_lack_the_same_words(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        kept = [w for w in words if draw.random() > 0.04]
        for _ in range(draw.randrange(1, 8)):
            kept[draw.randrange(len(kept))] = f"v{draw.randrange(40)}"
        texts.append(" ".join(kept))
    rows = list(enumerate(texts))
    assert found(spark, rows, 2) == brute(rows, 2)
