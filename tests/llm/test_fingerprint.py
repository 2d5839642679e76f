import hashlib
import random

from ripplegraph.llm import fingerprint as fp


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(1, 9))) for _ in range(n))


def test_equal_substrings_keep_their_names():
    draw = random.Random(1)
    a, b = words(draw, 400), words(draw, 400)
    moved = words(draw, 3) + " " + a
    own, shifted, other = fp.fingerprints([a, moved, b])
    assert fp.likeness(own, shifted) > 0.9
    assert fp.likeness(own, other) < 0.1
    assert fp.likeness(own, fp.fingerprints([a])[0]) == 1


def test_neighbours_in_a_chunk_have_no_influence():
    draw = random.Random(2)
    texts = ["", "a", "aaaaaaa", "ab", "ß" * 3 + "x"] + [words(draw, draw.randrange(1, 60)) for _ in range(80)]
    together = fp.fingerprints(texts)
    assert all((x == fp.fingerprints([t])[0]).all() and len(x) == len(fp.fingerprints([t])[0]) for t, x in zip(texts, together))


def test_query_against_a_sorted_list(spark):
    draw = random.Random(3)
    rows = [(i * 7 % 1000 + 5, words(draw, draw.randrange(0, 40))) for i in range(500)]
    rows += [(2, None), (3, ""), (3, "zz"), (3, "abcd"), (None, "first of all"), (4, "é" * 9)]
    out = fp.compare_with_next(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, k string").repartition(7)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        e = fp.edited(t, n)
        a, b, c = fp.fingerprints([t, e, n])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_text(a), fp.as_text(b), fp.likeness(a, b), fp.likeness(a, c)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_one_row_and_none(spark):
    one = fp.compare_with_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    assert fp.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def symbol_by_symbol(text):
    """The parsing said once more, one symbol at a time in Python's integers."""
    every = (1 << 64) - 1

    def scatter(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & every
        x = (x ^ x >> 27) * 0x94D049BB133111EB & every
        return x ^ x >> 31

    def toss(before, now):
        place = ((before ^ now) & -(before ^ now)).bit_length() - 1
        return 2 * place + (now >> place & 1)

    def phrases(symbols):
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        symbols = [s if n == 1 else scatter(s * int(fp._PLACE) + n * int(fp._RUN) & every) for s, n in runs]
        labels = symbols
        for _ in range(3):
            labels = [toss(labels[i - 1] if i else labels[0] ^ 1, x) for i, x in enumerate(labels)]
        cuts = [0] + [i for i in range(1, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]] + [len(labels)]
        return [scatter(sum((x + 1) * int(fp._FACTORS[k]) for k, x in enumerate(symbols[a:b])) & every) for a, b in zip(cuts, cuts[1:])]

    names, found = [ord(c) for c in text], set()
    for level in range(1, fp.LAST_LEVEL + 1):
        names = phrases(names) if names else []
        if level >= fp.FIRST_LEVEL:
            found |= {scatter(n + level) >> 32 for n in names}
    return sorted(found)[: fp.KEPT]


def test_same_as_symbol_by_symbol():
    draw = random.Random(8)
    texts = ["", "a", "aa", "aaaaaaa", "abab" * 20, "😀é\n" * 7] + [words(draw, draw.randrange(1, 300)) for _ in range(40)]
    texts += ["".join(draw.choice("ab") * draw.randrange(1, 6) for _ in range(200)) for _ in range(10)]
    for text, got in zip(texts, fp.fingerprints(texts)):
        assert got.tolist() == symbol_by_symbol(text)


def test_very_long_texts(spark):
    draw = random.Random(5)
    text = words(draw, 150_000)
    out = fp.compare_with_next(spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_chars for r in out] == [len(text), len(text), 5]
    assert out[0].near_next == 1 and out[0].fingerprint == out[1].fingerprint and out[1].near_next < 0.1
