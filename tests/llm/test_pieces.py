import collections
import math

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplegraph.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SAMPLER = pieces.Sampler(PATH)


def all_ways(word):
    """Every segmentation of a word with its weight."""
    form = pieces.SPACE + word
    if not form:
        return {}

    def ways(at):
        if at == len(form):
            yield (), 1.0
        for end in range(at + 1, len(form) + 1):
            if form[at:end] in SAMPLER.weight:
                for rest, w in ways(end):
                    yield (SAMPLER.id[form[at:end]], *rest), w * SAMPLER.weight[form[at:end]]

    return dict(ways(0))


def test_draws_follow_the_weights_of_all_segmentations():
    want = all_ways("there")
    total, n = sum(want.values()), 20_000
    seen = collections.Counter(tuple(x.tolist()) for x in SAMPLER.sample(list(range(n)), ["there"] * n))
    assert set(seen) <= set(want)
    for way, w in want.items():
        p = w / total
        assert abs(seen[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="ab \n▁字😀", max_size=20), max_size=4))
def test_lossless_and_the_same_beside_other_rows(texts):
    found = SAMPLER.sample(list(range(len(texts))), texts)
    assert [SAMPLER.decode(x.tolist()) for x in found] == texts
    for i, t in enumerate(texts):
        assert pieces.Sampler.sample(SAMPLER, [i], [t])[0].tolist() == found[i].tolist()


def test_very_long_words():
    text = "the" * 30_000 + " " + "字" * 3000
    assert SAMPLER.decode(SAMPLER.sample([3], [text])[0].tolist()) == text


def test_query(spark):
    rows = [(1, "Of the and", 0), (1, "Of the and", 0), (2, None, 0), (3, "", 0), (None, "no id", 0)]
    out = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    assert len(out) == 5 and all(r.lossless and r.n_pieces == len(r.ids) for r in out)
    twice = [r.ids for r in out if r.doc_id == 1]
    assert twice[0] == twice[1]
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
