"""Very long texts and columns with clashing names in every stage of the pipeline."""

import random

import corpus_pipeline
from ripplegraph.llm import licenses, mixing

NAMES = ["__source", "__topic", "__place", "__mixing", "comp", "id", "n", "key", "a", "b", "score", "rejected", "keep", "probability", "sketch", "x"]


def table(draw):
    vocabulary = {"en": ["river", "stone", "walking", "light", "garden", "table"], "de": ["straße", "fluss", "gehen", "licht", "garten", "tisch"]}
    rows = []
    for i in range(60):
        lang = draw.choice(["en", "de"])
        n = 60_000 if i == 7 else draw.randrange(30, 90)
        rows.append((i, " ".join(draw.choice(vocabulary[lang]) + draw.choice(["", "s", "en"]) for _ in range(n)), lang, f"src{i % 3}", n))
    return rows


def test_stages_with_clashing_columns_and_a_very_long_text(spark, tmp_path):
    rows = table(random.Random(1))
    docs = spark.createDataFrame([(*r, *[str(r[0])] * len(NAMES)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = {r.doc_id: r for r in out.collect()}
        assert all(r["__topic"] == str(i) and r.text == rows[i][1] for i, r in got.items()), name
        assert name == "mixing" or 7 in got, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("doc_id = 7").first()
    assert last.lossless and last.n_pieces == len(last.ids) > 60_000


def test_long_text_is_mixed_whole(spark):
    words = ["seventh"] * 3 + ["another"] * 100_000
    row = mixing.cells_of(spark.createDataFrame([(1, " ".join(words), "s", "en")], "doc_id long, text string, source string, lang string")).first()
    assert row.n_tokens == 100_003 and row.topic == mixing.topic(["another"])


def test_license_far_inside_a_long_text(spark):
    name, template = licenses.TEMPLATES[0]
    text = " ".join(f"w{i}" for i in range(60_000)) + " " + template
    found = licenses.scan(spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, license string")).collect()
    assert {r.doc_id for r in found} == {1}
