"""Each stage on its own input, and the whole against the stages' brute-force versions."""

import random

import corpus_pipeline as cp
from tests.llm.test_language_id import SYLLABLES
from tests.llm.test_near_dedup import brute as all_pairs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, topic string"


def rows():
    draw = random.Random(12)
    out = []
    for i in range(300):
        lang = draw.choice(list(SYLLABLES))
        words = ["".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 5))) for _ in range(draw.randrange(30, 90))]
        if i % 6 == 0:
            words = [w.upper() + "!!|$" for w in words]
        out.append((i, " ".join(words), lang, draw.choice("st"), 0, "clash"))
    out += [(1000 + i, out[i][1], out[i][2], "s", 0, "clash") for i in range(0, 120)]
    out += [(2000, None, "aa", "s", 0, ""), (2001, "", None, None, None, None), (2002, "1234 !!", "aa", "s", 0, ""), (None, out[1][1], "aa", "s", 0, "")]
    return out


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_and_run(spark, tmp_path):
    folder = write(spark, str(tmp_path), rows(), [(i, int(i % 6 != 0), 0) for i in range(300)])
    docs = cp.table(spark, folder, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, folder), name)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert name == "encoding" or docs.columns == columns
        if name == "quality":
            before = docs.select("doc_id", "text").collect()
        if name == "mixing":
            texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert not {2000, 2001, 2002} & set(kept["language_id"]) and len(kept["language_id"]) > 400
    bad = [i for i in kept["quality"] if i is not None and i < 300 and i % 6 == 0]
    good = [i for i in range(300) if i % 6]
    assert len(bad) <= 1 and len(set(good) - set(kept["quality"])) <= 5
    want = sorted(i for i, _, c in all_pairs([(r.doc_id, r.text) for r in before], 5) if i == c and i is not None)
    assert sorted(i for i in kept["near_duplicates"] if i is not None) == want
    assert 0.6 * len(want) < len(kept["mixing"]) <= len(kept["near_duplicates"]) and set(kept["mixing"]) <= set(kept["near_duplicates"])
    out = cp.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(map(str, texts)) and all(r.lossless for r in out)


def test_empty_tables(spark, tmp_path):
    assert cp.run(spark, write(spark, str(tmp_path), [], [])).count() == 0
