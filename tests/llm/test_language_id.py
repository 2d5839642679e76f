import random

from ripplegraph.llm import language_id as lid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ne"], "bb": ["sch", "ung", "ein", "der", "ich"], "cc": ["eau", "oui", "tre", "ment", "ç"]}
SCHEMA = "doc_id long, text string, lang string, score string"


def sample(n=240):
    draw = random.Random(8)
    rows = []
    for i in range(n):
        lang = draw.choice(list(SYLLABLES))
        words = ["".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 5))) for _ in range(draw.randrange(15, 120))]
        rows.append((i, " ".join(words), lang, "clash"))
    return rows


def test_held_out_documents(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lid.fit(docs, only=lambda c: c % 3 != 1)
    out = {r.doc_id: r for r in lid.identify(docs, model).collect()}
    held = [(i, lang) for i, _, lang, _ in rows if i % 3 == 1]
    assert sum(out[i].lang_pred == lang for i, lang in held) / len(held) > 0.98
    kept = lid.accepted(docs, model).collect()
    assert {r.doc_id for r in kept} == {i for i, r in out.items() if not r.rejected}
    assert len(kept) > 0.95 * len(rows)


def test_nulls_letterless_texts_and_ties(spark):
    docs = spark.createDataFrame([(1, None, "aa", ""), (2, "", None, ""), (3, "123 ... 45", "aa", ""), (None, "kalomi tune", None, ""), (4, "ka" * 60_000, "aa", ""), (4, "sch ein", "bb", "")], SCHEMA)
    model = lid.Model({"aa": b" kalo mitu nelo " * 20, "bb": b" schein derung ich " * 20})
    out = lid.identify(docs, model).collect()
    assert len(out) == 6
    assert [(r.lang_pred, r.score, r.rejected) for r in out[:3]] == [(lid.UNKNOWN, 0.0, True)] * 3
    assert out[3].lang_pred == "aa" and out[3].doc_id is None
    same = lid.Model({"aa": b" kalo mitu nelo " * 20, "bb": b" kalo mitu nelo " * 20})
    assert same.predict("kalo mitu") == ("aa", 0.5, True)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = lid.fit(none)
    assert lid.identify(none, model).count() == 0 and lid.accepted(none, model).count() == 0
    assert model.predict("anything")[0] == lid.UNKNOWN


def test_numbers_are_no_letters():
    model = lid.Model({"aa": b" kalo " * 20, "bb": b" schein " * 20})
    assert model.predict("½ ² ① Ⅷ ٣")[:2] == (lid.UNKNOWN, 0.0)
    assert lid.normal_form("Ab1c²d ab_é ñ̃") == "ab c d ab é ñ̃"


def test_whole_texts_are_learned(spark):
    """What only the end of long documents has is in the dictionary."""
    filler = {"aa": "ka lo mi ", "bb": "sch ung ein "}
    rows = [(i, filler[lang] * 3000 + f"{lang}zzquokka{i} {lang}wombat{i}", lang, "") for i, lang in enumerate(["aa", "bb"] * 6)]
    model = lid.fit(spark.createDataFrame(rows, SCHEMA))
    for i, lang in enumerate(["aa", "bb"] * 6):
        assert f"{lang}wombat".encode() in model.dictionaries[lang]
    assert model.predict("aawombat aazzquokka")[0] == "aa"


def test_all_of_a_large_dictionary_is_in_reach():
    draw = random.Random(3)
    content = " ".join("".join(draw.choices("abcdefghij", k=9)) for _ in range(300_000)).encode()
    compress = lid.Model({"aa": content}).compressors()[0].compress
    assert max(len(compress(content[a : a + 2000])) for a in (0, 1_500_000, 2_990_000)) < 60


def test_same_as_sizes_one_by_one(spark):
    """Predictions against compressing the whole form with each dictionary, without the operator's model."""
    import zstandard

    docs = spark.createDataFrame(sample(90), SCHEMA)
    model = lid.fit(docs)
    for r in lid.identify(docs, model).collect():
        text = next(t for i, t, _, _ in sample(90) if i == r.doc_id)
        form = f" {lid.normal_form(text)} "
        if len(form) < lid.SHORT + 2:
            continue
        sizes = {}
        for lang, content in model.dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(dict_data=d, level=3).compress(form.encode()))
        order = sorted(sizes, key=sizes.get)
        if sizes[order[1]] - sizes[order[0]] > 12:
            assert r.lang_pred == order[0]
