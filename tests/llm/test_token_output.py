import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ripplegraph.llm import token_output as out

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = out.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abeÉß字 \n\t.'!1 　")), max_size=30), max_size=5))
def test_same_ids_as_the_library(texts):
    want = [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, np.uint16).tobytes() for t in texts]
    assert ENCODER.encode(texts) == want


def test_special_tokens_as_the_library_has_them():
    text = "a <|endoftext|> b<|endoftext|>"
    assert ENCODER.encode([text, None]) == [np.array(LIBRARY.encode(text, add_special_tokens=False).ids, np.uint16).tobytes(), b""]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_numbers_come_back(numbers):
    assert out.unpack(*out.pack(np.array(numbers, np.uint32)), len(numbers)).tolist() == numbers


def test_files_of_all_documents(spark):
    texts = ["", None, "Is the of  and\n to", "x" * 3000, "the and " * 400] + [f"word{i} the other é{i}" for i in range(300)]
    rows = [(i * 37 % 1009 - 20, t, "z") for i, t in enumerate(texts)] + [(None, "no id", "z"), (-20, "same id", "z")]
    files, digest = out.write_and_read(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5), PATH)
    got = {(r.doc_id, r.n_tokens, r.ids_crc32): r.start for r in digest.collect()}
    at, want = 0, {}
    ids_of = lambda t: np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [out.END_ID], "<u4")
    for i, t, _ in sorted(rows, key=lambda r: (-99 if r[0] is None else r[0], ids_of(r[1]).astype("<u2").tobytes())):
        want[i, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())] = at
        at += len(ids_of(t))
    assert got == want
    assert files.count() >= 1


def test_empty_table(spark):
    assert out.write_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH)[1].count() == 0
