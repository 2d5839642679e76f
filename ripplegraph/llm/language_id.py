"""Language identification by compression.

Every language gets raw-content zstandard dictionaries made of text that is known
to be in it. A text is compressed once with each; the language whose dictionaries
give the fewest bytes wins. A near draw is a rejection.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, release, slices, table

#: Bound of the fit: documents sampled per language, each taken whole.
SAMPLE_DOCS = 160
#: Texts are compressed in pieces of so many bytes, so that a long text is measured against the dictionary and not against itself.
PIECE_BYTES = 4096
#: Of a text of fewer characters the sizes are means over so many turns of its words, as whole bytes are coarse there.
SHORT, TURNS = 300, 8
#: A text whose second-best language needs less than this share more bytes is rejected.
MIN_MARGIN = 0.01
UNKNOWN = "und"


def _letters() -> re.Pattern:
    """What separates words: all but letters (category L) and the marks on them (M)."""
    ranges, start = [], None
    for code in range(sys.maxunicode + 2):
        good = code <= sys.maxunicode and unicodedata.category(chr(code))[0] in "LM"
        if good and start is None:
            start = code
        elif not good and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return re.compile(f"[^{''.join(ranges)}]+")


_NOT_LETTERS = _letters()


def normal_form(text: str | None) -> str:
    """Lower-case words joined by one space, a word that repeats at once kept once;
    empty if there is no letter (a number such as a fraction or a circled digit is none)."""
    words = _NOT_LETTERS.sub(" ", text.lower()).split() if text else []
    words = words if any(w[0].isalpha() or any(map(str.isalpha, w)) for w in words) else []
    return " ".join(words[:1] + [w for w, before in zip(words[1:], words) if w != before])


class Model:
    """Dictionaries by language, and the sizes they give."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.dictionaries, self.level = dict(sorted(dictionaries.items())), level
        self._ready = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "level": self.level, "_ready": None}

    def compressors(self):
        if self._ready is None:
            made = []
            for content in self.dictionaries.values():
                as_dict = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                reach = max(17, (len(content) + PIECE_BYTES).bit_length())  # all of the dictionary stays in the window
                how = zstandard.ZstdCompressionParameters.from_level(
                    self.level, dict_size=len(content), window_log=reach, hash_log=reach, chain_log=reach, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                as_dict.precompute_compress(compression_params=how)
                made.append(zstandard.ZstdCompressor(dict_data=as_dict, compression_params=how))
            self._ready = made
        return self._ready

    def sizes(self, text: str | None) -> np.ndarray | None:
        """Compressed bytes by language, or None if the text has no letter."""
        form = normal_form(text)
        if not form:
            return None
        out = np.zeros(len(self.dictionaries))
        if len(form) < SHORT:
            words = form.split(" ")
            turns = [" ".join(words[i:] + words[:i]) for i in range(0, len(words), -(-len(words) // TURNS))]
            return out + np.mean([[len(c.compress(f" {t} ".encode("utf-8", "replace"))) for c in self.compressors()] for t in turns], 0)
        raw = f" {form} ".encode("utf-8", "replace")
        for at in range(0, len(raw), PIECE_BYTES):
            piece = raw[at : at + PIECE_BYTES]
            out += [len(c.compress(piece)) for c in self.compressors()]
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether the margin is too narrow."""
        sizes = self.sizes(text) if self.dictionaries else None
        if sizes is None:
            return UNKNOWN, 0.0, True
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return next(iter(self.dictionaries)), 1.0, False
        second = np.partition(sizes, 1)[1]
        margin = (second - sizes[best]) / second
        odds = np.exp2(np.clip(sizes[best] - sizes, -60, 0)).sum()
        return list(self.dictionaries)[best], float(1 / odds), bool(margin < MIN_MARGIN)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", only=None) -> Model:
    """Learn from a bounded sample of the rows that have a language.

    Per language about SAMPLE_DOCS documents, chosen by a hash of the id, give their
    whole texts, equal ones once; counts come from all rows.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    if only is not None:
        known = known.where(only(F.col("id")))
    known = known.where("id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SAMPLE_DOCS / n))])
    rows = (
        known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * F.lit(1 << 30))
        .select("lang", F.xxhash64("id", F.lit("order")).alias("o"), "text")
        .collect()
    )
    parts: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sorted(rows, key=lambda r: (r["o"], r["text"])):
        if form := normal_form(r["text"]):
            parts[r["lang"]].append(form)
    return Model({lang: f" {' '.join(dict.fromkeys(forms))} ".encode("utf-8", "replace") for lang, forms in parts.items() if forms})


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row.

    A null or letterless text, and every text where nothing was learned, is `und`
    with score 0 and rejected. Repeated rows each get their row; ties between
    languages go to the first by name and are rejected. Null ids are kept. A very long text
    is measured whole, piece by piece. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [held.value.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([not held.value.predict(t)[2] for t in part.column(at).to_pylist()], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, only=lambda c: F.crc32(c.cast("string")) % 3 != 1)
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
